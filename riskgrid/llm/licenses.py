"""License scans: ordered signature rules, in DataFrame operations only.

Each rule has keywords, a regular expression, a label and a priority. A rule is tried on a text only if the text has all its
keywords: single words that every match holds, whatever stands between them; texts without any of a few words that each rule's
keywords hold one of aren't searched for the others. All matches become intervals; an interval inside another one of the same
or a better priority is suppressed (of equal ones the earlier rule stays). SIGNATURES are sentences of grants, conditions and
disclaimers, written out license by license; identifier tags, addresses, notices, names with versions, and bare names are
spelled out for each license of LICENSES.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.tables import table

# Fixed values of the base: phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
SEPARATOR, WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Confidence of a detection by priority: tag, address, notice or signature, name and version, bare name.
CONFIDENCE = (1.0, 1.0, 0.95, 0.8, 0.5)

#: License by license: label, keywords, pattern of the name, identifier, versions, address. Order decides between equals.
LICENSES = (
    ("agpl", "affero", r"(?:gnu )?affero (?:gnu )?general public licen[sc]e", "agpl", ("1.0", "3.0", "3"), r"gnu\.org/licenses/agpl"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", "lgpl", ("2.1", "3.0", "3"), r"gnu\.org/licenses/lgpl"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]e", "lgpl", ("2.0", "2"), r"gnu\.org/licenses/old-licenses/lgpl"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", "gpl", ("1.0", "2.0", "2", "3.0", "3"), r"gnu\.org/licenses/gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", "gfdl", ("1.1", "1.2", "1.3"), r"gnu\.org/licenses/fdl"),
    ("apache", "apache", r"apache(?: software)?(?: licen[sc]e)?", "apache", ("1.0", "1.1", "2.0", "2"), r"apache\.org/licenses"),
    ("mit", "mit licen", r"mit(?: expat)? licen[sc]e", "mit", (), r"opensource\.org/licenses/mit"),
    ("bsd", "bsd", r"(?:[234]-clause |new |simplified |modified )?bsd(?: licen[sc]e)?", "bsd", ("2-clause", "3-clause", "4-clause"), r"opensource\.org/licenses/bsd"),
    ("isc", "isc licen", r"isc licen[sc]e", "isc", (), r"opensource\.org/licenses/isc"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "mpl", ("1.0", "1.1", "2.0"), r"mozilla\.org/mpl"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "epl", ("1.0", "2.0"), r"eclipse\.org/legal/epl"),
    ("edl", "eclipse distribution", r"eclipse distribution licen[sc]e", "edl", ("1.0",), r"eclipse\.org/org/documents/edl"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", "cddl", ("1.0", "1.1"), r"opensource\.org/licenses/cddl"),
    ("cpl", "common public", r"common public licen[sc]e", "cpl", ("1.0",), r"opensource\.org/licenses/cpl"),
    ("artistic", "artistic", r"artistic licen[sc]e", "artistic", ("1.0", "2.0"), r"perlfoundation\.org/artistic"),
    ("boost", "boost", r"boost software licen[sc]e", "bsl", ("1.0",), r"boost\.org/license"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib", (), r"zlib\.net/zlib_license"),
    ("unlicense", "unlicense", r"unlicense", "unlicense", (), r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl", ("2",), r"wtfpl\.net"),
    ("eupl", "european union public", r"european union public licen[sc]e", "eupl", ("1.0", "1.1", "1.2"), r"joinup\.ec\.europa\.eu"),
    ("osl", "open software", r"open software licen[sc]e", "osl", ("1.0", "2.0", "2.1", "3.0"), r"opensource\.org/licenses/osl"),
    ("afl", "academic free", r"academic free licen[sc]e", "afl", ("1.1", "2.0", "2.1", "3.0"), r"opensource\.org/licenses/afl"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", "ofl", ("1.0", "1.1"), r"scripts\.sil\.org/ofl"),
    ("python", "python", r"python (?:software foundation )?licen[sc]e", "psf", ("2.0", "2"), r"docs\.python\.org/.{0,20}license"),
    ("ruby", "ruby", r"ruby licen[sc]e", "ruby", (), r"ruby-lang\.org/.{0,20}license"),
    ("php", "php", r"php licen[sc]e", "php", ("3.0", "3.01"), r"php\.net/license"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql", (), r"postgresql\.org/about/licen"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl", (), r"openssl\.org/source/license"),
    ("mspl", "microsoft public", r"microsoft public licen[sc]e", "ms-pl", (), r"opensource\.org/licenses/ms-pl"),
    ("msrl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", "ms-rl", (), r"opensource\.org/licenses/ms-rl"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", "upl", ("1.0",), r"opensource\.org/licenses/upl"),
    ("odbl", "open database", r"open database licen[sc]e", "odbl", ("1.0",), r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", "odc-by", ("1.0",), r"opendatacommons\.org/licenses/by"),
    ("pddl", "public domain dedication", r"public domain dedication(?: and licen[sc]e)?", "pddl", ("1.0",), r"opendatacommons\.org/licenses/pddl"),
    ("cc0", "cc0", r"cc0", "cc0", ("1.0",), r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-sa", "cc", r"cc[ -]by[ -]nc[ -]sa", "cc-by-nc-sa", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "cc", r"cc[ -]by[ -]nc[ -]nd", "cc-by-nc-nd", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc", "cc", r"cc[ -]by[ -]nc", "cc-by-nc", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-sa", "cc", r"cc[ -]by[ -]sa", "cc-by-sa", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", "cc", r"cc[ -]by[ -]nd", "cc-by-nd", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nd"),
    ("cc-by", "cc", r"cc[ -]by", "cc-by", ("2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by/"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution[ -]non-?commercial[ -]share-?alike", "", ("2.0", "3.0", "4.0"), ""),
    ("cc-by-nc", "creative commons", r"creative commons attribution[ -]non-?commercial", "", ("2.0", "3.0", "4.0"), ""),
    ("cc-by-sa", "creative commons", r"creative commons attribution[ -]share-?alike", "", ("2.0", "3.0", "4.0"), ""),
    ("cc-by", "creative commons", r"creative commons attribution", "", ("2.0", "3.0", "4.0"), ""),
    ("public-domain", "public domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain", "", (), ""),
    ("copyright", "copyright", r"copyright (?:\(c\) |© )?(?:19|20)[0-9]{2}", "", (), ""),
    ("reserved", "reserved", r"(?:all|some) rights reserved", "", (), ""),
    ("proprietary", "proprietary", r"proprietary and confidential", "", (), ""),
)


#: Sentences that tell a license, and its label. Anything but letters and digits may stand between the words.
SIGNATURES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("json", "the software shall be used for good not evil"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("bsd", "this software is provided by the author and contributors as is and any express or implied warranties"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "products derived from this software may not be called apache"),
    ("gpl-2.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", "under the terms of the gnu general public license version 2 only as published by the free software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.1-or-later", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("lgpl-2.0", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl-2.1", "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license"),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("agpl-3.0-or-later", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "the contents of this file are subject to the mozilla public license"),
    ("epl-1.0", "the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license"),
    ("edl-1.0", "made available under the terms of the eclipse distribution license v 1 0"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", "must be included in all copies of the software in whole or in part and all derivative works of the software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("wtfpl-2", "do what the fuck you want to public license"),
    ("beerware", "the beer ware license revision 42"),
    ("artistic-1.0", "the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("python-2.0", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("python-2.0", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("php-3.01", "this source file is subject to version 3 01 of the php license"),
    ("php", "this product includes php software freely available from"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this product includes cryptographic software written by eric young"),
    ("mspl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("upl-1.0", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("eupl", "this european union public license the eupl applies to the work"),
    ("osl", "this open software license the license applies to any original work of authorship"),
    ("afl", "this academic free license the license applies to any original work of authorship"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("odbl-1.0", "is made available under the open database license"),
    ("odc-by-1.0", "is made available under the open data commons attribution license"),
    ("pddl-1.0", "is made available under the public domain dedication and license"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd-4.0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa-4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd-4.0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", "the work as defined below is provided under the terms of this creative commons public license"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("w3c", "this work is being provided by the copyright holders under the following license"),
    ("zpl", "this software is subject to the provisions of the zope public license"),
    ("ijg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "portions of this software are copyright the freetype project"),
    ("bsl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl", "server side public license"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the commons clause license condition"),
    ("public-domain", "has been released into the public domain by its author"),
    ("public-domain", "the author disclaims copyright to this source code"),
    ("proprietary", "this software contains proprietary and confidential information"),
    ("proprietary", "no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
    ("proprietary", "reproduction in whole or in part without written permission is prohibited"),
    ("reserved", "all rights not expressly granted are reserved"),
)
#: Each rule's keywords hold one of these.
OPENERS = ("licen", "copyright", "reserved", "permi", "warrant", "redistribut", "public", "software", "spdx", "http", "cc", "bsd", "apache", "creative", "proprietary", "wtfpl")
_GAP = "[^0-9A-Za-z]{1,40}"


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: str
    label: str
    priority: int


def _bounded(pattern: str) -> str:
    return rf"(?i)(?<!{WORD}){pattern}(?!{WORD})"


def _signature(label: str, sentence: str) -> Rule:
    """Its keywords are the longest of its words, one with an opener among them. Both spellings of license match."""
    words = sorted({"sublicen" if w == "sublicense" else "licen" if w.startswith("license") else w for w in sentence.split()}, key=lambda w: (-len(w), w))
    opener = next(w for w in words if any(o in w for o in OPENERS))
    keyword = " ".join(dict.fromkeys([opener, *[w for w in words if w.isalpha()][:3]]))
    return Rule(keyword, _bounded(_GAP.join(sentence.split()).replace("license", "licen[sc]e")), label, 2)


@lru_cache
def rules() -> tuple[Rule, ...]:
    """In order; a license without versions has the rules that need none."""
    out = [_signature(*x) for x in SIGNATURES]
    for label, keyword, name, identifier, versions, address in LICENSES:
        spaced = re.sub(r" (?![^\[]*\])", r"[ \\n]+", name).replace("[ -]", r"[ \n-]")
        if "licen[sc]e" in re.sub(r"\(\?:[^()]*\)\?", "", name) and "licen" not in keyword:
            keyword += " licen"
        full = {v: f"{label}-{v}" for v in versions}
        for v, labelled in full.items():
            number = v.replace(".", r"\.")
            if identifier:
                out.append(Rule("spdx", _bounded(rf"spdx-license-identifier: ?{identifier}-{number}"), labelled, 0))
            out.append(Rule(keyword, _bounded(rf"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?{spaced}(?: licen[sc]e)?(?:,? (?:version|v)? ?|-){number}"), labelled, 2))
            out.append(Rule(keyword, _bounded(rf"{spaced}(?: licen[sc]e)?(?:,? ?(?:version|v\.?)? ?|-){number}"), labelled, 3))
        if identifier:
            out.append(Rule("spdx", _bounded(rf"spdx-license-identifier: ?{identifier}"), label, 0))
        if address:
            out.append(Rule("http", rf"(?i)https?://(?:www\.)?{address}", label, 1))
        out.append(Rule(keyword, _bounded(rf"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?{spaced}(?: licen[sc]e)?"), label, 2))
        out.append(Rule(keyword, _bounded(spaced), label, 4))
    return tuple(out)


def phrase_pattern(phrase: str) -> str:
    """The words of a base phrase, consecutive as words: whatever separates them."""
    return _bounded(rf"{SEPARATOR}+".join(phrase.split()))


def word_count(text: Column) -> Column:
    """Words of a text: each is replaced by one character, together with what separates it."""
    return F.when(text.rlike(WORD), F.length(F.regexp_replace(text, f"{SEPARATOR}*+{WORD}++{SEPARATOR}*+", "x"))).otherwise(0).cast("long")


def _base(text: Column, lowered: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Places of a phrase, and the words before the first and the last of them; null where there is none."""
    pattern = phrase_pattern(phrase)
    has = lowered.contains(phrase.split()[0])
    for word in phrase.split()[1:]:
        has &= lowered.contains(word)
    has &= text.rlike(pattern)
    places = F.when(has, F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("long")
    first = F.when(has, word_count(F.get(F.split(text, pattern, 2), F.lit(0))))
    last = F.when(has, word_count(F.regexp_extract(text, f"(?s)^(.*){pattern}", 1)))
    return places, first, last


def _literal(value: list, kind: str) -> Column:
    """A constant: the optimiser folds it once, and it takes one call to build."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _detections(text: Column, keywords: Column) -> Column:
    """All matches of the rules whose keywords are there: (start, negative length, priority, order, label), sorted."""
    listed = _literal([{"words": r.keyword.split(), "pattern": r.pattern, "label": r.label, "priority": r.priority, "order": i} for i, r in enumerate(rules())], "array<struct<words:array<string>,pattern:string,label:string,priority:int,order:int>>")
    tried = F.filter(listed, lambda r: (F.size(F.array_except(r["words"], keywords)) == 0) & F.rlike(text, r["pattern"]))

    def found(r: Column) -> Column:
        pieces = F.transform(F.split(text, r["pattern"], -1), F.length)
        matched = F.transform(F.regexp_extract_all(text, r["pattern"], F.lit(0)), F.length)
        spans = F.aggregate(
            F.arrays_zip(F.slice(pieces, 1, F.size(matched)).alias("before"), matched.alias("own")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans")),
            lambda a, x: F.struct((a["at"] + x["before"] + x["own"]).alias("at"), F.concat(a["spans"], F.array(F.struct((a["at"] + x["before"]).alias("start"), x["own"].alias("size")))).alias("spans")),
        )["spans"]
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["size"]).alias("minus"), r["priority"].alias("priority"), r["order"].alias("order"), r["label"].alias("label")))

    return F.array_sort(F.flatten(F.transform(tried, found)))


def _resolved(detections: Column) -> Column:
    """Labels and priorities that stay. In this order an interval comes after all that hold it, so the farthest end of each
    priority so far tells whether it is suppressed."""
    levels = len(CONFIDENCE)
    start = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), F.array().cast("array<struct<label:string,priority:int>>").alias("kept"))

    def step(state: Column, d: Column) -> Column:
        end = d["start"] - d["minus"]
        hidden = F.exists(F.slice(state["ends"], 1, d["priority"] + 1), lambda e: e >= end)
        ends = F.transform(state["ends"], lambda e, i: F.when(i == d["priority"], F.greatest(e, end)).otherwise(e))
        kept = F.array_union(state["kept"], F.array(F.struct(d["label"].alias("label"), d["priority"].alias("priority"))))
        return F.struct(F.when(hidden, state["ends"]).otherwise(ends).alias("ends"), F.when(hidden, state["kept"]).otherwise(kept).alias("kept"))

    return F.aggregate(detections, start, step)["kept"]


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    A null text counts as empty and has no word; a text may be of any length; rows that repeat are each scanned; equal
    detections count once in the labels, and of equal intervals of one priority the earlier rule's stays; an empty table gives
    an empty one; columns other than doc_id and text, whatever their names, aren't read. score is the best confidence of a detection, 1 for a base phrase, 0 without either.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("lowered", F.lower("text"))
    text, lowered = F.col("text"), F.col("lowered")
    words = sorted({w for r in rules() for w in r.keyword.split()})
    keywords = F.filter(_literal(words, "array<string>"), lambda k: lowered.contains(k))
    opened = lowered.contains(OPENERS[0])
    for opener in OPENERS[1:]:
        opened |= lowered.contains(opener)
    keywords = F.when(opened, keywords).otherwise(F.array().cast("array<string>"))
    marked = base.withColumns({"keywords": keywords, "n_words": word_count(text)} | {f"base{i}": F.struct(*_named(_base(text, lowered, p))) for i, (p, _) in enumerate(BASE)})
    kept = F.when(F.size("keywords") > 0, _resolved(_detections(text, F.col("keywords")))).otherwise(F.array().cast("array<struct<label:string,priority:int>>"))
    marked = marked.withColumn("kept", kept)
    base_labels = F.array_compact(F.array(*[F.when(F.col(f"base{i}.places") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    n_base = sum((F.col(f"base{i}.places") for i in range(1, len(BASE))), F.col("base0.places"))
    confidence = F.array(*[F.lit(c) for c in CONFIDENCE])
    return marked.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*[F.col(f"base{i}.first") for i in range(len(BASE))]).alias("first_word"),
        F.greatest(*[F.col(f"base{i}.last") for i in range(len(BASE))]).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform("kept", lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(F.when(n_base > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("kept", lambda d: F.get(confidence, d["priority"]))), F.lit(0.0))).alias("score"),
    )


def _named(columns: tuple[Column, Column, Column]) -> list[Column]:
    return [c.alias(n) for c, n in zip(columns, ("places", "first", "last"), strict=True)]


def digests(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
