"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained from a small labelled table (``labelled_table``, or the caller's own) by gradient ascent on its exact
log-likelihood, and decoded by Viterbi in numpy batches. A sequence is a whole line, however long. Where "outside" leads at a
word by more than any transitions can give back, every best path goes through it, so lines are decoded exactly in the stretches
between such words, stretches of like length together.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm.kernel import ASCII_SPACE, LOWER, buffers, chunks, hashes, mapper, tokens
from riskgrid.llm.tables import table

#: In the order in which spans with one start are listed; the field alone finds secrets.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)
#: A labelled table may have so many rows at most.
MOST_LABELLED = 20_000
EPOCHS, RATE, DECAY = 120, 0.15, 1e-3

# Fixed patterns. Possessive repeats match the same as plain ones here, in linear time.
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = np.zeros(256, bool)
_LOCAL[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"]] = True
_IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[0-9]")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: bytes) -> list[tuple[int, int]]:
    """An address begins at the first local character of the run before its @ that no earlier address holds."""
    out, last, at = [], 0, text.find(b"@")
    while at >= 0:
        begin = at
        while begin > last and _LOCAL[text[begin - 1]]:
            begin -= 1
        match = _DOMAIN.match(text, at) if begin < at else None
        if match:
            last = match.end()
            out.append((begin, last))
        else:
            last = max(last, at + 1)  # no local part holds an @
        at = text.find(b"@", last)
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns."""
    out = [(s, 0, e) for s, e in emails(text)]
    if not _DIGITS.search(text):
        return out
    if text.count(b".") >= 3:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(g.lstrip(b"0")) <= 3 and int(g.lstrip(b"0") or b"0") <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(b" ", b"").replace(b"-", b"")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if b"+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


# Word shapes --------------------------------------------------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = ord("A"), ord("a"), ord("0"), ord("a")
_MASK = np.full(256, 128, np.uint8)  # which classes a word holds
for _bit, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "@", ".", "-", "+()")):
    _MASK[[ord(c) for c in _chars]] = 1 << _bit
_MASK[128:] = 2
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
_DIGIT_BUCKET = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 9, 9, 9, 10, 10, 10, 11, 11, 11, 12])
_LENGTH_BUCKET = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 6, 7, 7, 7, 7, 7, 7, 8, 8, 8, 8, 8, 8, 8, 8, 9, 9, 9, 9, 9, 9, 9, 9, 10])


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Hashes of the collapsed shape and of the lower-case word; the classes held; buckets of digits and of length."""
    if not len(starts):
        return {k: np.zeros(0, np.uint64 if k in ("shape", "word") else np.int64) for k in ("shape", "word", "mask", "digits", "length")}
    kind = _CLASS[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    new &= ~ASCII_SPACE[data]
    at = np.flatnonzero(new)
    first = np.searchsorted(at, starts)
    digits = np.add.reduceat(_DIGIT[data].astype(np.int32), starts)  # spaces between words hold no digits
    mask = np.bitwise_or.reduceat(np.where(ASCII_SPACE[data], np.uint8(0), _MASK[data]), starts)
    return {
        "shape": hashes(kind[at], first, np.append(first[1:], len(at)), 3),
        "word": hashes(data, starts, ends, 4, LOWER),
        "mask": mask.astype(np.int64),
        "digits": _DIGIT_BUCKET[np.minimum(digits, 20)],
        "length": _LENGTH_BUCKET[np.minimum(ends - starts, 32)],
    }


@dataclass
class Field:
    """Weights of the field; a table for each feature, a row for each of its values, 0 for unseen shapes and words."""

    shapes: np.ndarray
    words: np.ndarray
    tables: dict[str, np.ndarray] = field(default_factory=dict)
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))

    def columns(self, f: dict[str, np.ndarray], begins: np.ndarray) -> dict[str, np.ndarray]:
        """Rows of the tables for each word; neighbours outside the sequence have the last row."""
        own = {"shape": _known(self.shapes, f["shape"]), "word": _known(self.words, f["word"]), "mask": f["mask"], "digits": f["digits"], "length": f["length"]}
        n = len(own["mask"])
        first = np.zeros(n + 1, bool)
        first[begins] = True
        first[n] = True
        for name in ("word", "mask", "digits"):
            outside = self.sizes()[name]
            before, after = np.full(n, outside), np.full(n, outside)
            before[1:] = own[name][:-1]
            after[:-1] = own[name][1:]
            before[first[:n]] = outside
            after[first[1:]] = outside
            own["before_" + name], own["after_" + name] = before, after
        return own

    def sizes(self) -> dict[str, int]:
        own = {"shape": len(self.shapes) + 1, "word": len(self.words) + 1, "mask": 256, "digits": 13, "length": 11}
        return own | {f"{side}_{k}": own[k] + 1 for side in ("before", "after") for k in ("word", "mask", "digits")}

    def scores(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns["mask"]), len(LABELS)), np.float32)
        for name, rows in columns.items():
            out += self.tables[name][rows]
        return out

    def slack(self) -> float:
        """A word at which "outside" leads by more has that label on every best path: no transitions before and after give it back."""
        gain_in = np.maximum((self.transitions - self.transitions[:, :1]).max(axis=0), 0)
        gain_out = np.maximum((self.transitions - self.transitions[:1]).max(axis=1), 0)
        return float((gain_in + gain_out)[1:].max()) + 1e-3


def _known(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at + 1, 0)


def viterbi(scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best labels of sequences ``begins[i] .. begins[i] + lengths[i]`` of the words; longer ones first, so the live ones lead."""
    out = np.zeros(len(scores), np.int8)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    n, most = len(begins), int(lengths[0]) if len(lengths) else 0
    if not n:
        return out
    best = scores[begins].T.astype(np.float64)
    back = np.zeros((most, len(LABELS), n), np.int8)
    for t in range(1, most):
        live = int(np.searchsorted(-lengths, -t, "left"))
        emit = scores[begins[:live] + t].T
        step = np.empty((len(LABELS), live))
        for label in range(len(LABELS)):
            candidates = best[:, :live] + transitions[:, label, None]
            back[t, label, :live] = candidates.argmax(axis=0)
            step[label] = candidates.max(axis=0) + emit[label]
        best[:, :live] = step
    label = best.argmax(axis=0)
    for t in range(most - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, "left"))
        out[begins[:live] + t] = label[:live]
        if t:
            label[:live] = back[t, label[:live], np.arange(live)]
    return out


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS) -> Field:
    """A field from labelled lines: text and spans (kind, start, end) in characters. A word has the label of the span it touches."""
    lines = [(t.encode(), [(k, len(t[:s].encode()), len(t[:e].encode())) for k, s, e in spans]) for t, spans in rows]
    data = np.frombuffer(b"".join(t for t, _ in lines), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t, _ in lines])]).astype(np.int64)
    starts, ends, first = tokens(data, offs)
    truth = np.zeros(len(starts), np.int64)
    for i, (_, spans) in enumerate(lines):
        for k, s, e in spans:
            a, b = first[i], first[i + 1]
            truth[a:b][(starts[a:b] < offs[i] + e) & (ends[a:b] > offs[i] + s)] = LABELS.index(k)
    f = word_features(data, starts, ends)
    words, counts = np.unique(f["word"], return_counts=True)
    model = Field(np.unique(f["shape"]), words[counts >= 3])
    lengths = np.diff(first)
    begins, lengths = first[:-1][lengths > 0], lengths[lengths > 0]
    columns = model.columns(f, begins)
    sizes, labels = model.sizes(), len(LABELS)
    most = int(lengths.max()) if len(lengths) else 0
    index = np.minimum(begins[:, None] + np.arange(most), max(len(truth) - 1, 0))
    inside = np.arange(most) < lengths[:, None]
    w = {k: np.zeros((n, labels)) for k, n in sizes.items()} | {"": np.zeros((labels, labels))}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    one = np.eye(labels)[truth]
    real = np.zeros((labels, labels))
    follows = np.setdiff1d(np.arange(len(truth)), begins)
    np.add.at(real, (truth[follows - 1], truth[follows]), 1)
    for epoch in range(1, epochs + 1):
        scores = sum(w[k][r] for k, r in columns.items())
        marginal, pairs = _marginals(scores[index], inside, w[""])
        expected = np.zeros_like(scores)
        expected[index[inside]] = marginal[inside]
        gap = one - expected
        for k in w:
            if k:
                g = np.stack([np.bincount(columns[k], weights=gap[:, c], minlength=sizes[k]) for c in range(labels)], axis=1)
            else:
                g = real - pairs
            g = g / max(len(begins), 1) - DECAY * w[k] / 10
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] + RATE * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-4)
    model.transitions = w.pop("")
    model.tables = {k: x.astype(np.float32) for k, x in w.items()}
    return model


def _marginals(scores: np.ndarray, inside: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of padded sequences, and the sum of the pairs' marginals, by forward and backward recursions.

    Each step of the recursions is scaled to a sum of one, so no logarithms are needed.
    """
    n, most, labels = scores.shape
    emit, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(transitions)
    forward, backward, scale = np.empty_like(emit), np.ones_like(emit), np.ones((n, most, 1))
    for t in range(most):
        step = emit[:, 0] if t == 0 else (forward[:, t - 1] @ move) * emit[:, t]
        scale[:, t] = step.sum(axis=1, keepdims=True)
        forward[:, t] = step / scale[:, t]
    for t in range(most - 2, -1, -1):
        step = (backward[:, t + 1] * emit[:, t + 1] / scale[:, t + 1]) @ move.T
        backward[:, t] = np.where(inside[:, t + 1, None], step, 1)
    pairs = np.zeros((labels, labels))
    for t in range(1, most):
        m = inside[:, t]
        pairs += move * (forward[m, t - 1].T @ (backward[m, t] * emit[m, t] / scale[m, t]))
    return forward * backward, pairs


# The labelled table -------------------------------------------------------------------------------------------------


def examples(count: int = 1600, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented labelled lines: words of random syllables, personal data in common forms, and numbers that are none."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    syllables = ["the", "an", "er", "re", "tion", "le", "ou", "é", "sch", "en", "ü", "os", "ción", "ñ", "ing", "ha", "st", "que"]

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 6)))
        w = r.choice([w, w, w, w, w, w.capitalize(), w.upper()])
        return w + r.choice([""] * 8 + [".", ",", "***", "###", "&&&", "!!", "$$$", "%%%", ";", ":"])

    def number() -> str:
        return r.choice([d(r.randint(1, 6)), f"{r.randint(1, 9)}.{r.randint(0, 9)}.", f"({r.randint(1900, 2030)})", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"${d(2)}.{d(2)}", f"{d(1)},{d(3)}", "|", "=", "2.0.", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(2)}:{d(2)}", f"#{d(4)}", f"{d(1)}.", f"{d(1)},", f"version {d(1)}.", f"Version {d(1)}.{d(1)}.", f"section {d(2)}."])

    def host() -> str:
        return f"{r.choice(syllables[:8])}{r.choice(['', d(1)])}.{r.choice(['example.com', 'example.org', 'co.uk', 'net'])}"

    def item(kind: str) -> tuple[str, str]:
        """What comes before the span, and the span."""
        name = r.choice(["jo", "anna", "lee", "max", "kim"]) + r.choice(["", ".", "_"]) + r.choice(["", d(2), "smith"])
        if kind == "email":
            return "", r.choice([f"{name.strip('._')}@{host()}"] * 3 + [f"{name.strip('._')} [at] {host()}", f"{name.strip('._')} (at) mail [dot] com"])
        if kind == "ip":
            return "", ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            return "", r.choice([d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(6)} {d(5)}"])
        if kind == "phone":
            return "", r.choice([f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) 555-{d(4)}", f"+44 20 {d(4)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])
        secret = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 64])))
        return r.choice(["token = ", "token: ", "api_key = ", "password = ", "secret: "]), r.choice([f'"{secret}"', f'"{secret}"', secret, f"'{secret[:20]}'"])

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 8)):
                text += (number() if r.random() < 0.15 else word()) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                before, span = item(kind)
                text += before
                spans.append((kind, len(text), len(text) + len(span)))
                text += span + r.choice(["", "", "", "", ".", ",", "***", "$$$", "!!"]) + " "
        out.append((text.strip(), spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = [(t, [(k, s, e) for k, s, e in spans]) for t, spans in examples()]
    return spark.createDataFrame(rows, "text string, spans array<struct<kind: string, start: int, end: int>>")


_fitted: dict[str, Field] = {}


def trained(labelled: DataFrame) -> Field:
    """A field from a labelled table of at most MOST_LABELLED rows; in one process equal tables are fitted once."""
    rows = labelled.select("text", "spans").limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"a labelled table of at most {MOST_LABELLED} rows is expected")
    lines = sorted((r.text or "", sorted((s.kind, s.start, s.end) for s in r.spans or [] if s.kind in KINDS)) for r in rows)
    name = hashlib.sha256(repr(lines).encode()).hexdigest()
    if name not in _fitted:
        _fitted.clear()
        _fitted[name] = fit(lines)
    return _fitted[name]


# Finding ------------------------------------------------------------------------------------------------------------

_TRIM = b"\"'<>[]{},;:!?*#$%&|.="


def sequences(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word indices where sequences begin: at texts and after line ends."""
    if not len(starts):
        return np.zeros(0, np.int64)
    new = np.zeros(len(starts), bool)
    new[first[:-1][np.diff(first) > 0]] = True
    line = np.searchsorted(starts, np.flatnonzero(data == 10))
    new[line[line < len(starts)]] = True
    return np.flatnonzero(new)


def stretches(sure: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the runs of words that aren't sure, with the sure word of the line on either side of each."""
    head = np.zeros(len(sure) + 1, bool)
    head[begins] = True
    head[-1] = True
    unsure = ~sure
    opens = np.flatnonzero(unsure & (head[:-1] | np.append(True, sure[:-1])))
    closes = np.flatnonzero(unsure & (head[1:] | np.append(sure[1:], True)))
    left = opens - ~head[opens]
    right = closes + ~head[closes + 1]
    return left, right - left + 1


def label_words(model: Field, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.int8)
    if not len(starts):
        return out
    scores = model.scores(model.columns(word_features(data, starts, ends), begins))
    at, lengths = stretches(scores[:, 0] - scores[:, 1:].max(axis=1) > model.slack(), begins)
    size = np.frexp(lengths)[1]  # lengths between two powers of two go together, so back pointers take twice the words at most
    for k in np.unique(size).tolist():
        out |= viterbi(scores, at[size == k], lengths[size == k], model.transitions)
    return out


def field_spans(model: Field, data: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, kind, end) in bytes of the text; words of one label that follow each other are one span."""
    starts, ends, first = tokens(data, offs)
    begins = sequences(data, starts, first)
    labels = label_words(model, data, starts, ends, begins)
    hits = np.flatnonzero(labels)
    if not len(hits):
        return {}
    text = np.searchsorted(first, hits, "right") - 1
    out: dict[int, list[tuple[int, int, int]]] = {}
    k = 0
    while k < len(hits):
        j = k
        while j + 1 < len(hits) and hits[j + 1] == hits[j] + 1 and labels[hits[j + 1]] == labels[hits[k]] and text[j + 1] == text[k] and 10 not in data[ends[hits[j]] : starts[hits[j + 1]]]:
            j += 1
        a, b, base = int(starts[hits[k]]), int(ends[hits[j]]), int(offs[text[k]])
        raw = data[a:b].tobytes()
        a += len(raw) - len(raw.lstrip(_TRIM))
        b -= len(raw) - len(raw.rstrip(_TRIM))
        if a < b:
            out.setdefault(int(text[k]), []).append((a - base, int(labels[hits[k]]) - 1, b - base))
        k = j + 1
    return out


def spans_of(model: Field, data: np.ndarray, offs: np.ndarray) -> tuple[list[list], list[list]]:
    """For each text its base spans and all spans, as (start, kind, end) in code points.

    The field's span is added unless a base span of its kind overlaps it.
    """
    more = field_spans(model, data, offs)
    marks = np.concatenate([[0], np.cumsum((data == 64) | (data == 43) | _DIGIT[data])])
    likely = marks[offs[1:]] > marks[offs[:-1]]
    base_all, all_all = [], []
    for i in range(len(offs) - 1):
        if not likely[i] and i not in more:
            base_all.append([])
            all_all.append([])
            continue
        part = data[offs[i] : offs[i + 1]]
        base = base_spans(part.tobytes()) if likely[i] else []
        extra = [x for x in more.get(i, ()) if not any(b[1] == x[1] and b[0] < x[2] and x[0] < b[2] for b in base)]
        if base or extra:
            points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            to = lambda x: (int(points[x[0]]), x[1], int(points[x[2]]))  # noqa: E731, B023
            base, extra = [to(x) for x in base], [to(x) for x in extra]
        base_all.append(sorted(base))
        all_all.append(sorted({*base, *extra}))
    return base_all, all_all


def find(documents: DataFrame, model: Field) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in code points, end exclusive, of every whole text.

    A null or empty text has none; rows that repeat are each searched; an empty table gives an empty one; a text may be of any
    length, as may its lines; of labels that score alike the first of LABELS is taken; columns other than doc_id and text,
    whatever their names, aren't read.
    """
    kind = "array<struct<kind: string, start: int, end: int>>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: tuple[list, list] = ([], [])
        for _, _, data, offs in chunks(*buffers(batch.column(1))):
            for target, got in zip(columns, spans_of(model, data, offs), strict=True):
                target += [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in got]
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, arrow) for c in columns)], names=["doc_id", "base", "spans"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(mapper(run), f"doc_id long, base {kind}, spans {kind}")


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), trained(labelled_table(spark)))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    every = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, every, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
