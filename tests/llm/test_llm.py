import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import rows, tables
from conftest import odd_rows, words
from riskgrid.llm import decontaminate, jpeg, kernel, langid, licenses, lines, neardup, pieces, pii, registry, substrings, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(frame, expected):
    """Rows of a frame against expected tuples, in any order."""
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(expected, key=repr)


# Kernel ---------------------------------------------------------------------------------------------------------------


def test_hashes_don_t_depend_on_place(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(words(r, r.randint(0, 40))) for _ in range(60)] + [None, ""]
    data, offs = kernel.buffers(pa.array(texts, pa.string()))
    starts, ends, first = kernel.tokens(data, offs)
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)] == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    whole = kernel.hashes(data, starts, ends)
    monkeypatch.setattr(kernel, "HASH_BYTES", 50)
    assert (whole == kernel.hashes(data, starts, ends)).all()
    seen = defaultdict(set)
    for h, s, e in zip(whole.tolist(), starts, ends, strict=True):
        seen[data[s:e].tobytes()].add(h)
    assert all(len(v) == 1 for v in seen.values()) and len({h for v in seen.values() for h in v}) == len(seen)
    sliced = pa.array(texts, pa.string()).slice(5, 9)
    data, offs = kernel.buffers(sliced)
    assert [data[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)] == texts[5:14]


# 1 PII ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.examples())


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_base_spans_equal_plain_patterns():
    r = random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice("a1.@-+ (9") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text.encode()) == brute_base(text)
    for text in ("4111111111111111", "x 4111 1111 1111 1111.", "a@b.c@d.e", "+1 (555) 010-9999 ", "1.2.3.4.5.6.7.8", "999.1.1.1", "@", "a@@b.c"):
        assert pii.base_spans(text.encode()) == brute_base(text)


def test_field_on_lines_it_has_not_seen(field):
    good = found = true = 0
    for text, spans in pii.examples(300, seed=99):
        data = np.frombuffer(text.encode(), np.uint8)
        got = {(pii.KINDS[k], text.encode()[s:e].decode()) for s, k, e in pii.field_spans(field, data, np.array([0, len(data)])).get(0, [])}
        expected = {(k, text[s:e].strip("\"'<>[]{},;:!?*#$%&|.=")) for k, s, e in spans}
        good, found, true = good + len(got & expected), found + len(got), true + len(expected)
    assert good / found > 0.95 and good / true > 0.95


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(1)
    scores, transitions = r.normal(size=(11, len(pii.LABELS))), r.normal(size=(len(pii.LABELS),) * 2)
    begins, lengths = np.array([0, 4, 5]), np.array([4, 1, 5])
    got = pii.viterbi(scores, begins, lengths, transitions)
    for b, n in zip(begins, lengths, strict=True):
        paths = np.stack(np.meshgrid(*[np.arange(len(pii.LABELS))] * n, indexing="ij"), -1).reshape(-1, n)
        total = scores[b + np.arange(n), paths].sum(axis=1) + transitions[paths[:, :-1], paths[:, 1:]].sum(axis=1)
        assert (got[b : b + n] == paths[total.argmax()]).all()


def test_marginals_equal_all_paths():
    r = np.random.default_rng(4)
    n, labels = 4, len(pii.LABELS)
    scores, transitions = r.normal(size=(1, n, labels)) * 3, r.normal(size=(labels, labels))
    inside = np.array([[True, True, True, False]])
    marginal, pairs = pii._marginals(scores, inside, transitions)
    paths = np.stack(np.meshgrid(*[np.arange(labels)] * 3, indexing="ij"), -1).reshape(-1, 3)
    weight = np.exp(scores[0, np.arange(3), paths].sum(axis=1) + transitions[paths[:, :-1], paths[:, 1:]].sum(axis=1))
    weight /= weight.sum()
    for t in range(3):
        assert np.allclose(marginal[0, t], np.bincount(paths[:, t], weights=weight, minlength=labels))
    expected = np.zeros((labels, labels))
    for t in range(2):
        np.add.at(expected, (paths[:, t], paths[:, t + 1]), weight)
    assert np.allclose(pairs, expected)


def test_sure_words_cut_lines_exactly(field, documents):
    mixed = " ".join(r for t, _ in pii.examples(400, seed=5) for r in [t])  # one line of many items
    data, offs = kernel.buffers(pa.array([t for _, t in pairs(documents)] + [mixed], pa.large_string()))
    starts, ends, first = kernel.tokens(data, offs)
    begins = pii.sequences(data, starts, first)
    scores = field.scores(field.columns(pii.word_features(data, starts, ends), begins))
    lengths = np.diff(np.append(begins, len(starts)))
    full = np.zeros(len(starts), np.int8)
    for b, n in zip(begins, lengths, strict=True):  # one by one, as long lines need long tables
        full |= pii.viterbi(scores, np.array([b]), np.array([n]), field.transitions)
    assert (full == pii.label_words(field, data, starts, ends, begins)).all() and full.any()


def test_long_runs_of_digits_are_no_address():
    for text in ("0" * 5000 + ".1.2.3", "1.2.3." + "9" * 5000, "0" * 6000):
        assert pii.base_spans(text.encode()) == ([(0, 1, 5006)] if text.startswith("0") and "." in text else [])


def test_pii_of_odd_rows(spark, odd, empty, field):
    extra = spark.createDataFrame([(50, "é a.b@c.de, +1 (555) 010-9999"), (51, "4111111111111111, 1.2.3.4")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(odd.select("doc_id", "text").union(extra), field).collect()}
    assert [(s.kind, s.start, s.end) for s in got[50].base] == [("email", 2, 10), ("phone", 12, 29)]
    assert [(s.kind, s.start, s.end) for s in got[51].base] == [("card", 0, 16), ("ip", 18, 25)]
    assert got[4].base == got[5].spans == [] and pii.find(odd, field).count() == odd.count() and pii.find(empty, field).count() == 0


def test_op1_contract(spark, sf, documents):
    expected = {i: brute_base(t or "") for i, t in pairs(documents)}
    for r in entry.queries()["op1_pii"](spark, sf).collect():
        base = expected[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        texts = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == sha(",".join(texts)) and (set(texts) <= set(r.spans.split(",")) or not texts)
        assert r.n_spans == len(r.spans.split(",")) if r.spans else r.n_spans == 0


# 2 language -----------------------------------------------------------------------------------------------------------


def test_language_held_out(spark, documents):
    got = {r.doc_id: r for r in entry.queries()["op2_language_id"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= got[d.doc_id].score <= 1
    out = [got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out]
    assert sum(out) / len(out) > 0.97


def byte_grams(text):
    folded = [("#" if b < 128 and not chr(b).isalpha() else chr(b).lower() if b < 128 else b) for b in text.encode()]
    return {(n, *map(str, folded[i : i + n])) for n in (1, 2, 3) for i in range(len(folded) - n + 1)}


def test_predictions_equal_brute_force(spark, documents):
    """The whole query against sets of n-grams and plain linear algebra, with a small sample."""
    from pyspark.sql import functions as F

    sample, marks = 30, 6
    labelled = documents.where(~langid.held_out(documents))
    got = {r.doc_id: r for r in langid.predict(documents, langid.fit(labelled, sample, marks)).collect()}
    rows = defaultdict(list)
    for r in labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h")).collect():
        rows[r.lang].append((r.h, r.doc_id, r.text))
    languages, chosen, landmarks = sorted(rows), [], []
    for lang in languages:
        own = sorted(rows[lang])[:sample]
        chosen += [(lang, byte_grams(t)) for _, _, t in own]
        landmarks += [byte_grams(t) for _, _, _, t in sorted((len(t) > langid.LANDMARK_CHARS, h, i, t) for h, i, t in own if re.search(r"[^\W\d_]", t))[:marks]]
    known = set().union(*landmarks)
    k = lambda x, z: len(x & z) / (max(len(x & known), 1) * len(z)) ** 0.5
    zz = np.array([[k(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(zz)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.array([[k(x, z) for z in landmarks] for _, x in chosen]) @ root
    weight = np.array([1 / sum(lang == other for other, _ in chosen) for lang, _ in chosen])
    w = []
    for lang in languages:
        target = np.array([1.0 if lang == other else -1.0 for other, _ in chosen])
        w.append(np.linalg.solve(phi.T @ (phi * weight[:, None]) + langid.RIDGE * np.eye(phi.shape[1]), phi.T @ (target * weight)))
    for d in documents.collect():
        text = d.text or ""
        if not re.search(r"[^\W\d_]", text):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0.0)
            continue
        raw = langid.SHARPNESS * np.array([k(byte_grams(text), z) for z in landmarks]) @ root @ np.array(w).T
        p = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
        assert got[d.doc_id].score == pytest.approx(p.max(), abs=2e-3)
        assert got[d.doc_id].lang_pred == languages[p.argmax()] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3


def test_sample_has_the_smallest_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i % 700, ["aa", "bb", "aa"][i % 3], "x") for i in range(3000)] + [(5, "cc", "y")] * 4000 + [(9, "cc", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    hashed = frame.distinct().select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).collect()
    expected = {lang: [i for _, i in sorted((r.h, r.doc_id) for r in hashed if r.lang == lang)[:20]] for lang in ("aa", "bb", "cc")}
    assert langid.least_hashes(frame, 20) == expected
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.least_hashes(frame, 20)


def test_kernel_values_equal_sets():
    texts = ["Abc abd", "zz é!", "", "abc abd abc"]
    data, offs = kernel.buffers(pa.array(texts, pa.large_string()))
    columns, size, z = langid.dictionary(langid.grams(data, offs))
    got = langid.kernel(data, offs, columns, size, z)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = byte_grams(a), byte_grams(b)
            assert got[i, j] == pytest.approx(len(x & y) / (max(len(x), 1) * max(len(y), 1)) ** 0.5, abs=1e-6)


def test_language_of_odd_rows(odd, empty):
    assert langid.fit(empty) is None
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert got[4] == got[5] == got[6] == ("und", 0.0) and got[1][0] == "xx"
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"} and langid.predict(empty, langid.fit(odd)).count() == 0
    kept = langid.accepted(odd, langid.fit(odd), 0.5)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd.collect() if any(c.isalpha() for c in r.text or "")}


# 3 near copies --------------------------------------------------------------------------------------------------------


def brute_classes(texts, threshold=0.8):
    """Classes by all pairs that share a shingle, with weights and similarities in plain Python."""
    data, offs = kernel.buffers(pa.array(texts, pa.large_string()))
    counts = np.zeros(neardup.CELLS, np.int64)
    hashed = []
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        h, _ = neardup._words(data[a:b], np.array([0, b - a]))
        cells = (h & np.uint64(neardup.CELLS - 1)).astype(int)
        counts[np.unique(cells)] += 1
        hashed.append((h, cells))
    weights = neardup.idf(len(texts), counts)
    bags, where = [], defaultdict(list)
    for i, (h, cells) in enumerate(hashed):
        bag, n = defaultdict(float), len(h)
        size = min(5, n)
        for j in range(n - size + 1 if n else 0):
            bag[tuple(h[j : j + size])] += round(float(weights[cells[j : j + size]].mean()), 6)
        bags.append(bag)
        for s in bag:
            where[s].append(i)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(x, y) for group in where.values() for x in group for y in group if x < y}:
        both = sum(min(w, bags[b].get(s, 0)) for s, w in bags[a].items())
        if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= threshold:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [root(i) for i in range(len(texts))]


def test_near_copies_equal_all_pairs(spark, documents):
    r = random.Random(2)
    texts = [t or "" for _, t in sorted(pairs(documents))]
    source = words(r, 150)
    for _ in range(40):  # a group of near copies of one text
        copy = list(source)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(len(copy))] = "".join(words(r, 2))
        texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def dense_classes(texts, threshold=0.8):
    """Classes by all pairs at once, for texts in which no shingle repeats."""
    data, offs = kernel.buffers(pa.array(texts, pa.large_string()))
    counts = np.zeros(neardup.CELLS, np.int64)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        h, _ = neardup._words(data[a:b], np.array([0, b - a]))
        counts[np.unique((h & np.uint64(neardup.CELLS - 1)).astype(int))] += 1
    text, key, weight, _ = neardup.shingles(data, offs, neardup.idf(len(texts), counts))
    _, column = np.unique(key, return_inverse=True)
    has = np.zeros((len(texts), column.max() + 1))
    has[text, column] = weight
    total = has.sum(axis=1)
    shared = has @ (has > 0).T
    linked = shared >= threshold * (total[:, None] + total[None] - shared)
    classes = np.arange(len(texts))
    while (lower := np.where(linked, classes[None], len(texts)).min(axis=1)).tolist() != classes.tolist():
        classes = lower
    return classes.tolist(), int((linked.sum() - len(texts)) / 2)


def test_group_of_thousands_mostly_below_the_threshold(spark):
    r = random.Random(5)
    source, texts = [f"word{i}" for i in range(100)], []
    for i in range(2000):  # two own words each: 0.65 alike, 0.73 with one place in common, above 0.8 with both
        copy = list(source)
        for p in r.sample(range(5, 95), 2):
            copy[p] = f"own{i}at{p}"
        texts.append(" ".join(copy))
    expected, links = dense_classes(texts)
    assert links > 50 and len(set(expected)) > 100
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_lone_link_in_a_large_group(spark):
    source, texts = [f"word{i}" for i in range(100)], []
    for i in range(700):  # own places, but for the last one's, which are those of the first
        copy = list(source)
        a, b = (0, 50) if i == 699 else (i % 45, 50 + i // 45 * 3 % 45)
        copy[a] = copy[a + 1] = f"own{i}"
        copy[b] = copy[b + 1] = f"more{i}"
        texts.append(" ".join(copy))
    expected, _ = dense_classes(texts)
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_group_beyond_the_limit_is_sent_as_one(spark, monkeypatch):
    r = random.Random(8)
    source, texts = [f"word{i}" for i in range(100)], []
    for i in range(300):
        copy = list(source)
        for p in r.sample(range(5, 95), 2):
            copy[p] = f"own{i}at{p}"
        texts.append(" ".join(copy))
    expected, _ = dense_classes(texts)
    sent = []

    def spied(frame, kind, write=neardup.written):
        out = write(frame, kind)
        if kind == "dealt":
            sent.append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", spied)
    monkeypatch.setattr(neardup, "GROUP", 50)
    monkeypatch.setattr(neardup, "BLOCK", 4000)
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == expected
    assert 0 < sent[0] <= len(texts)  # once in the group, not once in each of its buckets


def test_samples_agree_as_often_as_texts_are_similar():
    r = random.Random(4)
    left = [" ".join(words(r, 300)) for _ in range(60)]
    right = []
    for t in left:
        w = t.split()
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = "new"
        right.append(" ".join(w))
    weights = np.linspace(1, 9, neardup.CELLS)

    def sampled(texts):
        out = np.zeros((len(texts), 400), np.int32)
        for i, _, data, offs in kernel.chunks(*kernel.buffers(pa.array(texts, pa.large_string()))):
            text, key, weight, _ = neardup.shingles(data, offs, weights)
            at, got = neardup.samples(text, key, weight, 400)
            out[i + at] = got
        return out

    exact = neardup.similarity(pa.array(left, pa.large_string()), pa.array(right, pa.large_string()), weights)
    assert np.abs((sampled(left) == sampled(right)).mean(axis=1) - exact).max() < 0.1


def test_near_copies_of_odd_rows(odd, empty):
    got = defaultdict(set)
    for r in neardup.classes(odd).collect():
        got[r.doc_id].add(r.class_id)
    assert got[1] == got[2] == got[3] == {1} and got[4] == {4} and got[5] == {5} and got[6] == {6} and got[15] == {14} and got[8] == {8}
    assert 1 in got[None] and len(neardup.classes(odd).collect()) == odd.count() and neardup.classes(empty).count() == 0
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and not {2, 3, 15} & set(ids) and {4, 5, 6, 7, 14} <= set(ids) and neardup.representatives(empty).count() == 0


# 4 JPEG ---------------------------------------------------------------------------------------------------------------


def test_jpeg_contract(odd, empty, documents):
    for frame in (odd, documents):
        texts = defaultdict(list)
        for i, t in pairs(frame):
            texts[i].append((t or "").encode())
        for r in jpeg.features(jpeg.store(frame)).collect():
            raw = next(t for t in texts[r.doc_id] if len(t) == r.n_bytes)
            padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert jpeg.features(jpeg.store(empty)).count() == 0
    media = {r.doc_id: r for r in jpeg.store(odd.where("doc_id in (1, 2)")).collect()}
    row = jpeg.features(jpeg.store(odd.where("doc_id = 2"))).first()
    assert media[1].media == media[2].media and (row.media_bytes, row.media_sha256) == (len(media[2].media), hashlib.sha256(media[2].media).hexdigest())


def test_jpeg_frames_and_broken_media():
    r = np.random.default_rng(1)
    payload = r.integers(0, 256, jpeg.FRAME + 640, dtype=np.uint8)
    media, ends = jpeg.encode(np.concatenate([payload, payload[:64]]), np.array([0, len(payload), len(payload) + 64]))
    samples, at, dims = jpeg.decode_dc(media, ends)
    assert (samples == np.concatenate([payload, payload[:64]])).all() and at.tolist() == [0, len(payload), len(payload) + 64] and dims[0][2] == 2
    for broken in (b"GIF89a", b"\xff\xd8\xff\xc2\x00\x0b" + b"\0" * 30, media.tobytes()[1:200]):
        with pytest.raises(ValueError):
            jpeg.parse(broken)


def test_jpeg_with_ac_coefficients():
    """Other tables, AC coefficients, no restart markers: what a common encoder writes."""
    dc, codes = jpeg._canonical({s: 4 for s in range(12)})
    ac, acs = jpeg._canonical({0x00: 2, 0x01: 3, 0x12: 3, 0xF0: 4, 0x23: 5})
    values = [5, -3, 100, -100, 0, 7]
    bits, previous = "", 0
    magnitude = lambda v: (f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}" if v else "")
    for n, v in enumerate(values):
        d, previous = v - previous, v
        bits += f"{codes[abs(d).bit_length()][0]:0{codes[abs(d).bit_length()][1]}b}" + magnitude(d)
        for symbol, value in ((0x01, 1), (0x12, -2), (0xF0, 0), (0x23, 5))[: n % 5]:
            bits += f"{acs[symbol][0]:0{acs[symbol][1]}b}" + magnitude(value)
        bits += f"{acs[0][0]:0{acs[0][1]}b}"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + jpeg._segment(jpeg.DQT, b"\0" + b"\x10" + b"\1" * 63) + jpeg._segment(jpeg.SOF0, b"\x08" + (16).to_bytes(2, "big") + (24).to_bytes(2, "big") + b"\1\1\x11\0")
    media = head + jpeg._segment(jpeg.DHT, b"\0" + dc) + jpeg._segment(jpeg.DHT, b"\x10" + ac) + jpeg._segment(jpeg.SOS, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9"
    samples, _, dims = jpeg.decode_dc(np.frombuffer(media, np.uint8), np.array([0, len(media)]))
    assert samples.tolist() == [min(255, max(0, 128 + 2 * v)) for v in values] and dims == [(24, 16, 1)]


def colour_jpeg(r, width, height, sampling, interleaved, interval, fill=b""):
    """A baseline JPEG of three components and its luminance DC values, encoded block by block in plain Python."""
    dc, codes = jpeg._canonical({s: 4 for s in range(12)})
    ac, acs = jpeg._canonical({0x00: 2, 0x01: 3, 0x12: 3, 0xF0: 4, 0x23: 5})
    h, v = max(x for x, _ in sampling), max(y for _, y in sampling)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    planes = [[[r.randint(-100, 100) for _ in range(across * x)] for _ in range(down * y)] for x, y in sampling]
    magnitude = lambda d: (f"{d if d > 0 else d + (1 << abs(d).bit_length()) - 1:0{abs(d).bit_length()}b}" if d else "")

    def block(d):
        bits = f"{codes[abs(d).bit_length()][0]:0{codes[abs(d).bit_length()][1]}b}" + magnitude(d)
        for symbol, value in ((0x01, 1), (0x12, -2), (0xF0, 0), (0x23, 5))[: r.randint(0, 4)]:
            bits += f"{acs[symbol][0]:0{acs[symbol][1]}b}" + magnitude(value)
        return bits + f"{acs[0][0]:0{acs[0][1]}b}"

    def coded(units):
        """Entropy-coded bytes of MCUs, lists of (component, value)."""
        out, step = b"", interval or len(units)
        for i in range(0, len(units), step):
            bits, previous = "", [0, 0, 0]
            for unit in units[i : i + step]:
                for c, value in unit:
                    bits, previous[c] = bits + block(value - previous[c]), value
            bits += "1" * (-len(bits) % 8)
            out += bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
            if i + step < len(units):
                out += bytes([0xFF, 0xD0 + i // step % 8])
        return out

    media = b"\xff\xd8" + fill + jpeg._segment(jpeg.DQT, b"\0" + b"\x10" + b"\1" * 63) + jpeg._segment(jpeg.DQT, b"\1" + b"\x20" + b"\1" * 63)
    media += jpeg._segment(jpeg.SOF0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\3" + b"".join(bytes([c + 1, x << 4 | y, min(c, 1)]) for c, (x, y) in enumerate(sampling)))
    media += jpeg._segment(jpeg.DHT, b"\0" + dc + b"\x10" + ac) + jpeg._segment(jpeg.DRI, interval.to_bytes(2, "big"))
    size = [(-(-(-(-width * x // h)) // 8), -(-(-(-height * y // v)) // 8)) for x, y in sampling]
    if interleaved:
        units = [[(c, planes[c][my * y + j][mx * x + i]) for c, (x, y) in enumerate(sampling) for j in range(y) for i in range(x)] for my in range(down) for mx in range(across)]
        media += jpeg._segment(jpeg.SOS, b"\3\1\0\2\0\3\0\0\x3f\0") + coded(units)
    else:
        for c in (1, 0, 2):
            media += jpeg._segment(jpeg.SOS, bytes([1, c + 1, 0, 0, 0x3F, 0])) + coded([[(c, planes[c][j][i])] for j in range(size[c][1]) for i in range(size[c][0])])
    return media + b"\xff\xd9", [min(255, max(0, 128 + 2 * x)) for row in planes[0][: size[0][1]] for x in row[: size[0][0]]]


def test_colour_jpeg(spark):
    r = random.Random(8)
    kinds = [(w, h, s, mixed, n) for w, h in ((40, 24), (33, 50), (8, 8)) for s in (((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1)), ((1, 1),) * 3, ((1, 2), (1, 1), (1, 2))) for mixed in (True, False) for n in (0, 2)]
    images = [(*colour_jpeg(r, *k, fill=b"\xff" * (i % 3)), k) for i, k in enumerate(kinds)]
    frame = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(images)] + [(90, None), (91, b""), (92, b"GIF89a"), (93, images[0][0][:-30]), (94, images[0][0][:100])], "id long, image binary")
    got = {x.id: x for x in jpeg.thumbnails(frame, "id", "image").collect()}
    for i, (_, expected, k) in enumerate(images):
        assert (got[i].error, got[i].width, got[i].height) == (None, k[0], k[1]) and list(got[i].thumbnail) == expected, k
    assert all(got[i].error and got[i].thumbnail is None for i in range(90, 95))


# 5 substrings ---------------------------------------------------------------------------------------------------------


def brute_substrings(texts, size=20):
    first = {}
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0))
    split = [WORD.findall(t or "") for _, t in texts]
    for i in order:
        for s in range(len(split[i]) - size + 1):
            first.setdefault(tuple(split[i][s : s + size]), (texts[i][0], s))
    out = []
    for (doc, _), w in zip(texts, split, strict=True):
        gone = {k for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] != (doc, s) for k in range(s, s + size)}
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("width", [None, 1 << 20])
def test_substrings_equal_brute_force(odd, documents, width, monkeypatch):
    if width:  # a sketch that is full lets everything through and loses nothing
        monkeypatch.setattr(substrings, "LEAST", 64)
        monkeypatch.setattr(substrings, "MOST", 64)
    for frame in (odd.select("doc_id", "text"), documents.select("doc_id", "text").repartition(5)):
        same(substrings.deduplicate(frame), brute_substrings(pairs(frame)))


def test_substrings_of_nothing(empty):
    assert substrings.deduplicate(empty).count() == 0


def test_sketch_never_underestimates():
    r = np.random.default_rng(2)
    values = r.integers(0, 3000, 4000).astype(np.uint64)
    one, two = substrings.Sketch(1 << 12), substrings.Sketch(1 << 12)
    for part in np.array_split(values[:2000], 7):
        one.add(part)
    two.add(values[2000:])
    merged = np.zeros_like(one.twice)
    size = (1 << 12) // 8
    for sketch in (one, two):
        for row, _, payload in sketch.blocks():
            once, twice = substrings._planes(payload, size)
            assert (once == sketch.once[row]).all() and (twice == sketch.twice[row]).all()
    merged = one.twice | two.twice | (one.once & two.once)
    kinds, counts = np.unique(values, return_counts=True)
    assert substrings.estimated_repeated(kinds[counts > 1], merged).all() and not substrings.estimated_repeated(kinds, merged).all()


# 6 pieces -------------------------------------------------------------------------------------------------------------


def brute_tokens(v, table, text):
    """The recursion over the whole text, piece by piece, in plain Python."""
    raw = b" " + text.encode()
    starts = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]
    best, back = {0: 0.0}, {}
    for j in starts[1:]:
        for i in starts:
            if i >= j or i not in best:
                continue
            piece, alone = table.get(raw[i:j]), starts[starts.index(i) + 1] == j
            score = v.scores[piece] if piece is not None else v.unknown if alone else None
            if score is not None and (j not in best or best[i] + score > best[j]):
                best[j], back[j] = best[i] + score, (i, piece)
    out, j = [], len(raw)
    while j:
        i, piece = back[j]
        out[:0] = [int(v.ids[piece])] if piece is not None else [int(v.byte_ids[b]) for b in raw[i:j]]
        j = i
    return out


def test_tokens_equal_brute_force(odd, documents, monkeypatch):
    v = pieces.load()
    place = {int(i): n for n, i in enumerate(v.ids)}
    table = {v.data[v.offs[i] : v.offs[i + 1]].tobytes(): place[i] for i in place}
    r = random.Random(6)
    texts = ["", " ", "a  b", "\n\n x\n", "é漢字🙂 ▁", "tab\tx", "x" * 40, *["".join(r.choice("ab é\n🙂the▁ ") for _ in range(r.randint(0, 40))) for _ in range(60)], *[(t or "")[:150] for _, t in pairs(documents)[:15]]]
    for long, size, number in ((pieces.LONG, pieces.SLICE, pieces.SLICES), (3, pieces.SLICE, 1), (3, 7, 2), (0, 1, 3)):  # also in slices
        monkeypatch.setattr(pieces, "LONG", long)
        monkeypatch.setattr(pieces, "SLICE", size)
        monkeypatch.setattr(pieces, "SLICES", number)
        tokens, at = pieces.encode(v, *kernel.buffers(pa.array(texts, pa.large_string())))
        for i, text in enumerate(texts):
            assert tokens[at[i] : at[i + 1]].tolist() == brute_tokens(v, table, text)


def test_slices_of_long_words_equal_one_recursion():
    v, r = pieces.load(), random.Random(8)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "=-", "日本語中文字漢é", "aé日😀z", "0123456789abcdef", "etaoinshr"]
    long = ["".join(r.choice(k) for _ in range(n)).encode() for k in kinds for n in (255, 256, 257, 512, 1500, 5000)]
    tokens, counts = pieces._sliced(v, np.frombuffer(b"".join(long), np.uint8), np.array([len(w) for w in long]))
    whole = [pieces._viterbi(v, np.frombuffer(w, np.uint8)[None])[0] for w in long]
    assert tokens.tolist() == np.concatenate(whole).tolist() and counts.tolist() == [len(w) for w in whole]


def test_round_trip(spark, odd, empty, documents):
    for frame in (odd, documents):
        assert pieces.digests(frame).where("not round_trip").count() == 0 and pieces.digests(frame).count() == frame.count()
        back = pieces.decoded(pieces.encoded(frame))
        same(back, [(i, t or "") for i, t in pairs(frame)])
    row = {r.doc_id: r for r in pieces.digests(odd).collect()}
    assert row[4].n_bytes == 0 and row[4].decoded_sha256 == sha("") and pieces.digests(empty).count() == 0
    ids = {r.doc_id: r.ids for r in pieces.encoded(odd.where("doc_id = 9")).collect()}[9]
    assert row[9].n_tokens == len(ids) and row[9].ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


# 7 licenses -----------------------------------------------------------------------------------------------------------


def brute_base_phrases(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


LICENSED = [
    (100, "CC BY cc--by! CC\nBY é all Rights reserved. ccby cc byx General public license", {"cc-by", "gpl", "reserved"}),
    (101, "This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3"}),
    (102, "Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}),
    (103, "SPDX-License-Identifier: Apache-2.0\nhttps://www.gnu.org/licenses/gpl-3.0.html", {"apache-2.0", "gpl"}),
    (104, "Copyright (c) 2020 X. Under the MIT License.", {"copyright", "mit"}),
    (105, "İK ALL  RIGHTS;reserved ſ", {"reserved"}),
    (106, "GNU Lesser General Public License version 2.1", {"gpl", "lgpl-2.1"}),
    (107, "commit ccby apachean reservedly", set()),
]


def test_license_scan(spark, odd, empty, documents):
    frame = odd.select("doc_id", "text").union(documents.select("doc_id", "text").where("doc_id > 100")).union(spark.createDataFrame([x[:2] for x in LICENSED], "doc_id long, text string"))
    texts = defaultdict(list)
    for i, t in pairs(frame):
        texts[i].append(brute_base_phrases(t))
    got = defaultdict(list)
    for r in licenses.scan(frame).collect():
        got[r.doc_id].append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in texts.items()}
    labels = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(frame.where("doc_id >= 100 and doc_id < 108 and text is not null")).collect()}
    alone = licenses.scan(spark.createDataFrame([(n, x[1]) for n, x in enumerate(LICENSED)], "doc_id long, text string")).collect()
    for row in alone:
        assert set(filter(None, row.labels.split(","))) == LICENSED[row.doc_id][2], LICENSED[row.doc_id][1]
    assert labels and licenses.scan(empty).count() == 0 and 200 < len(licenses.rules())


def test_wrapped_license_notices(spark):
    texts = [("GNU General\nPublic License version 3", "gpl-3"), ("the MIT\nLicense", "mit"), ("ISC  License", "isc"), ("Creative\nCommons  Attribution", "cc-by"), ("Open  Font\nLicense", "ofl"), ("in the public domain", "public-domain")]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert all(texts[r.doc_id][1] in r.labels.split(",") for r in got) and len(got) == len(texts)


compiled: list = []


def brute_labels(text):
    """All rules on the whole text, without prefilter; an interval inside another of as good a priority goes."""
    if not compiled:
        compiled.extend(re.compile(rule.pattern, re.ASCII) for rule in licenses.rules())
    found = []
    for order, (rule, pattern) in enumerate(zip(licenses.rules(), compiled, strict=True)):
        found += [(m.start(), m.end(), rule.priority, order, rule.label) for m in pattern.finditer(text)]
    best = lambda x: (-(x[1] - x[0]), x[2], x[3])
    kept = [x for x in found if not any(y is not x and y[2] <= x[2] and y[0] <= x[0] and x[1] <= y[1] and best(y) < best(x) for y in found)]
    return {x[4] for x in kept}


def test_every_detection_equals_brute_force(spark):
    r = random.Random(21)
    names = ["GNU General Public License", "gnu lesser general public licence", "Apache License", "MIT License", "BSD", "Mozilla Public License", "CC BY", "cc-by-sa", "CC0", "Creative Commons Attribution", "public domain dedication", "Eclipse Public License", "ISC License", "Boost Software License", "in the public domain", "Copyright (c) 2020", "All rights reserved"]
    notices = ["licensed under the ", "released under ", "distributed under the terms of the ", "", "SPDX-License-Identifier: gpl-", "http://www.gnu.org/licenses/gpl "]
    versions = ["", " version 2", ", version 2.0", " v3", "-3.0", " 4.0", " 1.1", "-3-clause"]
    gaps = [" ", "  ", "\n", " \n * ", "\n# ", ", "]
    texts = []
    for _ in range(70):
        parts = []
        for _ in range(r.randint(1, 5)):
            part = r.choice(notices) + r.choice(names) + r.choice(versions) if r.random() < 0.6 else r.choice(licenses.SIGNATURES)[1]
            if r.random() < 0.5:
                part = re.sub(" ", lambda m: r.choice(gaps), part)
            parts += [part.upper() if r.random() < 0.2 else part, " ".join(words(r, r.randint(0, 6)))]
        texts.append(r.choice([" ", "\n", ". "]).join(parts))
    texts += [s for _, s in licenses.SIGNATURES]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) - base == brute_labels(text) - base, text
    for i, (label, _) in enumerate(licenses.SIGNATURES, len(texts) - len(licenses.SIGNATURES)):
        assert label in got[i].labels.split(",")


def test_keywords_stand_in_every_match():
    for rule in licenses.rules():
        assert any(o in w for w in rule.keyword.split() for o in licenses.OPENERS), rule
    for label, sentence in licenses.SIGNATURES:
        rule = licenses._signature(label, sentence)
        assert all(w in sentence for w in rule.keyword.split()) and re.search(rule.pattern, sentence)


def test_license_plan_is_native(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# 8 lines --------------------------------------------------------------------------------------------------------------


def brute_lines(texts, size=3):
    first, split = {}, [None if t is None else t.split("\n") for _, t in texts]
    windows = lambda ls: [(s, "\n".join(ls[s : s + size])) for s in range(len(ls) - size + 1) if "\n".join(ls[s : s + size]).strip(" \t\n\r\f\x0b")]
    for i in sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0)):
        for s, w in windows(split[i] or []):
            first.setdefault(w, (texts[i][0], s))
    out = []
    for (doc, text), ls in zip(texts, split, strict=True):
        gone = {k for s, w in windows(ls or []) if first[w] != (doc, s) for k in range(s, s + size)}
        out.append((doc, text if not gone else "\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls or []), len(gone)))
    return out


def test_lines_equal_brute_force(odd, empty, documents):
    for frame in (odd, documents):
        expected = brute_lines(pairs(frame))
        same(lines.deduplicate(frame), expected)
        cleaned = lines.cleaned(frame)
        assert cleaned.columns == frame.columns
        same(cleaned.select("doc_id", "text"), [(d, t) for d, t, n, gone in expected if not gone or gone < n])
    assert lines.deduplicate(empty).count() == 0 and any(gone for *_, gone in expected)


def test_texts_that_share_a_doc_id(spark):
    r = random.Random(12)
    passage, a, b = (words(r, n) for n in (30, 25, 40))
    rows = [(1, " ".join(a + passage)), (1, " ".join(b + passage)), (2, " ".join(passage)), (1, " ".join(a + passage))]
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # One of the two texts comes first, whole; equal rows are one place.
    assert got in ([(1, 55, 0), (1, 55, 0), (1, 70, 30), (2, 30, 30)], [(1, 55, 30), (1, 55, 30), (1, 70, 0), (2, 30, 30)])
    lines_ = "\n".join(" ".join(words(r, 5)) for _ in range(4))
    rows = [(1, "one\n" + lines_), (1, "two\nmore\n" + lines_), (2, lines_)]
    got = sorted((x.doc_id, x.n_lines, x.n_removed) for x in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in ([(1, 5, 0), (1, 6, 4), (2, 4, 4)], [(1, 5, 4), (1, 6, 0), (2, 4, 4)])


# 9 WARC ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    body = "é\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n" * 400
    pages = [(5, "u", "x" * 20000), (3, "u", "x" * 20000), (7, None, None), (9, "u", ""), (None, "u", "x" * 20000), (3, "u", "x" * 20000), (11, "é\r\nWARC/1.1", body), (12, "u", "small"), (13, "u", "small")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, page string").repartition(3)
    path = warc.place(spark, "test")
    warc.write(frame, path)
    assert warc.segments(spark, path).where("type = 'continuation'").count() == 5
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()), key=repr)
    first = {"x" * 20000: 3, "": 7, body: 11, "small": 12}
    row = lambda i, t: (i, len(t.encode()), warc.digest(t.encode()), *(("response", None) if i == first[t] else ("revisit", first[t])))
    assert got == sorted((row(i, t or "") for i, _, t in pages), key=repr)
    assert warc.read(spark, path).where("page_id = 11").first().payload.decode() == body
    warc.write(frame, path + "-large", least=10)
    assert {r.page_id for r in warc.read(spark, path + "-large").where("record_type = 'revisit'").collect()} == {5, None}
    warc.write(frame.where("page_id < 0"), path + "-none")
    assert warc.read(spark, path + "-none").count() == 0


def test_archives_of_members_and_plain_ones():
    import gzip

    records = [r for n in range(3) for r in warc.page_records(n, 0, "http://a.b", b"page %d" % n, None)]
    members = b"".join(map(gzip.compress, records))
    for archive in (members, b"".join(records), gzip.compress(b"".join(records)), members + warc.member(b"")):
        assert [h["warc-record-id"].split(":")[3] for h, _ in warc.parse(warc.inflated(archive))] == ["0", "1", "2"]
    big = warc.page_records(7, 0, "u", random.Random(1).randbytes(300_000), None)
    assert warc.inflated(b"".join(map(warc.member, big))) == b"".join(big) and warc.inflated(b"") == b""
    with pytest.raises(ValueError):
        warc.inflated(members[:-4])


def test_written_archives_have_a_member_a_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i % 5} " * 4000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w")
    content = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    heads = []
    while content:
        stream = zlib.decompressobj(31)
        data, content = stream.decompress(content), stream.unused_data
        assert stream.eof and (not data or data.startswith(b"WARC/1.1") and data.endswith(b"\r\n\r\n"))
        heads += [data[:8]] * bool(data)
    assert len(heads) == warc.segments(spark, f"file://{tmp_path}/w").count() > 40


def test_broken_archives():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc" * 5000)
    assert warc.payload_of(block) == (b"abc" * 5000, 15000) and warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert warc.reassemble([(2, b"b"), (1, b"a")], 2) == b"ab"
    for parts, total in (([(1, b"a"), (3, b"c")], 2), ([(1, b"a"), (2, b"b")], 3), ([(1, b"a"), (2, b"b")], None), ([(1, b"a"), (1, b"a")], 2)):
        with pytest.raises(ValueError):
            warc.reassemble(parts, total)
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"))


# 10 decontamination ---------------------------------------------------------------------------------------------------


def test_leaks_equal_plain_search(spark, sf, documents):
    plain = lambda t: " ".join((t or "").lower().split())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = {(d, i) for d, t in pairs(documents) for i, b in bench if plain(b) in plain(t)}
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op10_decontamination"](spark, sf).collect()}
    assert expected and expected == got


def found(spark, texts, item, **more):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.reparameterised for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, item), (1, item), (None, "x"), (2, None), (3, "too short")], "item_id long, text string")).collect()}


def test_questions_with_other_values(spark):
    item = "John has 3 apples and gives 2 apples to Mary every 5 hours, while John keeps 3 kg of pears for himself in the end"
    texts = [
        "x y. " + item + " z",
        "Then Peter has 7 apples and gives 4 apples to Anna every 9 hours, while Peter keeps 7 kg of pears for himself in the end",
        "JOHN HAS 3 APPLES AND GIVES 2 APPLES TO MARY EVERY 5 HOURS, WHILE JOHN KEEPS 3 KG OF PEARS FOR HIMSELF IN THE END",
        "a word here and there, for himself in the end", None, "",
    ]
    assert found(spark, texts, item) == {0: False, 1: True, 2: False}


def test_slots_must_be_consistent(spark):
    item = "so many as 4 red balls and 5 blue balls make 4 red balls more than 5 blue balls but not 4 green balls or 5 green balls"
    one, other = item.replace("4", "8").replace("5", "6"), "so many as 1 red balls and 2 blue balls make 3 red balls more than 7 blue balls but not 8 green balls or 9 green balls"
    assert found(spark, [one, other], item) == {0: True}


def test_items_of_numbers_and_names_and_short_ones(spark):
    items = ["What is 17 + 25?", "Compute 17 * 23 - 45 / 9", "so Anna Berta Clara Dora Emma Frida Gerda Hanna", "two words", "5 kg 6 km 7 cm 8 mm 9 ml 10 mg", "Seventeen"]
    texts = [f"At first it was asked: {t} And then no more." for t in items] + ["What is 18 + 26? Compute 1 * 2 - 4 / 3 two other words 5 mg 6 km", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(len(items))]
    assert all(r.n_matched == r.n_windows and not r.reparameterised for r in got)


def test_leaks_of_odd_rows_and_blocks(spark, odd, empty, monkeypatch):
    texts = dict(odd_rows())
    bench = spark.createDataFrame([(1, texts[9]), (2, " ".join(texts[7].split()[100:130]))], "item_id long, text string")
    expected = {(8, 1), (9, 1), (10, 1), (7, 2)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()} == expected
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()} == expected
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id not in (7, 8, 9, 10))
    assert decontaminate.contaminated(empty, bench).count() == decontaminate.contaminated(odd, bench.where("item_id < 0")).count() == 0


# Queries and pipeline -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(tables(sf).sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["op3_near_duplicates", "op4_jpeg_media", "op5_substring_dedup", "op6_sentencepiece", "op7_license_scan"])
def test_query_covers_the_table(spark, sf, documents, name):
    ids = [r.doc_id for r in entry.queries()[name](spark, sf).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in documents.collect())


def test_pipeline(spark, sf, documents, tmp_path):
    docs = documents
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{n}")
        out = spark.read.parquet(f"file://{tmp_path}/{n}")
        if n < 4:
            assert out.dtypes == docs.dtypes, name
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if n == 0:
            assert set(after) == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        if n == 1:
            assert {i: r.text for i, r in after.items()} == {d: t for d, t, total, gone in brute_lines(list(before.items())) if not gone or gone < total}
        if n == 2:
            ids = sorted(before)
            assert set(after) == {ids[c] for c in brute_classes([before[i] for i in ids])}
        if n == 3:
            plain = lambda t: " ".join((t or "").lower().split())
            assert set(before) - set(after) == {i for i, t in before.items() if any(plain(b.text) in plain(t) for b in bench.collect())}
        if n == 4:
            assert set(after) == set(before) and all(r.round_trip and r.decoded_sha256 == sha(before[i]) for i, r in after.items())
        docs = out
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(after)
    assert json.dumps(sorted(after))


def test_few_links_are_followed_without_steps(spark, monkeypatch):
    """Classes are those of the steps, and a few links make one table, not several for each step."""
    from riskgrid.llm import components, tables

    r = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (180, 2))] + [(i + 1000, i + 1001) for i in range(40)]
    links = spark.createDataFrame(pairs, "a long, b long")
    made, want = [], {}
    for few in (components.FEW, 10):
        monkeypatch.setattr(components, "FEW", few)
        kinds = []
        monkeypatch.setattr(components, "written", lambda frame, kind, kinds=kinds: (kinds.append(kind), tables.written(frame, kind))[1])
        want[few] = sorted(map(tuple, components.components(links).collect()))
        made.append(kinds)
    assert want[10] == want[1 << 18] and len(want[10]) > 100
    assert made[0] == ["edges", "stars"] and len(made[1]) > 4
    assert components.components(links.where("a < 0")).count() == 0


def test_driver_is_relieved_when_a_table_is_written(spark):
    """The driver's JVM collects all its garbage once a table is written, not when its heap happens to be full."""
    from pyspark.sql import functions as F

    from riskgrid.llm import tables

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    frame = spark.range(100).groupBy((F.col("id") % 7).alias("a")).agg(F.count("*").alias("n"))
    before = whole()
    out = tables.written(frame, "relieved")
    assert whole() > before and sorted(map(tuple, out.collect())) == sorted(map(tuple, frame.collect()))
