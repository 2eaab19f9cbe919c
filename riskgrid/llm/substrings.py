"""Substring dedup: repeated windows of words, found with a count-min prefilter.

A window is 20 consecutive words. Its anchor is the occurrence of the smallest hash among its runs of 8 words, the leftmost
of equals: equal windows have equal anchors at the same place, and one window in seven or so brings a new anchor. First pass:
each partition counts its anchors in a count-min sketch whose counters stop at two; partition sketches are merged block by
block. An anchor is counted for each of its occurrences, so a window that occurs twice is never estimated below two. Second
pass: windows whose anchor is estimated repeated are grouped exactly, by 96 bits of hash; of a window that a few megabytes of
text hold several times only the first takes part, the later ones are already known to be repeats, so a hot window costs a
row for each such stretch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.kernel import buffers, chunks, gather, hashes, mapper, mix, ramp, tokens, window_starts, windows
from riskgrid.llm.tables import key, table

WINDOW = 20
GRAM = 8
#: Rows of the sketch. Cells of a row: a power of two near a cell for each 8 bytes of text, but at most MOST, so the merged
#: sketch, a bit a cell, is 64 MB at most. Beyond about 5 GB of text it lets more windows through; results stay the same.
DEPTH = 2
LEAST, MOST = 1 << 20, 1 << 28
BLOCK = 1 << 20
#: Bytes of packed windows aimed at in a task of the second pass.
TASK_BYTES = 64 << 20
#: Bytes of text whose windows are brought together before they are dealt out: of equal ones only the first goes on.
GATHER_BYTES = 8 << 20

#: tag: a hash of the text, which tells rows apart that share a doc_id.
_RECORD = np.dtype([("h", "<u8"), ("check", "<u4"), ("start", "<u4"), ("doc", "<i8"), ("tag", "<i4")])


def _least(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values the place of its smallest, the leftmost of equals."""
    place, width = np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(grams[b] < grams[a], b, a)
        width += step
    return place


def anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows' starts (word index), texts, and anchors (index into the fourth), and the anchors' hashes, one for each occurrence."""
    starts, text = window_starts(first, window)
    if not len(starts):
        return starts, text, starts, np.zeros(0, np.uint64)
    grams = windows(words, gram)
    place = _least(grams, window - gram + 1)[starts]
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    return starts, text, np.cumsum(new) - 1, grams[place[new]]


def _cells(anchor: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(anchor + np.uint64(row * 0x632BE59BD9B4E019 & (1 << 64) - 1)) & np.uint64(width - 1)).astype(np.int64)


class Sketch:
    """Count-min counters that stop at two, as two bit planes for each row: seen once, and seen twice."""

    def __init__(self, width: int, depth: int = DEPTH):
        self.width, self.once, self.twice = width, np.zeros((depth, width // 8), np.uint8), np.zeros((depth, width // 8), np.uint8)

    def add(self, anchor: np.ndarray) -> None:
        for r in range(len(self.once)):
            cells = np.sort(_cells(anchor, r, self.width))
            if len(cells):
                again = np.flatnonzero(cells[1:] == cells[:-1])
                self._set(r, np.unique(cells), np.unique(cells[again]))

    def _set(self, r: int, cells: np.ndarray, double: np.ndarray) -> None:
        for c in (cells, double):  # the cells of ``double`` are then seen for the second time
            if len(c):
                at, bits = _bits(c)
                self.twice[r][at] |= self.once[r][at] & bits
                self.once[r][at] |= bits

    def blocks(self):
        """(row, block, positions) of what isn't empty: positions with the highest bit where seen twice, or both planes."""
        size = min(BLOCK, self.width) // 8
        for r in range(len(self.once)):
            for b in range(self.width // 8 // size):
                once, twice = self.once[r, b * size : (b + 1) * size], self.twice[r, b * size : (b + 1) * size]
                if once.any():
                    n = int(np.bitwise_count(once).sum())
                    if n * 4 < size * 2:
                        at = np.flatnonzero(np.unpackbits(once, bitorder="little")).astype(np.uint32)
                        double = twice[at >> 3] >> (at & 7).astype(np.uint8) & 1
                        yield r, b, (at | double.astype(np.uint32) << 31).tobytes()
                    else:
                        yield r, b, once.tobytes() + twice.tobytes()


def _bits(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of sorted cells, and the bits in each."""
    at = cells >> 3
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[new], np.bitwise_or.reduceat(np.left_shift(1, cells & 7).astype(np.uint8), new)


def _planes(payload: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(payload) == 2 * size:
        both = np.frombuffer(payload, np.uint8)
        return both[:size], both[size:]
    values = np.frombuffer(payload, np.uint32)
    cells, out = (values & 0x7FFFFFFF).astype(np.int64), []
    for c in (cells, cells[values >> 31 == 1]):
        plane = np.zeros(size, np.uint8)
        if len(c):
            at, bits = _bits(c)
            plane[at] = bits
        out.append(plane)
    return out[0], out[1]


def _tag(documents: DataFrame) -> F.Column:
    return F.hash(documents["text"])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(key(documents).alias("k"), _tag(documents).alias("tag"), "text")


def sketch_width(text_bytes: int) -> int:
    return min(MOST, max(LEAST, 1 << max(0, (text_bytes // 8 - 1)).bit_length()))


def sketch(documents: DataFrame, width: int, depth: int = DEPTH) -> np.ndarray:
    """The merged sketch, rows x bits packed in bytes: 1 where a counter reached two."""
    size = min(BLOCK, width) // 8

    def count(batches):
        own = Sketch(width, depth)
        for batch in batches:
            for _, _, data, offs in chunks(*buffers(batch.column(0))):
                s, e, first = tokens(data, offs)
                own.add(anchors(hashes(data, s, e), first)[3])
        for r, b, payload in own.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([payload], pa.binary())], names=["r", "b", "payload"])

    def merge(batches):
        """The rows come in order of (r, b), so one block is held at a time."""
        key, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["r", "b", "twice"])

        for batch in batches:
            for r, b, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (r, b):
                    if key is not None:
                        yield done()
                    key, once, twice = (r, b), np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                o, t = _planes(payload, size)
                twice |= t | once & o
                once |= o
        if key is not None:
            yield done()

    parts = documents.select("text").mapInArrow(count, "r int, b int, payload binary")
    merged = parts.repartition("r", "b").sortWithinPartitions("r", "b").mapInArrow(merge, "r int, b int, twice binary")
    out = np.zeros((depth, width // 8), np.uint8)
    for row in merged.collect():
        out[row.r, row.b * size : (row.b + 1) * size] = np.frombuffer(row.twice, np.uint8)
    return out


def estimated_repeated(anchor: np.ndarray, sketched: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchor), bool)
    for r in range(len(sketched)):
        cell = _cells(anchor, r, sketched.shape[1] * 8)
        out &= (sketched[r][cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _later(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted records, and which of them have an equal window that starts earlier."""
    order = np.lexsort((records["start"], records["tag"], records["doc"], records["check"], records["h"]))
    r = records[order]
    new = np.ones(len(r), bool)
    new[1:] = (r["h"][1:] != r["h"][:-1]) | (r["check"][1:] != r["check"][:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return r, (r["doc"] != r["doc"][first]) | (r["tag"] != r["tag"][first]) | (r["start"] != r["start"][first])


def _by_document(records: np.ndarray) -> pa.RecordBatch:
    """Starts of repeated windows by document: runs of (first start, number), as 32-bit numbers."""
    r = records[np.lexsort((records["start"], records["tag"], records["doc"]))]
    start = r["start"].astype(np.int64)
    new = np.ones(len(r), bool)
    new[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["tag"][1:] != r["tag"][:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    runs = np.stack([start[at], start[np.append(at[1:], len(r)) - 1] - start[at] + 1], axis=1).astype("<u4")
    docs, tags = r["doc"][at], r["tag"][at]
    cut = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])))
    ends = np.append(cut[1:], len(docs))
    column = pa.array([runs[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), -1), pa.int32()), pa.array(docs[cut]), pa.array(tags[cut]), column], names=["bucket", "k", "tag", "payload"])


def repeats(documents: DataFrame, sketched: np.ndarray, text_bytes: int) -> DataFrame:
    """k, tag, payload: for each document packed runs of starts of windows that occur earlier; a document may have several rows.

    Windows are dealt out by their anchors, so those that follow each other mostly meet in one bucket and leave it as one run;
    by their own hashes, each would be a row of its own. A window that all documents share costs its bucket a row for each
    stretch of GATHER_BYTES; a phrase with many different windows around it makes its bucket larger than others.
    """
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(sketched)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes * 4 // TASK_BYTES))

    def candidates(batches):
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            kept, keys, size = [], [], 0
            for i, j, data, offs in chunks(*buffers(batch.column(2))):
                s, e, first = tokens(data, offs)
                words = hashes(data, s, e)
                starts, text, of, anchor = anchors(words, first)
                go = estimated_repeated(anchor, held.value)[of]
                at, text = starts[go], text[go]
                out = np.empty(len(at), _RECORD)
                if len(at):
                    out["h"] = windows(words, WINDOW)[at]
                    out["check"] = (windows(mix(words ^ np.uint64(0x2545F4914F6CDD1D)), WINDOW)[at] >> np.uint64(32)).astype(np.uint32)
                out["start"] = at - first[text]
                out["doc"], out["tag"] = ids[i + text], tags[i + text]
                kept.append(out)
                keys.append((mix(anchor)[of[go]] % np.uint64(buckets)).astype(np.int32))
                size += len(data)
                if size >= GATHER_BYTES or j == len(ids):
                    yield from dealt_out(np.concatenate(kept), np.concatenate(keys))
                    kept, keys, size = [], [], 0

    def dealt_out(records, bucket):
        """Packed records by bucket, each window once; and, by document, the windows that are repeats already."""
        if not len(records):
            return
        order = np.lexsort((records["start"], records["tag"], records["doc"], records["check"], records["h"]))
        bucket = bucket[order]
        r, later = _later(records)  # in the same order
        if later.any():
            yield _by_document(r[later])
        r, bucket = r[~later], bucket[~later]
        order = np.lexsort((r["start"], r["tag"], r["doc"], bucket))
        r, bucket = r[order], bucket[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        packed = [_pack(r[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.nulls(len(packed), pa.int64()), pa.nulls(len(packed), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "k", "tag", "payload"])

    def settle(batches):
        held_here = []
        for batch in batches:
            known = batch.column(1).is_valid()
            if known.true_count:
                yield batch.filter(known)
            held_here += [_unpack(p.as_buffer()) for p in batch.filter(pa.compute.invert(known)).column(3)]
        if held_here:
            r, later = _later(np.concatenate(held_here))
            if later.any():
                yield _by_document(r[later])

    import pyarrow.compute  # noqa: F401

    parts = _texts(documents).mapInArrow(candidates, "bucket int, k long, tag int, payload binary")
    # What is settled already is spread by document; the rest meets in its bucket.
    dealt = parts.repartition(buckets, F.when(F.col("k").isNull(), F.col("bucket").cast("long")).otherwise(F.xxhash64("k", "tag")))
    return dealt.mapInArrow(settle, "bucket int, k long, tag int, payload binary").select("k", "tag", "payload")


def _pack(r: np.ndarray) -> bytes:
    """Columns one after another: documents and starts as differences in wrapping arithmetic, which compress well."""
    start = r["start"].astype(np.uint32)
    doc = r["doc"].astype(np.int64)
    tag = r["tag"].astype(np.int32)
    return b"".join([np.diff(doc, prepend=np.int64(0)).tobytes(), np.diff(start, prepend=np.uint32(0)).tobytes(), r["check"].tobytes(), np.diff(tag, prepend=np.int32(0)).tobytes(), r["h"].tobytes()])


def _unpack(payload) -> np.ndarray:
    n = len(payload) // _RECORD.itemsize
    out = np.empty(n, _RECORD)
    out["doc"] = np.cumsum(np.frombuffer(payload, "<i8", n))
    out["start"] = np.cumsum(np.frombuffer(payload, "<u4", n, 8 * n), dtype=np.uint32)
    out["check"] = np.frombuffer(payload, "<u4", n, 12 * n)
    out["tag"] = np.cumsum(np.frombuffer(payload, "<i4", n, 16 * n), dtype=np.int32)
    out["h"] = np.frombuffer(payload, "<u8", n, 20 * n)
    return out


def covered(lists: list, first: np.ndarray, total: int, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a repeated window, from each text's payloads."""
    edge = np.zeros(total + 1, np.int64)
    for text, payloads in enumerate(lists):
        for p in payloads or ():
            runs = np.frombuffer(p, "<u4").reshape(-1, 2).astype(np.int64)
            begin = first[text] + runs[:, 0]
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + runs[:, 1] - 1 + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words, each followed by a space, and the offsets of the texts."""
    lengths = ends[keep] - starts[keep] + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = gather(np.append(data, np.uint8(32)), starts[keep], lengths)
    out[at[1:] - 1] = 32
    return out.tobytes(), at[np.concatenate([[0], np.cumsum(keep)])[first]]


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every whole text; kept words are joined by one space.

    A word is removed if a window of 20 words covers it that also starts earlier: in a row with a smaller doc_id, or earlier
    in the row. A null or empty text, or one of less than 20 words, has no window and loses nothing. Rows that repeat a
    doc_id with the same text count as one place; with another text, the order of the texts' hashes decides; rows without
    doc_id come after all others, by a hash of the text. A text may be of any length below 2**32 words. An empty table gives
    an empty one; columns other than doc_id and text, whatever their names, aren't read.
    """
    return _finish(documents, True)


def _finish(documents: DataFrame, texts: bool) -> DataFrame:
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketched = sketch(documents, sketch_width(total))
    lost = repeats(documents, sketched, total).groupBy("k", "tag").agg(F.collect_list("payload").alias("lost"))
    joined = documents.select(F.col("doc_id").cast("long").alias("doc_id"), key(documents).alias("k"), _tag(documents).alias("tag"), "text").join(lost, ["k", "tag"], "left")

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2).to_pylist()
        words, removed, kept = [], [], []
        for i, j, data, offs in chunks(*buffers(batch.column(1))):
            s, e, first = tokens(data, offs)
            gone = covered(lists[i:j], first, len(s))
            text, at = _kept(data, s, e, first, ~gone)
            sums = np.concatenate([[0], np.cumsum(gone)])[first]
            words += np.diff(first).tolist()
            removed += np.diff(sums).tolist()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                one = text[a : max(a, b - 1)]
                kept.append(one.decode("utf-8", "replace") if texts else hashlib.sha256(one).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    name = "kept_text" if texts else "kept_sha256"
    return joined.select("doc_id", "text", "lost").mapInArrow(mapper(apply), f"doc_id long, n_words long, n_removed long, {name} string")


def digests(spark, sf_dir: str) -> DataFrame:
    return _finish(table(spark, sf_dir, "documents"), False)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d WHERE len(ws) >= 20),
w AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s : s + 19], ' ') ORDER BY doc_id, s) AS n FROM p),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM w, (SELECT unnest(range(0, 20)) AS k) WHERE n > 1),
l AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT l.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(l.word, ' ' ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept
      FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
