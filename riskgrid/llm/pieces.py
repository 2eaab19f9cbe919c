"""SentencePiece encoding and decoding by batched numpy Viterbi.

The vocabulary comes from a SentencePiece model file whose path is a parameter. Scores of a BPE model are merge priorities and
no log-probabilities, so pieces get those of Zipf's law over the model's order: -log(rank) - log(sum of 1/rank). A text is prefixed with a space
and cut into words where no piece can span: before a run of spaces, and around line ends. Distinct words of equal length
advance together through the Viterbi recursion: the hash of every substring that ends at a position is looked up in the
sorted piece keys, and a vectorised maximum over the starts stores the back pointers. Long words advance together in slices
of equal length, chained by the best scores between their ends. A character without a piece of its own
costs the lowest score less 10 and is written as byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.kernel import buffers, byte_table, chunks, gather, hashes, mapper, mix, powers, ramp
from riskgrid.llm.tables import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Words of more bytes go through the recursion in slices, so many at a time.
LONG = 256
SLICE, SLICES = 256, 64
#: Scores are multiples of 2**-SCALE, so that sums of them are exact and ties are ties in any order of summation.
SCALE = 20
_BASE = 0x9E3779B97F4A7C15
_SEEN_BITS = 20
_CHUNK = 4 << 20


@dataclass
class Vocabulary:
    keys: np.ndarray  # sorted hashes of the pieces
    ids: np.ndarray  # their ids, in the order of keys
    scores: np.ndarray
    seen: np.ndarray  # by the first bits of a key: whether a piece's key begins so
    longest: int
    byte_ids: np.ndarray  # id of the piece of each byte
    unknown: float  # score of a character without a piece
    data: np.ndarray  # what each id is decoded to
    offs: np.ndarray


@lru_cache
def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, normal, byte_ids = [], [], np.full(256, -1, np.int32)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            # A space stands for the mark of a space; no piece holds a real one.
            texts.append(piece.replace("▁", " ").encode())
            normal.append(i)
    if any(b" " in texts[i].lstrip(b" ") for i in normal) or any(b"\n" in texts[i] for i in normal) or (byte_ids < 0).any():
        raise ValueError("a model with byte pieces, and with spaces only at the front of pieces, is needed")
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    chosen = np.array(normal)
    keys = hashes(data, offs[chosen], offs[chosen + 1])
    order = np.argsort(keys)
    if (np.diff(keys[order]) == 0).any():
        raise ValueError("two pieces have one key")
    given = np.array([model.get_score(int(i)) for i in chosen])
    rank = np.empty(len(chosen))
    rank[np.lexsort((chosen, -given))] = np.arange(1, len(chosen) + 1)
    scores = np.round(np.ldexp(-np.log(rank) - np.log((1 / rank).sum()), SCALE)) / (1 << SCALE)
    seen = np.zeros(1 << _SEEN_BITS, bool)
    seen[keys >> np.uint64(64 - _SEEN_BITS)] = True
    return Vocabulary(keys[order], chosen[order].astype(np.int32), scores[order], seen, int(np.diff(offs)[chosen].max()), byte_ids, float(scores.min()) - UNKNOWN_PENALTY, data, offs)


def probe(v: Vocabulary, key: np.ndarray) -> np.ndarray:
    """Places of keys among the piece keys, -1 for none."""
    out = np.full(key.shape, -1, np.int64)
    likely = v.seen[key >> np.uint64(64 - _SEEN_BITS)]
    some = key[likely]
    at = np.minimum(np.searchsorted(v.keys, some), len(v.keys) - 1)
    out[likely] = np.where(v.keys[at] == some, at, -1)
    return out


def _viterbi(v: Vocabulary, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words of equal length (a row each): tokens one after another, and how many each word has."""
    n, length = words.shape
    up, down = powers(_BASE, length + 1)
    sums = np.zeros((length + 1, n), np.uint64)
    np.cumsum((byte_table(1)[words] * up[:length]).T, axis=0, out=sums[1:])
    first = (words & 0xC0) != 0x80  # a character begins here
    begins = np.concatenate([first, np.ones((n, 1), bool)], axis=1).T
    width = np.zeros((length, n), np.int64)  # of the character that begins here
    after = np.full(n, length)
    for i in range(length - 1, -1, -1):
        width[i] = after - i
        after = np.where(begins[i], i, after)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    start, token = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
    for j in range(1, length + 1):
        low = max(0, j - v.longest)
        span = np.arange(low, j)
        key = mix(((sums[j] - sums[low:j]) * down[low:j, None]) ^ (j - span).astype(np.uint64)[:, None])
        found = probe(v, key)
        hit = (found >= 0) & begins[low:j] & begins[j]
        score = np.where(hit, v.scores[found], -np.inf) + best[low:j]
        alone = (width[low:j] == (j - span)[:, None]) & begins[low:j]
        lost = alone & ~hit
        score = np.where(lost, v.unknown + best[low:j], score)
        top = score.argmax(axis=0)  # the first of equals: the longest last piece
        pick = np.arange(n)
        best[j] = score[top, pick]
        start[j] = low + top
        token[j] = np.where(hit[top, pick], found[top, pick], -1)
    return _trace(v, words, start, token)


def _trace(v: Vocabulary, words: np.ndarray, start: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, length = words.shape
    at, live, steps = np.full(n, length), np.arange(n), []
    while len(live):
        end = at[live]
        steps.append((live, start[end, live], end, token[end, live]))
        at[live] = start[end, live]
        live = live[at[live] > 0]
    word, begin, end, piece = (np.concatenate([s[k] for s in steps]) for k in range(4))
    order = np.lexsort((begin, word))
    word, begin, end, piece = word[order], begin[order], end[order], piece[order]
    tokens, counts = _spell(v, words.ravel(), begin + word * length, end + word * length, piece)
    return tokens, np.bincount(word, weights=counts, minlength=n).astype(np.int64)


def _spell(v: Vocabulary, data: np.ndarray, begin: np.ndarray, end: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the steps of paths, and how many each step has: its piece, or the bytes of a character without one."""
    lost = piece < 0
    counts = np.where(lost, end - begin, 1)
    out = np.repeat(np.where(lost, 0, v.ids[piece]), counts)
    raw = np.repeat(lost, counts)
    out[raw] = v.byte_ids[data[(ramp(counts) + np.repeat(begin, counts))[raw]]]
    return out.astype(np.int32), counts


def _edges(v: Vocabulary, data: np.ndarray, begins: np.ndarray, word: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Of what can end at lo + 1 to hi, by its length from 1 on: piece (-1 for none) and score. ``word`` is where the word begins
    that holds a byte."""
    at = max(0, lo - v.longest)
    up, down = powers(_BASE, hi - at + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_table(1)[data[at:hi]] * up[: hi - at])])
    ends = np.arange(lo + 1, hi + 1)
    piece, score = np.full((v.longest, hi - lo), -1, np.int32), np.full((v.longest, hi - lo), -np.inf)
    last = np.maximum.accumulate(np.where(begins[at:hi], np.arange(at, hi), -1))[ends - 1 - at]  # where the last character begins
    for size in range(1, v.longest + 1):
        ok = np.flatnonzero((ends - size >= word[ends - 1]) & begins[ends - size] & begins[ends])
        starts = ends[ok] - size
        found = probe(v, mix(((sums[starts + size - at] - sums[starts - at]) * down[starts - at]) ^ np.uint64(size)))
        piece[size - 1, ok] = found
        score[size - 1, ok] = np.where(found >= 0, v.scores[found], np.where(last[ok] == starts, v.unknown, -np.inf))
    return piece, score


def _sliced(v: Vocabulary, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of long words, which stand one after another, and how many each word has.

    Slices of equal length advance together, twice. First from every place where a path can enter a slice, which gives the
    best score from each way in to each way out; over these the slices are chained. Then from the scores that the ways in
    have by then, which gives each place the score and the back pointer of one unbroken recursion: scores are multiples of
    a power of two, so sums are exact in any order.
    """
    total = len(data)
    begins = np.append((data & 0xC0) != 0x80, True)
    word = np.repeat(np.cumsum(lengths) - lengths, lengths)
    reach = np.full(v.longest, -np.inf)  # best scores of the last places
    reach[-1] = 0
    back, token = np.zeros(total, np.uint8), np.full(total, -1, np.int32)
    for lo in range(0, total, SLICE * SLICES):
        hi = min(total, lo + SLICE * SLICES)
        n = -(-(hi - lo) // SLICE)
        piece, score = _edges(v, data, begins, word, lo, hi)
        width = max(1, v.longest - int((score > -np.inf).any(axis=1)[::-1].argmax()))
        steps = np.full((width, n * SLICE), -np.inf)
        steps[:, : hi - lo] = score[width - 1 :: -1]  # the longest first
        steps = steps.reshape(width, n, SLICE)
        ways = np.full((width + SLICE, n, width), -np.inf)
        ways[np.arange(width), :, np.arange(width)] = 0
        for j in range(SLICE):
            ways[width + j] = (ways[j : width + j] + steps[:, :, j, None]).max(axis=0)
        best = np.empty((width + SLICE, n))
        into = reach[-width:]
        for k in range(n):
            best[:width, k] = into
            into = (ways[SLICE:, k] + into).max(axis=1)
        pick, own = np.empty((SLICE, n), np.int64), np.arange(n)
        for j in range(SLICE):
            options = best[j : width + j] + steps[:, :, j]
            pick[j] = options.argmax(axis=0)  # the first of equals: the longest last piece
            best[width + j] = options[pick[j], own]
        back[lo:hi] = (width - pick).T.ravel()[: hi - lo]
        token[lo:hi] = piece[back[lo:hi] - 1, np.arange(hi - lo)]
        reach = np.concatenate([reach, best[width:].T.ravel()[: hi - lo]])[-v.longest :]
    ends, at = [], total
    sizes = back.tobytes()
    while at > 0:
        ends.append(at)
        at -= sizes[at - 1]
    end = np.array(ends[::-1], np.int64)
    begin = end - back[end - 1]
    tokens, counts = _spell(v, data, begin, end, token[end - 1])
    return tokens, np.bincount(np.searchsorted(np.cumsum(lengths), begin, "right"), weights=counts, minlength=len(lengths)).astype(np.int64)


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text with a space before it, the starts of its words, and the new offsets."""
    n = len(offs) - 1
    at = offs + np.arange(n + 1)
    out = np.full(at[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offs))] = data
    space, line = out == 32, out == 10
    begin = space | line
    begin[1:] &= ~(space[1:] & space[:-1])  # in a run of spaces only the first
    begin[1:] |= line[:-1]  # and what follows a line end
    begin[at[:-1]] = True
    return out, np.flatnonzero(begin), at


def encode_words(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the words, and how many each has; each distinct word is worked on once."""
    keys = hashes(data, starts, ends)
    _, one, inverse = np.unique(keys, return_index=True, return_inverse=True)
    lengths = (ends - starts)[one]
    counts = np.zeros(len(one), np.int64)
    pools, where = [], np.zeros(len(one), np.int64)
    size = 0
    order = np.argsort(lengths, kind="stable")
    short = int(np.searchsorted(lengths[order], LONG, "right"))

    def put(part: np.ndarray, tokens: np.ndarray, c: np.ndarray) -> int:
        counts[part] = c
        where[part] = size + np.cumsum(c) - c
        pools.append(tokens)
        return size + len(tokens)

    cuts = np.flatnonzero(np.diff(lengths[order[:short]])) + 1
    for group in np.split(order[:short], cuts) if short else ():
        length = int(lengths[group[0]])
        room = max(1, (4 << 20) // (length * (v.longest + 8) * 8))
        for k in range(0, len(group), room):
            part = group[k : k + room]
            size = put(part, *_viterbi(v, data[starts[one[part]][:, None] + np.arange(length)]))
    if short < len(order):
        part = order[short:]
        size = put(part, *_sliced(v, gather(data, starts[one[part]], lengths[part]), lengths[part]))
    pool = np.concatenate(pools) if pools else np.zeros(0, np.int32)
    return gather(pool, where[inverse], counts[inverse]), counts[inverse]


def encode(v: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the texts one after another, and their offsets. An empty text is its space alone."""
    spaced, starts, at = cut(data, offs)
    tokens, counts = encode_words(v, spaced, starts, np.concatenate([starts[1:], at[-1:]]))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return tokens, ends[np.searchsorted(starts, at)]


def decode(v: Vocabulary, tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, without the space that encoding put before each."""
    lengths = (v.offs[1:] - v.offs[:-1])[tokens]
    data = gather(v.data, v.offs[tokens], lengths)
    at = np.concatenate([[0], np.cumsum(lengths)])[offs]
    keep = np.ones(len(data), bool)
    spaced = at[:-1][np.diff(at) > 0]
    keep[spaced] = data[spaced] != 32
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def encoded(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids array<int>: the tokens of every whole text (null: empty)."""
    v = load(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [encode(v, data, offs) for _, _, data, offs in chunks(*buffers(batch.column(1)), limit=_CHUNK)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.concatenate([np.diff(at) for _, at in parts])]), pa.int32()), pa.array(np.concatenate([t for t, _ in parts]), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mapper(run), "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    v = load(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(1)
        at = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        tokens, texts = ids.flatten().to_numpy(zero_copy_only=False), []
        for i, j, part, own in chunks(tokens, at, limit=_CHUNK >> 2):
            data, offs = decode(v, part, own)
            texts += [data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace") for k in range(j - i)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(mapper(run), "doc_id long, text string")


def digests(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_byte_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, round_trip.

    Every whole text is encoded and decoded again; a null text counts as empty. Rows that repeat are kept; an empty table
    gives an empty one; columns other than doc_id and text aren't read.
    """
    v = load(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for _, _, data, offs in chunks(*buffers(batch.column(1)), limit=_CHUNK):
            tokens, at = encode(v, data, offs)
            back, ends = decode(v, tokens, at)
            spelled = np.concatenate([[0], np.cumsum(np.isin(tokens, v.byte_ids))])[at]
            for i in range(len(offs) - 1):
                text, again = data[offs[i] : offs[i + 1]], back[ends[i] : ends[i + 1]]
                rows.append((len(text), int(at[i + 1] - at[i]), int(spelled[i + 1] - spelled[i]), hashlib.sha256(tokens[at[i] : at[i + 1]]).hexdigest(), hashlib.sha256(again).hexdigest(), len(text) == len(again) and bool((text == again).all())))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        names = ["n_bytes", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(mapper(run), "doc_id long, n_bytes long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def round_trip(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
