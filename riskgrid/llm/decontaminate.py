"""Benchmark decontamination by templates.

Words are stripped of punctuation at their ends and lower-cased; numbers, names (capitalised words that don't begin a sentence)
and units after numbers become typed placeholders. Windows of five template words of the benchmark are joined by hash with those
of the documents (and all windows without placeholders, as texts in one case have no names to tell and windows of numbers or
names only are told by their words), and the values in the slots of matching windows must map to each other one to one: a question that was
asked again with other numbers or names is found, and windows that fit by form alone don't count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.kernel import buffers, chunks, hashes, lower, releasing, tokens, window_starts, windows
from riskgrid.llm.tables import table

WINDOW = 5
#: A window of the form with placeholders counts if so many of its words are words, not slots.
LITERALS = 3
#: A document holds an item if this share of the item's windows, and LEAST at least or all, stand in it consistently.
COVERAGE = 0.4
LEAST = 2
#: The benchmark is sent to the executors in blocks of about so many bytes of text; each block is a pass over the documents.
BLOCK_BYTES = 16 << 20

UNITS = ("%", "percent", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees", "meter", "meters", "metre", "metres")

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
_LETTER = _ALNUM & ~_DIGIT
_UPPER = (np.arange(256) >= 65) & (np.arange(256) < 91)
_LOWERS = ((np.arange(256) >= 97) & (np.arange(256) < 123)) | (np.arange(256) >= 128)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def _word_keys(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(hashes(data, ends - [len(w) for w in words], ends, 5))


_UNIT_KEYS = _word_keys(UNITS)
NUMBER, NAME, UNIT, MEASURE = (np.uint64(x) for x in (0xA11CE0001, 0xA11CE0002, 0xA11CE0003, 0xA11CE0004))


def _isin(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def template(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words with a letter or digit: template hash, whether it is a slot, hash of its value, and the texts' first words."""
    starts, ends, first = tokens(data, offs)
    alnum = np.flatnonzero(_ALNUM[data])
    at = np.searchsorted(alnum, starts)
    has = at < np.searchsorted(alnum, ends)
    if not has.any():
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    begin, end = alnum[at[has]], alnum[np.searchsorted(alnum, ends[has]) - 1] + 1
    # A sentence begins at a text, after a line end, and after a word that ends with a stop.
    fresh = np.zeros(len(starts) + 1, bool)
    fresh[first[:-1]] = True
    fresh[np.searchsorted(starts, np.flatnonzero(data == 10))] = True
    fresh[1:-1] |= _STOP[data[ends[:-1] - 1]]
    fresh = fresh[:-1]
    # Words without a letter or digit are left out, but pass the mark on.
    group = np.cumsum(has) - has
    carried = np.zeros(int(has.sum()) + 1, bool)
    np.logical_or.at(carried, group[fresh], True)
    fresh = carried[:-1]
    value = hashes(lower(data), begin, end, 5)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    n_digits, n_letters = digits[end] - digits[begin], letters[end] - letters[begin]
    number = (n_digits > 0) & (n_letters == 0)
    second = data[np.minimum(begin + 1, end - 1)]
    name = _UPPER[data[begin]] & (end - begin > 1) & _LOWERS[second] & (n_digits == 0) & ~fresh
    after = np.zeros(len(value), bool)
    after[1:] = number[:-1]
    unit = after & _isin(_UNIT_KEYS, value)
    measure = np.zeros(len(value), bool)
    for i in np.flatnonzero((n_digits > 0) & (n_letters > 0) & _DIGIT[data[begin]]):
        word = data[begin[i] : end[i]].tobytes().decode("utf-8", "replace").lower()
        measure[i] = word.lstrip("0123456789.,") in UNITS
    out = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, np.where(measure, MEASURE, value))))
    return out, number | name | unit | measure, value, np.concatenate([[0], np.cumsum(has)])[first]


@dataclass
class Index:
    """Windows of a block of the benchmark."""

    keys: np.ndarray  # sorted hashes of windows
    items: np.ndarray  # item (row of ids) of each
    places: np.ndarray  # first word of each in its item
    sizes: np.ndarray  # by length of windows: which keys have it
    ids: list[int]
    counting: np.ndarray  # whether each has words enough to count in the form with placeholders
    totals: np.ndarray  # windows that count in the form with placeholders, by item
    literal: np.ndarray  # all windows, by item: those of the form without placeholders
    lengths: np.ndarray  # words of a window, by item
    values: list[np.ndarray]
    slots: list[np.ndarray]
    seen: np.ndarray


def _counting(slot: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(~slot)])
    return sums[at + size] - sums[at] >= min(size, LITERALS)


def index(rows: list[tuple[int, str]]) -> Index | None:
    """Windows with too few words besides slots, and items of less than LITERALS words, have no form with placeholders, as that
    can't be told from chance; all windows, of short items the whole item, have the form without."""
    data, offs = buffers(pa.array([t for _, t in rows], pa.large_string()))
    words, slot, value, first = template(data, offs)
    keys, items, places, counting = [], [], [], []
    lengths, totals, literal = (np.zeros(len(rows), np.int64) for _ in range(3))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        size = min(WINDOW, b - a)
        lengths[i] = size
        if not size:
            continue
        at = np.arange(b - a - size + 1)
        counts = _counting(slot[a:b], at, size) & (size >= LITERALS)
        totals[i], literal[i] = counts.sum(), len(at)
        for form, own in ((words, at[counts]), (value, at)):
            keys.append(windows(form[a:b], size)[own])
            items.append(np.full(len(own), i))
            places.append(own)
            counting.append(counts[own])
    if not keys or not sum(map(len, keys)):
        return None
    k, i, p, c = (np.concatenate(x).astype(np.uint64) for x in (keys, items, places, counting))
    k, i, p, c = np.unique(np.stack([k, i, p, c]), axis=1)
    i, p = i.astype(np.int64), p.astype(np.int64)
    order = np.lexsort((p, i, k))
    seen = np.zeros(1 << 22, bool)
    seen[k >> np.uint64(42)] = True
    cut = [slice(int(a), int(b)) for a, b in zip(first[:-1], first[1:], strict=True)]
    return Index(k[order], i[order], p[order], np.unique(lengths[np.unique(i)]), [x for x, _ in rows], c[order].astype(bool), totals, literal, lengths, [value[c] for c in cut], [slot[c] for c in cut], seen)


def _fits(ix: Index, item: int, value: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[int, bool]:
    """Windows of the item that stand consistently among (place in item, place in text), and whether a slot differs.

    Each slot value of the item is held to stand for the value that most windows give it, and no two for one value.
    """
    size = int(ix.lengths[item])
    votes: dict[int, Counter] = defaultdict(Counter)
    read = []
    for p, q in pairs:
        held = [(int(ix.values[item][p + k]), int(value[q + k])) for k in range(size) if ix.slots[item][p + k]]
        read.append((p, held))
        for a, b in held:
            votes[a][b] += 1
    chosen, taken = {}, set()
    for a, c in sorted(votes.items(), key=lambda x: (-max(x[1].values()), x[0])):
        for b, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])):
            if b not in taken:
                chosen[a] = b
                taken.add(b)
                break
    good = {p for p, held in read if all(chosen.get(a) == b for a, b in held)}
    return len(good), any(a != b for a, b in chosen.items())


def matches(ix: Index, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
    """(text, item_id, windows of the item, windows found, whether slots differ) of texts that hold an item."""
    words, slot, value, first = template(data, offs)
    found: dict[tuple[int, int], tuple[int, int, bool]] = {}
    for size in ix.sizes.tolist():
        at, text = window_starts(first, size)
        if not len(at):
            continue
        key = np.concatenate([windows(words, size)[at], windows(value, size)[at]])
        likely = np.flatnonzero(ix.seen[key >> np.uint64(42)])
        key, plain, likely = key[likely], likely >= len(at), likely % len(at)
        low, high = np.searchsorted(ix.keys, key, "left"), np.searchsorted(ix.keys, key, "right")
        count = high - low
        hit = np.repeat(np.arange(len(key)), count)
        if not len(hit):
            continue
        row = np.repeat(low, count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        here, item, place = at[likely[hit]], ix.items[row], ix.places[row]
        own = ix.lengths[item] == size
        here, item, place, of = here[own], item[own], place[own], text[likely[hit]][own]
        counts, same = ix.counting[row][own], plain[hit][own]
        order = np.lexsort((here, place, item, of))
        here, item, place, of, counts, same = here[order], item[order], place[order], of[order], counts[order], same[order]
        new = np.append(True, (item[1:] != item[:-1]) | (of[1:] != of[:-1]))
        cuts = np.append(np.flatnonzero(new), len(of))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i, t = int(item[a]), int(of[a])
            key_ = (t, ix.ids[i])
            # The form with placeholders is tried first, the one without where that finds nothing.
            for own, total in ((counts[a:b], int(ix.totals[i])), (same[a:b], int(ix.literal[i]))):
                need = max(min(LEAST, total), COVERAGE * total)
                p, q = place[a:b][own], here[a:b][own]
                if not total or len(np.unique(p)) < need:
                    continue
                good, differs = _fits(ix, i, value, list(zip(p.tolist(), q.tolist(), strict=True)))
                if good >= need:
                    found[key_] = max(found.get(key_, (0, 0, False)), (good, total, differs))
                    break
    return [(t, i, total, good, differs) for (t, i), (good, total, differs) in sorted(found.items())]


def blocks(benchmark: DataFrame):
    """Indexes of the benchmark (item_id, text), block by block; rows without id or text are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect() if n > 1 else rows.collect()
        if (ix := index(sorted((r.item_id, r.text) for r in part))) is not None:
            yield ix


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, reparameterised: a row for each document and item that it holds.

    Null and empty texts hold none; rows that repeat are each reported; an empty table on either side gives an empty result.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, n_windows long, n_matched long, coverage double, reparameterised boolean"
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for ix in blocks(benchmark):
        held = spark.sparkContext.broadcast(ix)

        def run(batches, held=held):
            for batch in batches:
                for i, _, data, offs in chunks(*buffers(batch.column(1))):
                    if got := matches(held.value, data, offs):
                        text, item, total, good, differs = zip(*got, strict=True)
                        columns = [batch.column(0).take(pa.array([i + t for t in text])), pa.array(item, pa.int64()), pa.array(total, pa.int64()), pa.array(good, pa.int64()), pa.array([g / t for g, t in zip(good, total, strict=True)]), pa.array(differs)]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_windows", "n_matched", "coverage", "reparameterised"])

        part = chosen.mapInArrow(releasing(run), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the documents that hold no item of the benchmark, with all their columns."""
    spark, out = documents.sparkSession, documents
    at = documents.columns.index(text)
    for ix in blocks(benchmark):
        held = spark.sparkContext.broadcast(ix)

        def run(batches, held=held):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, data, offs in chunks(*buffers(batch.column(at))):
                    keep[[i + m[0] for m in matches(held.value, data, offs)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(releasing(run), documents.schema)
    return out


def leaks(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
