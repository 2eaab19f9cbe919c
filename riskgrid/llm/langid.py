"""Language identification by a string kernel.

Kernel: blended-spectrum presence. A text is the set of its byte n-grams of one to three bytes (letters lower-cased, other
ASCII bytes merged into one), k(x, z) = |x & z| / sqrt(|x| |z|). Nystrom landmarks give finite features, one-versus-rest
kernel ridge regression is solved in closed form, and scoring is a product of presence matrices with the landmarks' matrix.
The n-grams considered are those that occur in a landmark; others can't change |x & z|.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.kernel import buffers, chunks, mapper
from riskgrid.llm.tables import table

#: The classifier is fitted on this many labelled rows of a language at most, those with the smallest hash of doc_id ...
SAMPLE = 400
#: ... of which so many are landmarks, short texts first.
LANDMARKS = 24
LANDMARK_CHARS = 4000
#: A labelled table may name so many languages at most.
MOST_LANGUAGES = 2000
RIDGE = 1e-3
SHARPNESS = 8.0
UNDETERMINED = "und"

_CLASSES = np.zeros(256, np.int32)
_CLASSES[97:123] = _CLASSES[65:91] = np.arange(1, 27)
_CLASSES[128:] = np.arange(27, 155)
_A = 155
_CHUNK = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    columns: list[np.ndarray]  # for n = 1, 2, 3: the dictionary column of each n-gram code, or the last, unused one
    size: int
    landmarks: np.ndarray  # dictionary x landmarks, each column divided by the root of its count
    weights: np.ndarray  # landmarks x languages


def _codes(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams that begin at each byte, -1 where one would leave its text."""
    c = _CLASSES[data]
    out = [c]
    for n in (2, 3):
        code = np.full(len(c), -1, np.int32)
        if len(c) >= n:
            code[: 1 - n] = out[-1][: 1 - n] * _A + c[n - 1 :] if n == 2 else (c[:-2] * _A + c[1:-1]) * _A + c[2:]
        for back in range(1, n):
            at = offs[1:] - back
            code[at[at >= 0]] = -1
        out.append(code)
    return out


def presence(data: np.ndarray, offs: np.ndarray, columns: list[np.ndarray], size: int) -> np.ndarray:
    """Texts x dictionary, 1 where the n-gram occurs."""
    out = np.zeros((len(offs) - 1) * (size + 1), bool)
    row = np.repeat(np.arange(len(offs) - 1) * (size + 1), np.diff(offs))
    for codes, column in zip(_codes(data, offs), columns, strict=True):
        out[row + column[codes]] = True  # code -1 is the last entry, the unused column
    return out.reshape(-1, size + 1)[:, :size]


def kernel(data: np.ndarray, offs: np.ndarray, columns: list[np.ndarray], size: int, landmarks: np.ndarray) -> np.ndarray:
    parts = []
    for _, _, part, at in chunks(data, offs, _CHUNK, 256):
        x = presence(part, at, columns, size).astype(np.float32)
        parts.append((x @ landmarks) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None])
    return np.concatenate(parts) if parts else np.zeros((0, landmarks.shape[1]), np.float32)


def grams(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The distinct n-gram codes of each text, n = 1, 2, 3: of bounded size, however long the text."""
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        out.append(tuple(np.unique(c[c >= 0]).astype(np.int32) for c in _codes(data[a:b], np.array([0, b - a]))))
    return out


def dictionary(texts: list[tuple[np.ndarray, ...]]) -> tuple[list[np.ndarray], int, np.ndarray]:
    """Columns of the n-gram codes, their number, and the landmarks' matrix, from the distinct codes of each landmark."""
    columns, size = [], 0
    for n in (1, 2, 3):
        known = np.unique(np.concatenate([t[n - 1] for t in texts]))
        column = np.full(_A**n + 1, -1, np.int32)
        column[known] = np.arange(size, size + len(known))
        columns.append(column)
        size += len(known)
    for column in columns:
        column[column < 0] = size
    z = np.zeros((len(texts), size), np.float32)
    for row, text in zip(z, texts, strict=True):
        for column, codes in zip(columns, text, strict=True):
            row[column[codes]] = 1
    return columns, size, (z / np.sqrt(np.maximum(z.sum(axis=1), 1))[:, None]).T.copy()


def solve(k_zz: np.ndarray, k_xz: np.ndarray, labels: np.ndarray, classes: int, ridge: float) -> np.ndarray:
    """Weights on k(x, landmarks) of one-versus-rest kernel ridge regression in the Nystrom space; classes count alike."""
    values, vectors = np.linalg.eigh(k_zz.astype(np.float64))
    keep = values > 1e-6 * max(values[-1], 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k_xz.astype(np.float64) @ root
    target = np.where(labels[:, None] == np.arange(classes), 1.0, -1.0)
    weight = (1 / np.maximum(np.bincount(labels, minlength=classes), 1))[labels][:, None]
    gram = phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1])
    return (root @ np.linalg.solve(gram, phi.T @ (target * weight))).astype(np.float32)


def least_hashes(usable: DataFrame, sample: int) -> dict[str, list[int]]:
    """For each language the ``sample`` numbers doc_id with the smallest hashes, in that order.

    Rows are counted by language, and only those whose hash lies below a bound come to the driver: it lets four times the
    sample of a language through on average, and is raised where that was too few. No language's rows meet in a task.
    """
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"labels of at most {MOST_LANGUAGES} languages are expected")
    out: dict[str, list[int]] = {}
    share = 4
    while rest := {lang: n for lang, n in counts.items() if lang not in out}:
        bounds = {lang: (1 << 63) - 1 if share * sample >= n else int(share * sample / n * (1 << 64)) - (1 << 63) for lang, n in rest.items()}
        bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]
        below = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).where(F.col("h") <= bound).distinct()
        found = defaultdict(list)
        for r in below.collect():
            found[r.lang].append((r.h, r.doc_id))
        for lang, n in rest.items():
            if len(found[lang]) >= sample or share * sample >= n:
                out[lang] = [i for _, i in sorted(found[lang])[:sample]]
        share *= 8  # rows that repeat a doc_id count once, so it may take more
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from labelled rows (doc_id, text, lang); None if no row has a number, a label, and a text with a letter.

    The fit uses at most ``sample`` rows of a language, chosen by the hash of doc_id over all rows (of rows that repeat a
    doc_id the smallest text); their kernel values are computed on the executors, so the driver gets ``sample`` x ``landmarks``
    numbers a language and the landmarks' distinct n-grams.
    """
    usable = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("doc_id is not null and lang is not null and text is not null")
    chosen = least_hashes(usable, sample)
    if not chosen:
        return None
    spark = labelled.sparkSession
    known = F.broadcast(spark.createDataFrame([(i, lang) for lang, ids in chosen.items() for i in ids], "doc_id long, lang string"))
    rows = usable.join(known, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    able = rows.select("doc_id", "lang", F.length("text").alias("n"), F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]").alias("letter")).collect()
    candidates = defaultdict(list)
    for r in able:
        if r.letter:
            candidates[r.lang].append((r.n > LANDMARK_CHARS, chosen[r.lang].index(r.doc_id), r.doc_id))
    marked = [(i, lang) for lang, ranked in sorted(candidates.items()) for _, _, i in sorted(ranked)[:landmarks]]
    if not marked:
        return None

    def distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = grams(*buffers(batch.column(2)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([t[n].tobytes() for t in texts], pa.binary()) for n in range(3))], names=["doc_id", "lang", "one", "two", "three"])

    own = rows.join(F.broadcast(spark.createDataFrame(marked, "doc_id long, lang string")), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    marks = sorted(own.mapInArrow(mapper(distinct), "doc_id long, lang string, one binary, two binary, three binary").collect(), key=lambda m: (m.lang, m.doc_id))
    columns, size, z = dictionary([tuple(np.frombuffer(g, np.int32) for g in (m.one, m.two, m.three)) for m in marks])

    def values(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = kernel(*buffers(batch.column(1)), columns, size, z)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(k), pa.list_(pa.float32()))], names=["doc_id", "lang", "k"])

    got = rows.select("doc_id", "text", "lang").mapInArrow(mapper(values), "doc_id long, lang string, k array<float>").collect()
    got = sorted(got, key=lambda r: (r.lang, r.doc_id))
    languages = sorted({r.lang for r in got})
    labels = np.array([languages.index(r.lang) for r in got])
    return Model(languages, columns, size, z, solve(z.T @ z, np.array([r.k for r in got], np.float32), labels, len(languages), ridge))


def _scores(data: np.ndarray, offs: np.ndarray, model: Model | None, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    n = len(offs) - 1
    has = np.zeros(n, bool)
    for i, j, part, at in chunks(data, offs):
        small = part | 32
        letters = np.concatenate([[0], np.cumsum((small >= 97) & (small <= 122), dtype=np.int32)])
        has[i:j] = letters[at[1:]] > letters[at[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offs) > 0)):
        has[i] = bool(_LETTER.search(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
    if model is None or not n:
        return np.full(n, UNDETERMINED, object), np.zeros(n)
    raw = kernel(data, offs, model.columns, model.size, model.landmarks) @ model.weights * sharpness
    top = 1 / np.exp(raw - raw.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(has, np.array(model.languages, object)[raw.argmax(axis=1)], UNDETERMINED), np.where(has, top, 0.0).astype(np.float64)


def predict(documents: DataFrame, model: Model | None, sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; ``und`` with score 0 where the text is null or has no letter.

    Ties between languages go to the first in alphabetical order. Rows that repeat are each scored; a text may be of any
    length, and is scored as a whole; an empty table gives an empty one; columns other than doc_id and text, whatever their names, aren't read.
    """

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, best = _scores(*buffers(batch.column(1)), model, sharpness)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(best)], names=["doc_id", "lang_pred", "score"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(mapper(score), "doc_id long, lang_pred string, score double")


def accepted(documents: DataFrame, model: Model | None, least: float, sharpness: float = SHARPNESS) -> DataFrame:
    """The documents, with all their columns, whose language is told with a score of ``least`` or more; a null ``lang`` is filled in."""
    text, lang = documents.columns.index("text"), documents.columns.index("lang")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        told, best = _scores(*buffers(batch.column(text)), model, sharpness)
        filled = pc.coalesce(batch.column(lang), pa.array(told.tolist(), batch.column(lang).type))
        return batch.set_column(lang, batch.schema.field(lang), filled).filter(pa.array((told != UNDETERMINED) & (best >= least)))

    return documents.mapInArrow(mapper(run), documents.schema)


def held_out(documents: DataFrame):
    """The fold that is kept from the fit: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(documents["doc_id"].cast("string")) % 4 == 2, F.lit(False))


def identify(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.where(~held_out(documents)))
    predicted = predict(documents, model)
    return predicted.select("doc_id", held_out(predicted).alias("held_out"), "lang_pred", "score")
