"""Line dedup: overlapping windows of three consecutive lines.

The hash of each window is grouped over all documents; a window that starts earlier elsewhere is a repeat, and the lines that
repeats cover are removed, overlapping windows merging into one stretch. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.tables import key, table

SIZE = 3


def _window_rows(documents: DataFrame, size: int) -> DataFrame:
    """k, tag, pos, h1, h2 of each window with a line that isn't blank."""
    split = documents.select("k", "tag", F.split("text", "\n").alias("lines")).where(F.size("lines") >= size)
    at = split.select("k", "tag", "lines", F.explode(F.expr(f"sequence(0, size(lines) - {size})")).alias("pos"))
    window = at.select("k", "tag", "pos", F.array_join(F.slice("lines", F.col("pos") + 1, size), "\n").alias("w")).where(F.col("w").rlike(r"[^ \t\n\r\f\x0B]"))
    return window.select("k", "tag", "pos", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(7), F.col("w")).alias("h2"))


def repeated_starts(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """k, tag, starts: the windows of each document that start earlier elsewhere, or earlier in the same document.

    ``tag``, a hash of the text, tells rows apart that share a doc_id.
    """
    rows = _window_rows(documents, size)
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("k", "tag", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = rows.join(first, ["h1", "h2"]).where(F.struct("k", "tag", "pos") > F.col("first"))
    return later.groupBy("k", "tag").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def _deduplicated(documents: DataFrame, size: int) -> DataFrame:
    """row (all columns as a struct, so names can't clash), kept_text, n_lines, n_removed."""
    base = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), key(documents).alias("k"), F.hash(documents["text"]).alias("tag"))
    starts = repeated_starts(base.select("k", "tag", F.col("row.text").alias("text")), size)
    joined = base.join(starts, ["k", "tag"], "left").withColumn("lines", F.split("row.text", "\n"))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1)))))
    joined = joined.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    # A text without repeats is passed through; else lines stay that no repeat covers.
    covered = F.map_from_arrays("gone", F.transform("gone", lambda g: F.lit(True)))
    kept = F.filter("lines", lambda line, i: ~F.coalesce(F.element_at(F.col("covered"), i), F.lit(False)))
    out = joined.withColumn("covered", F.when(F.size("gone") > 0, covered))
    return out.select(
        "row",
        F.when(F.size("gone") == 0, F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
    )


def deduplicate(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, kept_text, n_lines, n_removed of each document.

    Lines end at line feeds. A window counts if a line of it isn't blank. Order: doc_id, then position; rows without doc_id come
    last, by a hash of the text, as do rows that share a doc_id among themselves. Rows with one doc_id and one text count as
    one place. A text of less than three lines, empty, or null has no window; a null
    text has no lines and stays null. An empty table gives an empty one; other columns, whatever their names, aren't read.
    """
    return _deduplicated(documents.select("doc_id", "text"), size).select("row.doc_id", "kept_text", "n_lines", "n_removed")


def cleaned(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents with all their columns and the kept text; those that had lines and lost all of them go.

    ``n_chars``, where there is such a column, follows the text.
    """
    out = _deduplicated(documents, size).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in documents.columns else None}
    return out.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(f"row.`{c}`") for c in documents.columns])


def digests(spark, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS pos FROM d),
w AS (SELECT doc_id, pos, lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] AS t FROM p),
v AS (SELECT doc_id, pos, t, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS n FROM w WHERE regexp_matches(t, '[^ \t\n\r\f\v]')),
gone AS (SELECT DISTINCT doc_id, pos + i AS line FROM v, (SELECT unnest([0, 1, 2]) AS i) WHERE n > 1),
l AS (SELECT doc_id, unnest(lines) AS t, unnest(generate_series(1, len(lines))) AS line FROM d),
k AS (SELECT l.doc_id, string_agg(l.t, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL) AS kept, count(*) AS n_lines, count(g.line) AS n_removed
      FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
