"""Preprocessing as a job: a labelled corpus in, a quantised index out.

    spark-submit -m riskgrid.jobs.preprocess CORPUS INDEX [--format parquet|flat_index]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.sources import corpus
from riskgrid.sources.index_format import FlatIndex


def preprocess(spark: SparkSession, source: str, target: str, kind: str = "parquet") -> tuple[float, float]:
    """Reads JSON arrays (plain or gzip), takes the bounds of all vectors, and writes the quantised index; returns the bounds.

    An empty corpus gives an empty index with bounds 0 and 0.
    """
    rows = corpus.read_corpus(spark, source)
    low, high = corpus.bounds(rows)
    if low > high:
        low = high = 0.0
    index = corpus.quantise(rows, low, high)
    if kind == "parquet":
        corpus.write_index(index.withColumns({"min": F.lit(low), "max": F.lit(high)}), target)
    else:
        spark.dataSource.register(FlatIndex)
        ordered = index.repartitionByRange("ref_id").sortWithinPartitions("ref_id")
        ordered.write.format("flat_index").mode("append").option("min", repr(low)).option("max", repr(high)).save(target)
    return low, high


def load(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """ref_id, is_fraud, q0 .. q13 of an index."""
    if kind == "flat_index":
        spark.dataSource.register(FlatIndex)
    return spark.read.format(kind).load(path).select("ref_id", "is_fraud", *corpus.COLUMNS)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("corpus")
    parser.add_argument("index")
    parser.add_argument("--format", choices=("parquet", "flat_index"), default="parquet")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("riskgrid-preprocess").getOrCreate()
    low, high = preprocess(spark, args.corpus, args.index, args.format)
    print(f"references: {load(spark, args.index, args.format).count()}, bounds: {low} to {high}")


if __name__ == "__main__":
    main()
