"""Reading the labelled corpus and configuration, and writing the quantised index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.config import DIMS
from riskgrid.functions.quantize import label, quantize16
from riskgrid.schema import ENTRY, REFERENCE, REQUEST

COLUMNS = [f"q{i}" for i in range(DIMS)]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    """A configuration file as a whole. Raises FileNotFoundError where it is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(f"missing resource {path}")
    return spark.read.option("wholetext", True).text(path).first()[0]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, vector, is_fraud from JSON arrays of objects, plain or gzip. Rows without a vector are left out before the
    rest is numbered from 0, file by file in their order. A vector of another length raises when it is read."""
    rows = spark.read.schema(REFERENCE).option("multiLine", True).json(path)
    rows = rows.select("vector", label(F.col("is_fraud"), F.col("fraud"), F.col("label")).alias("is_fraud"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place")).where("vector is not null")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row for each file
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("place"))).join(before, "file")
    checked = F.when(F.size("vector") == DIMS, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector of {DIMS} numbers is expected")).cast("array<double>"))
    return numbered.select((F.col("before") + F.col("r") - 1).alias("ref_id"), checked.alias("vector"), "is_fraud")


def bounds(corpus: DataFrame) -> tuple[float, float]:
    """Least and greatest number of all vectors; NaN never counts, and an empty corpus has (inf, -inf)."""
    values = F.filter("vector", lambda x: ~F.isnan(x))
    row = corpus.agg(F.min(F.array_min(values)).alias("lo"), F.max(F.array_max(values)).alias("hi")).first()
    return (float("inf") if row.lo is None else row.lo, float("-inf") if row.hi is None else row.hi)


def quantise(corpus: DataFrame, low: float, high: float) -> DataFrame:
    return corpus.select("ref_id", "is_fraud", *[quantize16(F.get("vector", F.lit(i)), low, high).alias(f"q{i}") for i in range(DIMS)])


def write_index(index: DataFrame, path: str) -> None:
    """The native form of the index: Parquet, sorted by id within files, whose columns are read one by one."""
    index.sortWithinPartitions("ref_id").write.mode("overwrite").parquet(path)


def write_corpus(frame: DataFrame, path: str) -> None:
    """ref_id, vector, label as gzip files of one JSON array each, the files in order of ref_id."""
    lines = frame.repartitionByRange("ref_id").sortWithinPartitions("ref_id").select("ref_id", F.spark_partition_id().alias("part"), F.to_json(F.struct("vector", "label")).alias("line"))
    arrays = lines.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("ref_id", "line"))).alias("lines"))
    text = F.concat(F.lit("["), F.array_join(F.transform("lines", lambda x: x["line"]), ","), F.lit("]"))
    arrays.repartitionByRange("part").sortWithinPartitions("part").select(text.alias("value")).write.option("compression", "gzip").text(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).option("multiLine", True).json(path)


def parse_requests(frame: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    return frame.select(*keep, F.from_json(column, REQUEST).alias("r")).select(*keep, "r.*")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """request and expected_approved of an evaluation file {entries: [...], stats: ...}."""
    schema = f"entries array<{ENTRY.simpleString()}>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
