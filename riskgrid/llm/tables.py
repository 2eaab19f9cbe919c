"""Reading tables and finding the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm.kernel import release

#: Keys of rows without a number begin here.
UNNUMBERED = 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(documents: DataFrame) -> Column:
    """doc_id; for a row without one a number from UNNUMBERED on that stands for its text."""
    return F.coalesce(documents["doc_id"].cast("long"), F.pmod(F.xxhash64(documents["text"]), F.lit(UNNUMBERED >> 1)) + F.lit(UNNUMBERED))


def shared(spark: SparkSession) -> str:
    """The folder that all executors share; one is made only where a local session names none, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="riskgrid-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def place(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark).rstrip('/')}/riskgrid/{kind}-{uuid.uuid4().hex}"


#: Paths of the tables written so far, in order.
_made: list[str] = []


def written(frame: DataFrame, kind: str) -> DataFrame:
    """The frame as a table in the shared folder: it cuts lineage, and executors may be lost afterwards."""
    spark = frame.sparkSession
    path = place(spark, kind)
    frame.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    relieve(spark)
    out = spark.read.schema(frame.schema).parquet(path)
    out._table = path
    return out


def relieve(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans, broadcasts and shuffles of the last step. Else its heap grows to its limit over dozens of
    steps, and broadcasts and shuffle files stay until it happens to be full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    release()


def mark() -> int:
    """How many tables have been written: what is written from here on can be swept."""
    return len(_made)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Remove the tables written since a mark, but for those of the frames that are still read."""
    kept = {frame._table for frame in keep}
    for path in _made[since:]:
        if path not in kept:
            drop(spark, path)
    _made[since:] = [path for path in _made[since:] if path in kept]


def drop(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
