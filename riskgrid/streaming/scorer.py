"""Scoring a stream of requests: a stateless stream against static references, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskgrid.config import DIMS
from riskgrid.operators import scoring


def score_stream(stream: DataFrame, refs: DataFrame | None, to_queries: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "exact"):
    """Starts a query that scores all that is there: top-k isn't supported on streams, so each micro-batch is scored whole.

    A micro-batch that is run again overwrites its own folder, so that each request is answered once.
    """

    def score(batch: DataFrame, epoch: int) -> None:
        scoring.scored(to_queries(batch), refs, mode).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def query_columns() -> list[str]:
    return ["qid", *[f"q{i}" for i in range(DIMS)]]
