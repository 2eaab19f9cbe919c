"""Votes, scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.config import DENY_AT, K
from riskgrid.operators import search


def vote(neighbours: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """qid, fraud_count. Queries without neighbours count none, where ``queries`` is given."""
    counts = neighbours.groupBy("qid").agg(F.count_if(F.col("is_fraud")).cast("long").alias("fraud_count"))
    if queries is None:
        return counts
    return queries.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("fraud_count", F.lit(0)).cast("long").alias("fraud_count"))


def score(fraud_count: Column) -> Column:
    """The share of five, however many neighbours there are."""
    return fraud_count / F.lit(float(K))


def approved(fraud_count: Column) -> Column:
    """Decided on whole numbers: three of five is a denial, which floats can get wrong."""
    return fraud_count < DENY_AT


def scored(queries: DataFrame | search.Every, refs: DataFrame | None, mode: str = "exact", strategy: str = "arrow") -> DataFrame:
    """qid, fraud_count, fraud_score, approved. Without references everything is approved with score 0."""
    if refs is None:
        return queries.select("qid", F.lit(0).cast("long").alias("fraud_count"), F.lit(0.0).alias("fraud_score"), F.lit(True).alias("approved"))
    found = (search.exact if mode == "exact" else search.two_stage)(queries, refs, strategy=strategy)
    return vote(found, search.asked_of(queries, refs)).select("qid", "fraud_count", score(F.col("fraud_count")).alias("fraud_score"), approved(F.col("fraud_count")).alias("approved"))


def response(scores: DataFrame) -> DataFrame:
    return scores.select("qid", F.to_json(F.struct("approved", "fraud_score")).alias("response"))


class Engine:
    """References held ready for scoring: the counterpart of a service with a readiness check."""

    def __init__(self, refs: DataFrame | None, mode: str = "exact"):
        self.refs, self.mode, self.ready = refs, mode, False

    @classmethod
    def from_path(cls, spark: SparkSession, path: str | None, mode: str = "exact", kind: str = "parquet") -> Engine:
        """An engine over an index; without one, or where nothing is at the path, everything is approved."""
        from riskgrid.jobs.preprocess import load
        from riskgrid.sources.corpus import exists

        return cls(load(spark, path, kind) if path and exists(spark, path) else None, mode)

    def warm_up(self) -> Engine:
        if self.refs is not None:
            self.refs = self.refs.persist()
            self.refs.count()
        self.ready = True
        return self

    def size(self) -> int:
        return 0 if self.refs is None else self.refs.count()

    def score(self, queries: DataFrame) -> DataFrame:
        return scored(queries, self.refs, self.mode)

    def close(self) -> None:
        if self.refs is not None:
            self.refs.unpersist()
        self.ready = False
