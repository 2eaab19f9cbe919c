"""Evaluation: confusion counts, weighted errors, tail latency, composite scores, recall and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the composite score.
CUT = -3000.0
MOST_P99, MOST_FAILURE, LEAST_EPSILON = 2000.0, 0.15, 0.001


def iterated(entries: DataFrame, order: str, beyond: int) -> DataFrame:
    """Entries by the iterations of a run, numbered from 0 in order; ``beyond`` iterations more than entries find none.

    Numbers come from range partitions, so no task holds all entries.
    """
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = entries.repartitionByRange(parts, order).sortWithinPartitions(order)
    placed = placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)})
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    numbered = placed.join(before, "part").withColumn("iteration", F.col("before") + F.col("place")).drop("part", "place", "before")
    total = sizes.agg((F.coalesce(F.sum("n"), F.lit(0)) + beyond).alias("total"))
    iterations = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("iteration")) if beyond else numbered.select("iteration")
    return iterations.join(numbered, "iteration", "left").where(F.col(order).isNotNull())


def confusion(results: DataFrame) -> DataFrame:
    """tp, tn, fp, fn, errors from (approved, expected_approved, status); a denial is a positive."""
    ok = F.col("status") == 200
    denied, expected = ~F.col("approved"), ~F.col("expected_approved")
    count = lambda c: F.count_if(c).cast("long")
    return results.agg(count(ok & denied & expected).alias("tp"), count(ok & ~denied & ~expected).alias("tn"), count(ok & denied & ~expected).alias("fp"), count(ok & ~denied & expected).alias("fn"), count(~ok).alias("errors"))


def weighted_error(counts: DataFrame) -> DataFrame:
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("errors")
    e = F.col("fp") + 3 * F.col("fn") + 5 * F.col("errors")
    failed = F.col("fp") + F.col("fn") + F.col("errors")
    share = lambda x: F.when(n > 0, x / F.when(n > 0, n)).otherwise(0.0)
    return counts.withColumns({"n": n, "weighted": e, "epsilon": share(e), "failure_rate": share(failed)})


def p99(column: str) -> Column:
    return F.percentile(F.col(column), F.lit(0.99))


def p99_score(value: Column) -> Column:
    return F.when(value <= 0, 0.0).when(value > MOST_P99, CUT).otherwise(1000 * F.log10(F.lit(1000.0) / F.greatest(value, F.lit(1.0))))


def detection_score(failure_rate: Column, epsilon: Column, weighted: Column) -> Column:
    good = 1000 * F.log10(F.lit(1.0) / F.greatest(epsilon, F.lit(LEAST_EPSILON))) - 300 * F.log10(1 + weighted)
    return F.when(failure_rate > MOST_FAILURE, CUT).otherwise(good)


def report(counts: DataFrame, latency: DataFrame) -> DataFrame:
    """One row: counts, errors, and the scores; ``latency`` is one row with p99."""
    both = weighted_error(counts).crossJoin(F.broadcast(latency.select("p99")))
    both = both.withColumn("p99_score", p99_score(F.col("p99"))).withColumn("detection_score", detection_score(F.col("failure_rate"), F.col("epsilon"), F.col("weighted")))
    return both.withColumn("final_score", F.col("p99_score") + F.col("detection_score"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """neighbours, hits, recall of one neighbour table against another, over all queries."""
    hits = truth.join(found.select("qid", "ref_id", F.lit(1).alias("hit")), ["qid", "ref_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("hits")).withColumn("recall", F.when(F.col("neighbours") > 0, F.col("hits") / F.col("neighbours")))


def corpus_stats(frame: DataFrame, fraud: Column, edge: Column) -> DataFrame:
    n = F.count(F.lit(1))
    share = lambda c: F.round(F.when(n > 0, F.count_if(c) / n).otherwise(0.0), 4)
    return frame.agg(n.alias("total"), F.count_if(fraud).cast("long").alias("fraud_count"), F.count_if(~fraud).cast("long").alias("legit_count"), share(fraud).alias("fraud_rate"), share(~fraud).alias("legit_rate"), F.count_if(edge).cast("long").alias("edge_case_count"), share(edge).alias("edge_case_rate"))
