"""All queries of the library and the SQL that gives the same rows. Queries run over their whole tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.config import BLOCK_A, BLOCK_B, BOUNDS, DIMS, K, PRUNE, RiskTable
from riskgrid.functions import features as X
from riskgrid.functions import quantize as Q
from riskgrid.operators import evaluation, scoring, search
from riskgrid.plans import adapters
from riskgrid.plans.adapters import table
from riskgrid.sources import corpus
from riskgrid.sources.corpus import parse_requests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL of the adapter ---------------------------------------------------------------------------------------------------


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


_RISK = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in adapters.RISKS.items()) + " ELSE 0.5 END::DOUBLE"
_FEATURES = [
    _clamp("value / 10000.0"),
    _clamp("(1 + k % 12) / 12.0::DOUBLE"),
    f"CASE WHEN avg_amount > 0 THEN {_clamp('value / avg_amount / 10.0')} ELSE 1.0 END",
    "hour(ts) / 23.0::DOUBLE",
    "(isodow(ts) - 1) / 6.0::DOUBLE",
    f"CASE WHEN last_sec IS NULL THEN -1.0 ELSE {_clamp('(sec - last_sec) / 60.0::DOUBLE / 1440.0::DOUBLE')} END",
    f"CASE WHEN last_sec IS NULL THEN -1.0 ELSE {_clamp('10 * abs(k - last_k) / 1000.0::DOUBLE')} END",
    _clamp("10 * k / 1000.0::DOUBLE"),
    _clamp("tx_count_24h / 20.0::DOUBLE"),
    "CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END",
    "CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END",
    "CASE WHEN seen = 1 THEN 1.0 ELSE 0.0 END",
    _RISK,
    _clamp("merchant_avg / 10000.0"),
]
_TX = """e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec FROM events),
m AS (SELECT k % 20 AS merchant, avg(value) AS merchant_avg FROM e GROUP BY 1),
tx AS (SELECT e.*, m.merchant_avg,
  avg(value) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS avg_amount,
  count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS tx_count_24h,
  row_number() OVER (PARTITION BY user_id, k % 20 ORDER BY sec, event_id) AS seen,
  lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS last_sec,
  lag(k) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS last_k
  FROM e LEFT JOIN m ON e.k % 20 = m.merchant)"""
_VEC = _TX + ",\nv AS (SELECT event_id, event_type = 'error' AS is_fraud, " + ", ".join(f"({f})::DOUBLE AS f{i}" for i, f in enumerate(_FEATURES)) + " FROM tx)"


def _q16(x: str, low: float = BOUNDS[0], high: float = BOUNDS[1]) -> str:
    return f"floor((greatest({low}::DOUBLE, least({high}::DOUBLE, {x})) - ({low}::DOUBLE)) / {high - low}::DOUBLE * 65535.0::DOUBLE - 32768.0::DOUBLE + 0.5::DOUBLE)"


_IDX = _VEC + ",\nr AS (SELECT event_id AS ref_id, is_fraud, " + ", ".join(f"{_q16(f'f{i}')}::BIGINT AS q{i}" for i in range(DIMS)) + " FROM v)"


def _distance(dims) -> str:
    return " + ".join(f"(a.q{i} - b.q{i}) * (a.q{i} - b.q{i})" for i in dims)


_PAIRS = _IDX + f",\np AS (SELECT a.ref_id AS qid, b.ref_id, b.is_fraud, {_distance(BLOCK_A)} AS da, {_distance(range(DIMS))} AS d FROM r a JOIN r b ON a.ref_id % {adapters.QUERY_STEP} = 0 AND a.ref_id <> b.ref_id)"
_EXACT = _PAIRS + f",\nx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS rank FROM p) WHERE rank <= {K})"
_PRUNED = _PAIRS + f",\nc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY da, ref_id) AS place FROM p) WHERE place <= {PRUNE}),\ny AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, da, ref_id) AS rank FROM c) WHERE rank <= {K})"
_VOTE = _EXACT + ",\ns AS (SELECT qid, count(*) FILTER (WHERE is_fraud) AS fraud_count FROM x GROUP BY qid)"
_RESULT = _VOTE + ",\nt AS (SELECT s.qid, s.fraud_count < 3 AS approved, NOT r.is_fraud AS expected_approved FROM s JOIN r ON r.ref_id = s.qid)"
_CONFUSION = _RESULT + """,
cf AS (SELECT count(*) FILTER (WHERE NOT approved AND NOT expected_approved) AS tp, count(*) FILTER (WHERE approved AND expected_approved) AS tn,
  count(*) FILTER (WHERE NOT approved AND expected_approved) AS fp, count(*) FILTER (WHERE approved AND NOT expected_approved) AS fn, 0::BIGINT AS errors FROM t)"""
_WEIGHTED = _CONFUSION + """,
we AS (SELECT *, tp + tn + fp + fn + errors AS n, fp + 3 * fn + 5 * errors AS weighted FROM cf),
wf AS (SELECT *, CASE WHEN n > 0 THEN weighted / n::DOUBLE ELSE 0.0 END AS epsilon, CASE WHEN n > 0 THEN (fp + fn + errors) / n::DOUBLE ELSE 0.0 END AS failure_rate FROM we)"""
_P99 = "SELECT quantile_cont(value, 0.99) AS p99 FROM events"
_P99_SCORE = "CASE WHEN p99 <= 0 THEN 0.0 WHEN p99 > 2000 THEN -3000.0 ELSE 1000 * log10(1000.0::DOUBLE / greatest(p99, 1.0)) END::DOUBLE"
_DETECTION = "CASE WHEN failure_rate > 0.15 THEN -3000.0 ELSE 1000 * log10(1.0::DOUBLE / greatest(epsilon, 0.001::DOUBLE)) - 300 * log10((1 + weighted)::DOUBLE) END::DOUBLE"


# Features -----------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.vectors(table(spark, sf_dir, "events"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.quantised(table(spark, sf_dir, "events"))


def _iso(frame: DataFrame) -> DataFrame:
    return frame.withColumn("iso", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


_ROUNDED = ", ".join(f"round(f{i}, 9) AS f{i}" for i in range(DIMS))


@query(f"WITH {_VEC} SELECT event_id, {_ROUNDED} FROM v")
def vectorize_events(spark, sf_dir):
    return _vectors(spark, sf_dir).select("event_id", *[F.round(f"f{i}", 9).alias(f"f{i}") for i in range(DIMS)])


@query(f"WITH {_VEC} SELECT event_id, {_ROUNDED} FROM v")
def vectorize_payloads(spark, sf_dir):
    texts = adapters.requests(table(spark, sf_dir, "events"))
    out = X.vectorize(parse_requests(texts, "request", ("event_id",)), RiskTable(adapters.request_risks()), keep=("event_id",))
    return out.select("event_id", *[F.round(f"f{i}", 9).alias(f"f{i}") for i in range(DIMS)])


@query(f"SELECT event_id, {_clamp('value / 100 - 0.5::DOUBLE')} AS clamped FROM events")
def clamp01(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.clamp01(F.col("value") / 100 - 0.5).alias("clamped"))


@query("SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 10000.0)), 9) AS amount, (1 + user_id % 12) / 12.0::DOUBLE AS installments FROM events")
def scale_by_max(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(X.scaled(F.col("value"), 10000.0), 9).alias("amount"), X.scaled(1 + F.col("user_id") % 12, 12.0).alias("installments"))


@query(f"WITH {_VEC} SELECT event_id, round(f2, 9) AS ratio FROM v")
def amount_vs_avg(spark, sf_dir):
    return _vectors(spark, sf_dir).select("event_id", F.round("f2", 9).alias("ratio"))


@query("SELECT event_id, hour(ts) / 23.0::DOUBLE AS hour_share FROM events")
def hour_of_day(spark, sf_dir):
    return _iso(table(spark, sf_dir, "events")).select("event_id", X.hour_of_day(F.col("iso")).alias("hour_share"))


@query("SELECT event_id, (isodow(ts) - 1) / 6.0::DOUBLE AS weekday_share FROM events")
def day_of_week(spark, sf_dir):
    return _iso(table(spark, sf_dir, "events")).select("event_id", X.day_of_week(F.col("iso")).alias("weekday_share"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS seconds FROM events")
def epoch_seconds(spark, sf_dir):
    return _iso(table(spark, sf_dir, "events")).select("event_id", X.epoch_seconds(F.col("iso")).alias("seconds"))


@query(f"WITH {_VEC} SELECT event_id, round(f5, 9) AS minutes, round(f6, 9) AS km FROM v")
def since_last(spark, sf_dir):
    return _vectors(spark, sf_dir).select("event_id", F.round("f5", 9).alias("minutes"), F.round("f6", 9).alias("km"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END::DOUBLE AS is_online, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END::DOUBLE AS card_present FROM events")
def boolean_flags(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", X.flag(kind.isin("click", "view")).alias("is_online"), X.flag(kind == "purchase").alias("card_present"))


@query(f"WITH {_TX} SELECT event_id, CASE WHEN seen = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS unknown FROM tx")
def unknown_merchant(spark, sf_dir):
    requests = parse_requests(adapters.requests(table(spark, sf_dir, "events")), "request", ("event_id",))
    return requests.select("event_id", X.unknown_merchant(F.col("customer.known_merchants"), F.col("merchant.id")).alias("unknown"))


@query(f"WITH {_TX} SELECT event_id FROM tx WHERE seen = 1")
def unknown_merchant_anti(spark, sf_dir):
    e = adapters.events(table(spark, sf_dir, "events"))
    first = e.groupBy("user_id", "merchant").agg(F.min(F.struct("sec", "event_id")).alias("first"))
    known = e.join(first, ["user_id", "merchant"]).where(F.struct("sec", "event_id") > F.col("first")).select("event_id")
    return e.select("event_id").join(known, "event_id", "left_anti")


_CODES = ("5411", "05812", "+6011", " 5411", "5411.7", "9999", "", "100000")


@query("WITH c AS (SELECT event_id, list_extract(['5411', '05812', '+6011', ' 5411', '5411.7', '9999', '', '100000'], (event_id % 8 + 1)::BIGINT) AS mcc FROM events), "
       "d AS (SELECT *, CASE WHEN regexp_matches(mcc, '^[+-]?[0-9]+$') THEN TRY_CAST(ltrim(mcc, '+') AS BIGINT) END AS code FROM c) "
       "SELECT event_id, CASE code WHEN 5411 THEN 0.5 WHEN 5812 THEN 0.8 WHEN 6011 THEN 1.2 ELSE 0.5 END::DOUBLE AS risk FROM d")
def mcc_risk_lookup(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in _CODES])
    frame = table(spark, sf_dir, "events").select("event_id", F.get(codes, (F.col("event_id") % 8).cast("int")).alias("mcc"))
    return X.with_risk(frame, F.col("mcc"), RiskTable()).select("event_id", "risk")


_BLOCK = {i: "A" for i in BLOCK_A} | {i: "B" for i in BLOCK_B}


@query(f"WITH {_VEC} " + " UNION ALL ".join(f"SELECT event_id, {i} AS dim, '{_BLOCK[i]}' AS block, round(f{i}, 9) AS feature FROM v" for i in range(DIMS)))
def features_long(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(i).alias("dim"), F.lit(_BLOCK[i]).alias("block"), F.round(f"f{i}", 9).alias("feature")) for i in range(DIMS)])
    return _vectors(spark, sf_dir).select("event_id", F.explode(rows).alias("x")).select("event_id", "x.*")


# Corpus ---------------------------------------------------------------------------------------------------------------

_LABELS = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN toxic = 1 END AS is_fraud, CASE WHEN doc_id % 4 = 1 THEN quality = 0 END AS fraud, CASE WHEN toxic = 1 THEN 'fraud' WHEN quality = 1 THEN 'legit' ELSE 'FRAUD' END AS label FROM labels"


@query(f"WITH l AS ({_LABELS}) SELECT doc_id, coalesce(is_fraud, fraud, label = 'fraud', false) AS resolved FROM l")
def label_resolution(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(c("doc_id") % 4 == 0, c("toxic") == 1).alias("is_fraud"), F.when(c("doc_id") % 4 == 1, c("quality") == 0).alias("fraud"), F.when(c("toxic") == 1, "fraud").when(c("quality") == 1, "legit").otherwise("FRAUD").alias("label"))
    return rows.select("doc_id", Q.label(c("is_fraud"), c("fraud"), c("label")).alias("resolved"))


@query("SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings")
def global_bounds(spark, sf_dir):
    values = F.filter("embedding", lambda x: ~F.isnan(x))
    return table(spark, sf_dir, "embeddings").agg(F.min(F.array_min(values)).cast("double").alias("lo"), F.max(F.array_max(values)).cast("double").alias("hi"))


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL")
def skip_null_vectors(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("value").isNotNull() & F.get_json_object("props", "$.k").isNotNull()).select("event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events")
def dense_ordinal(spark, sf_dir):
    """Ordinals by range partitions: sorted, counted, and numbered from each partition's start."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, so that both uses below see the same partitions
    frame = table(spark, sf_dir, "events").select("event_id").repartitionByRange(parts, "event_id").sortWithinPartitions("event_id")
    numbered = frame.select("event_id", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("place"))
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return numbered.join(before, "part").select("event_id", (F.col("before") + F.col("place")).alias("ordinal"))


@query(f"WITH {_VEC} SELECT event_id, " + ", ".join(f"{_q16(f'f{i}')}::SMALLINT AS q{i}" for i in range(DIMS)) + " FROM v")
def quantize16(spark, sf_dir):
    return _refs(spark, sf_dir).select(F.col("ref_id").alias("event_id"), *[f"q{i}" for i in range(DIMS)])


def _wrapped(x: str, low: float = 0.0, high: float = 0.9) -> str:
    raw = f"(({x} - ({low}::DOUBLE)) / {high - low}::DOUBLE * 65535.0::DOUBLE - 32768.0::DOUBLE)"
    return f"(((trunc({raw})::BIGINT + 32768) % 65536 + 65536) % 65536 - 32768)::SMALLINT"


@query(f"WITH {_VEC} SELECT event_id, " + ", ".join(f"{_wrapped(f'f{i}')} AS q{i}" for i in range(DIMS)) + " FROM v")
def quantize16_query(spark, sf_dir):
    return _vectors(spark, sf_dir).select("event_id", *[Q.quantize16_query(F.col(f"f{i}"), 0.0, 0.9).alias(f"q{i}") for i in range(DIMS)])


@query(f"WITH {_VEC} SELECT event_id, " + ", ".join(f"floor((greatest(-1.0::DOUBLE, least(1.0::DOUBLE, f{i})) + 1.0::DOUBLE) / 2.0::DOUBLE * 255.0::DOUBLE - 128.0::DOUBLE + 0.5::DOUBLE)::TINYINT AS b{i}" for i in range(DIMS)) + " FROM v")
def quantize8(spark, sf_dir):
    return _vectors(spark, sf_dir).select("event_id", *[Q.quantize8(F.col(f"f{i}"), *BOUNDS).alias(f"b{i}") for i in range(DIMS)])


@query("SELECT event_id // 8 AS byte, sum(CASE WHEN event_type = 'error' THEN 1 << (event_id % 8)::INTEGER ELSE 0 END)::BIGINT AS bits FROM events GROUP BY 1")
def label_bitpack(spark, sf_dir):
    return _packed(spark, sf_dir)


def _packed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bit = F.when(F.col("event_type") == "error", F.expr("shiftleft(1, cast(event_id % 8 as int))")).otherwise(0)
    return e.groupBy(F.floor(F.col("event_id") / 8).alias("byte")).agg(F.sum(bit).alias("bits"))


@query("SELECT event_id, event_type = 'error' AS is_fraud FROM events")
def label_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 8).alias("byte"))
    bit = F.expr("shiftright(bits, cast(event_id % 8 as int)) & 1")
    return e.join(_packed(spark, sf_dir), "byte").select("event_id", (bit == 1).alias("is_fraud"))


@query("SELECT count(*) AS size FROM events")
def corpus_size(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("size"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS fraud_count, count(*) FILTER (WHERE event_type <> 'error') AS legit_count, "
       "round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 4) AS fraud_rate, round(count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE, 4) AS legit_rate, "
       "count(*) FILTER (WHERE value > 100) AS edge_case_count, round(count(*) FILTER (WHERE value > 100) / count(*)::DOUBLE, 4) AS edge_case_rate FROM events")
def corpus_stats(spark, sf_dir):
    return evaluation.corpus_stats(table(spark, sf_dir, "events"), F.col("event_type") == "error", F.col("value") > 100)


@query("SELECT event_id, round(CASE WHEN value - 50 < 0 THEN 0 ELSE sqrt(value - 50) END::FLOAT::DOUBLE, 5) AS root FROM events")
def sqrt_guarded(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(Q.sqrt_guarded(F.col("value") - 50).cast("double"), 5).alias("root"))


# Search -----------------------------------------------------------------------------------------------------------------


def _steps(spark, sf_dir, dims: int) -> DataFrame:
    """The distance of each event's vector to that of the event numbered one lower."""
    refs = _refs(spark, sf_dir)
    before = refs.select((F.col("ref_id") + 1).alias("ref_id"), *[F.col(f"q{i}").alias(f"x{i}") for i in range(dims)])
    return refs.join(before, "ref_id").select("ref_id", Q.squared_distance([F.col(f"q{i}") for i in range(dims)], [F.col(f"x{i}") for i in range(dims)]).alias("d"))


@query(f"WITH {_IDX} SELECT a.ref_id, {_distance(range(DIMS))} AS d FROM r a JOIN r b ON a.ref_id = b.ref_id + 1")
def sqdist_i16(spark, sf_dir):
    return _steps(spark, sf_dir, DIMS)


@query(f"WITH {_IDX} SELECT a.ref_id, {_distance(range(7))} AS d FROM r a JOIN r b ON a.ref_id = b.ref_id + 1")
def sqdist_7d(spark, sf_dir):
    return _steps(spark, sf_dir, 7)


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id AS qid, b.vec_id AS ref_id, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d "
       "FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS rank FROM p) SELECT qid, ref_id, rank::INTEGER AS rank, round(d, 6) AS d FROM w WHERE rank <= 5")
def knn_exact_float(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    found = search.exact_float(search.Every(adapters.QUERY_STEP), rows.withColumnRenamed("vec_id", "ref_id"))
    return found.select("qid", "ref_id", "rank", F.round("d", 6).alias("d"))


def _both(spark, sf_dir) -> tuple[search.Every, search.Packed]:
    numbers = table(spark, sf_dir, "events").select(F.col("event_id").alias("ref_id"))
    return search.Every(adapters.QUERY_STEP, numbers), adapters.packed(table(spark, sf_dir, "events"))


@query(f"WITH {_EXACT} SELECT qid, ref_id, d, rank::INTEGER AS rank FROM x")
def knn_exact_quant(spark, sf_dir):
    return search.exact(*_both(spark, sf_dir)).select("qid", "ref_id", "d", "rank")


@query(f"WITH {_EXACT} SELECT qid, ref_id, d, rank::INTEGER AS rank FROM x")
def knn_exact_frame(spark, sf_dir):
    return search.exact(*_both(spark, sf_dir), strategy="frame").select("qid", "ref_id", "d", "rank")


@query(f"WITH {_PRUNED} SELECT qid, ref_id, da, d, place::INTEGER AS rank FROM c")
def prune_candidates(spark, sf_dir):
    return search.prune(*_both(spark, sf_dir)).select("qid", "ref_id", "da", "d", "rank")


@query(f"WITH {_PRUNED} SELECT qid, ref_id, da, d, rank::INTEGER AS rank FROM y")
def knn_two_stage(spark, sf_dir):
    return search.two_stage(*_both(spark, sf_dir)).select("qid", "ref_id", "da", "d", "rank")


@query("SELECT event_type, event_id, value, rank FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)::INTEGER AS rank FROM events) WHERE rank <= 5")
def topk_queue(spark, sf_dir):
    return search.topk(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "value", "event_id")


@query(f"WITH {_EXACT} SELECT qid, CASE WHEN count(*) >= {K} THEN max(d)::DOUBLE ELSE 'infinity'::DOUBLE END AS worst FROM x GROUP BY qid")
def worst_distance(spark, sf_dir):
    return search.worst_distance(search.exact(*_both(spark, sf_dir)))


@query(f"WITH {_PRUNED}, n AS (SELECT qid, count(*) AS n, max(da) AS last_da FROM c GROUP BY qid), z AS (SELECT qid, max(d) AS kth FROM y GROUP BY qid) SELECT n.qid, n.n < {PRUNE} OR z.kth < n.last_da AS certified FROM n JOIN z ON n.qid = z.qid")
def exactness_certificate(spark, sf_dir):
    return search.certificate(*_both(spark, sf_dir))


# Scoring --------------------------------------------------------------------------------------------------------------


def _scores(spark, sf_dir) -> DataFrame:
    return scoring.scored(*_both(spark, sf_dir))


@query(f"WITH {_VOTE} SELECT qid AS tx_id, fraud_count, fraud_count / 5.0::DOUBLE AS fraud_score, fraud_count < 3 AS approved FROM s")
def score_events(spark, sf_dir):
    return _scores(spark, sf_dir).withColumnRenamed("qid", "tx_id")


@query(f"WITH {_PRUNED} SELECT qid, count(*) FILTER (WHERE is_fraud) AS fraud_count FROM y GROUP BY qid")
def fraud_vote(spark, sf_dir):
    return scoring.vote(search.two_stage(*_both(spark, sf_dir)))


@query(f"WITH {_VOTE} SELECT qid, fraud_count / 5.0::DOUBLE AS fraud_score FROM s")
def fraud_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("qid", "fraud_score")


@query(f"WITH {_VOTE} SELECT qid, fraud_count < 3 AS approved FROM s")
def decision(spark, sf_dir):
    return _scores(spark, sf_dir).select("qid", "approved")


@query(f"SELECT event_id AS qid, 0::BIGINT AS fraud_count, 0.0::DOUBLE AS fraud_score, true AS approved FROM events WHERE event_id % {adapters.QUERY_STEP} = 0")
def fail_open(spark, sf_dir):
    return scoring.scored(adapters.queries_of(_refs(spark, sf_dir)), None)


@query(f"WITH {_VOTE} SELECT qid, '{{\"approved\":' || (fraud_count < 3)::VARCHAR || ',\"fraud_score\":' || (fraud_count / 5.0::DOUBLE)::VARCHAR || '}}' AS response FROM s")
def score_response(spark, sf_dir):
    return scoring.response(_scores(spark, sf_dir))


# Evaluation -----------------------------------------------------------------------------------------------------------


def _results(spark, sf_dir) -> DataFrame:
    queries, refs = _both(spark, sf_dir)
    events = table(spark, sf_dir, "events").where(F.col("event_id") % adapters.QUERY_STEP == 0)
    expected = events.select(F.col("event_id").alias("qid"), (F.col("event_type") != "error").alias("expected_approved"))
    return scoring.scored(queries, refs).join(expected, "qid").withColumn("status", F.lit(200))


def _confusion(spark, sf_dir) -> DataFrame:
    return evaluation.confusion(_results(spark, sf_dir))


@query(f"WITH {_RESULT} SELECT * FROM t")
def expected_vs_actual(spark, sf_dir):
    return _results(spark, sf_dir).select("qid", "approved", "expected_approved")


@query(f"WITH {_CONFUSION} SELECT * FROM cf")
def confusion_matrix(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query("SELECT count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def status_split(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return table(spark, sf_dir, "events").agg(F.count_if(status == 200).alias("ok"), F.count_if(status != 200).alias("failed"))


@query(f"WITH {_WEIGHTED} SELECT n, weighted, round(epsilon, 6) AS epsilon, round(failure_rate, 6) AS failure_rate FROM wf")
def weighted_error(spark, sf_dir):
    return evaluation.weighted_error(_confusion(spark, sf_dir)).select("n", "weighted", F.round("epsilon", 6).alias("epsilon"), F.round("failure_rate", 6).alias("failure_rate"))


def _latency(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").agg(evaluation.p99("value").alias("p99"))


@query(f"SELECT round(p99, 6) AS p99 FROM ({_P99})")
def latency_p99(spark, sf_dir):
    return _latency(spark, sf_dir).select(F.round("p99", 6).alias("p99"))


@query(f"SELECT round({_P99_SCORE}, 6) AS p99_score FROM ({_P99})")
def p99_score(spark, sf_dir):
    return _latency(spark, sf_dir).select(F.round(evaluation.p99_score(F.col("p99")), 6).alias("p99_score"))


@query(f"WITH {_WEIGHTED} SELECT round({_DETECTION}, 6) AS detection_score FROM wf")
def detection_score(spark, sf_dir):
    w = evaluation.weighted_error(_confusion(spark, sf_dir))
    return w.select(F.round(evaluation.detection_score(F.col("failure_rate"), F.col("epsilon"), F.col("weighted")), 6).alias("detection_score"))


@query(f"WITH {_WEIGHTED} SELECT tp, tn, fp, fn, errors, round(p99, 6) AS p99, round({_P99_SCORE}, 2) AS p99_score, round({_DETECTION}, 2) AS detection_score, round(({_P99_SCORE}) + ({_DETECTION}), 2) AS final_score FROM wf, ({_P99})")
def final_score(spark, sf_dir):
    r = evaluation.report(_confusion(spark, sf_dir), _latency(spark, sf_dir))
    return r.select("tp", "tn", "fp", "fn", "errors", F.round("p99", 6).alias("p99"), *[F.round(c, 2).alias(c) for c in ("p99_score", "detection_score", "final_score")])


@query(f"WITH {_PRUNED}, x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS xrank FROM p) WHERE xrank <= {K}) "
       "SELECT count(*) AS neighbours, count(y.ref_id) AS hits, count(y.ref_id) / count(*)::DOUBLE AS recall FROM x LEFT JOIN y ON x.qid = y.qid AND x.ref_id = y.ref_id")
def recall_at_k(spark, sf_dir):
    queries, refs = _both(spark, sf_dir)
    return evaluation.recall(search.two_stage(queries, refs), search.exact(queries, refs))


@query("SELECT round(sum(CASE i WHEN 5411 THEN 0.5 WHEN 5812 THEN 0.8 WHEN 6011 THEN 1.2 ELSE 0.5 END::DOUBLE), 6) AS checksum FROM range(10000) t(i)")
def risk_checksum(spark, sf_dir):
    codes = spark.range(10000).select(F.col("id").cast("string").alias("mcc"))
    return X.with_risk(codes, F.col("mcc"), RiskTable()).agg(F.round(F.sum("risk"), 6).alias("checksum"))


# Files and streams: no SQL --------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; only a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="riskgrid-")
    return f"{base.rstrip('/')}/riskgrid/{kind}-{uuid.uuid4().hex}"


@query(f"WITH {_IDX} SELECT ref_id, is_fraud, " + ", ".join(f"q{i}::SMALLINT AS q{i}" for i in range(DIMS)) + " FROM r")
def index_roundtrip(spark, sf_dir):
    """The quantised index, written in the flat binary form and read back."""
    from riskgrid.sources.index_format import FlatIndex, _local

    spark.dataSource.register(FlatIndex)
    path = _local(_scratch(spark, "flat-index"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    index = _refs(spark, sf_dir)
    index.repartitionByRange("ref_id").sortWithinPartitions("ref_id").write.format("flat_index").mode("append").save(path)
    return spark.read.format("flat_index").load(path)


_QUANTISED = _VEC + """,
b AS (SELECT least({lo}) AS lo, greatest({hi}) AS hi FROM (SELECT {each} FROM v WHERE event_id % 7 <> 3))""".format(
    lo=", ".join(f"l{i}" for i in range(DIMS)), hi=", ".join(f"h{i}" for i in range(DIMS)), each=", ".join(f"min(f{i}) AS l{i}, max(f{i}) AS h{i}" for i in range(DIMS)))


@query(f"WITH {_QUANTISED} SELECT row_number() OVER (ORDER BY event_id) - 1 AS ref_id, is_fraud, "
       + ", ".join(f"floor((f{i} - lo) / (hi - lo) * 65535.0::DOUBLE - 32768.0::DOUBLE + 0.5::DOUBLE)::SMALLINT AS q{i}" for i in range(DIMS)) + " FROM v, b WHERE event_id % 7 <> 3")
def preprocess_roundtrip(spark, sf_dir):
    """The events as a corpus of JSON arrays, some without a vector, preprocessed into an index and loaded."""
    from riskgrid.jobs.preprocess import load, preprocess

    vector = F.when(F.col("event_id") % 7 != 3, F.array(*[F.col(f"f{i}") for i in range(DIMS)]))
    rows = _vectors(spark, sf_dir).select(F.col("event_id").alias("ref_id"), vector.alias("vector"), F.when(F.col("is_fraud"), "fraud").otherwise("legit").alias("label"))
    source, target = _scratch(spark, "corpus"), _scratch(spark, "index")
    corpus.write_corpus(rows, source)
    preprocess(spark, source, target)
    return load(spark, target)


_PARITY = _IDX + ",\na AS (SELECT event_id AS ref_id, " + ", ".join(f"{_wrapped(f'f{i}', *BOUNDS)}::BIGINT AS q{i}" for i in range(DIMS)) + f""" FROM v WHERE event_id % {adapters.QUERY_STEP} = 0),
p AS (SELECT a.ref_id AS qid, b.ref_id, b.is_fraud, {_distance(BLOCK_A)} AS da, {_distance(range(DIMS))} AS d FROM a JOIN r b ON a.ref_id <> b.ref_id),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY da, ref_id) AS place FROM p) WHERE place <= {PRUNE}),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, da, ref_id) AS rank FROM c) WHERE rank <= {K})"""


@query(f"WITH {_PARITY} SELECT qid, ref_id, da, d, rank::INTEGER AS rank FROM y")
def knn_parity(spark, sf_dir):
    """The two-stage search with queries quantised as the index's own reader does: cut toward zero, and wrapped."""
    both = adapters.packed(table(spark, sf_dir, "events"), adapters.QUERY_STEP)
    return search.two_stage(both, both).select("qid", "ref_id", "da", "d", "rank")


@query(f"""WITH {_VOTE}, i AS (SELECT unnest(range((SELECT count(*) FROM s) + 25)) AS n), o AS (SELECT *, row_number() OVER (ORDER BY qid) - 1 AS n FROM s),
t AS (SELECT o.qid, o.qid % 9 = 0 AS failed, o.fraud_count < 3 AS approved, NOT r.is_fraud AS expected_approved FROM i JOIN o ON o.n = i.n JOIN r ON r.ref_id = o.qid)
SELECT count(*) FILTER (WHERE NOT failed AND NOT approved AND NOT expected_approved) AS tp, count(*) FILTER (WHERE NOT failed AND approved AND expected_approved) AS tn,
  count(*) FILTER (WHERE NOT failed AND NOT approved AND expected_approved) AS fp, count(*) FILTER (WHERE NOT failed AND approved AND NOT expected_approved) AS fn, count(*) FILTER (WHERE failed) AS errors FROM t""")
def confusion_with_errors(spark, sf_dir):
    """A run of more iterations than entries, of which some answers fail: those past the end send nothing and count nowhere."""
    results = _results(spark, sf_dir).withColumn("status", F.when(F.col("qid") % 9 == 0, 500).otherwise(200))
    entries = results.withColumn("answer", F.when(F.col("status") == 200, F.col("approved"))).drop("approved").withColumnRenamed("answer", "approved")
    return evaluation.confusion(evaluation.iterated(entries, "qid", 25))


@query(f"WITH {_VOTE} SELECT qid AS tx_id, fraud_count, fraud_count / 5.0::DOUBLE AS fraud_score, fraud_count < 3 AS approved FROM s")
def stream_score(spark, sf_dir):
    """JSON requests as a file stream, scored in micro-batches against the quantised events."""
    from riskgrid.streaming.scorer import score_stream

    refs = adapters.packed(table(spark, sf_dir, "events"))
    incoming, out = _scratch(spark, "requests"), _scratch(spark, "scores")
    texts = adapters.requests(table(spark, sf_dir, "events"), adapters.QUERY_STEP)
    texts.write.parquet(incoming)

    def to_queries(batch: DataFrame) -> DataFrame:
        v = X.vectorize(parse_requests(batch, "request", ("event_id",)), RiskTable(adapters.request_risks()), keep=("event_id",))
        return v.select(F.col("event_id").alias("qid"), *[Q.quantize16(F.col(f"f{i}"), *BOUNDS).alias(f"q{i}") for i in range(DIMS)])

    stream = spark.readStream.schema("event_id long, request string").parquet(incoming)
    score_stream(stream, refs, to_queries, out, _scratch(spark, "stream")).awaitTermination()
    return spark.read.parquet(out).select(F.col("qid").alias("tx_id"), "fraud_count", "fraud_score", "approved")
