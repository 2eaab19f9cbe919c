import gzip
import json
import pickle
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskgrid.config import BLOCK_A, DIMS, Normalization, RiskTable
from riskgrid.functions.quantize import quantize16
from riskgrid.jobs import preprocess
from riskgrid.operators import evaluation, scoring, search
from riskgrid.plans import adapters
from riskgrid.sources import corpus, index_format

COLUMNS = ", ".join(f"q{i} smallint" for i in range(DIMS))


def refs_of(spark, vectors, labels):
    return spark.createDataFrame([(i, bool(y), *map(int, v)) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))], f"ref_id long, is_fraud boolean, {COLUMNS}")


def queries_of(spark, vectors, start=10**6):
    return spark.createDataFrame([(start + i, *map(int, v)) for i, v in enumerate(vectors)], f"qid long, {COLUMNS}")


@pytest.fixture(scope="module")
def sample(spark):
    r = random.Random(42)
    vectors = [[r.randint(-50, 50) for _ in range(DIMS)] for _ in range(400)]
    asked = [[r.randint(-50, 50) for _ in range(DIMS)] for _ in range(7)]
    labels = [r.random() < 0.3 for _ in vectors]
    return vectors, labels, asked, refs_of(spark, vectors, labels).repartition(3).persist(), queries_of(spark, asked)


def brute(vectors, asked, k, dims=range(DIMS)):
    return [[i for _, i in sorted((sum((a[d] - v[d]) ** 2 for d in dims), i) for i, v in enumerate(vectors))[:k]] for a in asked]


def ids(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.ref_id)
    return [out[q] for q in sorted(out)]


@pytest.mark.parametrize("strategy", ["arrow", "frame"])
def test_exact_equals_scan(sample, strategy):
    vectors, _, asked, refs, queries = sample
    assert ids(search.exact(queries, refs, strategy=strategy)) == brute(vectors, asked, 5)


@pytest.mark.parametrize("strategy", ["arrow", "frame"])
def test_two_stage(sample, strategy):
    vectors, _, asked, refs, queries = sample
    kept = ids(search.prune(queries, refs, 30, strategy))
    assert kept == brute(vectors, asked, 30, (0, 6, 7, 9, 10, 12))
    found = ids(search.two_stage(queries, refs, 5, 30, strategy))
    for mine, among, a in zip(found, kept, asked, strict=True):
        d = lambda i, a=a: sum((x - y) ** 2 for x, y in zip(a, vectors[i], strict=True))
        assert [d(i) for i in mine] == sorted(map(d, among))[:5]
    certified = {r.qid: r.certified for r in search.certificate(queries, refs, 5, 30, strategy).collect()}
    exact = brute(vectors, asked, 5)
    for q, (mine, true) in enumerate(zip(found, exact, strict=True)):
        if certified[10**6 + q]:
            assert set(mine) == set(true)


def test_blocks_of_queries_and_self(spark, sample, monkeypatch):
    vectors, _, asked, refs, queries = sample
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert ids(search.exact(queries, refs)) == brute(vectors, asked, 5)
    own = refs.where("ref_id < 4").select(F.col("ref_id").alias("qid"), *[f"q{i}" for i in range(DIMS)])
    assert all(q not in found for q, found in enumerate(ids(search.exact(own, refs))))


def test_bounds_carry_over_batches(spark, sample):
    vectors, _, asked, refs, queries = sample
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert ids(search.exact(queries, refs.coalesce(1))) == brute(vectors, asked, 5)
        assert ids(search.exact(queries, refs.coalesce(1), k=50)) == brute(vectors, asked, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_go_to_the_smallest_id(spark):
    refs = refs_of(spark, [[0] * DIMS] * 20, [False] * 20).repartition(4)
    assert ids(search.exact(queries_of(spark, [[1] * DIMS]), refs)) == [[0, 1, 2, 3, 4]]


def test_topk_queue(spark):
    frame = spark.createDataFrame([(0, 10.0), (1, 5.0), (2, 2.0), (3, 8.0), (4, 1.0), (5, 3.0)], "i int, d double").withColumn("qid", F.lit(1))
    got = search.topk(frame, "qid", "d", "i").orderBy("rank")
    assert [(r.i, r.d) for r in got.collect()] == [(4, 1), (2, 2), (5, 3), (1, 5), (3, 8)]
    assert search.worst_distance(got).first().worst == 8
    assert search.worst_distance(got.limit(3)).first().worst == float("inf")


def ten_step(spark):
    rows = [(i, i >= 5, [i / 10] + [0.0] * 13) for i in range(10)]
    frame = spark.createDataFrame(rows, "ref_id long, is_fraud boolean, vector array<double>")
    low, high = corpus.bounds(frame)
    return corpus.quantise(frame, low, high), low, high


@pytest.mark.parametrize("mode", ["exact", "two_stage"])
@pytest.mark.parametrize(("share", "score"), [(0.8, 1.0), (0.2, 0.0)])
def test_ten_step_corpus(spark, mode, share, score):
    refs, low, high = ten_step(spark)
    query = spark.createDataFrame([(99, share)], "qid long, x double").select("qid", quantize16(F.col("x"), low, high).alias("q0"), *[quantize16(F.lit(0.0), low, high).alias(f"q{i}") for i in range(1, DIMS)])
    row = scoring.scored(query, refs, mode).first()
    assert (row.fraud_score, row.approved) == (score, score < 0.6)


def test_three_of_five_is_denied_and_small_corpora_count_of_five(spark):
    frame = spark.createDataFrame([(c,) for c in range(6)], "c long")
    assert [r[0] for r in frame.select(scoring.approved(F.col("c"))).collect()] == [True, True, True, False, False, False]
    refs = refs_of(spark, [[0] * DIMS, [1] * DIMS], [True, True])
    assert scoring.scored(queries_of(spark, [[0] * DIMS]), refs).first().fraud_score == 0.4
    empty = refs.where("ref_id < 0")
    row = scoring.scored(queries_of(spark, [[0] * DIMS]), empty).first()
    assert (row.fraud_score, row.approved) == (0.0, True)


def test_engine_fails_open_and_tells_readiness(spark):
    engine = scoring.Engine(None)
    assert not engine.ready and engine.warm_up().ready and engine.size() == 0
    row = engine.score(queries_of(spark, [[0] * DIMS])).first()
    assert (row.fraud_score, row.approved) == (0.0, True)
    full = scoring.Engine(refs_of(spark, [[0] * DIMS, [5] * DIMS], [False, True])).warm_up()
    assert full.size() == 2 and [r.is_fraud for r in full.refs.orderBy("ref_id").collect()] == [False, True]
    full.close()
    assert not full.ready


def test_report_equals_the_recorded_run(spark):
    counts = spark.createDataFrame([(2, 29953, 69, 24035, 0)], "tp long, tn long, fp long, fn long, errors long")
    row = evaluation.report(counts, spark.createDataFrame([(1.17,)], "p99 double")).first()
    assert (row.n, row.weighted, round(row.epsilon, 6), round(100 * row.failure_rate, 2)) == (54059, 72174, 1.335097, 44.59)
    assert row.detection_score == -3000
    # The recorded latency is rounded; this one gives the recorded score.
    row = evaluation.report(counts, spark.createDataFrame([(1000 / 10**2.93235,)], "p99 double")).first()
    assert (round(row.p99, 2), round(row.p99_score, 2), round(row.final_score, 2)) == (1.17, 2932.35, -67.65)
    values = spark.createDataFrame([(0.0,), (2001.0,), (0.5,), (100.0,)], "v double")
    assert [r[0] for r in values.select(evaluation.p99_score(F.col("v"))).collect()] == [0.0, -3000.0, 3000.0, 1000.0]
    nothing = spark.createDataFrame([(0, 0, 0, 0, 0)], "tp long, tn long, fp long, fn long, errors long")
    assert evaluation.weighted_error(nothing).first().failure_rate == 0


def test_corpus_files(spark, tmp_path):
    vectors = [{"vector": [i / 10] + [0] * 13, "label": "fraud" if i > 2 else "legit"} for i in range(4)]
    rows = [vectors[0], {"label": "fraud"}, {**vectors[1], "is_fraud": "true", "fraud": True}, {**vectors[2], "is_fraud": False, "label": "fraud"}, vectors[3]]
    for name in ("a", "b"):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump(rows, f)
    got = corpus.read_corpus(spark, f"file://{tmp_path}").orderBy("ref_id").collect()
    assert [r.ref_id for r in got] == list(range(8))
    assert [r.is_fraud for r in got] == [False, True, False, True] * 2
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps([{"vector": [1, 2]}]))
    with pytest.raises(Exception, match="a vector of 14 numbers"):
        corpus.read_corpus(spark, f"file://{bad}").collect()
    assert corpus.bounds(corpus.read_corpus(spark, f"file://{bad}").where("ref_id < 0")) == (float("inf"), float("-inf"))


@pytest.mark.parametrize("kind", ["parquet", "flat_index"])
def test_preprocess_and_engine_from_a_path(spark, tmp_path, kind):
    rows = [{"vector": [i / 10] + [0] * 13, "label": "fraud" if i >= 5 else "legit"} for i in range(10)] + [{"label": "fraud"}]
    with gzip.open(tmp_path / "corpus.json.gz", "wt") as f:
        json.dump(rows, f)
    target = f"file://{tmp_path}/index"
    preprocess.main([f"file://{tmp_path}/corpus.json.gz", target, "--format", kind])
    engine = scoring.Engine.from_path(spark, target, kind=kind).warm_up()
    asked = spark.createDataFrame([(99, 0.8)], "qid long, x double").select("qid", quantize16(F.col("x"), 0.0, 0.9).alias("q0"), *[quantize16(F.lit(0.0), 0.0, 0.9).alias(f"q{i}") for i in range(1, DIMS)])
    assert engine.size() == 10 and (engine.score(asked).first().fraud_score, engine.score(asked).first().approved) == (1.0, False)
    engine.close()
    missing = scoring.Engine.from_path(spark, f"file://{tmp_path}/nothing")
    assert missing.score(asked).first().approved and missing.size() == 0
    with pytest.raises(ValueError, match="mounted"):
        index_format._local("hdfs://a/b")


def test_configuration_files(spark, tmp_path):
    (tmp_path / "risk.json").write_text('{"5411": 0.15, "12345": 1, "7995": 0.9}')
    (tmp_path / "norm.json").write_text('{"max_amount": 5000, "other": 1}')
    assert RiskTable.from_json(corpus.read_text(spark, f"file://{tmp_path}/risk.json")).risks == {5411: 0.15, 7995: 0.9}
    assert Normalization.from_json(corpus.read_text(spark, f"file://{tmp_path}/norm.json")).max_amount == 5000
    with pytest.raises(FileNotFoundError, match="missing resource"):
        corpus.read_text(spark, f"file://{tmp_path}/none.json")


def test_iterations_past_the_end_count_nowhere(spark):
    rows = [(i, i % 3 != 0, i % 2 == 0, 500 if i == 4 else 200) for i in range(10)]
    frame = spark.createDataFrame(rows, "qid long, approved boolean, expected_approved boolean, status int")
    for beyond in (0, 7):
        got = evaluation.confusion(evaluation.iterated(frame, "qid", beyond)).first()
        assert (got.tp, got.tn, got.fp, got.fn, got.errors) == (2, 2, 2, 3, 1)
    assert evaluation.iterated(frame.where("false"), "qid", 3).count() == 0


def test_flat_index(spark, tmp_path):
    r = random.Random(1)
    n = 300
    refs = refs_of(spark, [[r.randint(-32768, 32767) for _ in range(DIMS)] for _ in range(n)], [r.random() < 0.5 for _ in range(n)])
    spark.dataSource.register(index_format.FlatIndex)
    path = str(tmp_path / "index.bin")
    refs.repartitionByRange(4, "ref_id").write.format("flat_index").mode("append").option("min", "-1").option("max", "1").save(path)
    data = open(path, "rb").read()
    assert len(data) == 16 + 28 * n + -(-n // 8) and data[:4] == bytes([0x52, 0x5A, 0x41, 0x52])
    assert index_format.header(data) == (n, -1.0, 1.0)
    assert [tuple(x) for x in spark.read.format("flat_index").load(path).orderBy("ref_id").collect()] == [tuple(x) for x in refs.orderBy("ref_id").collect()]
    with pytest.raises(ValueError, match="Invalid magic"):
        index_format.header(b"\0" * 16)


def test_entries(spark, tmp_path):
    path = tmp_path / "entries.json"
    path.write_text(json.dumps({"entries": [{"request": {"id": "a", "transaction": {"amount": 1.0}}, "expected_approved": True}], "stats": {"total": 1}}))
    row = corpus.read_entries(spark, f"file://{path}").first()
    assert row.request.id == "a" and row.expected_approved


def test_frame_strategy_takes_more_queries_than_a_block(sample, monkeypatch):
    vectors, _, asked, refs, queries = sample
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert ids(search.exact(queries, refs, 5, "frame")) == brute(vectors, asked, 5)


@pytest.fixture(scope="module")
def clustered(spark):
    """30,000 references around 40 centres, each vector three times: several cells, and ties everywhere."""
    r = np.random.default_rng(3)
    values = np.repeat(r.integers(-30000, 30000, (40, DIMS))[r.integers(0, 40, 10000)] + r.integers(-40, 40, (10000, DIMS)), 3, axis=0)
    ids = r.permutation(30000)
    table = pa.table({"ref_id": ids, "is_fraud": ids % 7 == 0, **{f"q{i}": values[:, i].astype(np.int16) for i in range(DIMS)}})
    order = np.argsort(ids)
    return values[order].astype(np.int64), spark.createDataFrame(table.to_pandas()).repartition(5).persist()


@pytest.mark.parametrize("strategy", ["arrow", "frame"])
def test_cells_give_the_nearest_of_all(spark, clustered, strategy):
    values, refs = clustered
    queries = {"own": search.Every(500), "other": search.Every(500).frame(refs)}[{"arrow": "own", "frame": "other"}[strategy]]
    near, kept = (defaultdict(list) for _ in range(2))
    for x in search.exact(queries, refs, strategy=strategy).orderBy("qid", "rank").collect():
        near[x.qid].append((x.ref_id, x.d))
    for x in search.prune(queries, refs, 30, strategy).orderBy("qid", "rank").collect():
        kept[x.qid].append((x.ref_id, x.da, x.d))
    assert len(near) == len(kept) == 60
    for q in near:
        squares = (values - values[q]) ** 2
        da, d, ids = squares[:, list(BLOCK_A)].sum(axis=1), squares.sum(axis=1), np.arange(len(values))
        own = ids != q
        assert near[q] == [(i, d[i]) for i in ids[own][np.lexsort((ids[own], d[own]))[:5]]]
        assert kept[q] == [(i, da[i], d[i]) for i in ids[own][np.lexsort((ids[own], da[own]))[:30]]]


def test_queries_are_sent_to_few_blocks(clustered):
    _, refs = clustered
    blocks, met = search._routed(refs, search.Every(50), search.names(DIMS), [], 5, "is_fraud")
    n = blocks.count()
    sent = sum(len(pickle.loads(x.content)[0]) for x in met.where("kind = 1").collect())
    assert n >= 4 and 600 <= sent < 600 * n / 2


def odd_events(spark):
    props = ['{"k": 7}', '{"k": 2147483647}', '{"k": -33}', '{"k":27}', '{"k": 47 }', '{"k": "8"}', '{"j": 1}', "{}", None, '{"k": -2147483648}', '{"k": 007}', '{"j": 1, "k": 87}', '{"k": 0}', '{"k": -0}']
    day = [0, 0, 1, 86399, 86400, 86401, 86401, 172800, 172801, 200000, 259200, 300000, 300000, 400000]
    rows = [(i, None if i % 29 == 5 else day[i % 14] + i // 28, i % 3, float(i), props[i * 5 % 14]) for i in range(140)]
    frame = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double, props string")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)")
    return frame.select("event_id", ts.alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", "props")


def test_growing_windows_equal_moving_ones(spark):
    from pyspark.sql import Window

    frame = odd_events(spark)
    got = adapters.transactions(frame)
    by = Window.partitionBy("user_id", F.get_json_object("props", "$.k").cast("int") % 20).orderBy("sec", "event_id")
    want = adapters.events(frame).join(frame.select("event_id", "props"), "event_id").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("sec").rangeBetween(-86400, -1)).alias("tx_count_24h"), (F.row_number().over(by) == 1).alias("first_there"))
    one, other = ({r.event_id: tuple(r) for r in x.select("event_id", "k", "tx_count_24h", "first_there").collect()} for x in (got, want))
    assert len(one) == 140 and one == other


def test_features_move_once_and_are_compiled(spark, sf):
    """One shuffle of the events, no moving window, and no projection of all features in whole-stage code, which is too long for that."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        refs = adapters.quantised(spark.read.parquet(f"{sf}/events.parquet"))
        plan = refs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(user_id") == 1 and "SortMergeJoin" not in plan and "RangeFrame, -86400" not in plan
    assert "lambdafunction" in plan  # such an expression is never in whole-stage code


def test_blocks_are_made_once(clustered):
    """The boxes are taken from whole blocks, so that the shuffle of these is used again; without that columns are pruned below it."""
    _, met = search._routed(clustered[1], search.Every(50), search.names(DIMS), [], 5, "is_fraud")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[collect_list\(struct\(b.*\n[^\n]*MapInArrow boxed", plan)) == 1


def test_distances_to_boxes_by_parts(monkeypatch):
    r = np.random.default_rng(1)
    points, low = r.integers(-9, 9, (50, 3)).astype(float), r.integers(-9, 9, (20, 3))
    high = low + r.integers(0, 5, (20, 3))
    want = (np.maximum(np.maximum(low - points[:, None], points[:, None] - high), 0) ** 2).sum(axis=2)
    monkeypatch.setattr(search, "CACHED", 60)
    assert (search._apart(points, low, high) == want).all() and search._apart(points[:0], low, high).shape == (0, 20)


def test_certificate_searches_once(clustered):
    found = search.certificate(search.Every(500), clustered[1], 5, 30)
    assert found.count() == 60 and found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow gather") == search.prune(search.Every(500), clustered[1], 30)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow gather")


def test_a_block_gives_what_brute_force_does(monkeypatch):
    """With ties, fewer references than asked for, queries among the references, and candidates cut before all are found."""
    r = np.random.default_rng(5)
    values = r.integers(-3, 4, (900, 3)).astype(np.int16)
    numbers = r.permutation(5000)[:900].astype(np.int64)
    block = search._Block.of(numbers, np.zeros(900, np.uint8), values, 2)
    qids, q = np.concatenate([numbers[:40], [9000, 9001]]), np.concatenate([values[:40], [[0, 0, 0], [30, 30, 0]]]).astype(np.int16)
    d = ((q[:, None, :2].astype(int) - values[None, :, :2]) ** 2).sum(axis=2).astype(float)
    d[np.arange(40), np.arange(40)] = np.inf
    for most in (search.TILE, 50):
        monkeypatch.setattr(search, "TILE", most)
        for k in (1, 5, 100, 899, 950):
            bound = block.bound(qids, q, k, 2)
            assert (bound == (np.sort(d, axis=1)[:, k - 1] if k <= 900 else np.inf)).all()
            for limit in (np.full(42, np.inf), bound, np.full(42, 2.0)):
                row, column, near = block.search(qids, q, limit, k, 2)
                found = defaultdict(list)
                for i, c, x in zip(row, column, near, strict=True):
                    found[i].append((x, block.ids[c]))
                for i in range(42):
                    want = [(x, n) for x, n in sorted(zip(d[i], numbers, strict=True)) if np.isfinite(x) and x <= limit[i]][:k]
                    assert sorted(found[i]) == want


def test_both_searches_of_recall_share_the_blocks(spark, sf):
    """Blocks are packed the same way whatever is searched by: features and blocks are made once."""
    from riskgrid.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.QUERIES["recall_at_k"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("MapInArrow run(event_id") == 1
