import json
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskgrid.config import Normalization, RiskTable
from riskgrid.functions import features as X
from riskgrid.functions import quantize as Q
from riskgrid.plans import adapters
from riskgrid.sources.corpus import parse_requests


def request(**changes):
    base = {
        "id": "t", "transaction": {"amount": 100.0, "installments": 1, "requested_at": "2026-03-11T18:45:53Z"},
        "customer": {"avg_amount": 100.0, "tx_count_24h": 1, "known_merchants": ["m1", "m1", None]}, "merchant": {"id": "m1", "mcc": "5411", "avg_amount": 100.0},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 10.0}, "last_transaction": {"timestamp": "2026-03-11T18:40:53Z", "km_from_current": 5.0},
    }
    for key, value in changes.items():
        base[key] = {**base[key], **value} if isinstance(value, dict) and base.get(key) else value
    return base


def vector(spark, body):
    frame = spark.createDataFrame([(json.dumps(body),)], "value string")
    return [float(x) for x in X.vectorize(parse_requests(frame)).first()[1:]]


def test_complete_request(spark):
    expected = [0.01, 1 / 12, 0.1, 18 / 23, 2 / 6, 5 / 1440, 5 / 1000, 10 / 1000, 1 / 20, 0, 1, 0, 0.5, 0.01]
    assert vector(spark, request()) == pytest.approx(expected, abs=1e-9)


def test_no_last_transaction_gives_sentinels(spark):
    assert vector(spark, request(last_transaction=None))[5:7] == [-1, -1]
    assert vector(spark, request(last_transaction={"timestamp": None}))[5:7] == [-1, -1]
    assert vector(spark, request(last_transaction={"timestamp": "when?"}))[5:7] == [-1, -1]


def test_clamped_request(spark):
    body = request(transaction={"amount": 2e4, "installments": 24}, customer={"avg_amount": 10.0, "tx_count_24h": 99, "known_merchants": None}, terminal={"km_from_home": 5000.0}, merchant={"avg_amount": 5e4})
    got = vector(spark, body)
    assert [got[i] for i in (0, 1, 2, 7, 8, 11, 13)] == [1] * 7


def test_missing_average_and_short_timestamp(spark):
    got = vector(spark, request(customer={"avg_amount": 0.0}, transaction={"requested_at": "2026-03-11"}))
    assert got[2] == 1 and got[3] == 0 and got[4] == 0 and got[5] == -1


def test_times_ignore_zones(spark):
    frame = spark.createDataFrame([("2026-03-11T18:45:53+05:00",), ("2024-02-29T00:00:00.123Z",), ("1969-12-31T23:59:59Z",), ("nonsense",), (None,)], "t string")
    got = [tuple(r) for r in frame.select(X.epoch_seconds(F.col("t")), X.iso_weekday(F.col("t"))).collect()]
    assert got == [(1773254753, 3), (1709164800, 4), (-1, 3), (-1, 1), (-1, 1)]


def test_days_run_on_and_months_do_not(spark):
    frame = spark.createDataFrame([("2026-02-30T00:00:01Z",), ("2024-02-30T00:00:00Z",), ("2026-13-01T00:00:00Z",), ("2026-00-01T00:00:00Z",), ("2026-04-31T25:61:00Z",)], "t string")
    got = [r[0] for r in frame.select(X.epoch_seconds(F.col("t"))).collect()]
    assert got == [1772409601, 1709251200, -1, -1, 1777593600 + 25 * 3600 + 61 * 60]


def test_mcc(spark):
    codes = ["5411", "05812", "+6011", " 5411", "5411.7", "", None, "10000", "9999", "-1"]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, mcc string")
    got = [r.risk for r in X.with_risk(frame, F.col("mcc"), RiskTable()).orderBy("i").collect()]
    assert got == [0.5, 0.8, 1.2, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5]
    assert RiskTable.from_json('{"5411": 0.3, "10001": 1}').risks == {5411: 0.3}
    assert Normalization.from_json('{"max_km": 5}').max_km == 5.0


def test_quantisers(spark):
    frame = spark.createDataFrame([(x,) for x in (-10.0, 10.0, 0.0, 99.0)], "x double")
    assert [r[0] for r in frame.select(Q.quantize16(F.col("x"), -10.0, 10.0)).collect()] == [-32768, 32767, 0, 32767]
    frame = spark.createDataFrame([(-1.0,), (1.0,), (0.0,), (1.2,)], "x double")
    assert [r[0] for r in frame.select(Q.quantize16_query(F.col("x"), 0.0, 0.9)).collect()][:2] == [25488, -25488]
    assert [r[0] for r in frame.select(Q.quantize16_query(F.col("x"), -1.0, 1.0)).collect()] == [-32768, 32767, 0, -26216]
    assert [r[0] for r in frame.select(Q.quantize16_query(F.col("x"), 1.0, 1.0)).collect()] == [0] * 4
    frame = spark.createDataFrame([(x,) for x in (0.0, 1.0, 100.0, 1e6, -1.0)], "x double")
    assert [r[0] for r in frame.select(Q.sqrt_guarded(F.col("x"))).collect()] == [0, 1, 10, 1000, 0]


def test_labels(spark):
    rows = [(False, None, "fraud", False), (None, True, None, True), (None, None, "fraud", True), (None, None, "FRAUD", False), (None, None, None, False)]
    frame = spark.createDataFrame(rows, "a boolean, b boolean, c string, expected boolean")
    assert frame.where(Q.label(F.col("a"), F.col("b"), F.col("c")) != F.col("expected")).count() == 0


def test_running_mean_keeps_its_precision(spark):
    values = [round(0.01 * (i * 7919 % 50021), 2) for i in range(6000)]
    frame = spark.createDataFrame(list(enumerate(values)), "i long, value double").withColumn("u", F.lit(1))
    window = Window.partitionBy("u").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    got = {r.i: r.mean for r in frame.select("i", adapters.running_mean("value", window).alias("mean")).collect()}
    assert got[0] is None and got[1] == values[0]
    for i in range(adapters.SHORT + 1, 6000):
        assert abs(got[i] - math.fsum(values[:i]) / i) <= 2 * math.ulp(got[i])
