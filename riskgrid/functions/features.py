"""Feature expressions: Column builders for the fourteen dimensions of a transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.config import DEFAULT_RISK, MOST_MCC, Normalization, RiskTable


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def scaled(x: Column, most: float) -> Column:
    """x / most within 0 and 1; null counts as 0."""
    return clamp01(F.coalesce(x.cast("double"), F.lit(0.0)) / F.lit(most))


def amount_vs_avg(amount: Column, average: Column, ratio: float) -> Column:
    """The ratio to the customer's average, or 1 where there is no positive average."""
    return F.when(average > 0, clamp01(amount.cast("double") / F.when(average > 0, average) / F.lit(ratio))).otherwise(1.0)


def _digits(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("int")


def timestamp_ok(text: Column) -> Column:
    return F.coalesce(F.length(text) >= 19, F.lit(False))


def hour_of_day(text: Column) -> Column:
    """Hour / 23 of an ISO timestamp's own digits, whatever its offset; 0 for a missing or short one."""
    return F.when(timestamp_ok(text), _digits(text, 12, 2) / F.lit(23.0)).otherwise(0.0)


def iso_weekday(text: Column) -> Column:
    """Monday 1 .. Sunday 7 by Sakamoto's congruence on the digits, without a look at the calendar; 1 if they can't be read."""
    y, m, d = _digits(text, 1, 4), _digits(text, 6, 2), _digits(text, 9, 2)
    shift = F.element_at(F.array(*[F.lit(v) for v in (0, 3, 2, 5, 0, 3, 5, 1, 4, 6, 2, 4)]), F.when(m.between(1, 12), m))
    year = y - F.when(m < 3, 1).otherwise(0)
    sunday0 = F.pmod(year + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + shift + d, F.lit(7))
    return F.coalesce(F.when(sunday0 == 0, 7).otherwise(sunday0), F.lit(1)).cast("int")


def day_of_week(text: Column) -> Column:
    return F.when(timestamp_ok(text), (iso_weekday(text) - 1) / F.lit(6.0)).otherwise(0.0)


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 of the digits, without time zones; days beyond a month's end run on into the next. -1 if they can't
    be read, or the month is none."""
    y, m, d = _digits(text, 1, 4), _digits(text, 6, 2), _digits(text, 9, 2)
    days = F.unix_date(F.make_date(y, F.when(m.between(1, 12), m), F.lit(1))).cast("long") + d - 1
    out = days * 86400 + _digits(text, 12, 2) * 3600 + _digits(text, 15, 2) * 60 + _digits(text, 18, 2)
    return F.coalesce(out, F.lit(-1)).cast("long")


def since_last(now: Column, last: Column, most_minutes: float) -> Column:
    """Share of ``most_minutes`` since the last transaction, -1 without one. Both are epoch seconds; last may be null."""
    return F.when(now.isNotNull() & last.isNotNull(), clamp01((now - last) / F.lit(60.0) / F.lit(most_minutes))).otherwise(-1.0)


def flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int").cast("double")


def unknown_merchant(known: Column, merchant: Column) -> Column:
    """1 unless the list holds the merchant; a null list, or nulls in it, hold none."""
    return F.when(F.coalesce(F.array_contains(known, merchant), F.lit(False)), 0.0).otherwise(1.0)


def parsed_mcc(text: Column) -> Column:
    """A category code as a whole number within range: a sign and leading zeros are fine, spaces and points aren't."""
    value = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    return F.when(value.between(0, MOST_MCC), value)


def with_risk(frame: DataFrame, mcc: Column, table: RiskTable, name: str = "risk") -> DataFrame:
    """The frame with the risk of a category code. The table has at most 10,000 rows, so it is broadcast."""
    spark = frame.sparkSession
    risks = spark.createDataFrame([(k, float(v)) for k, v in table.risks.items() if 0 <= k <= MOST_MCC] or [(None, None)], "risk_mcc long, risk_value double")
    joined = frame.withColumn("risk_key", parsed_mcc(mcc)).join(F.broadcast(risks), F.col("risk_key") == F.col("risk_mcc"), "left")
    return joined.withColumn(name, F.coalesce("risk_value", F.lit(DEFAULT_RISK))).drop("risk_key", "risk_mcc", "risk_value")


def vectorize(requests: DataFrame, table: RiskTable | None = None, norm: Normalization | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """f0 .. f13 of nested requests. Missing numbers count as 0; a missing or unreadable last timestamp gives both sentinels."""
    n = norm or Normalization()
    c = F.col
    frame = with_risk(requests, c("merchant.mcc"), table or RiskTable(), "risk")
    # Read once, in columns of their own: each is used several times.
    now_ok = timestamp_ok(c("transaction.requested_at"))
    read = F.when(now_ok & c("last_transaction.timestamp").isNotNull(), epoch_seconds(c("last_transaction.timestamp")))
    frame = frame.withColumns({"now_sec": epoch_seconds(c("transaction.requested_at")), "last_read": read})
    frame = frame.withColumn("last_sec", F.when(c("last_read") != -1, c("last_read")))
    last = c("last_sec")
    amount = F.coalesce(c("transaction.amount"), F.lit(0.0))
    features = [
        scaled(amount, n.max_amount),
        scaled(c("transaction.installments"), n.max_installments),
        amount_vs_avg(amount, c("customer.avg_amount"), n.amount_vs_avg_ratio),
        F.coalesce(hour_of_day(c("transaction.requested_at")), F.lit(0.0)),
        day_of_week(c("transaction.requested_at")),
        since_last(c("now_sec"), last, n.max_minutes),
        F.when(last.isNotNull(), scaled(c("last_transaction.km_from_current"), n.max_km)).otherwise(-1.0),
        scaled(c("terminal.km_from_home"), n.max_km),
        scaled(c("customer.tx_count_24h"), n.max_tx_count_24h),
        flag(c("terminal.is_online")),
        flag(c("terminal.card_present")),
        unknown_merchant(c("customer.known_merchants"), c("merchant.id")),
        c("risk"),
        scaled(c("merchant.avg_amount"), n.max_merchant_avg_amount),
    ]
    return frame.select(*keep, *[f.alias(f"f{i}") for i, f in enumerate(features)])
