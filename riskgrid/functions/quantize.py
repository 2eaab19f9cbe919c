"""Quantisers, integer distances and the guarded square root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(x: Column, low: float, high: float) -> Column:
    """The place of x, clamped, between the bounds; equal bounds count as one apart."""
    width = high - low if high != low else 1.0
    return (F.greatest(F.lit(low), F.least(F.lit(high), x)) - F.lit(low)) / F.lit(width)


def quantize16(x: Column, low: float, high: float) -> Column:
    """Corpus side: clamped, rounded half up to 16 bits with sign."""
    return F.floor(_share(x, low, high) * 65535.0 - 32768.0 + 0.5).cast("smallint")


def quantize8(x: Column, low: float, high: float) -> Column:
    return F.floor(_share(x, low, high) * 255.0 - 128.0 + 0.5).cast("tinyint")


def quantize16_query(x: Column, low: float, high: float) -> Column:
    """Query side of the parity mode: not clamped, cut toward zero, wrapped to 16 bits. Equal bounds give 0."""
    if high == low:
        return F.lit(0).cast("smallint")
    raw = (x - F.lit(low)) / F.lit(high - low) * 65535.0 - 32768.0
    cut = F.when(raw < 0, F.ceil(raw)).otherwise(F.floor(raw))
    return (F.pmod(cut + 32768, F.lit(65536)) - 32768).cast("smallint")


def squared_distance(a: Sequence[Column], b: Sequence[Column], kind: str = "long") -> Column:
    """Sum of squared differences, one unrolled expression; smallints are widened before they are subtracted."""
    out = F.lit(0).cast(kind)
    for x, y in zip(a, b, strict=True):
        d = x.cast(kind) - y.cast(kind)
        out = out + d * d
    return out


def sqrt_guarded(x: Column) -> Column:
    """Square root as a float, 0 below 0."""
    return F.when(x < 0, 0.0).otherwise(F.sqrt(F.greatest(x, F.lit(0.0)))).cast("float")


def label(is_fraud: Column, fraud: Column, text: Column) -> Column:
    """The first of two booleans that is there decides, then the exact word."""
    return F.coalesce(is_fraud, fraud, text == "fraud", F.lit(False))
