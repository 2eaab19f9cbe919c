"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskgrid.llm import decontaminate, jpeg, langid, licenses, lines, neardup, pieces, pii, substrings, warc
from riskgrid.llm.tables import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(spark, sf_dir)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, sf_dir)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, sf_dir)


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.store(table(spark, sf_dir, "documents")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(spark, sf_dir)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(spark, sf_dir)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(spark, sf_dir)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(spark, sf_dir)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, sf_dir)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii, op2_language_id, op3_near_duplicates, op4_jpeg_media, op5_substring_dedup, op6_sentencepiece, op7_license_scan, op8_line_dedup, op9_warc, op10_decontamination)}
ORACLES: dict[str, str] = {"op5_substring_dedup": substrings.SQL, "op8_line_dedup": lines.SQL, "op9_warc": warc.SQL}
