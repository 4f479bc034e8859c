"""Queries of the text problems. SQL can't say them; they are tested by brute force, round trips and held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint, table
from . import leak, reading, tokens


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"))


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf, "documents"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaked_items(_leaks(spark, sf), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return reading.profile(checkpoint(reading.levels(documents, table(spark, sf, "reading_labels"))), documents)


def queries() -> dict:
    return {f.__name__: f for f in (p7_ids, p7_round_trip, p8_found, p8_items, p9_found, p9_profile)}


def oracle_sql() -> dict[str, str]:
    return {}
