"""Queries p6 to p8: leaked evaluation items, source mixing, reading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import leakage, mixing, reading, tokens
from tesserae.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: how many documents hold it, and how much of it at most."""
    found = leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    counts = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("most_words"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(counts, "item_id")


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    counts = tokens.token_counts(table(spark, d, "documents"), keep=("doc_id", "source"))
    return mixing.mix(counts, table(spark, d, "mix_targets"))


def p7_drawn(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).drawn


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels")).select("doc_id", "level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by source and level."""
    levels = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))
    return levels.groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    return reading.validation(table(spark, d, "documents"), table(spark, d, "level_labels"))


QUERIES = {f.__name__: f for f in (p6_found, p6_report, p7_drawn, p7_shares, p8_found, p8_profile, p8_validation)}

#: None of these is expressible in SQL: they are tested against brute force, exact sums and held-out labels.
SQL: dict[str, str] = {}
