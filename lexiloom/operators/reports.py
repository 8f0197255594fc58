"""Corpus reports over identified documents with a declared language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status_by_language(done: DataFrame, lang: str = "lang") -> DataFrame:
    return done.groupBy(F.col(lang).alias("lang"), "status").agg(F.count("*").alias("n"))


def confusion(done: DataFrame, lang: str = "lang") -> DataFrame:
    """Declared against identified language, with the share of the declared."""
    n = done.groupBy(F.col(lang).alias("lang"), F.coalesce("primary_language", F.lit("none")).alias("identified")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6))


def rollup(done: DataFrame, *keys: str) -> DataFrame:
    """Documents and characters by source, declared language and status, with all subtotals."""
    keys = keys or ("source", "lang", "status")
    return done.rollup(*keys).agg(F.count("*").alias("n"), F.sum(F.length("normalized_text")).alias("chars"))
