"""What the registered queries share: the registry, passages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import table

WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> '')"
SQL_WORDS = f"""
base AS (SELECT doc_id AS text_id, {WORDS} AS w FROM documents),
words AS (SELECT text_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS word_id FROM base)"""
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), "text")
