"""A training corpus from raw documents: toxic ones out, one of each group of near
duplicates, repeated passages out, sources mixed to weight, and tokens.

Defined cases, for every stage: rows are judged each on its own, whatever ids
they share; a null text counts as an empty one, which is no toxic document, no
copy and no passage, and is in no mix; a null source is a source of its own; very
long texts are handled whole; ties go by id and then by row; an empty table
stays empty; columns other than those of documents are not carried past the
second stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, mixing, near_dedup, substring_dedup, toxicity
from glossa.session import cut, shared_dir, small_side, table

DROPPED_ROWS = 2_000_000  # row numbers, 32 MB: broadcast up to here


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written once, so that a row is itself however
    often its id occurs."""
    home = f"{shared_dir(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
    docs.withColumn("row", F.monotonically_increasing_id()).write.parquet(home)
    return docs.sparkSession.read.parquet(home)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: that of the least id, a null
    last, and of several the first by number."""
    rows = numbered(docs)
    found = near_dedup.near_duplicates(rows, doc_id="row", size=5)
    copies = cut(found.where(~F.col("kept")).select(F.col("doc_id").alias("row"), "component_id"))
    members = copies.unionByName(copies.select(F.col("component_id").alias("row"), "component_id").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    firsts = rows.select("row", "doc_id").join(small_side(members, 2 * copies.count(), DROPPED_ROWS), "row").groupBy("component_id").agg(F.min(order).alias("first"))
    dropped = cut(members.join(firsts.select(F.col("first.row").alias("row")), "row", "left_anti").select("row"))
    return rows.join(small_side(dropped, dropped.count(), DROPPED_ROWS), "row", "left_anti").select(*docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated passages go; a document that has nothing else goes whole."""
    left = substring_dedup.remove_repeats(docs, keep_text=True, carry=("lang", "source"))
    kept = left.where("n_removed = 0 or n_removed < n_words")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; whole epochs over a source leave its empty
    texts out too."""
    rows = numbered(docs)
    plan = mixing.mix(rows, table(spark, sf_dir, "labels"), keep=("row",)).select("row", (F.col("epochs") + F.col("more").cast("long")).alias("copies")).where("copies > 0")
    repeated = rows.where("text <> ''").join(plan, "row")
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and digests of them and of their decoding."""
    return bpe.encode_texts(docs, keep_tokens=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
