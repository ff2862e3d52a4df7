"""Queries of the scans and sinks: tables written as files and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossa.operators import checks, words
from glossa.plans.base import SQL_WORDS, passages, query
from glossa.session import shared_dir, table
from glossa.sources import readers, stores


def _home(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


ORDER_WORDS = """CASE o_orderstatus WHEN 'P' THEN 'NA' WHEN 'F' THEN '' ELSE 'a "b" c' END AS word"""


@query(f"SELECT o_orderkey, {ORDER_WORDS}, o_orderpriority FROM orders")
def delimited_scan(spark, sf_dir):
    """S1, S8: 'NA' and '' stay words, quotes come back."""
    home = _home(spark, "delimited")
    readers.write_table(table(spark, sf_dir, "orders").selectExpr("o_orderkey", ORDER_WORDS, "o_orderpriority"), home, sep="\t")
    return readers.read_table(spark, home, "o_orderkey long, word string, o_orderpriority string")


@query(f"SELECT o_orderkey, {ORDER_WORDS} FROM orders")
def unquoted_scan(spark, sf_dir):
    """Quotes are letters like any other."""
    home = _home(spark, "unquoted")
    readers.write_table(table(spark, sf_dir, "orders").selectExpr("o_orderkey", ORDER_WORDS), home, sep="\t", quoting=False)
    return readers.read_table(spark, home, "o_orderkey long, word string", quoting=False)


@query(f"SELECT o_orderkey, nullif(word, '') AS word FROM (SELECT o_orderkey, {ORDER_WORDS} FROM orders)")
def empty_as_missing_scan(spark, sf_dir):
    """S3: '' is missing, 'NA' isn't."""
    home = _home(spark, "missing")
    readers.write_table(table(spark, sf_dir, "orders").selectExpr("o_orderkey", ORDER_WORDS), home, sep="\t")
    return readers.read_table(spark, home, "o_orderkey long, word string", empty_is_null=True)


@query("SELECT c_custkey, c_name || ' é ñ ß' AS name FROM customer")
def latin1_scan(spark, sf_dir):
    """S5."""
    home = _home(spark, "latin1")
    readers.write_table(table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(c_name, ' é ñ ß') AS name"), home, sep=",", encoding="ISO-8859-1")
    return readers.read_table(spark, home, "c_custkey long, name string", sep=",", encoding="ISO-8859-1")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS text_id, translate(text, chr(10) || chr(13), '  ') AS text FROM documents")
def passage_files(spark, sf_dir):
    """Passages written one a line and numbered by line again."""
    home = _home(spark, "passages")
    readers.write_passages(passages(spark, sf_dir).withColumn("text", F.translate("text", "\n\r", "  ")), home)
    return readers.read_passages(spark, home)


@query("SELECT CAST(o_custkey % 5 AS VARCHAR) AS worker, year(o_orderdate) AS text_id, replace(o_orderpriority, ' ', '') || '“é”' AS \"WORD\", CAST(o_orderkey AS VARCHAR) AS \"FXNO\" FROM orders")
def fixation_scan(spark, sf_dir):
    """Worker and text id from the files' paths, Windows-1252 quotes decoded."""
    home = _home(spark, "fixations")
    cp1252 = F.concat(F.replace("o_orderpriority", F.lit(" "), F.lit("")), F.lit("\x93é\x94"))
    rows = table(spark, sf_dir, "orders").select(F.concat_ws("\t ", cp1252, F.col("o_orderkey").cast("string")).alias("line"), (F.col("o_custkey") % 5).alias("w"), F.year("o_orderdate").alias("t"))
    rows.write.partitionBy("w", "t").options(encoding="ISO-8859-1", quote="", sep="\x01", header=False).csv(home)
    return readers.read_fixation_files(spark, home, "*.csv", r"/w=(\d+)/t=(\d+)/", ["WORD", "FXNO"], on="file_path").drop("row_idx")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus AS dataset, lower(replace(o_orderpriority, ' ', '')) AS model,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'first' ELSE split_part(o_orderpriority, '-', 1) END AS family FROM orders""")
def result_grid_scan(spark, sf_dir):
    """Result files by dataset and model, as many as there are."""
    home = _home(spark, "grid")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("d"), F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit(""))).alias("m"))
    readers.write_table(rows, home, sep="\t", parts=["d", "m"])
    return readers.read_result_grid(spark, home, "*.csv", r"/d=([^/]+)/m=([^/]+)/", {"1-urgent": "first"}, on="file_path")


@query(f"WITH {SQL_WORDS} SELECT text_id, word_id, word, length(word)::DOUBLE AS value, text_id IN (SELECT doc_id FROM labels) AS reused FROM words")
def resumed_scores(spark, sf_dir):
    """A run that stopped after the labelled documents, another run's scores of
    all, and the same run again, in batches."""
    score = lambda p: words.word_table(p).select("text_id", "word_id", "word", F.col("word_len").cast("double").alias("value"))
    docs, labelled = passages(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("text_id")).distinct()
    store = stores.score_store(spark, _home(spark, "scores"))
    store.commit(score(docs.join(labelled, "text_id", "left_semi")), "this")
    store.commit(score(docs).withColumn("value", F.lit(0.0)), "other")
    return stores.resume_scores(docs, store, "this", score, batches=2)


@query("SELECT doc_id AS text_id, sha256(text) AS sha256 FROM documents")
def text_digests(spark, sf_dir):
    return checks.text_digests(passages(spark, sf_dir))
