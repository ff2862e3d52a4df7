"""Stores that jobs fill bit by bit, and resume where an earlier one was stopped.

A commit's rows lie in a folder of their own, by name (an index, or the identity of a
run) and commit; when they are all there, a line in the manifest makes them part of the
store. Rows that the manifest lacks don't count, so a job that is killed half way
leaves nothing behind that a later one could read, and a later one computes only what
no commit has. A name has one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.grams import ngram_counts
from glossa.operators.words import word_table
from glossa.session import cut, small_side

MANIFEST = "name string, commit string, number long, held long"


@dataclass(frozen=True)
class Store:
    """home's rows of ddl, told apart by keys."""

    spark: SparkSession
    home: str
    ddl: str
    keys: list[str]

    def __post_init__(self) -> None:
        for folder, ddl in (("manifest", MANIFEST), ("rows", f"{self.ddl}, name string, commit string")):
            self.spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{self.home}/{folder}")

    def manifest(self, name: str) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.home}/manifest").where(F.col("name") == name)

    def rows(self, name: str) -> DataFrame:
        """Committed rows, with the number of their commit."""
        written = self.spark.read.schema(f"{self.ddl}, name string, commit string").parquet(f"{self.home}/rows").where(F.col("name") == name)
        commits = self.manifest(name)
        return written.join(small_side(commits.select("commit", "number"), commits.count()), "commit").drop("name", "commit")

    def missing(self, needed: DataFrame, name: str) -> DataFrame:
        """What is needed and in no commit."""
        return needed.select(*self.keys).distinct().join(self.rows(name).select(*self.keys).distinct(), self.keys, "left_anti")

    def commit(self, rows: DataFrame, name: str) -> int:
        """Write rows and then their line in the manifest; their number."""
        commit, number = uuid.uuid4().hex, self.commits(name) + 1
        rows.withColumns({"name": F.lit(name), "commit": F.lit(commit)}).write.mode("append").partitionBy("name", "commit").parquet(f"{self.home}/rows")
        held = self.spark.read.schema(f"{self.ddl}, name string, commit string").parquet(f"{self.home}/rows").where(F.col("commit") == commit).count()
        self.spark.createDataFrame([(name, commit, number, held)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.home}/manifest")
        return number

    def commits(self, name: str) -> int:
        return self.manifest(name).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]


def count_store(spark: SparkSession, home: str) -> Store:
    """Counts of n-grams by index; order 0 with an empty n-gram is the corpus size."""
    return Store(spark, home, "order int, ngram string, cnt long", ["order", "ngram"])


def extend_counts(corpus: DataFrame, needed: DataFrame, store: Store, index_name: str) -> DataFrame:
    """(order, ngram, cnt, reused) of the needed n-grams. Those that no commit of the
    index has are counted in one pass over the corpus, 0 where it lacks them, and
    committed; the others are reused."""
    open_ = cut(store.missing(needed, index_name))
    before = store.commits(index_name)
    if not open_.isEmpty():
        top = max(open_.agg(F.max("order")).first()[0], 1)
        counts = ngram_counts(corpus, top, needed=open_.where("order > 0"))
        store.commit(open_.join(counts, store.keys, "left").select(*store.keys, F.coalesce("cnt", F.lit(0)).alias("cnt")), index_name)
    wanted = needed.select(*store.keys).distinct().join(store.rows(index_name), store.keys)
    return wanted.select(*store.keys, "cnt", (F.col("number") <= before).alias("reused"))


def score_store(spark: SparkSession, home: str) -> Store:
    """Word scores of whole passages by the identity of a run."""
    return Store(spark, home, "text_id long, word_id int, word string, value double", ["text_id"])


def _marks(word_id: Column, word: Column) -> list[Column]:
    """128 bits of a word and its place, in parts whose sums don't overflow."""
    both = [F.xxhash64(F.lit(seed), word_id.cast("int"), word) for seed in (1, 2)]
    return [part for h in both for part in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def checked_scores(passages: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows as they are; rows that don't cover their passage's words exactly,
    or aren't finite and 0 or above, stop the job. Words are compared by a text's number of
    them and the sums of their marks, so that a row a text is shuffled and no word."""
    fine = F.coalesce(~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < float("inf")), F.lit(False))
    held = stored.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~fine).alias("odd"), *[F.sum(m).alias(f"m{k}") for k, m in enumerate(_marks(F.col("word_id"), F.col("word")))])
    said = word_table(passages).groupBy("text_id").agg(F.count(F.lit(1)).alias("n_said"), *[F.sum(m).alias(f"s{k}") for k, m in enumerate(_marks(F.col("word_id"), F.col("word")))])
    same = reduce(lambda c, k: c & F.col(f"m{k}").eqNullSafe(F.col(f"s{k}")), range(4), F.col("n").eqNullSafe(F.col("n_said")) & (F.col("odd") == 0))
    unfit = held.join(said, "text_id", "left").where(~same).select("text_id").first()
    if unfit:
        raise ValueError(f"stored scores don't fit text {unfit['text_id']}")
    return stored


def resume_scores(passages: DataFrame, store: Store, identity: str, compute: Callable[[DataFrame], DataFrame], batches: int = 1) -> DataFrame:
    """(text_id, word_id, word, value, reused) of all passages. What earlier commits
    of this identity have is reused; the other passages are computed in batches, each
    committed when it is done, so that a job that stops goes on from its last batch."""
    before = store.commits(identity)
    open_ = cut(store.missing(passages, identity))
    few, own = open_.count(), F.pmod(F.xxhash64("text_id"), F.lit(batches))
    for batch in range(batches):
        part = passages.where(own == batch).join(small_side(open_.where(own == batch), few), "text_id")  # either side is dealt once, whatever the batches
        store.commit(compute(part).select("text_id", "word_id", "word", "value"), identity)
    all_rows = checked_scores(passages, store.rows(identity))
    return all_rows.select("text_id", "word_id", "word", "value", (F.col("number") <= before).alias("reused"))
