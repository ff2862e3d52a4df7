import pytest
from pyspark.sql import functions as F

from glossa.operators.words import word_table
from glossa.sources import stores

TEXTS = "text_id long, text string"


def length(passages):
    return word_table(passages).select("text_id", "word_id", "word", F.col("word_len").cast("double").alias("value"))


def test_counts_are_counted_once_and_the_corpus_size_is_a_key(spark, tmp_path):
    corpus = spark.createDataFrame([(0, "a b c a b"), (1, "c"), (2, None)], TEXTS)
    store = stores.count_store(spark, str(tmp_path / "counts"))
    ask = lambda *keys: spark.createDataFrame(list(keys), "order int, ngram string")
    got = stores.extend_counts(corpus, ask((0, ""), (1, "a"), (1, "a"), (2, "a b")), store, "i")
    assert sorted(tuple(r) for r in got.collect()) == [(0, "", 6, False), (1, "a", 2, False), (2, "a b", 2, False)]
    other = spark.createDataFrame([(0, "a a")], TEXTS)
    got = stores.extend_counts(other, ask((0, ""), (2, "a b"), (1, "zz"), (3, "a b c")), store, "i")
    assert sorted(tuple(r) for r in got.collect()) == [(0, "", 6, True), (1, "zz", 0, False), (2, "a b", 2, True), (3, "a b c", 0, False)]
    assert store.commits("i") == 2 and stores.extend_counts(other, ask((0, "")), store, "j").first()["cnt"] == 2
    assert stores.extend_counts(other, ask((0, "")), store, "i").first()["reused"] and store.commits("i") == 2


def test_a_job_that_was_killed_goes_on_from_its_last_batch(spark, tmp_path):
    texts = spark.createDataFrame([(k, f"word{k} and more") for k in range(30)] + [(30, "  ")], TEXTS)
    store = stores.score_store(spark, str(tmp_path / "scores"))
    calls = []

    def failing(passages):
        calls.append(sorted(r["text_id"] for r in passages.collect()))
        if len(calls) == 2:
            raise KeyboardInterrupt
        return length(passages)

    with pytest.raises(KeyboardInterrupt):
        stores.resume_scores(texts, store, "run", failing, batches=3)
    # Rows without their line in the manifest: what a job leaves that dies while it writes.
    length(texts).withColumns({"name": F.lit("run"), "commit": F.lit("torn"), "value": F.lit(-1.0)}).write.mode("append").partitionBy("name", "commit").parquet(str(tmp_path / "scores/rows"))
    again = stores.resume_scores(texts, store, "run", lambda p: calls.append(sorted(r["text_id"] for r in p.collect())) or length(p), batches=3).collect()
    assert sorted((r["text_id"], r["word_id"], r["value"]) for r in again) == sorted((r["text_id"], r["word_id"], r["value"]) for r in length(texts).collect())
    assert {r["text_id"] for r in again if r["reused"]} == set(calls[0]) and not set(calls[0]) & {i for c in calls[2:] for i in c}
    assert all(r["reused"] for r in stores.resume_scores(texts, store, "run", length).collect())


@pytest.mark.parametrize("value, word, left_out", [(float("inf"), "one", False), (-0.5, "one", False), (None, "one", False), (1.0, "uno", False), (1.0, "one", True)])
def test_stored_scores_that_do_not_fit_are_refused(spark, tmp_path, value, word, left_out):
    texts = spark.createDataFrame([(0, "one two")], TEXTS)
    store = stores.score_store(spark, str(tmp_path / "scores"))
    rows = [(0, 0, word, value)] + ([] if left_out else [(0, 1, "two", 2.0)])
    store.commit(spark.createDataFrame(rows, store.ddl), "run")
    with pytest.raises(Exception, match="don't fit"):
        stores.resume_scores(texts, store, "run", length).collect()
    assert stores.resume_scores(texts, store, "other", length).count() == 2


@pytest.mark.parametrize("rows", [[(0, 0, "two", 1.0), (0, 1, "one", 1.0)], [(0, 0, "one", 1.0), (0, 0, "one", 1.0)], [(0, 0, "one", 1.0), (0, 1, "two", 1.0), (0, 1, "two", 1.0)], [(0, 0, "one", 1.0), (0, 1, None, 1.0)], [(7, 0, "one", 1.0)]])
def test_places_repeats_and_foreign_texts_are_refused(spark, tmp_path, rows):
    """A stored row that is there twice was taken for sound before."""
    store = stores.score_store(spark, str(tmp_path / "scores"))
    with pytest.raises(Exception, match="don't fit"):
        stores.checked_scores(spark.createDataFrame([(0, "one two")], TEXTS), spark.createDataFrame(rows, store.ddl)).collect()


def test_stored_words_are_checked_without_a_shuffle(spark, tmp_path):
    """words were dealt by key beside their passages' words."""
    texts = spark.createDataFrame([(k, f"word{k} and more") for k in range(5)] + [(5, None)], TEXTS)
    store = stores.score_store(spark, str(tmp_path / "scores"))
    got = stores.resume_scores(texts, store, "run", length, batches=2)
    assert got.count() == 15 and "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
