import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import checks, joins, readings
from glossa.sources import readers


def test_fixation_fixture(spark):
    rows = spark.createDataFrame([("w", 0, k, k, f, 1.0 * k) for k, f in zip((1, 2, 3, 4), (1, 3, 0, 2))], "worker string, text_id int, word_id int, row_idx int, fixation int, time double")
    got = {r["word_id"]: r for r in readings.regressions(readings.gaze_passes(rows)).collect()}
    assert [got[k]["pass"] for k in (1, 2, 3, 4)] == [1, 3, 0, 2]
    assert [got[k]["regression"] for k in (1, 2, 4)] == [False, True, False] and all(r["first_pass"] for r in got.values())


def test_outliers_and_zeros(spark):
    rows = spark.createDataFrame([(10.0,)] * 30 + [(1e6,), (0.0,), (None,)], "time double")
    assert readings.log_outliers(rows).where("outlier").count() == 1
    assert readings.log_outliers(rows, zeros="strict").where("outlier").count() == 0


def test_variants_keep_unskipped_null(spark):
    rows = [(1, True, 9.0, 8.0, 7.0), (2, False, 5.0, 4.0, 3.0), (3, False, None, None, None), (4, True, None, None, None)]
    want = {1: (9.0, 8.0, 7.0, 0.0, 0.0), 2: (5.0, 4.0, 3.0, 3.0, 4.0), 3: (None, 0.0, 0.0, None, None), 4: (None, 0.0, 0.0, 0.0, 0.0)}
    got = readings.time_variants(spark.createDataFrame(rows, "k int, skipped boolean, t double, p double, f double"), "t", "p", "f")
    assert {r["k"]: tuple(r[f"time_v{v}"] for v in range(1, 6)) for r in got.collect()} == want


def test_measures_are_those_of_the_first_row(spark):
    rows = [(2, 1, 5, 10.0), (2, 2, 3, 20.0), (3, 3, 4, 30.0), (1, 4, 1, 40.0), (1, 5, 2, 50.0)]
    table = spark.createDataFrame([("w", 0, *r) for r in rows], "worker string, text_id int, word_id int, row_idx int, fixation int, time double")
    got = readings.reading_measures(readings.regressions(readings.gaze_passes(table))).collect()
    # Word 2's first row is its later pass; word 3's fixation comes before none; word 1's two rows are one pass.
    assert {r["word_id"]: tuple(r)[3:] for r in got} == {2: (30.0, 10.0, 10.0, 0.0, 0.0), 3: (30.0, 30.0, 30.0, 0.0, 0.0), 1: (90.0, 40.0, 90.0, 90.0, 40.0)}


def test_repair_ids(spark):
    rows = spark.createDataFrame([("fi", 0, k) for k in (1, 2, 4, 5)], "lang string, text_id int, word_id int")
    gaps = spark.createDataFrame([("fi", 0, 3)], "lang string, text_id int, gap int")
    assert sorted(r["word_id"] for r in readings.repair_ids(rows, gaps).collect()) == [1, 2, 3, 4]


def test_lags_do_not_cross_texts(spark):
    values = {(6, 0): 4.0, (6, 1): 5.5, (6, 2): 7.0, (6, 3): 1.0, (8, 0): 2.5, (8, 1): 9.0}
    rows = spark.createDataFrame([(*k, v) for k, v in sorted(values.items(), key=lambda x: -x[1])], "text_id int, word_id int, surprisal double")
    for r in joins.add_lags(rows, ["surprisal"]).collect():
        assert [r["prev_surprisal"], r["prev2_surprisal"], r["prev3_surprisal"]] == [values.get((r["text_id"], r["word_id"] - k)) for k in (1, 2, 3)]


def test_merge_violations(spark):
    ddl = "text_id int, word_id int, word string"
    left = spark.createDataFrame([(0, 0, "a"), (0, 1, "é"), (0, 2, "x")], ddl)
    right = spark.createDataFrame([(0, 0, "b"), (0, 1, "Ã©"), (0, 3, "y"), (0, 3, "y")], ddl)
    got = sorted((r["word_id"], r["violation"]) for r in joins.match_violations(left, right, word="word").collect())
    assert got == [(0, "word differs"), (2, "missing right"), (3, "missing left"), (3, "missing left"), (3, "repeated right")]


def test_swap_keeps_order_and_rebuilds_lags(spark):
    base = joins.add_lags(spark.createDataFrame([(0, 0, 1.0, 5), (0, 1, 2.0, 6)], "text_id int, word_id int, s double, len int"), ["s", "len"])
    other = spark.createDataFrame([(0, 1, 9.0), (0, 0, 8.0)], "text_id int, word_id int, s double")
    out = joins.swap_model(base, other, ["s"])
    assert out.columns == base.columns
    assert {r["word_id"]: (r["s"], r["prev_s"], r["prev_len"]) for r in out.collect()} == {0: (8.0, None, None), 1: (9.0, 8.0, 5)}
    assert checks.wrong_lags(out, ["s", "len"]).count() == 0


@pytest.mark.parametrize("slice_words", [joins.SLICE_WORDS, 3])
def test_swap_in_texts_is_swap_of_their_words(spark, monkeypatch, slice_words):
    """words that the other model lacks, has twice or in another order, and texts that
    one side lacks; before, every word was shuffled by its key and sorted again."""
    monkeypatch.setattr(joins, "SLICE_WORDS", slice_words)
    rng = random.Random(6)
    own = [(i, w, rng.randint(1, 9), rng.random()) for i in (*range(8), None) for w in sorted(rng.sample(range(12), 7))]
    new = [(i, w, rng.random()) for i in (*range(1, 9), None) for w in rng.sample(range(12), 9)]
    base, other = spark.createDataFrame(own, "text_id long, word_id int, len int, s double"), spark.createDataFrame(new, "text_id long, word_id int, s double")
    whole = lambda df, *c: df.groupBy("text_id").agg(F.collect_list(F.struct("word_id", *c)).alias("r")).select("text_id", F.col("r.word_id").alias("word_id"), F.transform("r", lambda x: F.struct(*[x[n].alias(n) for n in c])).alias("w"))
    got = joins.swap_in_texts(whole(base.orderBy("text_id", "word_id").coalesce(1), "len", "s"), whole(other, "s"), ["s"])
    want = joins.swap_model(joins.add_lags(base, ["len", "s"]), other, ["s"])
    key = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    assert got.columns == want.columns and key(got) == key(want) and 20 < got.count() < len(own)


def test_model_swap_deals_texts_once(spark):
    """one shuffle of whole texts, used by both sides."""
    from glossa.plans.queries import QUERIES

    plan = QUERIES["model_swap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2 and "Window" not in plan


def test_anchor_uses_nearest_rank(spark):
    left = spark.range(1, 101).select(F.lit(0).alias("text_id"), F.col("id").alias("word_id"), F.col("id").cast("double").alias("v"))
    r = joins.anchor_report(left, left.withColumn("v", F.lit(0.0)), "v").first()
    assert (r["max_gap"], r["p99_gap"]) == (100.0, 99.0)


def test_family_order_and_checks(spark):
    df = spark.createDataFrame([(0, 0, 1.0, -1.0), (0, 2, None, float("inf"))], "text_id int, word_id int, s_10 double, s_2 double")
    assert joins.family_columns(df, "s") == ["s_2", "s_10"] and checks.family_differs(df, "s", [2, 9]) == ["s_10", "s_9"]
    bad = {r["column"]: (r["n_null"], r["n_odd"], r["n_negative"]) for r in checks.bad_values(df, ["s_10", "s_2"]).collect()}
    assert bad == {"s_10": (1, 0, 0), "s_2": (0, 1, 1)} and checks.gaps(df).count() == 1 and checks.repeated_keys(df).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('word\tn\nnull\t1\n"q\tNA\n\t3\n')
    got = [tuple(r) for r in readers.read_table(spark, str(tmp_path / "t.tsv"), "word string, n string", quoting=False).collect()]
    assert got == [("null", "1"), ('"q', "NA"), ("", "3")]
    (tmp_path / "sa12ma1.dat").write_bytes("WORD FXNO\n“caf\xe9” 1\nb 2\n".replace("“", "\x93").replace("”", "\x94").encode("latin-1"))
    fix = readers.read_fixation_files(spark, str(tmp_path), "*.dat", r"^(s.)(\d+)ma", ["WORD", "FXNO"]).orderBy("row_idx").collect()
    assert [(r["worker"], r["text_id"], r["WORD"]) for r in fix] == [("sa", 12, "“café”"), ("sa", 12, "b")]
    (tmp_path / "p.txt").write_text("one\n\nthree\n")
    assert sorted(map(tuple, readers.read_passages(spark, str(tmp_path / "p.txt")).collect())) == [(0, "one"), (1, ""), (2, "three")]
    (tmp_path / "long.txt").write_text("".join(f"line {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = sorted(map(tuple, readers.read_passages(spark, str(tmp_path / "long.txt")).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k, f"line {k}") for k in range(5000)]


def test_strict_integers_and_clashing_families(spark):
    with pytest.raises(Exception, match="no whole number"):
        checks.strict_integer(spark.createDataFrame([("1",), ("1.5",)], "x string"), "x").collect()
    one = spark.createDataFrame([(0, 0, "a", 1.0)], "text_id long, word_id int, word string, s double")
    with pytest.raises(ValueError, match="both tables have s"):
        joins.join_predictors(one, one)


def test_match_violations_equal_a_plain_comparison(spark):
    """Repeated and null keys, words that are null, equal, in the byte alphabet or not."""
    import random
    from collections import Counter

    rng = random.Random(7)
    code = {"é": "Ã©", "ok": "ok", "no": "no"}
    side = lambda n: [(rng.choice([0, 0, 1, 2, None]), rng.choice([*range(12), None]), rng.choice(["é", "Ã©", "ok", "no", None])) for _ in range(n)]
    left, right = side(60), side(50)
    ddl = "text_id long, word_id int, word string"
    want = Counter()
    for t, w_, a in left:
        met = [b for u, x, b in right if (u, x) == (t, w_)] if None not in (t, w_) else []
        if not met:
            want[t, w_, "missing right"] += 1
        want[t, w_, "word differs"] += sum(a is None or b is None or b not in (a, code.get(a, "?")) for b in met)
    for t, w_, _ in right:
        want[t, w_, "missing left"] += None in (t, w_) or not any((u, x) == (t, w_) for u, x, _ in left)
    for name, rows_ in (("repeated left", left), ("repeated right", right)):
        for (t, w_), n in Counter((t, w_) for t, w_, _ in rows_).items():
            want[t, w_, name] += n > 1
    got = joins.match_violations(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), word="word")
    assert Counter(tuple(r) for r in got.collect()) == Counter({k: n for k, n in want.items() if n})
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_rules_are_counted_while_a_table_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (None, float("nan"))], "k long, x double")
    got = checks.write_checked(rows, {"key": F.col("k").isNotNull(), "value": F.col("x") > 1}, str(tmp_path / "t"))
    assert [tuple(r) for r in got.collect()] == [("key", 3, 1), ("value", 3, 1)] and spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_outlier_share_of_zero_times_is_that_of_its_sql(spark, tmp_path):
    """A time of zero is no outlier, in query and SQL."""
    import duckdb

    from glossa.plans.queries import ORACLES, QUERIES

    values = [0.0] * 3 + [float(v) for v in range(90, 110)] + [100000.0]
    spark.createDataFrame([(k, v) for k, v in enumerate(values)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = QUERIES["outlier_share"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.execute(ORACLES["outlier_share"]).fetchall() == [(round(100 / 24, 9), 24)]
