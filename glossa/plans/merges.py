"""Queries of the keyed merges, lags and reading times."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import joins, readings, words
from glossa.plans.base import SQL_WORDS, held_out, passages, query
from glossa.plans.texts import SQL_BYTES, SQL_HELD
from glossa.session import table


@query(f"""WITH {SQL_HELD}, common AS (SELECT word FROM hwords GROUP BY word HAVING count(*) > 1),
o AS (SELECT text_id, word_id, word, CASE WHEN word IN (SELECT word FROM common) THEN {SQL_BYTES} ELSE word || 'x' END AS other FROM hwords)
SELECT text_id, word_id, 'word differs' AS violation FROM o WHERE other <> word AND other <> {SQL_BYTES}""")
def word_agreement(spark, sf_dir):
    """Words that another table has in the byte alphabet agree, others don't."""
    left = words.word_table(held_out(spark, sf_dir)).select("text_id", "word_id", "word")
    common = left.groupBy("word").count().where("count > 1").select("word", F.lit(True).alias("common"))
    coded = F.when(F.col("common"), words.byte_alphabet(F.col("word"))).otherwise(F.concat("word", F.lit("x")))
    right = left.join(common, "word", "left").select("text_id", "word_id", coded.alias("word"))
    return joins.match_violations(left, right, word="word")


SQL_BASE = f"""{SQL_WORDS}, {SQL_HELD}, seen AS (SELECT word, count(*) AS n FROM words GROUP BY word),
scores AS (SELECT text_id, word_id, word, ln(n) AS surprisal FROM hwords JOIN seen USING (word) WHERE n >= 3),
means AS (SELECT text_id + 1 AS text_id, word_id, CASE WHEN word LIKE '%.' THEN lower(word) ELSE word END AS ref_token, length(word)::DOUBLE AS time FROM hwords WHERE word NOT LIKE '%th%')"""


def _base(spark, sf_dir):
    """Scores of the words that the corpus has thrice, and times of words without 'th'."""
    seen = words.word_table(passages(spark, sf_dir)).groupBy("word").count()
    own = words.word_table(held_out(spark, sf_dir))
    scores = own.join(seen, "word").where("count >= 3").select("text_id", "word_id", "word", F.log("count").alias("surprisal"))
    token = F.when(F.col("word").like("%."), F.lower("word")).otherwise(F.col("word"))
    means = own.where("word not like '%th%'").select((F.col("text_id") + 1).alias("text_id"), "word_id", token.alias("ref_token"), F.col("word_len").cast("double").alias("time"))
    return means, scores


@query(f"""WITH {SQL_BASE}, m AS (SELECT coalesce(m.text_id, s.text_id + 1) AS text_id, coalesce(m.word_id, s.word_id) AS word_id, word, ref_token, surprisal FROM means m FULL JOIN scores s ON m.text_id = s.text_id + 1 AND m.word_id = s.word_id)
SELECT text_id, word_id, CASE WHEN surprisal IS NULL THEN 'no surprisal' ELSE 'word differs' END AS violation FROM m WHERE surprisal IS NULL OR word IS DISTINCT FROM ref_token""")
def base_violations(spark, sf_dir):
    """Times and scores side by side, and the rows that break its two rules."""
    return joins.base_violations(joins.merge_base(*_base(spark, sf_dir)))


@query(f"""WITH {SQL_BASE} SELECT s.text_id + 1 AS text_id, s.word_id, s.word, round(s.surprisal, 9) AS surprisal, m.ref_token, m.time FROM scores s LEFT JOIN means m ON m.text_id = s.text_id + 1 AND m.word_id = s.word_id""")
def base_attached(spark, sf_dir):
    """J4."""
    means, scores = _base(spark, sf_dir)
    return joins.attach_base(scores, means).withColumn("surprisal", F.round("surprisal", 9))


@query(f"WITH {SQL_BASE} SELECT text_id + 1 AS text_id, word_id FROM scores EXCEPT SELECT text_id, word_id FROM means")
def base_uncovered(spark, sf_dir):
    """J4's violations."""
    means, scores = _base(spark, sf_dir)
    return joins.uncovered(scores, means)


@query(f"""WITH {SQL_BASE} SELECT s.text_id + 1 AS text_id, s.word_id, round(s.surprisal, 9) AS internal_layer_surprisal_layer_2, round(s.surprisal * 2, 9) AS internal_layer_surprisal_layer_12, m.ref_token, m.time
FROM scores s LEFT JOIN means m ON m.text_id = s.text_id + 1 AND m.word_id = s.word_id""")
def layers_attached(spark, sf_dir):
    """J5."""
    means, scores = _base(spark, sf_dir)
    layers = scores.select("text_id", "word_id", F.round(F.col("surprisal") * 2, 9).alias("internal_layer_surprisal_layer_12"), F.round("surprisal", 9).alias("internal_layer_surprisal_layer_2"))
    return joins.attach_layers(means, layers)


@query(f"""WITH {SQL_BASE}, l AS (SELECT text_id + 1 AS text_id, word_id FROM scores), m AS (SELECT text_id, word_id FROM means)
SELECT (SELECT count(*) FROM l ANTI JOIN m USING (text_id, word_id)) AS missing_left, (SELECT count(*) FROM m ANTI JOIN l USING (text_id, word_id)) AS missing_right""")
def key_differences(spark, sf_dir):
    """How many keys each of two tables lacks."""
    means, scores = _base(spark, sf_dir)
    return joins.key_differences(means, scores.withColumn("text_id", F.col("text_id") + 1))


@query(f"""WITH {SQL_BASE}, n AS (SELECT text_id, word_id, word, round(surprisal, 9) AS ngram_surprisal_context_0 FROM scores)
SELECT n.*, length(h.word) AS context_limited_surprisal_context_1, ascii(h.word) AS internal_layer_surprisal_layer_3 FROM n JOIN hwords h USING (text_id, word_id)""")
def three_families(spark, sf_dir):
    """N-gram, context and layer predictors side by side."""
    _, scores = _base(spark, sf_dir)
    own = words.word_table(held_out(spark, sf_dir))
    n = scores.select("text_id", "word_id", "word", F.round("surprisal", 9).alias("ngram_surprisal_context_0"))
    c = own.select("text_id", "word_id", "word", F.col("word_len").alias("context_limited_surprisal_context_1"))
    return joins.join_predictors(n, c, own.select("text_id", "word_id", "word", F.ascii("word").alias("internal_layer_surprisal_layer_3")))


@query("""SELECT o_orderstatus, l_returnflag, l_linestatus FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT DISTINCT l_linestatus FROM lineitem)""")
def context_grid(spark, sf_dir):
    """J9."""
    axis = lambda t, c: table(spark, sf_dir, t).select(c).distinct()
    return joins.grid(axis("orders", "o_orderstatus"), axis("lineitem", "l_returnflag"), axis("lineitem", "l_linestatus"))


#: Lines as readings: the supplier reads the order's line.
LINES = """l_suppkey AS "WorkerId", l_orderkey + 1 AS text_id, CASE WHEN l_tax = 0.08 THEN NULL ELSE l_linenumber END AS word_id, l_linestatus AS lang, CASE WHEN l_quantity < 3 THEN '' ELSE l_returnflag END AS word,
 CASE WHEN l_discount = 0.1 THEN 0 WHEN l_discount = 0.05 THEN NULL ELSE l_extendedprice END AS time, l_discount = 0.1 AS skipped"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[c.strip() for c in LINES.replace('"', "`").replace("\n", " ").split(",")])


@query(f"""WITH r AS (SELECT {LINES} FROM lineitem), k AS (SELECT text_id - 1 AS text_id, word_id, lang, word, time, "WorkerId" AS worker, skipped::INT AS skipped FROM r WHERE word_id IS NOT NULL AND "WorkerId" NOT IN (1, 2) AND lang = 'O' AND word <> '' AND time <> 0)
SELECT *, round(ln(time), 9) AS log_time FROM k UNION ALL SELECT *, round(ln(time), 9) FROM (SELECT text_id - 1 AS text_id, word_id, lang, word, time, "WorkerId" AS worker, skipped::INT AS skipped FROM r WHERE word_id IS NOT NULL AND "WorkerId" NOT IN (1, 2) AND lang = 'F' AND time <> 0)""")
def clean_readings(spark, sf_dir):
    """P1 names, P17 word numbers and workers, P16 language, P19 empty words in one of
    them, P15 zero times, P13 ids from 0, P20 log time, P21 complete rows, A11 both
    languages together, A12 in order."""
    rows = joins.drop_index_columns(_lines(spark, sf_dir).withColumn("Unnamed: 0", F.lit(1))).withColumnsRenamed({"WorkerId": "worker"})
    kept = [readings.drop_empty_words(readings.skip_policy(readings.keep_rows(rows, [1, 2], langs=[lang]), keep_zeros=False), ("O",)) for lang in "OF"]
    both = kept[0].unionByName(kept[1]).withColumn("text_id", F.col("text_id") - 1)
    return readings.regression_inputs(both).na.drop("any").withColumn("log_time", F.round("log_time", 9)).orderBy("text_id", "word_id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount = 0.1 AS skipped, nullif(l_extendedprice, 900) AS t, nullif(l_quantity, 50) AS p, nullif(l_tax, 0) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(t, -1) AS time_v1, coalesce(p, 0) AS time_v2, coalesce(f, 0) AS time_v3, CASE WHEN skipped THEN 0 ELSE coalesce(f, -1) END AS time_v4, CASE WHEN skipped THEN 0 ELSE coalesce(p, -1) END AS time_v5 FROM r""")
def time_variants(spark, sf_dir):
    """P14."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount = 0.1 AS skipped", "nullif(l_extendedprice, 900) AS t", "nullif(l_quantity, 50) AS p", "nullif(l_tax, 0) AS f")
    out = readings.time_variants(rows, "t", "p", "f").drop("skipped", "t", "p", "f")
    return out.select(*[F.coalesce(c, F.lit(-1.0)).alias(c) if c.startswith("time") else c for c in out.columns])


@query(f"""WITH r AS (SELECT {LINES} FROM lineitem) SELECT policy, count(*) AS n, count(time) AS n_timed FROM (SELECT 'kept at zero' AS policy, time FROM r UNION ALL SELECT 'left out', time FROM r WHERE time <> 0) GROUP BY policy""")
def skip_policies(spark, sf_dir):
    """Both policies."""
    rows = _lines(spark, sf_dir)
    parts = [readings.skip_policy(rows, keep).select(F.lit(name).alias("policy"), "time") for name, keep in (("kept at zero", True), ("left out", False))]
    return parts[0].unionByName(parts[1]).groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count("time").alias("n_timed"))


@query("""WITH g AS (SELECT DISTINCT l_linestatus AS lang, l_orderkey AS text_id, l_linenumber AS gap FROM lineitem WHERE l_discount = 0.1)
SELECT lang, text_id, word_id, word_id - (SELECT count(*) FROM g WHERE g.lang = r.lang AND g.text_id = r.text_id AND gap < word_id) AS repaired
FROM (SELECT DISTINCT l_linestatus AS lang, l_orderkey AS text_id, l_linenumber AS word_id FROM lineitem) r""")
def id_repair(spark, sf_dir):
    """P18."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linestatus AS lang", "l_orderkey AS text_id", "l_linenumber AS word_id", "l_discount")
    gaps = rows.where("l_discount = 0.1").select("lang", "text_id", F.col("word_id").alias("gap")).distinct()
    own = rows.select("lang", "text_id", "word_id", F.col("word_id").alias("own")).distinct()
    return readings.repair_ids(own, gaps).select("lang", "text_id", F.col("own").alias("word_id"), F.col("word_id").cast("long").alias("repaired"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events) WHERE nth = 1")
def first_rows(spark, sf_dir):
    """A3."""
    return readings.first_rows(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("WITH s AS (SELECT avg(ln(value)) AS m, stddev_pop(ln(value)) AS sd FROM events WHERE value > 0) SELECT round(100 * avg(CASE WHEN value > 0 AND abs(CASE WHEN value > 0 THEN ln(value) END - m) / sd > 2 THEN 1 ELSE 0 END), 9) AS outlier_percent, count(*) AS n FROM events, s")
def outlier_share(spark, sf_dir):
    """A13."""
    marked = readings.log_outliers(table(spark, sf_dir, "events").withColumn("time", F.col("value")), limit=2.0)
    return readings.outlier_share(marked).withColumn("outlier_percent", F.round("outlier_percent", 9))
