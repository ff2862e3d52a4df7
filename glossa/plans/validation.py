"""Queries of the data checks: what breaks each rule."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossa.operators import checks, joins, words
from glossa.plans.base import SQL_WORDS, held_out, passages, query
from glossa.plans.merges import SQL_BASE, _base
from glossa.plans.queries import SQL_FOLDS, SQL_PAIR, _design, _scores
from glossa.session import shared_dir, table


@query("""SELECT c AS name, 'missing column' AS violation FROM (VALUES ('l_tax'), ('l_comment'), ('l_clerk')) v(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE lineitem))
UNION ALL SELECT coalesce(h.c, e.c), 'family differs' FROM (SELECT 'size_' || l_linenumber AS c FROM lineitem GROUP BY l_linenumber) h FULL JOIN (VALUES ('size_1'), ('size_2'), ('size_9')) e(c) ON h.c = e.c WHERE h.c IS NULL OR e.c IS NULL""")
def schema_checks(spark, sf_dir):
    """V1 and V7: columns that are missing, and a family whose members aren't those expected."""
    rows = table(spark, sf_dir, "lineitem")
    family = rows.groupBy("l_orderkey").pivot("l_linenumber").agg(F.count(F.lit(1)))
    family = family.select(*[F.col(c).alias(f"size_{c}") for c in family.columns if c != "l_orderkey"])
    found = [(c, "missing column") for c in checks.missing_columns(rows, ["l_tax", "l_comment", "l_clerk"])] + [(c, "family differs") for c in checks.family_differs(family, "size", [1, 2, 9])]
    return spark.createDataFrame(found, "name string, violation string")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    """V2."""
    return checks.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT 'tax' AS "column", count(*) FILTER (WHERE l_tax = 0) AS n_null, 0 AS n_odd, 0 AS n_negative FROM lineitem UNION ALL SELECT 'change', 0, 0, count(*) FILTER (WHERE l_discount - 0.05::DOUBLE < 0) FROM lineitem
UNION ALL SELECT 'size', 0, count(*) FILTER (WHERE l_quantity > 40), 0 FROM lineitem""")
def bad_values(spark, sf_dir):
    """V3."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("nullif(l_tax, 0) AS tax", "l_discount - 0.05D AS change", "CASE WHEN l_quantity > 45 THEN double('nan') WHEN l_quantity > 40 THEN double('inf') ELSE l_quantity END AS size", "l_quantity AS plain")
    return checks.bad_values(rows, ["tax", "change", "size", "plain"])


MIXED = "CASE WHEN event_type = 'error' THEN 'none' WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN CAST(event_id AS {s}) ELSE CAST(value AS {s}) END"


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def not_numeric(spark, sf_dir):
    """V4: words where numbers or nothing should be."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{MIXED.format(s='STRING')} AS x")
    return checks.not_numeric(rows, "x").select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'view') OR (event_type <> 'click' AND value <> floor(value))")
def not_integer(spark, sf_dir):
    """P3's violations."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{MIXED.format(s='STRING')} AS x")
    return checks.not_integer(rows, "x").select("event_id")


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN -1 WHEN event_type = 'click' THEN event_id::DOUBLE ELSE value END AS x FROM events")
def coerced_numbers(spark, sf_dir):
    """P4, missing ones as -1."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{MIXED.format(s='STRING')} AS x")
    return checks.coerce(rows, ["x"]).withColumn("x", F.coalesce("x", F.lit(-1.0)))


@query("SELECT event_id, event_id AS x FROM events")
def strict_integers(spark, sf_dir):
    """P3 on values that are whole."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "concat(CAST(event_id AS STRING), '.0') AS x")
    return checks.strict_integer(rows, "x")


@query("""SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct FROM lineitem GROUP BY 1
HAVING min(l_linenumber) <> 0 OR max(l_linenumber) <> count(*) - 1 OR count(DISTINCT l_linenumber) <> count(*)""")
def contiguity(spark, sf_dir):
    """W8."""
    return checks.gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"""WITH {SQL_BASE} SELECT coalesce(m.text_id, h.text_id + 1) AS text_id, coalesce(m.word_id, h.word_id) AS word_id, m.ref_token AS found, h.word AS expected
FROM means m FULL JOIN hwords h ON m.text_id = h.text_id + 1 AND m.word_id = h.word_id WHERE m.text_id IS NULL OR h.text_id IS NULL OR m.ref_token IS DISTINCT FROM h.word""")
def coverage(spark, sf_dir):
    """V5."""
    means, _ = _base(spark, sf_dir)
    own = words.word_table(held_out(spark, sf_dir)).withColumn("text_id", F.col("text_id") + 1)
    return checks.coverage(means.withColumnRenamed("ref_token", "word"), own)


@query(f"WITH {SQL_WORDS} SELECT count(*) AS rows, count(DISTINCT text_id) AS texts FROM words HAVING count(*) <> 7 OR count(DISTINCT text_id) <> 2")
def counts_differ(spark, sf_dir):
    """V6."""
    return checks.counts_differ(words.word_table(passages(spark, sf_dir)), 7, 2)


SQL_TOTALS = """t AS (SELECT o_orderkey AS text_id, 0 AS word_id, o_totalprice AS total, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_custkey::DOUBLE END AS customer FROM orders),
s AS (SELECT o_orderkey AS text_id, 0 AS word_id, CASE o_orderstatus WHEN 'F' THEN o_totalprice + 0.01::DOUBLE ELSE o_totalprice END AS total, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey::DOUBLE END AS customer FROM orders)"""


@query(f"""WITH {SQL_TOTALS}, j AS (SELECT t.text_id, t.word_id, CASE WHEN abs(t.total - s.total) > 1e-12::DOUBLE THEN 'total' END AS a, CASE WHEN t.customer IS DISTINCT FROM s.customer THEN 'customer' END AS b FROM t JOIN s USING (text_id, word_id))
SELECT text_id, word_id, concat_ws(',', a, b) AS changed FROM j WHERE a IS NOT NULL OR b IS NOT NULL""")
def changed_values(spark, sf_dir):
    """V8."""
    o = table(spark, sf_dir, "orders")
    key = ["o_orderkey AS text_id", "0 AS word_id"]
    before = o.selectExpr(*key, "o_totalprice AS total", "CASE o_orderstatus WHEN 'P' THEN NULL ELSE double(o_custkey) END AS customer")
    after = o.selectExpr(*key, "CASE o_orderstatus WHEN 'F' THEN o_totalprice + 0.01D ELSE o_totalprice END AS total", "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE double(o_custkey) END AS customer")
    return checks.changed_values(before, after, ["total", "customer"])


@query(f"""WITH {SQL_WORDS}, l AS (SELECT text_id, word_id, length(word) AS x, length(word) > 12 AS odd FROM words),
g AS (SELECT text_id, word_id, lag(x, 1) OVER t AS p1, lag(x, 2) OVER t AS p2, lag(x, 3) OVER t AS p3, odd FROM l WINDOW t AS (PARTITION BY text_id ORDER BY word_id))
SELECT text_id, word_id, concat_ws(',', CASE WHEN p1 IS NOT NULL THEN 'prev_word_len' END, CASE WHEN p2 IS NOT NULL AND p2 <> p1 OR (p2 IS NULL AND p1 IS NOT NULL) THEN 'prev2_word_len' END) AS changed
FROM g WHERE odd AND (p1 IS NOT NULL OR (p2 IS NOT NULL AND p2 <> p1))""")
def wrong_lags(spark, sf_dir):
    """V9: stored lags of the longest words are off: the first is missing, the second is the first."""
    rows = joins.add_lags(words.word_table(words.by_text(passages(spark, sf_dir))).select("text_id", "word_id", "word_len"), ["word_len"])
    odd = F.col("word_len") > 12
    stored = rows.withColumns({"prev2_word_len": F.when(odd, F.col("prev_word_len")).otherwise(F.col("prev2_word_len")), "prev_word_len": F.when(~odd, F.col("prev_word_len"))})
    return checks.wrong_lags(stored, ["word_len"])


@query(f"""WITH {SQL_PAIR}, kept AS (SELECT * FROM ll WHERE NOT (formula = 'a' AND fold = 3)), parts AS (SELECT formula, sum(n_test) AS n_tested, sum(CASE WHEN n_train + n_test <> (SELECT count(*) FROM lineitem) THEN 1 ELSE 0 END) AS n_broken FROM kept GROUP BY formula)
SELECT formula, n_tested::BIGINT AS n_tested, n_broken::BIGINT AS n_broken FROM parts WHERE n_tested <> (SELECT count(*) FROM lineitem) OR n_broken > 0""")
def broken_folds(spark, sf_dir):
    """A stored table that lacks a fold of one formula."""
    stored = _scores(spark, sf_dir).where("not (formula = 'a' and fold = 3)")
    return checks.broken_folds(stored, table(spark, sf_dir, "lineitem").count())


@query(f"""WITH {SQL_PAIR}, stored AS (SELECT formula, fold, n_test, ll_mean, round(ll_mean, 2) * n_test AS ll_sum FROM ll)
SELECT formula, fold FROM stored WHERE abs(ll_sum - ll_mean * n_test) > 1e-8::DOUBLE * (1 + abs(ll_sum))""")
def broken_identities(spark, sf_dir):
    """Sums made from rounded means."""
    stored = _scores(spark, sf_dir).withColumn("ll_sum", F.round("ll_mean", 2) * F.col("n_test"))
    return checks.broken_identities(stored).select("formula", "fold")


@query(f"""WITH {SQL_PAIR}, w AS (SELECT x.fold, x.ll_mean AS la, y.ll_mean AS lab, z.ll_mean AS l0, CASE WHEN x.fold > 4 THEN y.ll_mean - x.ll_mean ELSE y.ll_mean - z.ll_mean + 1 END AS d FROM ll x JOIN ll y ON y.fold = x.fold AND y.formula = 'ab' JOIN ll z ON z.fold = x.fold AND z.formula = 'm0' WHERE x.formula = 'a')
SELECT fold, 'b_given_a' AS broken FROM w WHERE abs(d - (lab - la)) > 1e-8::DOUBLE * (1 + abs(lab))""")
def broken_deltas(spark, sf_dir):
    """Gains that aren't the difference of their scores in some folds."""
    wide = _scores(spark, sf_dir).groupBy("fold").pivot("formula", ["m0", "a", "ab"]).agg(F.first("ll_mean"))
    stored = wide.withColumn("b_given_a", F.when(F.col("fold") > 4, F.col("ab") - F.col("a")).otherwise(F.col("ab") - F.col("m0") + 1))
    return checks.broken_deltas(stored, {"b_given_a": ("ab", "a")}).select("fold", "broken")


@query(f"""WITH {SQL_FOLDS}, v AS (SELECT fold, l_linenumber, CASE WHEN fold % 2 = 0 THEN fold ELSE l_linenumber END AS score FROM f GROUP BY fold, l_linenumber)
SELECT fold, count(DISTINCT score) AS n_values FROM v GROUP BY fold HAVING count(DISTINCT score) <> 1""")
def varying_scores(spark, sf_dir):
    """Scores that should be one a fold and are one a line number in odd folds."""
    rows = _design(spark, sf_dir).groupBy("fold", "l_linenumber").count()
    return checks.varying_scores(rows.withColumn("score", F.when(F.col("fold") % 2 == 0, F.col("fold")).otherwise(F.col("l_linenumber"))), ["fold"], "score")


SQL_DIRECTED = """d AS (SELECT CASE l_returnflag WHEN 'A' THEN 'ngram' WHEN 'N' THEN 'context_limited' ELSE 'layer' END AS family, CASE WHEN l_quantity > 2 THEN l_tax END AS n_given_l, CASE WHEN l_returnflag = 'N' THEN l_discount END AS c_given_l FROM lineitem)"""


@query(f"""WITH {SQL_DIRECTED} SELECT family, (count(*) FILTER (WHERE family = 'ngram' AND n_given_l IS NULL) + count(*) FILTER (WHERE family = 'context_limited' AND c_given_l IS NULL))::BIGINT AS n_not_finite,
 (count(*) FILTER (WHERE family <> 'ngram' AND n_given_l IS NOT NULL) + count(*) FILTER (WHERE family <> 'context_limited' AND c_given_l IS NOT NULL))::BIGINT AS n_not_missing, count(*) FILTER (WHERE family = 'layer') AS n_unknown FROM d GROUP BY family
HAVING n_not_finite + n_not_missing + n_unknown > 0""")
def directional_violations(spark, sf_dir):
    """V14."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_returnflag WHEN 'A' THEN 'ngram' WHEN 'N' THEN 'context_limited' ELSE 'layer' END AS family", "CASE WHEN l_quantity > 2 THEN l_tax END AS n_given_l", "CASE WHEN l_returnflag = 'N' THEN l_discount END AS c_given_l"
    )
    return checks.directional_violations(rows, "family", {"ngram": ["n_given_l"], "context_limited": ["c_given_l"]})


@query("""WITH r AS (SELECT l_returnflag AS k, avg(l_tax) AS m, stddev_samp(l_tax) / sqrt(count(*)) AS e FROM lineitem GROUP BY 1), s AS (SELECT l_returnflag AS k, avg(l_tax) AS m FROM lineitem WHERE l_quantity > 1 GROUP BY 1)
SELECT k AS l_returnflag FROM r JOIN s USING (k) WHERE abs(r.m - s.m) > 1e-9::DOUBLE""")
def aggregate_differs(spark, sf_dir):
    """Stored means that left out the smallest lines."""
    rows = table(spark, sf_dir, "lineitem").withColumn("value", F.col("l_tax"))
    error = rows.groupBy("l_returnflag").agg((F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))
    stored = rows.where("l_quantity > 1").groupBy("l_returnflag").agg(F.avg("value").alias("mean")).join(error, "l_returnflag")
    return checks.aggregate_differs(rows, stored, ["l_returnflag"]).select("l_returnflag")


@query("""SELECT 'n_texts' AS key, '7' AS expected, count(DISTINCT l_orderkey)::VARCHAR AS value FROM lineitem HAVING count(DISTINCT l_orderkey) <> 7 UNION ALL SELECT 'seed', '42', NULL""")
def summary_differs(spark, sf_dir):
    """V16."""
    from glossa.operators import reports

    summary = reports.run_summary(table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey").alias("n_texts"), F.min("l_linenumber").alias("first")))
    first = table(spark, sf_dir, "lineitem").agg(F.min("l_linenumber")).first()[0]
    return checks.summary_differs(summary, {"n_texts": "7", "first": str(first), "seed": "42"})


@query("""WITH l AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), g AS (SELECT abs(l.v - o_totalprice) AS gap FROM l JOIN orders ON o_orderkey = k),
a AS (SELECT count(*) AS n, max(gap) AS mx, avg(gap) AS mn, quantile_disc(gap, 0.99) AS p FROM g), r AS (SELECT n, round(mx, -4) AS mx, round(mn, -4) AS mn, mx + 1 AS p FROM a)
SELECT 'max_gap differs' AS violation FROM a, r WHERE abs(r.mx - a.mx) > 1e-9::DOUBLE * (1 + a.mx) UNION ALL SELECT 'mean_gap differs' FROM a, r WHERE abs(r.mn - a.mn) > 1e-9::DOUBLE * (1 + a.mn)
UNION ALL SELECT 'p99_gap differs' FROM a, r WHERE abs(r.p - a.p) > 1e-9::DOUBLE * (1 + a.p) UNION ALL SELECT 'over tolerance' FROM a WHERE mx > 0.0005 UNION ALL SELECT 'mean over max' FROM r WHERE mn > mx UNION ALL SELECT 'p99 over max' FROM r WHERE p > mx""")
def anchor_differs(spark, sf_dir):
    """A stored anchor report that was rounded, against one computed again."""
    left = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    again = joins.anchor_report(left, right, "v", ["k"])
    stored = again.select("n", F.round("max_gap", -4).alias("max_gap"), F.round("mean_gap", -4).alias("mean_gap"), (F.col("max_gap") + 1).alias("p99_gap"))
    return checks.anchor_differs(stored, again, 0.0005)


def _fingerprint_sql(name: str, columns: list[str]) -> str:
    texts = [f"coalesce({c}::VARCHAR, '\\N')" for c in columns]
    line = " || ".join(f"length({t}) || ':' || {t}" for t in texts)
    return f"SELECT '{name}' AS name, count(*) AS n, sum(h)::HUGEINT::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT ('0x' || substr(md5({line}), 1, 15))::BIGINT AS h FROM {name})"


@query(_fingerprint_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]) + " UNION ALL " + _fingerprint_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def table_fingerprints(spark, sf_dir):
    """Digests of two tables' contents, whatever their order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority")
    two = [checks.fingerprint(df).withColumn("name", F.lit(t)) for t, df in (("orders", orders), ("documents", table(spark, sf_dir, "documents")))]
    return two[0].unionByName(two[1])


#: Rules on lines, each as SQL that both engines read.
LINE_RULES = {
    "quantity is whole": "l_quantity = floor(l_quantity)", "quantity is small": "l_quantity <= 45", "price is positive": "l_extendedprice > 0", "discount is a share": "l_discount BETWEEN 0 AND 0.05", "tax is there": "nullif(l_tax, 0) IS NOT NULL",
    "tax is below discount": "nullif(l_tax, 0.02) < l_discount", "flag is known": "l_returnflag IN ('A', 'N')", "open lines aren't returned": "l_linestatus <> 'O' OR l_returnflag = 'N'", "part and supplier differ": "l_partkey <> l_suppkey", "line is early": "l_linenumber < 5",
}


@query(" UNION ALL ".join(f"""SELECT '{name.replace("'", "''")}' AS "check", count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce({rule}, false)) AS n_broken FROM lineitem""" for name, rule in LINE_RULES.items()))
def checked_write(spark, sf_dir):
    """Ten rules counted while the lines are written."""
    home = f"{shared_dir(spark)}/checked-{uuid.uuid4().hex}"
    return checks.write_checked(table(spark, sf_dir, "lineitem"), {name: F.expr(rule) for name, rule in LINE_RULES.items()}, home)
