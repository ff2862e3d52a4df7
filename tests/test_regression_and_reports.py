import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossa.operators import checks, regression, reports
from glossa.plans import queries, studies  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 1 + x @ [0.5, -0.2] + rng.normal(size=400)
    rows = [(k, float(a), float(b), float(t)) for k, ((a, b), t) in enumerate(zip(x, y))]
    return regression.assign_folds(spark.createDataFrame(rows, "k long, a double, b double, y double"), ["k"], 5, "s").cache()


def test_folds_match_cut(design):
    sizes = {r["fold"]: r["count"] for r in design.groupBy("fold").count().collect()}
    assert sorted(sizes) == [1, 2, 3, 4, 5] and sum(sizes.values()) == 400 and max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("few", [0, 10_000])
def test_folds_equal_ranks_with_repeated_keys(spark, monkeypatch, few):
    """Repeated keys that a fold's end parts, tables of a few rows, and digests that are
    told apart by long prefixes alone."""
    monkeypatch.setattr(regression, "FEW_DIGESTS", few)
    for n, copies, folds in ((97, 5, 4), (3, 1, 10), (1, 1, 3), (40, 1, 7), (0, 1, 3)):
        keys = [k // copies for k in range(n)]
        rows = spark.createDataFrame([(k, j) for j, k in enumerate(keys)], "k long, j long")
        order = sorted(keys, key=lambda k: (hashlib.md5(f"s|{k}".encode()).hexdigest(), k))
        want = sorted((k, max(1, int(np.ceil(r * folds / (n - 1)))) if n > 1 else 1) for r, k in enumerate(order))
        assert sorted((r["k"], r["fold"]) for r in regression.assign_folds(rows, ["k"], folds, "s").collect()) == want


def test_scores_equal_row_level_fit(design):
    formulas = {"m0": [], "ab": ["a", "b", "a:b"]}
    triangles = regression.factors(design, ["a", "b", "a:b"], "y")
    scores = regression.fold_scores(triangles, ["a", "b", "a:b"], formulas)
    got = {(r["formula"], r["fold"]): (r["ll_mean"], r["coefficients"]) for r in scores.collect()}
    d = design.toPandas()
    for name, use in formulas.items():
        full = np.column_stack([np.ones(len(d)), *[np.prod([d[p] for p in t.split(":")], axis=0) for t in use]])
        for f in range(1, 6):
            tr, te = (d.fold != f).values, (d.fold == f).values
            beta = np.linalg.lstsq(full[tr], d.y[tr], rcond=None)[0]
            s2 = ((d.y[tr] - full[tr] @ beta) ** 2).mean()
            ll = (-0.5 * np.log(2 * np.pi * s2) - (d.y[te] - full[te] @ beta) ** 2 / (2 * s2)).mean()
            assert got[name, f][0] == pytest.approx(ll, abs=1e-10) and got[name, f][1] == pytest.approx(list(beta), abs=1e-8)
    assert checks.broken_folds(scores, 400).count() == 0 and checks.broken_identities(scores).count() == 0
    errors = regression.prediction_errors(design, ["a", "b", "a:b"], "y", scores.where("formula = 'ab'")).collect()
    assert all(0 < r["mse"] < 2 and r["r2"] < 1 for r in errors) and len(errors) == 5


def test_rank_deficiency_is_reported(design):
    twice = design.withColumn("a2", F.col("a") * 2)
    scores = regression.fold_scores(regression.factors(twice, ["a", "a2"], "y"), ["a", "a2"], {"bad": ["a", "a2"], "good": ["a"]})
    assert {r["formula"]: r["sound"] for r in scores.collect()} == {"bad": False, "good": True}


def test_unsound_scores_stop_what_builds_on_them(design):
    twice = design.withColumn("a2", F.col("a") * 2)
    scores = regression.fold_scores(regression.factors(twice, ["a", "a2"], "y"), ["a", "a2"], {"bad": ["a", "a2"], "good": ["a"]})
    with pytest.raises(Exception, match="no sound fit of bad"):
        regression.deltas(scores, [("d", "bad", "good")]).collect()
    few = regression.fold_scores(regression.factors(design.where("k < 6"), ["a", "b"], "y"), ["a", "b"], {"m": ["a", "b"]})
    assert {r["sound"] for r in few.where("n_train <= 3").collect()} <= {False}
    constant = regression.fold_scores(regression.factors(design.withColumn("y", F.lit(2.0)), ["a"], "y"), ["a"], {"m": ["a"]})
    assert all(not r["sound"] or r["ll_mean"] > 20 for r in constant.collect())


def test_condition_of_1e8_equals_a_row_level_fit(spark):
    """Raw normal equations lose all digits here."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 3000))
    near, y = a + 2e-8 * b, 3 + a + rng.normal(size=3000)
    assert 5e7 < np.linalg.cond(np.column_stack([np.ones(3000), a, near])) < 1e9
    rows = spark.createDataFrame([(k % 4 + 1, *map(float, v)) for k, v in enumerate(zip(a, near, b, y))], "fold int, a double, near double, b double, y double").repartition(7)
    terms = ["a", "near", "b"]
    got = {(r["formula"], r["fold"]): r for r in regression.fold_scores(regression.factors(rows, terms, "y"), terms, {"near": ["a", "near"], "plain": ["a", "b"]}).collect()}
    d = rows.toPandas()
    for f in range(1, 5):
        want = row_level(d, terms, ["a", "b"], "y", f)
        assert got["near", f]["sound"] and got["near", f]["ll_mean"] == pytest.approx(want, abs=1e-7) and got["plain", f]["ll_mean"] == pytest.approx(want, abs=1e-10)


def test_spearman_over_the_rows_that_have_the_predictor(spark):
    rng = np.random.default_rng(6)
    d = pd.DataFrame({"word_len": rng.integers(1, 9, 300), "x": rng.normal(size=300).round(1), "z": rng.normal(size=300)})
    d.loc[::4, "x"] = None
    rows = spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), "word_len int, x double, z double")
    got = {r["predictor"]: r for r in reports.length_correlations(rows, ["x", "z"]).collect()}
    for c in ("x", "z"):
        some = d[d[c].notna()]
        assert got[c]["n"] == len(some) and got[c]["pearson"] == pytest.approx(some["word_len"].corr(some[c]))
        assert got[c]["spearman"] == pytest.approx(some["word_len"].rank().corr(some[c].rank()))


def test_signflip_and_correction(spark):
    folds = spark.createDataFrame([("x", f, 0.1 * f) for f in range(1, 5)], "name string, fold int, d double")
    r = reports.signflip_exact(folds, ["name"], "d", 4).first()
    assert (r["n_greater"], r["n_patterns"]) == (0, 16)
    p = spark.createDataFrame([("g", 0.01), ("g", 0.04), ("g", 0.9)], "g string, p double")
    assert sorted(x["p_corrected"] for x in reports.corrected_p(p, ["g"]).collect()) == pytest.approx([0.03, 0.06, 0.9])


@pytest.mark.parametrize("k", [1, 2, 5, 10])
def test_patterns_met_in_the_middle_equal_all_of_them(k):
    import itertools

    for seed in range(20):
        values = np.random.default_rng(seed).normal(0.4, 1, k).round(seed % 3)
        sums = np.array([abs(sum(s * v for s, v in zip(signs, values))) for signs in itertools.product((1, -1), repeat=k)])
        assert reports._greater_patterns(values) == (sums > abs(values.sum()) + 1e-12).sum()


def test_forty_folds(spark):
    folds = spark.createDataFrame([("x", f, 1.0) for f in range(40)] + [("y", f, (-1.0) ** f) for f in range(40)], "name string, fold int, d double")
    got = {r["name"]: (r["n_greater"], r["n_patterns"]) for r in reports.signflip_exact(folds, ["name"], "d", 40).collect()}
    import math

    assert got == {"x": (0, 1 << 40), "y": ((1 << 40) - math.comb(40, 20), 1 << 40)}


def test_random_signflip_is_close_to_exact(spark):
    folds = spark.createDataFrame([("x", f, d) for f, d in enumerate((0.5, -0.4, 0.3, 0.2))], "name string, fold int, d double")
    exact = reports.signflip_exact(folds, ["name"], "d", 4).first()["p"]
    assert reports.signflip_random(folds, ["name"], "d", 4000, "s").first()["p"] == pytest.approx(exact - 1 / 16, abs=0.05)


def test_spearman_with_ties(spark):
    t = spark.createDataFrame([(1, 2.0), (1, 1.0), (2, 3.0), (3, 3.0)], "word_len int, x double")
    r = reports.length_correlations(t, ["x"]).first()
    assert r["spearman"] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [2, 1, 3.5, 3.5])[0, 1])


def test_pivot_and_summary(spark):
    rows = spark.createDataFrame([(n, c, f, float(n + c + f)) for n in (0, 2) for c in (1, 3) for f in (1, 2)], "ngram int, context int, fold int, d double")
    got = {r["context"]: (r["0"], r["2"]) for r in regression.pivot_grid(rows, "context", "ngram", [0, 2], "d").collect()}
    assert got == {1: (2.5, 4.5), 3: (4.5, 6.5)}
    one = regression.fold_summary(rows.where("fold = 1"), ["ngram", "context"], "d").first()
    assert one["se"] is None and one["k"] == 1
    assert {r["key"]: r["value"] for r in reports.run_summary(spark.createDataFrame([(1, "b")], "a int, c string")).collect()} == {"a": "1", "c": "b"}


def row_level(d, terms, use, response, fold):
    """Mean held-out log density and coefficients of a plain least-squares fit."""
    full = np.column_stack([np.ones(len(d)), *[np.prod([d[p] for p in t.split(":")], axis=0) for t in use]])
    y, train, test = d[response].to_numpy(), (d.fold != fold).to_numpy(), (d.fold == fold).to_numpy()
    beta = np.linalg.lstsq(full[train], y[train], rcond=None)[0]
    s2 = ((y[train] - full[train] @ beta) ** 2).mean()
    return (-0.5 * np.log(2 * np.pi * s2) - (y[test] - full[test] @ beta) ** 2 / (2 * s2)).mean()


def test_grids_equal_row_level_fits(spark):
    rows, terms = studies.reading_design(spark, SF)
    rows.cache()
    d = rows.toPandas()
    assert len(terms) == 12 + 4 * 5 > regression.NARROW
    n, c, layer = ({int(x.rsplit("_", 1)[1]): x for x in d.columns if x.startswith(p)} for p in ("ngram_surprisal", "context_limited", "internal_layer"))
    for one, two in ((n, c), (n, layer)):
        formulas = regression.grid_formulas(one, two)
        scores = regression.fold_scores(regression.factors(rows, terms, "time"), terms, formulas)
        assert scores.where("not sound").count() == 0
        got = {(r["first"], r["second"], r["fold"]): r for r in regression.grid_deltas(scores, list(one), list(two)).collect()}
        assert set(got) == {(i, j, f) for i in one for j in two for f in range(1, 11)}
        for (i, j, f), r in got.items():
            if f in (1, 7):
                want = {k: row_level(d, terms, formulas[k], "time", f) for k in ("m0", f"a{i}", f"b{j}", f"a{i}b{j}")}
                assert r["ll_m0_mean"] == pytest.approx(want["m0"], abs=1e-8)
                assert r["delta_a_given_b_mean"] == pytest.approx(want[f"a{i}b{j}"] - want[f"b{j}"], abs=1e-8)
                assert r["delta_b_given_a_sum"] == pytest.approx((want[f"a{i}b{j}"] - want[f"a{i}"]) * r["n_test"], abs=1e-4)
    rows.unpersist()


def test_wide_sums_equal_narrow_ones(design):
    terms = ["a", "b", "a:b"]
    form = lambda g: {(r["fold"], r["i"], r["j"]): r["v"] for r in g.collect()}
    assert form(regression.wide_gram(design, terms, "y")) == pytest.approx(form(regression.gram(design, terms, "y")), abs=1e-9)


def test_many_columns_are_planned_at_once(spark):
    names = [f"x{k}" for k in range(240)]
    rows = spark.range(3000).select((F.col("id") % 3 + 1).cast("int").alias("fold"), *[F.sin((F.col("id") + 1) * (k + 1)).alias(c) for k, c in enumerate(names)], F.cos(F.col("id") * 2.5).alias("y"))
    d = rows.toPandas()
    scores = {r["fold"]: r["ll_mean"] for r in regression.fold_scores(regression.factors(rows, names, "y"), names, {"all": names}).collect()}
    assert all(scores[f] == pytest.approx(row_level(d, names, names, "y", f), abs=1e-6) for f in (1, 2, 3))


def test_logistic_scores_equal_newton_steps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.4 + x @ [1.2, -0.7])))).astype(float)
    rows = [(k % 3 + 1, float(a), float(b), float(t)) for k, ((a, b), t) in enumerate(zip(x, y))]
    got = {r["fold"]: r["ll_mean"] for r in regression.logistic_scores(spark.createDataFrame(rows, "fold int, a double, b double, y double"), ["a", "b"], "y").collect()}
    full, fold = np.column_stack([np.ones(300), x]), np.arange(300) % 3 + 1
    for f in (1, 2, 3):
        beta, tr, te = np.zeros(3), fold != f, fold == f
        for _ in range(50):
            p = 1 / (1 + np.exp(-full[tr] @ beta))
            beta += np.linalg.solve((full[tr] * (p * (1 - p))[:, None]).T @ full[tr], full[tr].T @ (y[tr] - p))
        p = 1 / (1 + np.exp(-full[te] @ beta))
        assert got[f] == pytest.approx((y[te] * np.log(p) + (1 - y[te]) * np.log(1 - p)).mean(), abs=1e-9)


def test_flagship_gains_equal_row_level_fits(spark):
    """surprisal_gains' SQL-free part: backoff, lags, folds and gains over documents."""
    from glossa.plans.queries import flagship

    got = {r["delta"]: (r["mean"], r["se"], r["k"]) for r in flagship(spark, SF).collect()}
    docs = [(r["doc_id"], r["text"].split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    one, two, size = {}, {}, 0
    for _, ws in docs:
        size += len(ws)
        for k, word in enumerate(ws):
            one[word] = one.get(word, 0) + 1
            if k:
                two[ws[k - 1], word] = two.get((ws[k - 1], word), 0) + 1
    lines = []
    for i, ws in docs:
        s0 = [-np.log(one[word] / size) for word in ws]
        s1 = [s0[0], *[-np.log(two[a, b] / one[a]) for a, b in zip(ws, ws[1:])]] if ws else []
        lines += [(i, k, len(ws[k]), len(ws[k - 1]), s0[k], s0[k - 1], s1[k], s1[k - 1]) for k in range(1, len(ws))]
    terms = ["prev_word_len", "n0", "prev_n0", "n1", "prev_n1"]
    d = pd.DataFrame(lines, columns=["text_id", "word_id", "word_len", *terms])
    order = sorted(range(len(d)), key=lambda k: (hashlib.md5(f"flagship|{lines[k][0]}|{lines[k][1]}".encode()).hexdigest(), lines[k][:2]))
    rank = np.empty(len(d))
    rank[order] = np.arange(len(d))
    d["fold"] = np.maximum(1, np.ceil(rank * 10 / (len(d) - 1))).astype(int)
    use = {"m0": terms[:1], "n0": terms[:3], "n1": [terms[0], *terms[3:]], "both": terms}
    ll = {name: np.array([row_level(d, terms, columns, "word_len", f) for f in range(1, 11)]) for name, columns in use.items()}
    for name, (a, b) in {"n0": ("n0", "m0"), "n1": ("n1", "m0"), "n0 given n1": ("both", "n1"), "n1 given n0": ("both", "n0")}.items():
        gain = ll[a] - ll[b]
        assert got[name] == (pytest.approx(gain.mean(), abs=1e-8), pytest.approx(gain.std(ddof=1) / 10**0.5, abs=1e-8), 10)


def test_student_tail_and_ranks_over_ranges(spark):
    # Two-sided tails of Student's t from tables.
    for t, df, p in ((2.228, 10, 0.05), (-2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 100000, 0.05), (3.169, 10, 0.01), (0.0, 5, 1.0)):
        assert reports._incomplete_beta(df / (df + t * t), df / 2, 0.5) == pytest.approx(p, abs=2e-4)
    rng = np.random.default_rng(2)
    values = rng.integers(0, 60, 500) / 7
    rows = spark.createDataFrame([(k % 3, float(v)) for k, v in enumerate(values)], "g int, x double")
    want = pd.DataFrame({"g": np.arange(500) % 3, "x": values})
    want["r"] = want.groupby("g")["x"].rank()
    got = {(r["g"], r["x"]): r["r"] for r in reports.rank_values(rows, ["g"], "x", "r").collect()}
    assert got == {(g, x): r for g, x, r in want.itertuples(index=False)}


def test_budgets_have_the_signs_of_their_names(spark):
    r = reports.budgets(spark.createDataFrame([(5.0, 2.0, 1.0, 4.0, None, 1.0)], "surprisal double, h double, prev_surprisal double, prev_h double, next_surprisal double, next_h double"), "h", waves=("", "prev_", "next_")).first()
    assert (r["budget_delta_h"], r["overbudget_h"], r["underbudget_h"], r["absdelta_h"]) == (3.0, 0.0, 3.0, 3.0)
    assert (r["prev_budget_delta_h"], r["prev_overbudget_h"], r["prev_underbudget_h"], r["prev_absdelta_h"]) == (-3.0, 3.0, 0.0, 3.0)
    assert r["next_budget_delta_h"] is None and r["next_overbudget_h"] is None and r["next_underbudget_h"] is None


def test_fingerprint_follows_content_not_order(spark):
    rows = spark.range(100).selectExpr("id", "cast(id % 7 as string) AS s")
    same = checks.fingerprint(rows.orderBy(F.desc("id")).repartition(5)).first()
    assert checks.fingerprint(rows).first() == same != checks.fingerprint(rows.where("id < 99")).first()
