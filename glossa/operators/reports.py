"""Word-length study, significance and report tables."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut, small_side

MOST_FOLDS = 40  # 2^20 sums a half, 8 MB


def word_types(words: DataFrame, surprisal: str = "surprisal", buggy: str | None = None, frequency: str | None = None) -> DataFrame:
    """Per word the mean surprisal, its channel-capacity form mean(s^2) /
    mean(s), both also of the uncorrected scores where there are any, log frequency
    (of the rows, or the mean of a column) and length."""
    forms = [("piantadosi", "cch", F.col(surprisal))] + ([("piantadosi_buggy", "cch_buggy", F.col(buggy))] if buggy else [])
    measures = [c for mean, ratio, s in forms for c in (F.avg(s).alias(mean), (F.avg(s * s) / F.avg(s)).alias(ratio))]
    zipf = F.log(F.avg(frequency)) if frequency else F.log(F.count(F.lit(1)))
    return words.groupBy("word").agg(*measures, zipf.alias("zipf"), F.max("word_len").alias("word_len"))


def with_cost(types: DataFrame) -> DataFrame:
    """Zipf as a cost, its sign turned, as the correlations take it."""
    return types.withColumn("zipf", -F.col("zipf"))


def rank_values(values: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """(groups, value, name): ranks from 1 of a value among its group's, ties at their
    mean, for all groups at once. Distinct values go into ranges; what a group has in
    earlier ranges gives a range's offset, and only a range's own values are ordered in
    a task."""
    sizes = values.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("ties"))
    ranged = cut(sizes.repartitionByRange(*groups, value).withColumn("pid", F.spark_partition_id()))
    ahead = lambda what, window: F.coalesce(F.sum(what).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy(*groups, "pid").agg(F.sum("ties").alias("held")).select(*groups, "pid", ahead("held", Window.partitionBy(*groups).orderBy("pid")).alias("offset"))  # a row a range and group
    within = ahead("ties", Window.partitionBy("pid", *groups).orderBy(value))
    return ranged.join(F.broadcast(offsets), [*groups, "pid"]).select(*groups, value, (F.col("offset") + within + (F.col("ties") + 1) / 2).alias(name))


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = c = 1.0
    d = 0.0
    for k in range(500):
        m = k // 2
        if k % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k else 1.0
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        value *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (value - 1)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, for the few rows of a report."""

    def tails(values: pd.Series, degrees: pd.Series) -> pd.Series:
        return pd.Series([_incomplete_beta(n / (n + v * v), n / 2, 0.5) if n > 0 and v == v else None for v, n in zip(values, degrees, strict=True)], dtype="float64")

    return F.pandas_udf(tails, "double")(t.cast("double"), df.cast("double"))


def length_correlations(types: DataFrame, predictors: list[str], length: str = "word_len") -> DataFrame:
    """Pearson and Spearman of word length with each predictor, their t and p, over
    the rows that have the predictor. All are ranked in one long form: a row's two sides
    for each predictor, ranks by (predictor, side, value), and the sides together again."""
    whole = cut(types.select(length, *predictors)).withColumn("row", F.monotonically_increasing_id())
    sides = [F.when(F.col(p).isNotNull(), F.struct(F.lit(p).alias("predictor"), F.lit(side).alias("side"), F.col(c).cast("double").alias("value"))) for p in predictors for side, c in enumerate((length, p))]
    long = whole.select("row", F.inline(F.array_compact(F.array(*sides))))
    ranks = rank_values(long, ["predictor", "side"], "value", "rank")
    of = lambda side, what: F.max(F.when(F.col("side") == side, F.col(what)))
    pairs = long.join(ranks, ["predictor", "side", "value"]).groupBy("row", "predictor").agg(of(0, "value").alias("a"), of(1, "value").alias("b"), of(0, "rank").alias("rank_a"), of(1, "rank").alias("rank_b"))
    out = pairs.groupBy("predictor").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearson"), F.corr("rank_a", "rank_b").alias("spearman"))
    t = lambda r: F.col(r) * F.sqrt((F.col("n") - 2) / (1 - F.col(r) * F.col(r)))
    timed = out.withColumns({"pearson_t": t("pearson"), "spearman_t": t("spearman")})
    return timed.withColumns({f"{r}_p": student_p(F.col(f"{r}_t"), F.col("n") - 2) for r in ("pearson", "spearman")})


def _greater_patterns(values: np.ndarray) -> int:
    """How many sign patterns give a sum strictly greater in size than the plain one. The
    sums of either half are sorted and met in the middle; as every pattern's opposite
    is one too, those above count for those below."""
    signed = lambda part: np.sort(functools.reduce(lambda sums, v: np.concatenate((sums + v, sums - v)), part, np.zeros(1)))
    half = len(values) // 2
    left, right = signed(values[:half]), signed(values[half:])
    limit = abs(values.sum()) + 1e-12
    return 2 * int((len(right) - np.searchsorted(right, limit - left, side="right")).sum())


def signflip_exact(folds: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """M11, exact: the share of the 2^k sign patterns of a group's k fold values whose
    mean is strictly greater in size than the one seen; 2^(k/2) sums a group in memory."""
    if k > MOST_FOLDS:
        raise ValueError(f"for more than {MOST_FOLDS} folds use signflip_random")
    listed = folds.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", value))), lambda s: s[value].cast("double")).alias("d"))

    def count(lists: pd.Series) -> pd.Series:
        return pd.Series([_greater_patterns(np.asarray(d, float)) for d in lists], dtype="int64")

    seen = F.aggregate("d", F.lit(0.0), lambda a, v: a + v)
    counted = listed.select(*keys, F.pandas_udf(count, "long")("d").alias("n_greater"), F.shiftleft(F.lit(1).cast("long"), k).alias("n_patterns"), (seen / k).alias("mean_delta"))
    return counted.withColumn("p", (F.col("n_greater") + 1) / F.col("n_patterns"))


def signflip_random(folds: DataFrame, keys: list[str], value: str, flips: int, seed: str) -> DataFrame:
    """The same with random signs, p = (greater + 1) / flips. A group is one row
    with its fold values, met by every flip."""
    listed = folds.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", value))), lambda s: s[value]).alias("d"))  # folds: a few values a group
    digest = lambda i: F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("flip").cast("string"), F.floor(i / 32).cast("string")))
    bits = lambda i: F.conv(F.substr(digest(i), i % 32 + 1, F.lit(1)), 16, 10).cast("int") % 2
    total = lambda signed: F.aggregate(signed, F.lit(0.0), lambda a, v: a + v)
    flipped = total(F.transform("d", lambda v, i: F.when(bits(i) == 0, v).otherwise(-v)))
    drawn = listed.withColumn("flip", F.explode(F.sequence(F.lit(1), F.lit(flips))))
    met = drawn.select(*keys, (F.abs(flipped) > F.abs(total(F.col("d")))).alias("greater"))
    return met.groupBy(*keys).agg(((F.count_if("greater") + 1) / F.lit(flips)).alias("p"))


def corrected_p(rows: DataFrame, groups: list[str], p: str = "p") -> DataFrame:
    """P times the group's tests over its rank, neither capped nor made monotone."""
    group = Window.partitionBy(*groups)
    return rows.withColumn("p_corrected", F.col(p) * F.count(F.lit(1)).over(group) / F.row_number().over(group.orderBy(p, *[c for c in rows.columns if c != p])))


def stars(p: Column) -> Column:
    """Significance classes."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def density_change(delta: Column) -> Column:
    """Percent change of density."""
    return 100 * F.expm1(delta)


def directional(rows: DataFrame, family: str, value: str) -> DataFrame:
    """The value under a name of its family, missing for the other."""
    return rows.withColumns({"delta_ngram": F.when(F.col(family) == "ngram", F.col(value)), "delta_context": F.when(F.col(family) == "context", F.col(value))})


def grid_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and range of cells, how many are positive or above 1.96 errors, the best."""
    return rows.groupBy(*keys).agg(
        F.avg("mean").alias("mean"), F.min("mean").alias("least"), F.max("mean").alias("most"), F.count_if(F.col("mean") > 0).alias("n_positive"),
        F.count_if(F.col("mean") > 1.96 * F.col("se")).alias("n_clear"), F.max_by("cell", "mean").alias("best_cell"),
    )


def run_summary(rows: DataFrame) -> DataFrame:
    """A one-row table as key and value rows."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in rows.columns)
    return rows.select(F.expr(f"stack({len(rows.columns)}, {pairs})").alias("key", "value"))


def chart_means(rows: DataFrame, keys: list[str], value: str = "diff_empty") -> DataFrame:
    """Means over folds times 100 of plain predictors of type 1."""
    plain = rows.where(~F.col("predictor").rlike("prev|budget|delta|next") & (F.col("predictor_type") == 1))
    return plain.groupBy(*keys).agg((100 * F.avg(value)).alias("value"))


def budgets(rows: DataFrame, budget: str, cost: str = "surprisal", waves: tuple[str, ...] = ("", "prev_", "prev2_", "prev3_", "next_")) -> DataFrame:
    """At each place the difference of cost to budget, the parts of it that are
    over (cost below budget) and under, and its size."""
    columns = {}
    for w in waves:
        gap = F.col(f"{w}{cost}") - F.col(f"`{w}{budget}`")
        columns |= {f"{w}budget_delta_{budget}": gap, f"{w}overbudget_{budget}": F.greatest(-gap, gap * 0), f"{w}underbudget_{budget}": F.greatest(gap, gap * 0), f"{w}absdelta_{budget}": F.abs(gap)}
    return rows.withColumns(columns)


def p_table(folds: DataFrame, keys: list[str], value: str, k: int, groups: list[str]) -> DataFrame:
    """For every key the mean of its k fold values, the exact sign-flip p, the
    corrected p inside a group of tests, and the class of significance."""
    tested = signflip_exact(folds, keys, value, k).select(*keys, F.col("mean_delta").alias("diffs"), F.col("p").alias("pvalue"))
    return corrected_p(tested, groups, "pvalue").withColumn("stars", stars(F.col("p_corrected")))


def chosen_differences(results: DataFrame, kinds: dict[str, tuple[int, str]]) -> DataFrame:
    """M12's selection: each kind of comparison takes rows of its predictor_type and,
    as diff, one of the stored differences; rows of no kind go."""
    out = None
    for kind, (code, column) in kinds.items():
        part = results.where(F.col("predictor_type") == code).withColumns({"kind": F.lit(kind), "diff": F.col(column)})
        out = part if out is None else out.unionByName(part)
    return out


def predictor_descriptives(scores: DataFrame) -> DataFrame:
    """A10, from (model, size, context, key, value): the mean by model and context and
    whether it falls from the context before."""
    means = scores.groupBy("model", "size", "context").agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
    before = F.lag("mean_value").over(Window.partitionBy("model").orderBy("context"))
    return means.withColumn("falls", F.col("mean_value") < before)


def score_correlations(scores: DataFrame, across: str) -> DataFrame:
    """A10: Pearson correlations of the scores of a key between two values of across
    ('context' inside a model, 'model' at a context)."""
    same = "model" if across == "context" else "context"
    left, right = (scores.select("key", same, F.col(across).alias(c), F.col("value").alias(f"value_{c}")) for c in ("first", "second"))
    pairs = left.join(right, ["key", same]).where("first < second")
    return pairs.groupBy(same, "first", "second").agg(F.corr("value_first", "value_second").alias("r"))


def size_trend(means: DataFrame, value: str = "mean_value") -> DataFrame:
    """A10: per context the correlation of a model's value with the log of its size."""
    return means.groupBy("context").agg(F.corr(value, F.log("size")).alias("r"), F.count(F.lit(1)).alias("n_models"))


def with_labels(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Labels of a name (size, family, what it is called) from a dimension table."""
    return rows.join(small_side(labels, labels.count()), key, "left")
