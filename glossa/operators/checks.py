"""Data checks: every function returns the rows that break the rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from glossa.operators.joins import KEY, add_lags, family_columns


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """V1: from the schema alone."""
    return [c for c in required if c not in df.columns]


def repeated_keys(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """V2."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bad_values(df: DataFrame, columns: list[str], nonnegative: bool = True) -> DataFrame:
    """V3, one pass: per column how many are missing, not finite, or negative."""
    line = df.agg(*[
        F.struct(F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias("n_odd"), F.count_if(F.col(c) < 0).alias("n_negative")).alias(c)
        for c in columns
    ])
    rows = line.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.n_null"), F.col(f"`{c}`.n_odd"), F.col(f"`{c}`.n_negative")) for c in columns])))
    return rows.where("n_null > 0 or n_odd > 0" + " or n_negative > 0" * nonnegative)


def strict_integer(df: DataFrame, column: str) -> DataFrame:
    """The column as a long; a value that is no finite whole number stops the job."""
    number = F.col(column).cast("string").try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")) & (number == F.floor(number))
    refused = F.raise_error(F.concat(F.lit(f"{column} is no whole number: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return df.withColumn(column, F.when(whole, number.cast("long")).otherwise(refused.cast("long")))


def not_integer(df: DataFrame, column: str) -> DataFrame:
    """P3's violations: rows whose value is no finite whole number."""
    number = F.col(column).cast("string").try_cast("double")
    return df.where(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")) | (number != F.floor(number)))


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers, what is none missing."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})


def not_numeric(df: DataFrame, column: str) -> DataFrame:
    """V4: values that are there but no number."""
    return df.where(F.col(column).isNotNull() & F.col(column).cast("string").try_cast("double").isNull())


def gaps(df: DataFrame, text_id: str = "text_id", word_id: str = "word_id") -> DataFrame:
    """Texts whose word ids aren't 0 to n - 1."""
    return df.groupBy(text_id).agg(F.min(word_id).alias("first"), F.max(word_id).alias("last"), F.count(F.lit(1)).alias("n"), F.countDistinct(word_id).alias("n_distinct")).where(
        "first != 0 or last != n - 1 or n_distinct != n"
    )


def coverage(df: DataFrame, words: DataFrame) -> DataFrame:
    """V5: keys or words that differ from the passages' words."""
    mine, theirs = df.select(*KEY, F.col("word").alias("found"), F.lit(1).alias("l")), words.select(*KEY, F.col("word").alias("expected"), F.lit(1).alias("r"))
    return mine.join(theirs, KEY, "full_outer").where("l is null or r is null or not (found <=> expected)").select(*KEY, "found", "expected")


def counts_differ(df: DataFrame, rows: int, texts: int) -> DataFrame:
    """V6."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("text_id").alias("texts")).where((F.col("rows") != rows) | (F.col("texts") != texts))


def family_differs(df: DataFrame, prefix: str, expected: list[int]) -> list[str]:
    """V7: columns of the family that are missing or not expected."""
    return sorted(set(family_columns(df, prefix)) ^ {f"{prefix}_{k}" for k in expected})


def changed_values(before: DataFrame, after: DataFrame, columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """V8: keys where a numeric column isn't what it was."""
    other = after.select(*KEY, *[F.col(c).alias(f"{c}_after") for c in columns])
    return _changed(before.join(other, KEY), columns, tolerance)


def _changed(both: DataFrame, columns: list[str], tolerance: float) -> DataFrame:
    differs = [~F.col(c).eqNullSafe(F.col(f"{c}_after")) & ~F.coalesce(F.abs(F.col(c) - F.col(f"{c}_after")) <= tolerance, F.lit(False)) for c in columns]
    names = F.array_compact(F.array(*[F.when(d, c) for c, d in zip(columns, differs, strict=True)]))
    return both.select(*KEY, F.array_join(names, ",").alias("changed")).where("changed != ''")


def wrong_lags(df: DataFrame, columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """V9: lags that differ from recomputed ones, which are put beside them by one window;
    keys are there and unique (V2, V3)."""
    lagged = [f"prev{k}_{c}" for c in columns for k in ("", "2", "3")]
    own = df.select(*KEY, *columns, *[F.col(c).alias(f"_{c}") for c in lagged])
    again = add_lags(own, columns).withColumnsRenamed({c: f"{c}_after" for c in lagged}).withColumnsRenamed({f"_{c}": c for c in lagged})
    return _changed(again.dropna(subset=KEY), lagged, tolerance)


def incomplete_grid(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Combinations that are missing or not expected."""
    keys = expected.columns
    lack = expected.join(df.select(*keys), keys, "left_anti").withColumn("violation", F.lit("missing"))
    return lack.unionByName(df.select(*keys).join(expected, keys, "left_anti").withColumn("violation", F.lit("unexpected")))


def broken_folds(df: DataFrame, n: int) -> DataFrame:
    """Formulas whose folds don't part the sample."""
    return df.groupBy("formula").agg(F.sum("n_test").alias("n_tested"), F.count_if(F.col("n_train") + F.col("n_test") != n).alias("n_broken")).where((F.col("n_tested") != n) | (F.col("n_broken") > 0))


def broken_identities(df: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Sums that aren't the mean times the fold's size."""
    return df.where(F.abs(F.col("ll_sum") - F.col("ll_mean") * F.col("n_test")) > tolerance * (1 + F.abs("ll_sum")))


def broken_deltas(df: DataFrame, identities: dict[str, tuple[str, str]], tolerance: float = 1e-8) -> DataFrame:
    """Rows where a delta isn't the difference of its two scores, by name."""
    off = [F.when(~F.coalesce(F.abs(F.col(d) - (F.col(a) - F.col(b))) <= tolerance * (1 + F.abs(F.col(a))), F.lit(False)), d) for d, (a, b) in identities.items()]
    return df.withColumn("broken", F.array_join(F.array_compact(F.array(*off)), ",")).where("broken != ''")


def directional_violations(df: DataFrame, family: str, columns: dict[str, list[str]]) -> DataFrame:
    """Per family how many of its own directional columns aren't finite, how many
    of the other families' aren't missing, and rows of no known family."""
    own, other = F.lit(0), F.lit(0)
    for name, mine in columns.items():
        here = F.col(family).eqNullSafe(F.lit(name))
        for c in mine:
            finite = F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
            own = own + (here & ~finite).cast("int")
            other = other + (~here & F.col(c).isNotNull()).cast("int")
    unknown = ~F.coalesce(F.col(family).isin(list(columns)), F.lit(False))
    found = df.groupBy(family).agg(F.sum(own).alias("n_not_finite"), F.sum(other).alias("n_not_missing"), F.sum(unknown.cast("int")).alias("n_unknown"))
    return found.where("n_not_finite + n_not_missing + n_unknown > 0")


def anchor_differs(report: DataFrame, again: DataFrame, tolerance: float, slack: float = 1e-9) -> DataFrame:
    """A stored anchor report (n, max_gap, mean_gap, p99_gap) against one that is
    computed again: figures that differ, and gaps out of order or over the tolerance."""
    figures = ["n", "max_gap", "mean_gap", "p99_gap"]
    both = report.crossJoin(again.select(*[F.col(c).alias(f"{c}_again") for c in figures]))  # one row each
    near = lambda a, b: F.coalesce(F.abs(a - b) <= slack * (1 + F.abs(b)), F.lit(False))
    checks = [F.when(~near(F.col(c), F.col(f"{c}_again")), f"{c} differs") for c in figures]
    checks += [F.when(F.col("max_gap_again") > tolerance, "over tolerance"), F.when(F.col("mean_gap") > F.col("max_gap") + 1e-15, "mean over max"), F.when(F.col("p99_gap") > F.col("max_gap") + 1e-15, "p99 over max")]
    return both.select(F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def varying_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose score isn't the same in all partners."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).where("n_values != 1")


def aggregate_differs(rows: DataFrame, stored: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Stored fold means or errors that aren't those of the rows (mean, se)."""
    again = rows.groupBy(*keys).agg(F.avg("value").alias("mean_again"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se_again"))
    off = lambda a, b: ~F.col(a).eqNullSafe(F.col(b)) & ~F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
    return stored.join(again, keys, "full_outer").where(off("mean", "mean_again") | off("se", "se_again"))


def summary_differs(rows: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Summary keys whose value isn't the expected one."""
    wanted = rows.sparkSession.createDataFrame(list(expected.items()), "key string, expected string")
    return wanted.join(rows, "key", "left").where(~F.col("value").eqNullSafe(F.col("expected")))


def text_digests(texts: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """A digest of each text."""
    return texts.select(key, F.sha2(text, 256).alias("sha256"))


def fingerprint(df: DataFrame) -> DataFrame:
    """A digest of a table's content, whatever its order: rows are told by 60 bits of
    the md5 of their values, each with its length, which other engines have too."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in df.columns]
    line = F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts])
    h = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"))


def observed(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """V3, V4, P3, P22, V12 as one run: df, which counts the rows that break each rule (a
    null breaks it too) while something else reads it, and where the counts will be."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]), seen


def write_checked(df: DataFrame, rules: dict[str, Column], path: str) -> DataFrame:
    """df as Parquet at path, and (check, n_rows, n_broken) from the same scan."""
    counted, seen = observed(df, rules)
    counted.write.mode("overwrite").parquet(path)
    counts = seen.get
    return df.sparkSession.createDataFrame([(name, counts["rows"], counts[name]) for name in rules], "check string, n_rows long, n_broken long")
