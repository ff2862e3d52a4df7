"""Reading times: measures, outliers, passes and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centre_by_worker(rows: DataFrame, worker: str = "worker", time: str = "time") -> DataFrame:
    """Each time less its worker's mean."""
    return rows.withColumn("centred", F.col(time) - F.avg(time).over(Window.partitionBy(worker)))


def log_outliers(rows: DataFrame, time: str = "time", limit: float = 3.0, zeros: str = "ignore") -> DataFrame:
    """|z| of log time over limit, with the population deviation over all rows,
    joined back as one row. zeros: 'ignore' leaves zero times out (never outliers);
    'strict' finds none where any time is zero, as log 0 spoils every z. Missing
    times aren't outliers."""
    log = F.log(F.when(F.col(time) > 0, F.col(time)))
    whole = rows.agg(F.avg(log).alias("log_mean"), F.stddev_pop(log).alias("log_sd"), F.count_if(F.col(time) == 0).alias("n_zero"))
    outlier = F.coalesce(F.abs(log - F.col("log_mean")) / F.col("log_sd") > limit, F.lit(False))
    if zeros == "strict":
        outlier = outlier & (F.col("n_zero") == 0)
    return rows.crossJoin(F.broadcast(whole)).withColumn("outlier", outlier).drop("log_mean", "log_sd", "n_zero")  # one row


def outlier_share(rows: DataFrame) -> DataFrame:
    """Percentage of outliers."""
    return rows.agg((100 * F.avg(F.col("outlier").cast("double"))).alias("outlier_percent"), F.count(F.lit(1)).alias("n"))


def keep_rows(rows: DataFrame, excluded: list, number: str = "word_id", worker: str = "worker", langs: list[str] | None = None) -> DataFrame:
    """Rows that have a word number, are of none of the workers excluded and,
    where languages are named, are in one of them (null workers stay)."""
    kept = rows.where(F.col(number).isNotNull() & ~F.coalesce(F.col(worker).isin(excluded), F.lit(False)))
    return kept if langs is None else kept.where(F.col("lang").isin(langs))


def skip_policy(rows: DataFrame, keep_zeros: bool, time: str = "time") -> DataFrame:
    """Skipped words stay at zero or go."""
    return rows if keep_zeros else rows.where(F.col(time) != 0)


def time_variants(rows: DataFrame, total: str, first_pass: str, first_fixation: str) -> DataFrame:
    """Five times. v1 is the total as read; v2 and v3 are the first pass and the
    first fixation with nulls at zero; v4 and v5 are the first fixation and the first
    pass with skipped words at zero, where an unskipped null stays."""
    unskipped = lambda c: F.when(F.col("skipped"), 0.0).otherwise(F.col(c))
    return rows.withColumns(
        {"time_v1": F.col(total), "time_v2": F.coalesce(first_pass, F.lit(0.0)), "time_v3": F.coalesce(first_fixation, F.lit(0.0)), "time_v4": unskipped(first_fixation), "time_v5": unskipped(first_pass)}
    )


def repair_ids(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Ids above a gap move down by one for each gap of their (lang, text_id)."""
    listed = gaps.groupBy("lang", "text_id").agg(F.collect_list("gap").alias("gaps"))
    return (
        rows.join(listed, ["lang", "text_id"], "left")
        .withColumn("word_id", F.col("word_id") - F.coalesce(F.size(F.filter("gaps", lambda g: g < F.col("word_id"))), F.lit(0)))
        .drop("gaps")
    )


def drop_empty_words(rows: DataFrame, langs: tuple[str, ...] = ("fi", "gr", "it", "tr")) -> DataFrame:
    """Rows without a word go in the languages named."""
    return rows.where(~F.col("lang").isin(*langs) | (F.col("word") != ""))


def regressions(rows: DataFrame) -> DataFrame:
    """A fixation made after a later word's, in (worker, text) and row order;
    fixation 0 (skipped) comes after all others."""
    here = F.when(F.col("fixation") == 0, float("inf")).otherwise(F.col("fixation").cast("double"))
    ahead = Window.partitionBy("worker", "text_id").orderBy("row_idx").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("regression", F.col("fixation") > F.min(here).over(ahead))


def gaze_passes(rows: DataFrame) -> DataFrame:
    """A pass begins where the word differs from that of the fixation before
    (word 0 before the first); skipped rows have pass 0. first_pass marks a word's
    least pass."""
    order = Window.partitionBy("worker", "text_id", F.col("fixation") > 0).orderBy("fixation", "row_idx")
    new = (F.col("word_id") != F.lag("word_id", 1, 0).over(order)).cast("int")
    counted = rows.withColumn("is_new", new).withColumn("pass", F.when(F.col("fixation") > 0, F.sum("is_new").over(order)).otherwise(0)).drop("is_new")
    return counted.withColumn("first_pass", F.col("pass") == F.min("pass").over(Window.partitionBy("worker", "text_id", "word_id")))


def reading_measures(rows: DataFrame, time: str = "time") -> DataFrame:
    """Five measures of a word, those of its first row: the total over the word,
    the row's own time, the sum over the row's pass, and the latter two where the
    row is progressive (a first pass and no regression), else zero."""
    word = Window.partitionBy("worker", "text_id", "word_id")
    progressive = (F.col("first_pass") & ~F.col("regression")).cast("int")
    in_pass = F.sum(time).over(Window.partitionBy("worker", "text_id", "word_id", "pass"))
    measured = rows.withColumn("in_pass", in_pass).withColumns({"total": F.sum(time).over(word), "nth": F.row_number().over(word.orderBy("row_idx"))})
    return measured.where("nth = 1").select(
        "worker", "text_id", "word_id", "total", F.col(time).alias("first_fixation"), F.col("in_pass").alias("first_pass_time"),
        (F.col("in_pass") * progressive).alias("progressive_pass_time"), (F.col(time) * progressive).alias("progressive_fixation"),
    )


def word_means(rows: DataFrame, keys: list[str], numeric: list[str]) -> DataFrame:
    """A1: means over readers of all rows that aren't outliers; flags as shares."""
    return rows.where(~F.col("outlier")).groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numeric], F.count(F.lit(1)).alias("n_readings"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A3: the first row of each key in the order given."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def regression_inputs(rows: DataFrame, time: str = "time") -> DataFrame:
    """P20: log time and a numeric skipped flag, 0 where the column is absent."""
    skipped: Column = F.col("skipped").cast("int") if "skipped" in rows.columns else F.lit(0)
    return rows.withColumns({"log_time": F.log(time), "skipped": F.coalesce(skipped, F.lit(0))})
