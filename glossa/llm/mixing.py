"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / weight. Sorted by that key
within its source, documents are taken until the source's word budget is met;
whole epochs over the source come first and only the fraction left is sampled.

The weight is the text's measured quality (the share of letters among its signs,
squared, and less for capitals), times RATED[rating] where the document has been
rated 0 or 1.

The prefix sum needs no source in one task: a histogram of (source, key bucket)
gives the prefix up to the bucket in which the budget ends, and only that
bucket's documents are sorted. Buckets are 1 / OCTAVE of a doubling of the key, so
none holds more than some thousandth of a source, whatever the weights.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, ranked last; repeated rows count each on its own; ratings of
one document are averaged, those without id or value ignored; equal keys go by id
and size; a very long text may be all of a budget's error, no other; an empty
table gives an empty result. Columns other than the ones named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut, small_side

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
OCTAVE = 256
RATED = (0.25, 2.0)  # factors of a weight for ratings 0 and 1, in between by their share
LEAST_QUALITY = 0.05
NOWHERE = -(1 << 40)  # below every bucket: nothing is sampled


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """LEAST_QUALITY to 1: letters among all signs but white space, squared, less half
    the share of capitals A to Z among the letters."""
    signs = F.length(F.regexp_replace(text, r"\s+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    capitals = letters - F.length(F.translate(F.regexp_replace(text, r"[^\p{L}]+", ""), UPPER, ""))
    share = letters / F.greatest(signs, F.lit(1))
    return F.greatest(F.lit(LEAST_QUALITY), F.coalesce(share * share * (1 - capitals / F.greatest(2 * letters, F.lit(1))), F.lit(0.0)))


def sampling_key(seed: str, doc_id: Column, size: Column, weight: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), size.cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """sizes(source, source_size) with target: the total is shared by weight, a
    share above cap times its source stops there and the excess goes to the
    rest by weight. One row a source, so one ordered window suffices.

    Sorted by cap * size / weight the capped sources form a prefix; the level
    at the first source that isn't capped is the one that all others get.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), cycle.cast("int") + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("ceiling", F.lit(float(cap)) * F.col("source_size"))
    ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    heft = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", left / heft).withColumn("free", F.col("ceiling") >= F.col("weight") * F.col("level"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(everything)
    return levelled.select(
        "source", "source_size", F.coalesce(F.least(F.col("ceiling"), F.col("weight") * level), F.col("ceiling")).alias("target")
    )


def mix(docs: DataFrame, ratings: DataFrame | None = None, *, doc_id="doc_id", text="text", source="source", rating="quality", weights=(5, 2, 1), cap: int = 3, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of
    each document, whole epochs and the sampled fraction together. keep names
    columns that come along.

    A source's sample is the longest prefix within its budget, and then the one
    document outside it that fits best in what is left.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), text_quality(F.col(text)).alias("measured"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    carried = [f"kept_{c}" for c in keep]
    if ratings is not None:
        given = ratings.where(F.col(rating).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg((F.col(rating) > 0).cast("double")).alias("rating"))
        rows = rows.join(given, "doc_id", "left")
    else:
        rows = rows.withColumn("rating", F.lit(None).cast("double"))
    factor = F.coalesce(RATED[0] + (RATED[1] - RATED[0]) * F.col("rating"), F.lit(1.0))
    base = cut(
        rows.withColumn("weight", F.col("measured") * factor)
        .withColumn("key", sampling_key(seed, F.col("doc_id"), F.col("size"), F.col("weight")))
        .select("doc_id", "source", "size", "weight", "key", F.floor(F.log2("key") * OCTAVE).alias("bucket"), F.monotonically_increasing_id().alias("row"), *carried)
    )
    histogram = base.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    sizes = histogram.groupBy("source").agg(F.sum("held").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    prefix = F.sum("held").over(Window.partitionBy("source").orderBy("bucket"))
    stairs = histogram.select(F.col("source").alias("of"), "bucket", prefix.alias("upto"), "held")
    # The bucket in which the budget ends: the first whose prefix reaches it.
    plan = cut(
        budgets.join(stairs, F.col("source").eqNullSafe(F.col("of")) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("held") < F.col("rest")), "left")
        .groupBy("source", "source_size", "target", "epochs", "rest")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("held")).alias("before"))).alias("edge"))
        .select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest", F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"))
    )
    planned = base.join(small_side(plan, plan.count()), F.col("source").eqNullSafe(F.col("of")))
    edge = F.coalesce(F.col("edge"), F.lit(NOWHERE))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    sampled = cut(
        planned.where(F.col("bucket") != edge)
        .withColumn("more", F.col("bucket") < edge)
        .unionByName(planned.where(F.col("bucket") == edge).withColumn("more", upto <= F.col("rest") - F.col("before")))
        .select("row", "doc_id", "of", "key", "weight", "size", "source_size", "target", "epochs", "rest", "more", *carried)
    )
    # What the prefix leaves of a budget goes to the document that fits it best.
    gaps = sampled.groupBy("of", "rest").agg(F.coalesce(F.sum(F.when(F.col("more"), F.col("size"))), F.lit(0)).alias("got"))
    gaps = gaps.select(F.col("of").alias("gap_of"), (F.col("rest") - F.col("got")).alias("gap"))
    count = plan.count()
    miss = F.abs(F.col("gap") - F.col("size"))
    fitting = sampled.where(~F.col("more")).join(small_side(gaps, count), F.col("of").eqNullSafe(F.col("gap_of"))).where(miss < F.col("gap"))
    fillers = fitting.groupBy("of").agg(F.min(F.struct(miss.alias("miss"), "key", "doc_id", "row")).alias("best")).select(F.col("best.row").alias("filler"))
    filled = sampled.join(small_side(fillers, count), F.col("row") == F.col("filler"), "left")
    more = F.col("more") | F.col("filler").isNotNull()
    taken = F.col("size") * F.col("epochs") + F.when(more, F.col("size")).otherwise(0)
    return filled.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("epochs").cast("long").alias("epochs"), more.alias("more"), F.round("weight", 9).alias("weight"), *[F.col(f"kept_{c}").alias(c) for c in keep])


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS signs,
    regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g') AS letters FROM documents),
rated AS (SELECT doc_id, avg((quality > 0)::INT::DOUBLE) AS rating FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
weighted AS (
  SELECT doc_id, source, size, coalesce(0.25::DOUBLE + 1.75::DOUBLE * rating, 1) * greatest(0.05::DOUBLE,
    pow(length(letters)::DOUBLE / greatest(signs, 1), 2) * (1 - (length(letters) - length(translate(letters, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::DOUBLE / greatest(2 * length(letters), 1))) AS weight FROM base LEFT JOIN rated USING (doc_id)),
keyed AS (
  SELECT doc_id, source, size, weight, -ln((('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, size::VARCHAR)), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / weight AS key FROM weighted),
sizes AS (SELECT source, sum(size)::DOUBLE AS s FROM keyed GROUP BY source),
weighed AS (SELECT source, s, 3.0::DOUBLE * s AS ceiling,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sizes),
levels AS (SELECT *, (sum(s) OVER () - coalesce(sum(ceiling) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level, row_number() OVER (ORDER BY ceiling / w, source NULLS LAST) AS k FROM weighed
  WINDOW before AS (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(level, k) AS level FROM levels WHERE ceiling >= w * level),
targets AS (SELECT source, s, coalesce(least(ceiling, w * common.level), ceiling) AS target FROM levels, common),
budgets AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs FROM targets),
placed AS (SELECT k.doc_id, k.key, k.weight, k.source, k.size, b.s, b.target, b.epochs, b.target - b.epochs * b.s AS rest, row_number() OVER () AS r,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= b.target - b.epochs * b.s AS prefix
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source),
gaps AS (SELECT source, rest - coalesce(sum(size) FILTER (WHERE prefix), 0) AS gap FROM placed GROUP BY source, rest),
fit AS (SELECT p.r, row_number() OVER (PARTITION BY p.source ORDER BY abs(g.gap - p.size), p.key, p.doc_id) AS k
  FROM placed p JOIN gaps g ON p.source IS NOT DISTINCT FROM g.source WHERE NOT p.prefix AND abs(g.gap - p.size) < g.gap),
chosen AS (SELECT *, prefix OR r IN (SELECT r FROM fit WHERE k = 1) AS more FROM placed)
SELECT doc_id, size, s::BIGINT AS source_size, target,
  (size * epochs + CASE WHEN more THEN size ELSE 0 END)::BIGINT AS taken, epochs::BIGINT AS epochs, more, round(weight, 9) AS weight FROM chosen
"""
