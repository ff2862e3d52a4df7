"""How far the sources of a language differ in their words, by count-level bitmaps.

Terms that enough documents of a language have are dealt into blocks of TERMS term
ids, by how often the language has them and then by hash, so that rare terms, which
have few different counts, share blocks. In a block a bitset of term ids stands for
each (group, count). For two groups, AND and popcount of their bitsets give how many
terms have count a in one and b in the other; cells with a zero follow by complement,
from the bitsets' own sizes and the block's. Each cell is multiplied by the difference
of the two rates, which depend on the counts alone, and summed over blocks.

Occurrences are summed in every partition before they are shuffled, and blocks bound
what a task holds: a source, language or term may be as frequent as it likes.

All arithmetic is exact: counts are long, rates are divided as decimals, and a block's
sums are below 2^63. Rate: 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)).

Defined cases: null text, language and source are empty strings; a group without
terms takes part with a count of zero; a language without kept terms has pairs of
value 0; very long texts are walked whole; repeated rows count each; ties go by the
item's bytes; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.texts import chunks, gathered
from glossa.session import cut, small_side

LEAST_DOCS, TOP, SCALE, ADDED = 30, 50, 1_000_000_000, 5
TERMS, WORDS = 256, ["w0", "w1", "w2", "w3"]  # of a block: four 64-bit words a bitset
DEALT = 16 * TERMS  # terms that one window numbers
HELD = 200_000  # distinct terms a task holds before it hands them on
CELL_WORDS = 4_000_000  # 64-bit words of one AND, 32 MB
TERM_ROWS = 500_000  # kept terms, some 50 MB: broadcast up to here
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, summed over the partition."""
    often: dict[tuple, Counter] = {}
    in_docs: dict[tuple, Counter] = {}

    def batch() -> pa.RecordBatch:
        lines = [(*group, term.decode("utf-8", "surrogatepass"), n, in_docs[group][term]) for group, found in often.items() for term, n in found.items()]
        columns = zip(*lines, strict=True) if lines else [()] * 5
        often.clear()
        in_docs.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS, strict=True)], schema=COUNTS)

    for rows in chunks(batches):
        for row in rows:
            terms = _TERM.findall(row["text"].encode("utf-8", "surrogatepass").lower())
            group = (row["lang"], row["source"])
            often.setdefault(group, Counter()).update(terms)
            in_docs.setdefault(group, Counter()).update(set(terms))
        if sum(map(len, often.values())) > HELD:
            yield batch()
    yield batch()


def _rate(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exactly."""
    wide = lambda c: F.col(c) if isinstance(c, str) else c
    over = ((wide(count) + ADDED).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")).alias("over")
    under = (wide(total) + ADDED * wide(kept)).cast("decimal(20,0)")
    return 1 + F.call_function("div", over, under)


def _pairs(lines: pd.DataFrame) -> pd.DataFrame:
    """A block's lines (source, count, rate, w0 to w3), a group's zero line with the
    block's size among them, to the sums of its differences for every two groups."""
    lines = lines.sort_values(["source", "count"], kind="stable")
    zero, some = lines[lines["count"] == 0], lines[lines["count"] > 0]
    lang, size, names, base = zero["lang"].iloc[0], int(zero["size"].iloc[0]), zero["source"].to_numpy(), zero["rate"].to_numpy(np.int64)
    bits = np.ascontiguousarray(some[WORDS].to_numpy(np.int64)).view(np.uint64)
    rates, sizes = some["rate"].to_numpy(np.int64), np.bitwise_count(bits).sum(1, dtype=np.int64)
    bounds = np.searchsorted(pd.Index(names).get_indexer(some["source"]), np.arange(len(names) + 1))
    present = np.diff(np.concatenate(([0], np.cumsum(sizes)))[bounds])
    out = []
    for a in range(len(names) - 1):
        rest = np.arange(a + 1, len(names))
        full = rest[bounds[rest + 1] > bounds[rest]]  # groups that have terms in the block
        begin = bounds[a + 1]
        their_bits, their_rates, starts = bits[begin:], rates[begin:], bounds[full] - begin
        value, both, met = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.zeros(len(their_bits), np.int64)
        step = max(1, CELL_WORDS // max(1, their_bits.size))
        for low in range(bounds[a], bounds[a + 1], step):
            part = slice(low, min(low + step, bounds[a + 1]))
            shared = np.zeros((part.stop - low, len(names)), np.int64)
            if len(full):
                cells = np.bitwise_count(bits[part, None] & their_bits).sum(2, dtype=np.int64)
                value[full] += np.add.reduceat((cells * np.abs(rates[part, None] - their_rates)).sum(0), starts)
                shared[:, full] = np.add.reduceat(cells, starts, axis=1)
                met += cells.sum(0)
                both += shared.sum(0)
            value += ((sizes[part, None] - shared) * np.abs(rates[part, None] - base)).sum(0)  # terms of a that the other lacks
        if len(full):
            value[full] += np.add.reduceat((sizes[begin:] - met) * np.abs(their_rates - base[a]), starts)
        value += (size - present[a] - present + both) * np.abs(base[a] - base)
        out += [(lang, names[a], names[k], int(value[k])) for k in rest]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def source_divergence(docs: DataFrame, *, text="text", lang="lang", source="source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part 'pair': every other source of the
    language and the sum of differences of all kept terms' rates. Part 'term': the top
    terms that the source has oftener than its language, and by how much."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    counts = cut(rows.where("text != ''").mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs).select("lang", "term", "all"))
    terms, n_terms = gathered(kept)
    found = cut(counts.join(small_side(terms, n_terms, TERM_ROWS), ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    known = cut(rows.select("lang", "source").distinct())
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = cut(known.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("total").alias("total"), zero("kept").alias("kept"), zero("lang_total").alias("lang_total")))
    n_groups = groups.count()
    rated = found.join(small_side(groups, n_groups), ["lang", "source"]).withColumn("rate", _rate("n", "total", "kept"))
    return _terms(rated, top).unionByName(_ranked(_pair_values(terms, rated, groups, n_groups), "pair"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))


def _terms(rated: DataFrame, top: int) -> DataFrame:
    apart = F.col("rate") - _rate("all", "lang_total", "kept")
    over = rated.select("lang", "source", F.col("term").alias("item"), apart.alias("value")).where("value > 0")
    return _ranked(over, "term").where(F.col("rank") <= top)


def _pair_values(terms: DataFrame, rated: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value) of every two groups of a language, each way."""
    classed = terms.withColumn("class", F.floor(F.log2("all")))
    ways = classed.groupBy("lang", "class").agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("ways"))  # at most 64 classes a language
    dealt = classed.join(ways, ["lang", "class"]).withColumn("deal", F.pmod(F.xxhash64("term"), F.col("ways")))
    number = F.row_number().over(Window.partitionBy("lang", "class", "deal").orderBy("term")) - 1
    cell = ["lang", "class", "deal", "slice"]
    placed = cut(dealt.withColumn("number", number).select("lang", "term", "class", "deal", F.floor(F.col("number") / TERMS).alias("slice"), (F.col("number") % TERMS).alias("bit")))
    places, n_places = gathered(placed)
    word = lambda w: F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, cast(bit % 64 as int))")).otherwise(F.lit(0).cast("long")))
    levels = rated.join(small_side(places, n_places, TERM_ROWS), ["lang", "term"]).groupBy(*cell, "source", F.col("n").alias("count"), "rate").agg(*[word(k).alias(w) for k, w in enumerate(WORDS)])
    long = lambda v: F.lit(v).cast("long")
    blocks = places.groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
    blocks = blocks.unionByName(groups.select("lang").distinct().select("lang", *[long(-1).alias(c) for c in cell[1:]], long(0).alias("size")))  # so that every two groups have a sum
    rate = F.when(F.col("kept") > 0, _rate(F.lit(0), F.col("total"), F.greatest(F.col("kept"), F.lit(1))))
    zeros = blocks.join(small_side(groups, n_groups), "lang").select(*cell, "source", long(0).alias("count"), F.coalesce(rate, long(0)).alias("rate"), *[long(0).alias(w) for w in WORDS], "size")
    lines = levels.withColumn("size", long(0)).unionByName(zeros)
    total = lines.groupBy(*cell).applyInPandas(_pairs, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return total.unionByName(total.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT DISTINCT lang FROM docs),
sizes AS (SELECT lang, count(term) AS v FROM langs LEFT JOIN kept USING (lang) GROUP BY lang),
known AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM known JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
rates AS (
  SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + {ADDED})) // (sum(n) OVER (PARTITION BY lang, source) + {ADDED} * v)::HUGEINT AS p,
    1 + ({SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + {ADDED})::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + {ADDED} * v)::HUGEINT AS q
  FROM grid JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM known a JOIN known b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN rates x ON x.lang = a.lang AND x.source = a.source LEFT JOIN rates y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM rates WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, coalesce(value, 0)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY coalesce(value, 0) DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
