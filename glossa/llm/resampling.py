"""Importance resampling of documents towards a target's hashed n-gram distribution.

Runs of one to LONGEST words are hashed by crc32 into BUCKETS buckets. Both corpora
are counted once, per partition, into an array of BUCKETS numbers; a bucket's gain is
the log ratio of its smoothed shares in the target and in the documents. A document's
weight is the mean gain of its runs, looked up in the array of gains, and its score
the weight and a Gumbel variate from its id, so that the highest scores are a sample
without replacement in proportion to the weights.

The cutoff of the highest scores is found without ordering them all: a quantile sketch
gives a bracket around it, exact counts of the rows above and inside say whether it
holds the cutoff and widen it otherwise, and only the bracket is sorted.

Only arrays of BUCKETS numbers reach the driver. Drawn rows are numbered by range
partitions and their sizes, so neither a common score nor a common id gathers rows in
one task beyond its own equal rows.

Defined cases: a null or empty text has no words, weight 0 and isn't drawn; a very long
text is read whole, as one row; a null id is drawn as an empty one and comes after
the others; repeated rows are drawn each, rows equal in id, score and length in any
order, as they are the same; an empty table has no rows and an empty target gives each
bucket the gain of its rarity; other columns are ignored, but for those named in carry.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.texts import ARROW, chunks
from glossa.session import cut, shared_dir

BUCKETS, LONGEST, LEAST_WORDS, SHARE_PERCENT, SEED = 10_000, 2, 20, 25, "7"
ACCURACY = 1_000  # of the sketch: ranks are right to a thousandth of the rows
MEMORY = 200_000  # words remembered, some 40 MB a worker
LAST = 2**63 - 1
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class _Codes(dict):
    """crc32 of a word, and of the word and a space."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        code = zlib.crc32(word)
        pair = self[word] = (code, zlib.crc32(b" ", code))
        return pair


_codes = _Codes()


def buckets(text: str | None) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each of its runs of words."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0, np.zeros(0, np.int64)
    if len(_codes) > MEMORY:
        _codes.clear()
    codes, spaced = zip(*map(_codes.__getitem__, words), strict=True)
    runs = [np.array(codes, np.int64)]
    for size in range(2, LONGEST + 1):  # crc32 goes on from the run that is a word shorter
        codes = list(map(zlib.crc32, words[size - 1 :], spaced))
        runs.append(np.array(codes, np.int64))
        if size < LONGEST:
            spaced = map(zlib.crc32, repeat(b" "), codes)
    return len(words), np.concatenate(runs) % BUCKETS


def bucket_counts(texts: DataFrame, text: str = "text") -> list[int]:
    """Runs of words in each bucket, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(BUCKETS, np.int64)
        for rows in chunks(batches):
            for row in rows:
                met += np.bincount(buckets(row["text"])[1], minlength=BUCKETS)
        some = np.flatnonzero(met)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": met[some]})

    partial = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    out = [0] * BUCKETS
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def log_gains(source: list[int], target: list[int]) -> list[int]:
    """A bucket's log ratio of shares, each with one added, in thousandths."""
    s, t = sum(source), sum(target)
    return [math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(source, target, strict=True)]


def gumbel(doc_id: int | None) -> int:
    """A Gumbel variate in thousandths, the same for an id in every run."""
    number = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((number + 0.5) / 4294967296)))


def score(docs: DataFrame, gains: list[int], *, doc_id="doc_id", text="text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row, and carried columns."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    fields = [(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight", "score")] + [(c, ARROW[docs.select(c).dtypes[0][1].replace("bigint", "long")]) for c in carry]
    schema, table = pa.schema(fields), np.array(gains, np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            out = []
            for row in chunk:
                n, met = buckets(row["text"])
                weight = int(table[met].sum()) // len(met) if n else 0
                out.append((row["doc_id"], n, len(met), weight, weight + gumbel(row["doc_id"]), *(row[f"carried_{c}"] for c in carry)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kinds = {str(t): n for n, t in ARROW.items()}
    return rows.mapInArrow(work, ", ".join(f"`{f.name}` {kinds[str(f.type)]}" for f in schema))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their numbers from 1 in an order: ranges are numbered apart and take
    the sizes of those before."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("range", F.coalesce(before, F.lit(0)).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn(name, place.cast("long")).join(F.broadcast(offsets), "range").withColumn(name, F.col(name) + F.col("before")).drop("range", "before")


def bracket(rows: DataFrame, n: int, k: int, column: str) -> tuple[int, int, int]:
    """Two values of column that the k-th highest of n rows lies between, and how many
    rows are above. The sketch proposes them; exact counts accept or widen."""
    margin = 2 / ACCURACY
    while True:
        at = [max(0.0, 1 - k / n - margin), min(1.0, 1 - k / n + margin)]
        seen = rows.agg(F.percentile_approx(column, at, ACCURACY).alias("q"), F.min(column).alias("least"), F.max(column).alias("most")).first()
        low = seen["least"] if at[0] == 0 else seen["q"][0]
        high = seen["most"] if at[1] == 1 else seen["q"][1]
        met = rows.agg(F.count_if(F.col(column) > high).alias("above"), F.count_if(F.col(column).between(low, high)).alias("inside")).first()
        if met["above"] < k <= met["above"] + met["inside"]:
            return low, high, met["above"]
        margin *= 2


def draw(scored: DataFrame, *, share: int = SHARE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with the rank of each drawn row: the highest scores of share percent of the
    rows with least_words words, ties to the smaller id; null where a row isn't drawn."""
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count()
    k = share * n // 100
    unranked = scored.withColumn("rank", F.lit(None).cast("long"))
    if not k:
        return unranked
    keys = {"descent": -F.col("score"), "id": F.coalesce("doc_id", F.lit(LAST)), "n_features": F.col("n_features"), "n_words": F.col("n_words")}
    order = list(keys.values())
    low, high, above = bracket(scored.where(fit), n, k, "score")
    last = numbered(scored.where(fit & F.col("score").between(low, high)), order, "place").where(F.col("place") == k - above).select(*[c.alias(f"key_{name}") for name, c in keys.items()]).first()
    drawn = F.struct(*order) <= F.struct(*[F.lit(last[f"key_{name}"]).cast("long") for name in keys])
    ranked = numbered(scored.where(fit & drawn), order, "rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(unranked.where(~(fit & drawn)))


def resample(docs: DataFrame, target: DataFrame, *, doc_id="doc_id", text="text", share: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank and carried columns of every row
    of docs; those with a rank are the sample that resembles target."""
    gains = log_gains(bucket_counts(docs, text), bucket_counts(target))
    home = f"{shared_dir(docs.sparkSession)}/scores-{uuid.uuid4().hex}"
    score(docs, gains, doc_id=doc_id, text=text, carry=carry).write.parquet(home)
    return draw(docs.sparkSession.read.parquet(home), share=share, least_words=least_words)


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda j: ('0x' || h[2 * j + 1 : 2 * j + 2])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
ORACLE = rf"""
WITH remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, NULL, text, false FROM benchmark),
words AS (
  SELECT r, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
runs AS (
  SELECT r, own, unnest(w) AS f FROM words UNION ALL SELECT r, own, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
hashed AS (SELECT f, {_CRC} % {BUCKETS} AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM runs GROUP BY f), remainders),
met AS (SELECT r, own, bucket FROM runs JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM met GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS}) / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM counts),
weights AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM met JOIN gains USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT d.r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs d JOIN words USING (r) LEFT JOIN weights USING (r) WHERE d.own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= {LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {SHARE_PERCENT} * n // 100 THEN place END AS rank FROM ranked
"""
