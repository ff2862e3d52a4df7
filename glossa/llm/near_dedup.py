"""Near-duplicate classes by HyperMinHash registers, banding and exact checks.

One hash deals a document's word shingles into REGISTERS parts by its top bits;
a part's register is the least of the other bits there, kept as its leading-zero
count and ten mantissa bits. Shingles are dealt again, by the same hash mixed
anew, into parts that are still empty, so that registers of short texts agree as
often as those of long ones: each is a minimum over the whole set. What ROUNDS
rounds leave empty, in sets of a few dozen shingles, counts for neither side.
Bands of ROWS registers put documents into buckets; a pair from one bucket is
checked by the Jaccard estimate of its registers, corrected for the collisions
that short registers have by chance, and then on the full sets.

Documents with equal sets are one class from the start, so copies never meet
in a bucket. Within a bucket one front is compared with the others first: the
member that meets most others. A bucket of many near copies collapses there
without its pairs being listed. Components that still meet in a bucket are then
compared whole, member by member, as hosts and visitors in cells of bounded
size, so no link that a bucket shows is lost. At a similarity of 0.8 two
documents share no bucket with probability 3e-7, at 0.5 they share one with 0.4.

Buckets are counted with partial sums and joined by key, so a hot bucket is
never gathered in one task.

Defined cases: a null or empty text has no shingles, links with nothing and is
kept; a text shorter than a shingle is one shingle; a very long text is one row
of a cell like any other; repeated rows of an id are one document and share its
component; a row with a null id is a document by its text (62 bits of its hash),
never the least of a component that has an id, and its own component_id is null
where there is none; other columns are ignored. Ids are below 2^62.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.components import components
from glossa.llm.shingles import U, mix, shingle_set
from glossa.llm.texts import gathered, map_chunks, to_batch
from glossa.session import cut, small_side

BANDS, ROWS, MANTISSA = 64, 7, 10
REGISTERS = BANDS * ROWS
ROUNDS, SETS = 64, 1024  # deals of a set's shingles, and sets that are dealt together
NOTHING = 2**16 - 1  # the register of an empty part
BLOCK, BLOCK_SHINGLES = 1024, 400_000  # members, or visitors, of a cell and their shingles
SMALL = 128  # components under SMALL documents share a host
SIMILAR_PERCENT, SLACK = 80, 0.15  # the estimate's standard error is 0.02 to 0.03
UNNAMED = 2**62  # rows without an id go by this bit and a hash of their text
ID_ROWS = 2_000_000  # ids, 32 MB, or roots with two numbers: broadcast up to here
_GOLDEN = 0x9E3779B97F4A7C15
_BAND = np.random.default_rng(9).integers(1, 2**63, (ROWS, BANDS), dtype=np.uint64) * U(2) + U(1)


def _least(sets: list[np.ndarray]) -> np.ndarray:
    """The least remainder of each part of each set; the largest number where it is empty."""
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    none = U(2**64 - 1)
    least = np.full(len(sets) * REGISTERS, none)
    for k in range(ROUNDS):
        hashed = mix(items + U(k * _GOLDEN % 2**64)) if k else items
        part = owner * REGISTERS + ((hashed >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
        empty = least[part] == none
        np.minimum.at(least, part[empty], hashed[empty] * U(REGISTERS))  # the product's low bits are what the part leaves over
        if k % 4 == 0:
            left = (least.reshape(-1, REGISTERS) == none).any(1)[owner]
            items, owner = items[left], owner[left]
            if not len(items):
                break
    return least.reshape(-1, REGISTERS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of nonempty sets, a row each."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for start in range(0, len(sets), SETS):
        least = _least(sets[start : start + SETS])
        fraction, bits = np.frexp(least.astype(np.float64))
        zeros = np.clip(64 - bits, 0, 62).astype(np.uint16)
        short = np.clip((fraction - 0.5) * 2 ** (MANTISSA + 1), 0, 2**MANTISSA - 1).astype(np.uint16)
        out[start : start + SETS] = np.where(least == U(2**64 - 1), np.uint16(NOTHING), (zeros << np.uint16(MANTISSA)) | short)
    return out


def band_keys(rows: np.ndarray) -> list[np.ndarray]:
    """For each row of registers the keys of its bands, but for bands of empty parts alone."""
    parts = rows.reshape(len(rows), BANDS, ROWS)
    key = sum(mix(parts[:, :, j].astype(np.uint64) + U(1)) * _BAND[j] for j in range(ROWS))
    keys = mix(key + np.arange(BANDS, dtype=np.uint64) * U(_GOLDEN)).view(np.int64)
    return [line[full] for line, full in zip(keys, (parts != NOTHING).any(2), strict=True)]


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of unrelated sets of n and m shingles agree."""
    zeros = 2.0 ** -np.arange(0, 63)

    def share(size: np.ndarray) -> np.ndarray:
        dealt = size.astype(float)[:, None] / REGISTERS  # in a part, on the average; registers have one or more
        return (np.exp(-dealt * zeros / 2) - np.exp(-dealt * zeros)) / -np.expm1(-dealt)

    return (share(n) * share(m)).sum(1) / 2**MANTISSA


def likeness(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of rows of registers of sets of n and m shingles."""
    filled = (a != NOTHING) | (b != NOTHING)
    agree = ((a == b) & filled).sum(1) / filled.sum(1)
    by_chance = chance(n, m)
    return (agree - by_chance) / (1 - by_chance)


def estimate(left: pd.Series, right: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Likeness of pairs of packed registers."""
    if not len(left):
        return pd.Series([], dtype=float)
    a, b = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (left, right))
    return pd.Series(likeness(a, b, n.to_numpy(), m.to_numpy()))


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """id, n, digest and registers of every row; digest and registers are null for empty sets."""

    def work(chunk: list[dict]) -> list[tuple]:
        sets = [shingle_set(row["text"], size) for row in chunk]
        full = [s for s in sets if len(s)]
        lines = iter(registers(full) if full else ())
        return [(row["id"], len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, next(lines).tobytes() if len(s) else None) for row, s in zip(chunk, sets, strict=True)]

    return map_chunks(docs, work, "id long, n long, digest binary, registers binary")


def _banded(classes: DataFrame) -> DataFrame:
    def keys(lines: pd.Series) -> pd.Series:
        return pd.Series(band_keys(np.frombuffer(b"".join(lines), np.uint16).reshape(-1, REGISTERS)) if len(lines) else [])

    return classes.select("id", "n", F.explode(F.pandas_udf(keys, "array<long>")("registers")).alias("key"))


def _compare(size: int):
    """Links within cells: rows sorted by cell, a host's members (side 0) against
    visitors (side 1) of other components. The registers' estimate chooses the pairs whose
    full sets are compared."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        members, visitors = ([r for r in rows if r["side"] == k] for k in (0, 1))
        if not members or not visitors:
            return []
        sets = functools.cache(lambda text: shingle_set(text, size))
        m, v = (np.frombuffer(b"".join(r["registers"] for r in side), np.uint16).reshape(-1, REGISTERS) for side in (members, visitors))
        sizes = np.array([r["n"] for r in members], float)
        out = []
        for line, visitor in zip(v, visitors, strict=True):
            alike = likeness(m, line[None, :], sizes, np.array([visitor["n"]]))
            near = np.minimum(sizes, visitor["n"]) * 100 >= np.maximum(sizes, visitor["n"]) * SIMILAR_PERCENT
            joined = {visitor["root"]}
            for k in np.flatnonzero((alike >= SIMILAR_PERCENT / 100 - SLACK) & near):
                if members[k]["root"] in joined:  # one link joins the visitor to a component
                    continue
                p, q = sets(members[k]["text"]), sets(visitor["text"])
                both = np.intersect1d(p, q, assume_unique=True).size
                if 100 * both >= SIMILAR_PERCENT * (p.size + q.size - both):
                    out.append((members[k]["id"], visitor["id"]))
                    joined.add(members[k]["root"])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    found += links(held)
                    held, cell = [], row["cell"]
                held.append(row)
            yield to_batch(found, schema)
        yield to_batch(links(held), schema)

    return run


def _meet(members: DataFrame, visits: DataFrame, docs: DataFrame, registers_of: DataFrame, size: int) -> DataFrame:
    """Links of members (host, id, root, n) with visits (likewise), both distinct. A
    host's members and its visitors are dealt into cells of about BLOCK rows, or
    BLOCK_SHINGLES where they are long, each way, so texts travel once a cell, not a
    pair."""
    ways = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    plan, hosts = gathered(cut(visits.groupBy("host").agg(ways.alias("nb")).join(members.groupBy("host").agg(ways.alias("na")), "host")))
    plan = small_side(plan, hosts)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    inside = members.join(plan, "host").select("host", "id", "root", F.lit(0).alias("side"), place("na").alias("x"), F.explode(every("nb")).alias("y"))
    outside = visits.join(plan, "host").select("host", "id", "root", F.lit(1).alias("side"), F.explode(every("na")).alias("x"), place("nb").alias("y"))
    seats, _ = gathered(cut(inside.unionByName(outside).select("id", "root", "side", F.concat_ws("-", "host", "x", "y").alias("cell"))))
    ids = seats.select("id").distinct()
    few = small_side(ids, ids.count(), ID_ROWS)
    texts = docs.join(few, "id").join(registers_of.join(few, "id", "left_semi"), "id")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = seats.join(texts, "id").select("cell", "side", "id", "root", "n", "registers", "text").repartition(tasks, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_compare(size), "a long, b long").distinct()


def _fronts(open_: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each bucket's member that meets most others, with those of the bucket that it may
    be near by size and by the registers' estimate. The original of many copies
    shares more buckets than any copy, so a bucket of them collapses here."""
    met_most = open_.groupBy("id").agg(F.sum("g").alias("met"))
    fronts = open_.join(met_most, "id").groupBy("key").agg(F.max(F.struct("met", "id", "n", "root")).alias("f")).select("key", F.col("f.id").alias("front"), F.col("f.n").alias("front_n"), F.col("f.root").alias("front_root"))
    sized = (F.least("n", "front_n") * 100 >= F.greatest("n", "front_n") * SIMILAR_PERCENT) & (F.col("front_root") != F.col("root"))
    met = open_.join(fronts, "key").where(sized).groupBy("front", "id").agg(F.min("root").alias("root"), F.min("front_root").alias("front_root"))
    own, other = (known.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")) for c in ("id", "front"))
    rated = met.join(own, "id").join(other, "front")
    likely, _ = gathered(cut(rated.where(F.pandas_udf(estimate, "double")("r_front", "r_id", "n_front", "n_id") >= SIMILAR_PERCENT / 100 - SLACK).select("front", "front_root", "n_front", "id", "root", "n_id")))
    host = F.col("front").cast("string").alias("host")
    return likely.groupBy(host, F.col("front").alias("id"), F.col("front_root").alias("root")).agg(F.max("n_front").alias("n")), likely.groupBy(host, "id", "root").agg(F.max("n_id").alias("n"))


def _hosts(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts, and who visits them, so that all components that share a bucket meet.

    A large component is a host of its own; small ones that share their largest
    bucket are a host together, and all of them visit it. From other hosts those
    who share a bucket visit the higher one. As all order buckets alike by size, a
    large bucket has few hosts.
    """
    crowd = F.shiftleft(F.least("g", F.lit(2**22)), 40).bitwiseOR(F.col("key").bitwiseAND(F.lit(2**40 - 1)))  # by size, then by name
    sizes, roots = gathered(cut(open_.groupBy("root").agg(F.countDistinct("id").alias("weight"), F.max(crowd).alias("top"))))
    small = F.col("weight") < SMALL
    own = F.when(small, F.concat(F.lit("k"), F.col("top"))).otherwise(F.concat(F.lit("r"), F.col("root")))
    placed, _ = gathered(cut(open_.join(small_side(sizes, roots, ID_ROWS), "root").select("key", "id", "n", "root", F.struct("weight", "root").alias("rank"), own.alias("own"), small.alias("small"))))
    seat = ["host", "id", "root", "n"]
    members, _ = gathered(cut(placed.groupBy(F.col("own").alias("host"), "id", "root", "small").agg(F.max("n").alias("n"))))
    inside = members.where("small").select(*seat)
    hosts = placed.groupBy("key", "own").agg(F.max("rank").alias("host_rank")).withColumnRenamed("own", "host")
    outside = placed.join(hosts, "key").where("own != host and rank < host_rank").groupBy("host", "id", "root").agg(F.max("n").alias("n"))
    return members.select(*seat), inside.unionByName(outside.select(*seat))


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach), kept."""
    unnamed = F.lit(UNNAMED).bitwiseOR(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(UNNAMED - 1)))
    docs = docs.select(F.coalesce(F.col(doc_id), unnamed).alias("id"), F.col(text).alias("text"))
    sketches = cut(_sketch(docs, size))
    # A class goes by its least id. An id with several texts has several classes, and all its texts are compared.
    classes = cut(sketches.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "registers")).alias("c")).select("digest", "c.*"))
    banded = _banded(classes.select("id", "n", "registers"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    buckets = cut(banded.join(sizes, "key").select("key", "id", "n", "g"))
    roots = sketches.where("digest is not null").join(classes.select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b").where("a != b")
    roots = components(roots)
    met, ids = gathered(cut(buckets.select("id").distinct()))
    known = classes.select("id", "n", "registers").join(small_side(met, ids, ID_ROWS), "id", "left_semi")  # others' registers don't travel
    for among in (lambda rows: _fronts(rows, known), _hosts):
        placed = buckets.join(roots.select(F.col("a").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        open_, rows = gathered(cut(placed.join(mixed, "key")))
        if not rows:
            break
        links = cut(_meet(*among(open_), docs, known, size))
        roots = components(roots.select("a", F.col("root").alias("b")).unionByName(links))
        buckets = open_.select("key", "id", "n", "g")
    found = sketches.select("id", F.col("n").alias("n_shingles")).join(roots.select(F.col("a").alias("id"), "root"), "id", "left")
    component = F.coalesce("root", "id")
    named = lambda c: F.when(c < UNNAMED, c)
    return found.select(named(F.col("id")).alias("doc_id"), "n_shingles", named(component).alias("component_id"), (component == F.col("id")).alias("kept"))


#: For two-word shingles and one row an id.
ORACLE = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM docs),
followed AS (SELECT doc_id, n, word, lead(word) OVER (PARTITION BY doc_id ORDER BY place) AS following FROM words),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN word ELSE word || ' ' || following END AS shingle FROM followed WHERE n = 1 OR following IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * shared.n >= {SIMILAR_PERCENT} * (p.n + q.n - shared.n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION SELECT reach.a, other.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) other ON reach.b = other.a),
least_ids AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN least_ids USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
