"""Removal of byte strings that occur more than once, by longest-previous-factor arrays.

A window is WINDOW consecutive bytes of one document. Its anchor is the least hash
of the ANCHOR-byte strings inside it, so equal windows have one anchor, wherever
they stand. Consecutive starts with one anchor are a piece: its bytes hold all their
windows whole. Suffixes that begin in pieces of different anchors differ within a
window, so the suffix array of a corpus, as deep as a window, falls into one array an
anchor, and these are built apart in tasks.

Equal pieces (by 64 bits of hash under one anchor) are collapsed to one with a count
before anything is gathered; an anchor with one distinct piece needs no array. The others' pieces are put in suffix order; the
previous smaller and next smaller text positions around each suffix give the longest
match that begins earlier in the corpus (the longest previous factor) and, with
positions turned round, the longest that begins later. A window is a later copy if its
previous factor is a window long, and is repeated if either factor is.

An anchor whose distinct pieces have more than CROWD starts together (a phrase in
very many contexts) would be one large array: its windows are counted by the 128-bit
hash of their bytes instead, one row a window, dealt by that hash. This is the exact
way for such anchors and the same at every size of table.

Documents with equal texts (by 128 bits of hash) are one text with a count. Earlier
means a smaller id, then a smaller hash of the text, then an earlier place.

Defined cases: a null or empty text has no bytes; a text shorter than a window is kept
whole; a very long text is walked in slices that overlap by a window; rows that share
id and text are one document as to what comes first, and repeat each other where
nothing is to stay; null ids come last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shingles import U, mix
from glossa.llm.texts import chunks, to_batch
from glossa.session import cut, shared_dir, small_side

WINDOW, ANCHOR = 200, 64
MOST_STARTS = 200  # of a piece: a longer run of one anchor (periodic text) is several pieces
SLICE, PLACES = 1 << 20, U((1 << 21) - 1)  # starts of a long text that are hashed at once, and the bits of their places
CROWD = 300_000  # starts of an anchor's distinct pieces that one array takes, some 150 MB
BATCH_STARTS = 16_000  # small anchors share an array up to here
KEY_ROWS = 50_000  # of anchors: broadcast up to here
TEXT_ROWS = 1_000_000  # of (id, mark), 16 MB: broadcast up to here, so that other texts aren't shuffled
LAST = 2**63 - 1
_FACTORS = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
PIECE = pa.schema([(n, pa.int64()) for n in ("key", "d", "id", "mark")] + [(n, pa.int32()) for n in ("at", "run", "n", "inner")])
PIECE_DDL = "key long, d long, id long, mark long, at int, run int, n int, inner int"
BODY = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("at", pa.int32()), ("run", pa.int32()), ("body", pa.binary())])
BODY_DDL = "key long, d long, id long, mark long, at int, run int, body binary"
FLAGS = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("flags", pa.list_(pa.int32()))])
WINDOWS = pa.schema([(n, pa.int64()) for n in ("w1", "w2", "key", "d", "id", "mark")] + [("at", pa.int32()), ("k", pa.int32())])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of data, and the place where it first stands in it."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64) + U(1)
    reach = 1
    while reach < ANCHOR:  # hashes of strings of twice the length
        codes = codes[:-reach] * _FACTORS[reach] + codes[reach:]
        reach *= 2
    codes, span, reach = mix(codes), WINDOW - ANCHOR + 1, 1
    least = codes & ~PLACES | np.arange(len(codes), dtype=np.uint64)  # by the upper bits, then the first
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    place = (np.minimum(least[: len(least) - (span - reach)], least[span - reach :]) & PLACES).astype(np.int64)
    return codes[place], place


def pieces_of(keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of a run of anchors begin and end, and whether one has its anchor
    more than once, so that its own windows can be equal."""
    start = np.arange(len(keys))
    begun = np.maximum.accumulate(np.where(np.concatenate(([True], keys[1:] != keys[:-1])), start, 0))
    starts = np.flatnonzero((start - begun) % MOST_STARTS == 0)
    ends = np.append(starts[1:], len(keys))
    return starts, ends, place[starts] != place[ends - 1]


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, n, text) to their pieces."""
    held: list[tuple] = []
    digest = xxhash.xxh3_64_intdigest

    def batch() -> pa.RecordBatch:
        keys, digests, owners, places, runs, inner = zip(*held, strict=True)
        lengths = [len(k) for k in keys]
        id_, mark, n = (np.repeat(np.array(c, np.int64), lengths) for c in zip(*owners, strict=True))
        columns = [np.concatenate(keys).view(np.int64), np.concatenate(digests).view(np.int64), id_, mark, np.concatenate(places), np.concatenate(runs), n, np.concatenate(inner)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)

    for rows in chunks(batches):
        for row in rows:
            data = (row["text"] or "").encode("utf-8", "surrogatepass")
            for low in range(0, len(data) - WINDOW + 1, SLICE):
                part = data[low : low + SLICE + WINDOW - 1]
                keys, place = anchors(part)
                starts, ends, inner = pieces_of(keys, place)
                digests = [digest(part[a : b + WINDOW - 1]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                held.append((keys[starts], np.array(digests, np.uint64), (row["id"], row["mark"], row["n"]), starts + low, ends - starts, inner))
                if low:
                    yield batch()
                    held.clear()
        if held:
            yield batch()
            held.clear()


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, text, wanted) to the bytes of the wanted pieces."""
    for rows in chunks(batches):
        for row in rows:
            data = row["text"].encode("utf-8", "surrogatepass")
            for low in range(0, len(row["wanted"]), 10_000):
                some = row["wanted"][low : low + 10_000]
                lines = [(p["key"], p["d"], row["id"], row["mark"], p["at"], p["run"], data[p["at"] : p["at"] + p["run"] + WINDOW - 1]) for p in some]
                yield to_batch(lines, BODY)


def longest_previous(position: list[int], common: list[int]) -> list[int]:
    """For each suffix, in suffix order, the longest prefix that it shares with one at a
    smaller position; common[r] is what suffix r shares with the one before it. The
    stack holds suffixes whose next smaller position isn't met yet, so the one below on
    the stack is the previous smaller and the one that pops is the next smaller."""
    found, stack = [0] * len(position), []
    for r in range(len(position) + 1):
        here, shared = (position[r], common[r]) if r < len(position) else (-1, 0)
        while stack and position[stack[-1][0]] > here:
            top, before = stack.pop()
            found[top] = max(before, shared)
            shared = min(before, shared)
        stack.append((r, shared))
    return found


def factors(bodies: list[bytes], runs: list[int], text_order: list[int], keep_first: bool) -> list[np.ndarray]:
    """For each piece, which of its starts have a previous factor (or, unless the first
    is to stay, any factor) of a window's length. text_order ranks the pieces."""
    base = np.zeros(len(runs), np.int64)
    base[text_order] = np.concatenate(([0], np.cumsum(np.array(runs)[text_order])[:-1]))
    windows, position = [], []
    for body, run, first in zip(bodies, runs, base.tolist(), strict=True):
        windows += [body[k : k + WINDOW] for k in range(run)]
        position += range(first, first + run)
    order = sorted(range(len(windows)), key=windows.__getitem__)
    table = np.frombuffer(b"".join([windows[k] for k in order]), np.uint8).reshape(-1, WINDOW)
    apart = table[1:] != table[:-1]
    common = np.where(apart.any(1), apart.argmax(1), WINDOW)
    common = [0, *common.tolist()]
    placed = [position[k] for k in order]
    longest = longest_previous(placed, common)
    if not keep_first:
        longest = np.maximum(longest, longest_previous([len(placed) - p for p in placed], common))
    flags = np.zeros(len(windows), bool)
    flags[order] = np.asarray(longest) >= WINDOW
    return np.split(flags, np.cumsum(runs)[:-1])


def spans_of(flags: np.ndarray) -> list[int]:
    """Flagged starts as begin and end of each run, one after another."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()


def _arrays(keep_first: bool):
    """Pieces sorted by anchor to their flagged starts."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        ranked = sorted(range(len(rows)), key=lambda k: (rows[k]["id"], rows[k]["mark"], rows[k]["at"]))
        flags = factors([r["body"] for r in rows], [r["run"] for r in rows], ranked, keep_first)
        return to_batch([(r["key"], r["d"], spans_of(f)) for r, f in zip(rows, flags, strict=True) if f.any()], FLAGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["key"] != held[-1]["key"] and starts >= BATCH_STARTS:
                    yield solve(held)
                    held, starts = [], 0
                held.append(row)
                starts += row["run"]
        if held:
            yield solve(held)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of crowded anchors, one row a window: its hash and where it is."""
    for batch in batches:
        for row in batch.to_pylist():
            size, same = row["run"], [row[c] for c in ("key", "d", "id", "mark", "at")]
            w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(row["body"][k : k + WINDOW]) for k in range(size)]), np.int64).reshape(-1, 2)
            columns = [w[:, 0], w[:, 1], *(np.full(size, v) for v in same), np.arange(size)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, WINDOWS, strict=True)], schema=WINDOWS)


def _crowded(bodies: DataFrame, keep_first: bool) -> DataFrame:
    """Flagged starts of crowded anchors' pieces, by counting windows."""
    windows = bodies.mapInArrow(_windows, "w1 long, w2 long, key long, d long, id long, mark long, at int, k int")
    place = F.struct("id", "mark", "at", "k")
    counted = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("met"), F.min(place).alias("least")).where("met > 1")
    again = windows.join(counted, ["w1", "w2"])
    if keep_first:
        again = again.where(place != F.col("least"))
    starts = F.sort_array(F.collect_set("k"))
    return again.groupBy("key", "d").agg(F.flatten(F.transform(starts, lambda k: F.array(k, k + 1))).alias("flags"))


def _texts(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """id, text, mark (its hash) and a second hash of every row, and (mark, second,
    first) of texts that several rows have."""
    rows = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST)).alias("id"), F.col(text).alias("text")).withColumns({"mark": F.xxhash64("text"), "second": F.xxhash64(F.lit("second"), "text")})
    long_ones = rows.where(F.octet_length("text") >= WINDOW)
    return rows, cut(long_ones.groupBy("mark", "second").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first")).where("rows > 1"))


def _side(df: DataFrame, limit: int = KEY_ROWS) -> DataFrame:
    return small_side(df, df.count(), limit)


def _of_texts(rows: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, mark, text, ...) that lists has a line of, with it, and the others with a
    null one. Where the lines are few, the others aren't shuffled."""
    column, keys = lists.columns[-1], ["id", "mark"]
    if lists.count() > TEXT_ROWS:
        both = rows.join(lists, keys, "left")
        return both.where(F.col(column).isNotNull()), both.where(F.col(column).isNull())
    side = F.broadcast(lists.select(*keys))
    return rows.join(side, keys, "left_semi").join(lists, keys), rows.join(side, keys, "left_anti").withColumn(column, F.lit(None).cast(lists.schema[column].dataType))


def repeated_spans(docs: DataFrame, *, doc_id="doc_id", text="text", keep_first: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their texts' hashes, texts of several rows, and (id, mark, spans) of
    texts: starts that are later copies (or repeated), as [begin, end) of windows."""
    rows, copies = _texts(docs, doc_id, text)
    spark, home = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/pieces-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        """df as a table, so that later steps neither compute it nor its shuffles again."""
        df.write.parquet(f"{home}/{name}")
        return spark.read.parquet(f"{home}/{name}")

    walked = rows.join(_side(copies), ["mark", "second"], "left").where("first is null or id = first")
    weight = F.lit(1) if keep_first else F.when(F.col("first").isNull(), 1).otherwise(2)  # a copy goes whole, and only the first is walked
    pieces = kept(walked.select("id", "mark", weight.alias("n"), "text").mapInArrow(_cut_up, PIECE_DDL), "pieces")
    met = kept(pieces.groupBy("key").agg(F.sum(F.col("n") + F.col("inner")).alias("met")).where("met > 1").select("key"), "met")
    shared = kept(pieces.join(_side(met), "key"), "shared")
    several = shared.groupBy("key").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.max("inner").alias("inner")).where((F.col("low") != F.col("high")) | (F.col("inner") > 0) | F.lit(keep_first))
    several = _side(cut(several.select("key")))
    every = F.array(F.lit(0), F.col("run"))
    one = shared.join(several, "key", "left_anti").select("id", "mark", "at", every.alias("flags"))
    mixed = kept(shared.join(several, "key", "left_semi"), "mixed")
    first = F.min(F.struct("id", "mark", "at")).alias("first")
    distinct = kept(mixed.groupBy("key", "d").agg(F.sum("n").alias("met"), first, F.first("run").alias("run")), "distinct")
    wanted = distinct.groupBy("first.id", "first.mark").agg(F.collect_list(F.struct("key", "d", "first.at", "run")).alias("wanted"))
    bodies = _of_texts(walked.select("id", "mark", "text"), kept(wanted, "wanted"))[0].mapInArrow(_bodies, BODY_DDL).dropDuplicates(["key", "d"])
    crowds = cut(distinct.groupBy("key").agg(F.sum("run").alias("starts")).where(F.col("starts") > CROWD).select("key"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bodies = kept(bodies, "bodies")
    few = bodies.join(_side(crowds), "key", "left_anti").repartition(tasks, "key").sortWithinPartitions("key")
    arrays = few.mapInArrow(_arrays(keep_first), "key long, d long, flags array<int>")
    flags = kept(arrays.unionByName(_crowded(bodies.join(_side(crowds), "key", "left_semi"), keep_first)), "flags")
    marked = distinct.join(flags, ["key", "d"], "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<int>")))
    if keep_first:
        hits = mixed.join(marked.select("key", "d", "first", "flags"), ["key", "d"])
        hits = hits.withColumn("flags", F.when(F.col("first") == F.struct("id", "mark", "at"), F.col("flags")).otherwise(every))
    else:
        hits = mixed.join(marked.select("key", "d", F.when(F.col("met") > 1, every).otherwise(F.col("flags")).alias("flags")), ["key", "d"])
    placed = one.unionByName(hits.where("size(flags) > 0").select("id", "mark", "at", "flags"))
    return rows, copies, kept(placed.groupBy("id", "mark").agg(F.collect_list(F.struct("at", "flags")).alias("spans")), "spans")


def _left(keep_bytes: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + ([("kept", pa.binary()), ("removed", pa.list_(pa.int64()))] if keep_bytes else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            out = []
            for row in rows:
                data = (row["text"] or "").encode("utf-8", "surrogatepass")
                gone = [(0, len(data))] if row["whole"] else []
                ranges = sorted((s["at"] + a, s["at"] + b + WINDOW - 1) for s in row["spans"] or () for a, b in zip(s["flags"][::2], s["flags"][1::2], strict=True))
                for low, high in ranges if not row["whole"] else ():
                    if gone and low <= gone[-1][1]:
                        gone[-1] = (gone[-1][0], max(high, gone[-1][1]))
                    else:
                        gone.append((low, high))
                edges = [0, *[e for span in gone for e in span], len(data)]
                kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                line = (None if row["id"] == LAST else row["id"], len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                out.append((*line, kept, edges[1:-1]) if keep_bytes else line)
            yield to_batch(out, schema)

    return run


def remove_copies(docs: DataFrame, *, doc_id="doc_id", text="text", keep_first: bool = True, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: later copies of
    windows go and the first stays, or without keep_first all go. With keep_bytes also
    kept (the bytes that are left, which need be no whole characters) and removed (begin
    and end of each span, one after another)."""
    rows, copies, spans = repeated_spans(docs, doc_id=doc_id, text=text, keep_first=keep_first)
    gone = F.col("first").isNotNull() & ((F.col("id") != F.col("first")) | F.lit(not keep_first))
    placed = rows.join(_side(copies.select("mark", "second", "first")), ["mark", "second"], "left").select("id", "mark", "text", gone.alias("whole"))
    some, none = _of_texts(placed.where("not whole"), spans)
    every = placed.where("whole").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    columns = ["id", "text", "whole", "spans"]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<long>" * keep_bytes
    return some.select(columns).unionByName(none.select(columns)).unionByName(every.select(columns)).mapInArrow(_left(keep_bytes), ddl)


#: Windows as hexadecimal digits, two a byte; all that repeat go.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, n, c, h[2 * c + 1 : 2 * c + 2000 + {2 * WINDOW}] AS h FROM (SELECT *, unnest(range(0, n, 1000)) AS c FROM docs)),
bytes AS (SELECT r, n, c + j AS i, h[2 * j + 1 : 2 * j + 2] AS b, h[2 * j + 1 : 2 * j + {2 * WINDOW}] AS w FROM (SELECT *, unnest(range(least(1000, n - c))) AS j FROM parts)),
windows AS (SELECT r, i, b, CASE WHEN i + {WINDOW} <= n THEN md5_number(w) END AS k FROM bytes),
again AS (SELECT k FROM windows WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
covered AS (
  SELECT r, i, b, max((again.k IS NOT NULL)::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN again ON windows.k = again.k),
edges AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 AS opens FROM covered),
left_over AS (
  SELECT r, sum(gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM edges GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN left_over USING (r)
"""
