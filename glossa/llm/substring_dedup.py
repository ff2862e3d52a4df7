"""Removal of word passages that occur more than once in a corpus.

A window is WINDOW consecutive words of one document. Two passes find the
repeated ones. The first builds a count-min sketch in every partition and
merges them: a window is counted under its anchor, the ANCHOR-word piece inside
it with the least hash, once for each place where the anchor stands. Equal
windows have equal anchors at equal offsets, so the anchor's count is never
below the window's, the sketch overestimates as count-min sketches do, and it
holds a twelfth of the items. Only the cells that reach two matter after the
merge: one bit each, MOST_CELLS * ROWS / 8 bytes at most (64 MB), which is what
is broadcast. The second pass walks the texts once more, writes down the windows
that the sketch takes for repeated, and groups them by the 128-bit xxh3 of their
words. Beyond the sketch's capacity more windows pass it and the second pass
does more; none is lost.

Documents with equal texts (by 128 bits of hash) are collapsed first: all their
windows are repeated, one of them stands for the rest, and none of them needs an
answer.

Window counts combine before their shuffle; the way back to the documents is an
equi-join on the window key of the written windows with the written repeated
keys, one row a key, which Spark may split where a passage is hot.

Defined cases: a null or empty text has no words; a text shorter than a window
is kept whole, and a very long one is walked whole in one task; a row is known by
its id and 64 bits of its text's hash, so rows that share an id, or have none,
are each judged by their own text; repeated rows repeat each other's windows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shingles import U, mix, window_codes, word_codes
from glossa.llm.texts import chunks, map_chunks, to_batch
from glossa.session import cut, shared_dir, small_side

WINDOW, ANCHOR = 35, 12
ROWS, BLOCK, MOST_CELLS, LEAST_CELLS = 2, 1 << 16, 1 << 28, 1 << 18
CHARS_PER_CELL = 16  # about an anchor in 75 characters: cells are five times the anchors
ID_ROWS = 1_000_000  # of (id, mark): broadcast up to here
LAST = 2**63 - 1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its anchor, and the hashes of all pieces."""
    pieces = window_codes(codes, ANCHOR)
    span = WINDOW - ANCHOR + 1
    at = np.lib.stride_tricks.sliding_window_view(pieces, span).argmin(axis=1)
    return at + np.arange(len(at)), pieces


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(hashes + U((row + 1) * 0x9E3779B97F4A7C15 % 2**64)) & U(width - 1)).astype(np.int64)


def _sketches(width: int):
    """Each partition's sketch, block by block: the cells it has touched and whether twice."""
    schema = pa.schema([("line", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        for rows in chunks(batches):
            for row in rows:
                words = _words(row["text"])
                if len(words) >= WINDOW:
                    at, pieces = anchors(word_codes(words))
                    gathered.append(np.repeat(pieces[np.unique(at)], 2 if row["role"] else 1))
            if sum(map(len, gathered)) > 4_000_000:
                yield from emit(gathered)
                gathered = []
        yield from emit(gathered)

    def emit(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not gathered:
            return
        items = np.concatenate(gathered)
        for line in range(ROWS):
            touched, counts = np.unique(cells(items, line, width), return_counts=True)
            packed = ((touched % BLOCK) << 1 | (counts > 1)).astype(np.uint32)
            blocks, starts = np.unique(touched // BLOCK, return_index=True)
            yield to_batch([(line, int(b), part.tobytes()) for b, part in zip(blocks, np.split(packed, starts[1:]), strict=True)], schema)

    return run


def _merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """The block's cells that reach two over all partitions, one bit each."""
    counts = np.zeros(BLOCK, np.uint8)
    for part in parts["cells"]:
        packed = np.frombuffer(part, np.uint32)
        at = packed >> 1
        counts[at] = np.minimum(counts[at] + 1 + (packed & 1).astype(np.uint8), 2)
    return pd.DataFrame({"line": [key[0]], "block": [key[1]], "bits": [np.packbits(counts > 1, bitorder="little").tobytes()]})


def repeated_cells(docs: DataFrame, width: int) -> np.ndarray:
    """ROWS bit lines of the merged sketch: width * ROWS / 8 bytes, 64 MB at most."""
    parts = docs.mapInArrow(_sketches(width), "line int, block int, cells binary")
    merged = parts.groupBy("line", "block").applyInPandas(_merge, "line int, block int, bits binary")
    lines = np.zeros((ROWS, width // BLOCK, BLOCK // 8), np.uint8)
    for row in merged.collect():
        lines[row["line"], row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return lines.reshape(ROWS, -1)


def _candidates(docs: DataFrame, bits) -> DataFrame:
    """Windows that the sketch takes for repeated: key, number of the row, place and
    weight; a document that stands for its copies has weight 2 and no place. A row
    that has any gives its id and mark as well, once, without a key."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("weight", pa.int32()), ("id", pa.int64()), ("mark", pa.int64())])
    digest = xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = bits.value
        width = lines.shape[1] * 8
        for rows in chunks(batches):
            parts, heads = [], []
            for row in rows:
                words = _words(row["text"])
                if len(words) < WINDOW or row["role"] == "copy":
                    continue
                codes = word_codes(words)
                at, pieces = anchors(codes)
                places = np.unique(at)
                often = np.ones(len(places), bool)
                for line in range(ROWS):
                    cell = cells(pieces[places], line, width)
                    often &= (lines[line][cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                hit = np.flatnonzero(often[np.searchsorted(places, at)])
                if len(hit):
                    joined = b" ".join(words)
                    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
                    spans = zip(starts[hit].tolist(), (starts[hit + WINDOW] - 1).tolist(), strict=True)
                    keys = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in spans]), np.int64).reshape(-1, 2)
                    alone = row["role"] is None
                    parts.append((keys[:, 0], keys[:, 1], np.full(len(hit), row["row"]), hit.astype(np.int32) if alone else np.full(len(hit), -1, np.int32), np.full(len(hit), 1 if alone else 2, np.int32)))
                    if alone:
                        heads.append((None, None, row["row"], None, None, row["id"], row["mark"]))
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                columns += [pa.nulls(len(columns[0]), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            if heads:
                yield to_batch(heads, schema)

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, "k1 long, k2 long, row long, at int, weight int, id long, mark long")


def _with_roles(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """id, text and mark (its hash) of every row, and (id, mark, role) of equal texts:
    'first' on one of them, or on all of that id, and 'copy' on the others."""
    rows = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST)).alias("id"), F.col(text).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    rows = rows.withColumn("mark", F.xxhash64("text"))
    hashed = rows.where("text is not null").select("id", "mark", F.xxhash64(F.lit("second"), "text").alias("h2"))
    same = hashed.groupBy("mark", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    roles = cut(hashed.join(same, ["mark", "h2"]).groupBy("id", "mark").agg(F.max(F.when(F.col("id") == F.col("first"), "first").otherwise("copy")).alias("role")))
    return rows, roles


def remove_repeats(docs: DataFrame, *, doc_id="doc_id", text="text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with keep_text the text that is
    left: the words kept, joined by spaces, or the text as it was if all are.
    carry names string columns that come along."""
    rows, roles = _with_roles(docs, doc_id, text, carry)
    placed = rows.join(small_side(roles, roles.count(), ID_ROWS), ["id", "mark"], "left")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    width = min(MOST_CELLS, max(LEAST_CELLS, 1 << (chars // CHARS_PER_CELL).bit_length()))
    bits = docs.sparkSession.sparkContext.broadcast(repeated_cells(placed.where("role is null or role = 'first'").select("text", "role"), width))
    spark, home = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/windows-{uuid.uuid4().hex}"
    _candidates(placed.select("id", "text", "mark", "role"), bits).write.parquet(f"{home}/found")
    found = spark.read.parquet(f"{home}/found")
    # Written tables take less of the disk than checkpoints, which aren't compressed.
    found.where("k1 is not null").groupBy("k1", "k2").agg(F.sum("weight").alias("n")).where("n > 1").select("k1", "k2").write.parquet(f"{home}/repeated")
    repeated = spark.read.parquet(f"{home}/repeated")
    hits = found.where("at >= 0").join(small_side(repeated, repeated.count()), ["k1", "k2"]).select("row", "at")
    by_row = hits.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("hits"))
    marked = cut(by_row.join(found.where("k1 is null").select("row", "id", "mark"), "row").select("id", "mark", "hits"))
    touched = marked.select("id", "mark")
    side = small_side(touched, touched.count(), ID_ROWS)
    full = placed.join(side, ["id", "mark"], "left_semi").join(marked, ["id", "mark"], "left")
    rest = placed.join(side, ["id", "mark"], "left_anti").withColumn("hits", F.array().cast("array<int>"))

    def finish(chunk: list[dict]) -> list[tuple]:
        out = []
        for row in chunk:
            words = _words(row["text"])
            keep = np.ones(len(words), bool)
            if row["role"] and len(words) >= WINDOW:
                keep[:] = False
            elif row["hits"]:
                edge = np.zeros(len(words) + 1, np.int64)
                edge[row["hits"]] += 1
                np.subtract.at(edge, np.array(row["hits"]) + WINDOW, 1)
                keep = np.cumsum(edge)[:-1] == 0
            kept = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            joined = b" ".join(kept)
            left = (row["text"] if len(kept) == len(words) else joined.decode("utf-8", "surrogatepass"),) if keep_text else ()
            out.append((None if row["id"] == LAST else row["id"], len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *left, *(row[f"carried_{c}"] for c in carry)))
        return out

    columns = ["id", "text", "role", "hits", *(f"carried_{c}" for c in carry)]
    return map_chunks(full.select(columns).unionByName(rest.select(columns)), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text + "".join(f", {c} string" for c in carry))


ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM docs),
windows AS (
  SELECT r, place, word, CASE WHEN count(*) OVER ahead = {WINDOW} THEN string_agg(word, ' ') OVER ahead END AS k FROM words
  WINDOW ahead AS (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
repeated AS (SELECT k FROM windows WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
covered AS (
  SELECT r, place, word, max((repeated.k IS NOT NULL)::INT) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN repeated ON windows.k = repeated.k),
left_over AS (
  SELECT r, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE gone = 0) AS kept FROM covered GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (r)
"""
