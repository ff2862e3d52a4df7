"""Keyed joins of predictor tables, lags, and model swaps."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.words import byte_alphabet

KEY = ["text_id", "word_id"]
SLICE_WORDS, TEXTS = 50_000, 256  # words and texts that a task holds at once
FAMILIES = r"^(ngram_surprisal_context|context_limited_surprisal_context|internal_layer_surprisal_layer)_(\d+)$"


def family_columns(df: DataFrame, prefix: str) -> list[str]:
    """A family's columns in the order of their numbers."""
    found = [(int(m[1]), c) for c in df.columns if (m := re.fullmatch(rf"{re.escape(prefix)}_(\d+)", c))]
    return [c for _, c in sorted(found)]


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Columns left over from written row names."""
    return df.select(*[c for c in df.columns if not re.match("Unnamed:", c)])


def match_violations(left: DataFrame, right: DataFrame, keys: list[str] = KEY, word: str | None = None) -> DataFrame:
    """Keys on one side only, keys that repeat, and words that differ
    (the right word may be the left one or its byte alphabet).

    Both sides lie in one table with a mark and are dealt by key once; a key's counts by
    side and word say all there is to say of it. A row on one side, and a pair of rows
    whose words differ, is a violation each."""
    text = (lambda df: F.col(word).cast("string")) if word else (lambda df: F.lit(None).cast("string"))
    sides = left.select(*keys, text(left).alias("_word"), F.lit(0).alias("_side")).unionByName(right.select(*keys, text(right).alias("_word"), F.lit(1).alias("_side")))
    words = sides.repartition(*keys).groupBy(*keys, "_side", "_word").agg(F.count(F.lit(1)).alias("_n"))
    of = lambda side: F.collect_list(F.when(F.col("_side") == side, F.struct(F.col("_word").alias("word"), F.col("_n").alias("n"))))
    met = words.groupBy(*keys).agg(of(0).alias("_l"), of(1).alias("_r"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    n, m = total("_l"), total("_r")
    unlike = F.lit(0).cast("long")
    if word:
        same = lambda a, b: F.coalesce((a["word"] == b["word"]) | (byte_alphabet(a["word"]) == b["word"]), F.lit(False))
        unlike = F.aggregate("_l", unlike, lambda t, a: t + F.aggregate("_r", F.lit(0).cast("long"), lambda u, b: u + F.when(same(a, b), 0).otherwise(a["n"] * b["n"])))
    # A null key meets no other: each of its rows is missing on the other side.
    alone = reduce(lambda c, k: c | F.col(k).isNull(), keys, F.lit(False))
    found = {"missing right": F.when(alone | (m == 0), n), "missing left": F.when(alone | (n == 0), m), "word differs": F.when(~alone, unlike), "repeated left": F.when(n > 1, 1), "repeated right": F.when(m > 1, 1)}
    lines = F.array(*[F.struct(F.lit(name).alias("violation"), F.coalesce(count, F.lit(0)).alias("_times")) for name, count in found.items()])
    every = met.select(*keys, F.inline(lines)).where("_times > 0")
    return every.select(*keys, "violation", F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_k")).drop("_k")


def join_predictors(*tables: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Predictor families side by side; run match_violations first. A column
    besides the keys and word that two tables have is an error."""
    joined, *others = tables
    for other in others:
        require_disjoint(joined, other, [*keys, "word"])
        joined = joined.join(other.drop(*[c for c in ("word",) if c in joined.columns]), keys)
    return joined


def require_disjoint(left: DataFrame, right: DataFrame, shared: list[str]) -> None:
    """Columns that both tables have, beyond the shared ones, stop the merge."""
    if clash := sorted((set(left.columns) & set(right.columns)) - set(shared)):
        raise ValueError(f"both tables have {', '.join(clash)}")


def merge_base(means: DataFrame, scores: DataFrame) -> DataFrame:
    """Full outer join of reading-time means (text ids from 1) and scores (from 0)."""
    return means.join(scores.withColumn("text_id", F.col("text_id") + 1), KEY, "full_outer")


def base_violations(merged: DataFrame, lang: str = "en") -> DataFrame:
    """J3's checks: rows without surprisal, and words that aren't the reference token
    (not asked of he and gr)."""
    checks = [F.when(F.col("surprisal").isNull(), "no surprisal")]
    if lang not in ("he", "gr"):
        checks.append(F.when(~F.coalesce(F.col("word") == F.col("ref_token"), F.lit(False)), "word differs"))
    return merged.select(*KEY, F.coalesce(*checks).alias("violation")).where("violation is not null")


def attach_base(predictors: DataFrame, base: DataFrame) -> DataFrame:
    """Reading-time base (text ids from 1) onto predictors (from 0); base rows
    without a predictor fall away."""
    shifted = predictors.withColumn("text_id", F.col("text_id") + 1)
    require_disjoint(shifted, base, [*KEY])
    return shifted.join(base, KEY, "left")


def attach_layers(joint: DataFrame, layers: DataFrame, prefix: str = "internal_layer_surprisal_layer") -> DataFrame:
    """Layer columns (text ids from 0) onto a joint table (from 1); it may not have
    layer columns already. key_differences tells whether the keys are the same."""
    columns = family_columns(layers, prefix)
    require_disjoint(joint.select(*joint.columns), layers.select(*KEY, *columns), KEY)
    return layers.select((F.col("text_id") + 1).alias("text_id"), "word_id", *columns).join(joint, KEY, "left")


def uncovered(predictors: DataFrame, base: DataFrame) -> DataFrame:
    """J4's violations: predictor keys that the base lacks."""
    return predictors.select((F.col("text_id") + 1).alias("text_id"), "word_id").join(base, KEY, "left_anti")


def key_differences(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """How many keys each side lacks."""
    missing = right.select(*keys).join(left.select(*keys), keys, "left_anti").agg(F.count(F.lit(1)).alias("missing_left"))
    extra = left.select(*keys).join(right.select(*keys), keys, "left_anti").agg(F.count(F.lit(1)).alias("missing_right"))
    return missing.crossJoin(extra)  # one row each


def add_lags(rows: DataFrame, columns: list[str], partition: str = "text_id", order: str = "word_id", most: int = 3) -> DataFrame:
    """prev_, prev2_, prev3_ of each column inside a text: one window for all."""
    place = Window.partitionBy(partition).orderBy(order)
    lags = [F.lag(c, k).over(place).alias(f"prev{k if k > 1 else ''}_{c}") for c in columns for k in range(1, most + 1)]
    return rows.select(*rows.columns, *lags)


def handed_out(texts: DataFrame, words: Column, size: Column, columns: list[str], most: int = 3, text_id: str = "text_id") -> DataFrame:
    """W1 where a text is a row: words is an array of its size of structs, given back as a
    row a word (text_id, word_id, fields...) with prev_, prev2_, prev3_ of columns. A lag
    is an earlier place of the text's own array, so no row is shuffled or sorted."""
    # Made once a text, as a row of its own: inside the lambda it would be made once a word.
    arrays = texts.where(size > 0).select(text_id, size.alias("_n"), F.explode(F.array(words)).alias("_words"))
    fields = arrays.schema["_words"].dataType.elementType.names
    near = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(k.alias("word_id"), *[F.get("_words", k - back).alias(f"_{back}") for back in range(most + 1)]))
    placed = arrays.select(text_id, F.inline_outer(near))  # a word's row holds its few places and not its text
    lags = [F.col(f"_{k}")[c].alias(f"prev{k if k > 1 else ''}_{c}") for c in columns for k in range(1, most + 1)]
    return placed.select(text_id, "word_id", *[F.col("_0")[c].alias(c) for c in fields], *lags)


def read_out(texts: DataFrame, fields: str, read: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, np.ndarray]], columns: list[str], most: int, seed: str) -> DataFrame:
    """W1 as handed_out's, for the words that have all their lags, with read in Arrow tasks:
    from a batch of texts (text_id, w, ...), the row of each of its words and the word's
    place, read makes a value a word for each of fields. digest is that of the seed and the
    key, as assign_folds has it."""
    lags = [(f"prev{k if k > 1 else ''}_{c}", c, k) for c in columns for k in range(1, most + 1)]
    kinds = dict(f.split() for f in fields.split(", "))
    names = [*kinds, *[n for n, _, _ in lags]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            row, place = placed(batch)
            values = read(batch, row, place)
            at = np.flatnonzero(place >= most)
            digests = spelled_digests(key_digests(seed, batch.column("text_id").to_pylist(), batch.column("w").value_lengths().to_numpy(), most))
            out = [batch.column("text_id").take(pa.array(row[at])), pa.array(place[at].astype(np.int32)), digests]
            out += [pa.array(values[c][at]) for c in kinds] + [pa.array(values[c][at - k]) for _, c, k in lags]
            yield pa.RecordBatch.from_arrays(out, names=["text_id", "word_id", "digest", *names])

    typed = ", ".join([fields, *[f"{n} {kinds[c]}" for n, c, _ in lags]])
    return texts.mapInArrow(run, f"text_id {texts.schema['text_id'].dataType.simpleString()}, word_id int, digest string, {typed}")


def word_digests(texts: DataFrame, most: int, seed: str) -> tuple[DataFrame, int, Callable[[list[int]], DataFrame]]:
    """(digest) of read_out's rows, without their other columns; how many there are; and a
    function of rising edges that takes the digests' first 64 bits apart in one pass: (place, n,
    digest), n of the place (how many edges are at or below) or one digest of an odd place."""
    sizes = texts.select("text_id", F.size("w").alias("n"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                ids, n = (c.slice(start, TEXTS) for c in batch.columns)
                yield key_digests(seed, ids.to_pylist(), n.to_numpy(), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests in parts(batches):
            yield pa.RecordBatch.from_arrays([spelled_digests(digests)], names=["digest"])

    def near(edges: list[int]) -> DataFrame:
        bounds = np.array(edges, np.uint64)

        def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, schema = np.zeros(len(bounds) + 1, np.int64), pa.schema([("place", pa.int32()), ("n", pa.int64()), ("digest", pa.string())])
            for digests in parts(batches):
                place = np.searchsorted(bounds, np.frombuffer(b"".join(digests), ">u8")[::2], "right")
                counts += np.bincount(place, minlength=len(counts))
                odd = np.flatnonzero(place % 2)
                yield pa.RecordBatch.from_arrays([pa.array(place[odd], pa.int32()), pa.nulls(len(odd), pa.int64()), spelled_digests([digests[k] for k in odd])], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts), pa.nulls(len(counts), pa.string())], schema=schema)

        return sizes.mapInArrow(take_apart, "place int, n long, digest string")

    return sizes.mapInArrow(run, "digest string"), sizes.agg(F.coalesce(F.sum(F.greatest(F.col("n") - most, F.lit(0))), F.lit(0))).first()[0], near


def key_digests(seed: str, text_ids: list, sizes: np.ndarray, first: int) -> list[bytes]:
    """md5 of seed|text_id|word_id for the places of each text from the first on."""
    out, numbers = [], [str(k).encode() for k in range(max(sizes, default=0))]
    for text_id, n in zip(text_ids, sizes.tolist(), strict=True):
        head = "".join(f"{x}|" for x in (seed, text_id) if x is not None).encode()
        out += [hashlib.md5(head + k).digest() for k in numbers[first:n]]
    return out


def spelled_digests(digests: list[bytes]) -> pa.Array:
    return pa.array([d.hex() for d in digests], pa.string())


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' texts (w has their words) in slices of some SLICE_WORDS words."""
    for batch in batches:
        ends, start = np.cumsum(batch.column("w").value_lengths().to_numpy()), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + SLICE_WORDS, "right")))
            yield batch.slice(start, end - start)
            start = end


def placed(batch: pa.RecordBatch, words: str = "w") -> tuple[np.ndarray, np.ndarray]:
    """The row of every word of a batch's texts, and its place in the text."""
    sizes = batch.column(words).value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def swap_model(canonical: DataFrame, replacement: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of canonical replaced by key from another model, their lags
    rebuilt, the column order kept."""
    lagged = [c for c in columns if f"prev_{c}" in canonical.columns]
    stale = [f"prev{k}_{c}" for c in lagged for k in ("", "2", "3") if f"prev{k}_{c}" in canonical.columns]
    fresh = canonical.drop(*columns, *stale).join(replacement.select(*KEY, *columns), KEY)
    return add_lags(fresh, lagged).select(*canonical.columns)


def swap_in_texts(canonical: DataFrame, replacement: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """J7 where a text is a row: text_id, word_id (an array of rising places) and w, an array
    of structs, a value a field. As swap_model of both tables' words, canonical with lags of
    all its fields: texts meet by one key and words inside their text, so no row a word is
    shuffled or sorted."""
    kinds = {f.name: f.dataType.simpleString() for f in canonical.schema["w"].dataType.elementType.fields}
    met = canonical.select("text_id", "word_id", "w").join(replacement.select("text_id", F.col("word_id").alias("_at"), F.col("w").alias("_new")), "text_id")
    lags = [(f"prev{k if k > 1 else ''}_{c}", c, k) for c in kinds for k in range(1, most + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            (row, place), (other, _) = placed(batch), placed(batch, "_new")
            ids, theirs = batch.column("word_id").flatten().to_numpy(), batch.column("_at").flatten().to_numpy()
            # A word's key: its text's row, and its number in it.
            wide = max(ids.max(initial=0), theirs.max(initial=0)) + 1
            own, asked = row * wide + ids, other * wide + theirs
            order = np.argsort(asked, kind="stable")
            first, last = (np.searchsorted(asked[order], own, side) for side in ("left", "right"))
            at = np.repeat(np.arange(len(own)), last - first)
            new = order[np.arange(len(at)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[at]]
            values, fresh = (dict(zip((f.name for f in c.type.value_type), c.flatten().flatten(), strict=True)) for c in (batch.column("w"), batch.column("_new")))
            nth = np.arange(len(at)) - np.searchsorted(row[at], row[at], "left")
            out = [batch.column("text_id").take(pa.array(row[at])), pa.array(ids[at])]
            lag = lambda c, k: fresh[c].take(pa.array(np.roll(new, k), mask=nth < k)) if c in columns else values[c].take(pa.array(at - k, mask=place[at] < k))  # noqa: B023, E731
            out += [lag(c, 0) for c in kinds] + [lag(c, k) for _, c, k in lags]
            yield pa.RecordBatch.from_arrays(out, names=["text_id", "word_id", *kinds, *[n for n, _, _ in lags]])

    of = lambda name: canonical.schema[name].dataType
    typed = "".join(f", {n} {kinds[c]}" for n, c in [*((c, c) for c in kinds), *((n, c) for n, c, _ in lags)])
    return met.mapInArrow(run, f"text_id {of('text_id').simpleString()}, word_id {of('word_id').elementType.simpleString()}{typed}")


def anchor_report(left: DataFrame, right: DataFrame, value: str, keys: list[str] = KEY) -> DataFrame:
    """Greatest, mean and nearest-rank p99 of absolute differences by key."""
    gap = left.join(right.select(*keys, F.col(value).alias("other")), keys).select(F.abs(F.col(value) - F.col("other")).alias("gap"))
    return gap.agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), F.expr("percentile_disc(0.99) within group (order by gap)").alias("p99_gap"))


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of small dimension tables."""
    combined, *others = axes
    for axis in others:
        combined = combined.crossJoin(F.broadcast(axis))  # contexts, layers, folds: a few rows each
    return combined
