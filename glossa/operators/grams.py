"""N-grams as fixed-width integers over a word dictionary.

Words are numbered by falling frequency. An n-gram's numbers lie side by side, the
last word's lowest, in as few 64-bit columns as the dictionary and the order need, so
that n-grams are compared, shuffled and counted as integers, and words are spelled
only where they leave. Number ABSENT stands for no word and UNKNOWN for a word that
the dictionary lacks; an n-gram with such a word has no count.

Frequent words and n-grams are looked up in a broadcast head, which has a bound: of N
counted places at most N / t can have a count of t. Only the rest is joined by a
shuffle, where no key has more than t rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.ranks import numbered
from glossa.operators.words import word_array, words_of
from glossa.session import arrow_schema, cut, small_side, to_batch, written

ABSENT, UNKNOWN, FIRST = 0, 1, 2
HEAD = 200_000  # rows of a broadcast head
TASK_WORDS = 2_000_000  # of whole texts that one task takes apart
BUCKET_GRAMS = 2_000_000  # distinct n-grams, those of each part counted, that one task adds up
WORD_CHARS, CHUNK_CHARS, TEXT_ROWS = 6, 1_000_000, 256
MIXED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


@dataclass(frozen=True)
class Dictionary:
    """words(word, id, cnt): numbers from FIRST by falling count, and how many there are."""

    words: DataFrame
    size: int

    @property
    def bits(self) -> int:
        return (self.size + FIRST).bit_length()

    def columns(self, top: int) -> list[str]:
        """The integer columns of n-grams up to an order."""
        return [f"k{c}" for c in range(-(-top // self.fit))]

    @property
    def fit(self) -> int:
        """Words in one column."""
        return 63 // self.bits

    def pack(self, numbers: list[Column]) -> list[Column]:
        """Numbers, last word first, as columns."""
        out = []
        for low in range(0, len(numbers), self.fit):
            part = [F.shiftleft(n, self.bits * k) if k else n for k, n in enumerate(numbers[low : low + self.fit])]
            out.append(sum(part[1:], part[0]))
        return out

    def unpack(self, k: int) -> Column:
        """The number of the k-th word from the end."""
        return F.shiftrightunsigned(F.col(f"k{k // self.fit}"), self.bits * (k % self.fit)).bitwiseAND(F.lit((1 << self.bits) - 1))


@dataclass(frozen=True)
class GramCounts:
    """counts(order, k0.., cnt) over a dictionary, from order 2 on; order 1 are the
    dictionary's own counts, corpus is order 0."""

    words: Dictionary
    counts: DataFrame
    top: int
    corpus: int


def tokens(passages: DataFrame) -> DataFrame:
    return passages.select("text_id", F.posexplode(word_array(F.col("text"))).alias("word_id", "word"))


def dictionary(counted: DataFrame) -> Dictionary:
    """From distinct words and their counts (word, cnt)."""
    words = cut(numbered(counted, [F.desc("cnt"), F.asc("word")], "id").select("word", (F.col("id") + FIRST).alias("id"), "cnt"))
    return Dictionary(words, words.count())


def look_up(rows: DataFrame, known: DataFrame, keys: list[str], head: Column, whole: bool, settled: Column | None = None) -> DataFrame:
    """rows with known's columns, null where it lacks their keys: those of the head by a
    broadcast, the others, unless the head is the whole, by a shuffle. settled says of a
    row after the broadcast that the rest can't have its key."""
    values = [c for c in known.columns if c not in keys]
    first = rows.join(F.broadcast(known.where(head)), keys, "left")
    if whole:
        return first
    settled = F.col(values[0]).isNotNull() if settled is None else settled
    rest = first.where(~settled).drop(*values).join(known.where(~head), keys, "left")
    return first.where(settled).unionByName(rest)


def coded(rows: DataFrame, words: Dictionary) -> DataFrame:
    """rows with the number (id) and count (cnt) of their word."""
    found = look_up(rows, words.words, ["word"], F.col("id") < FIRST + HEAD, words.size <= HEAD)
    return found.withColumns({"id": F.coalesce("id", F.lit(UNKNOWN)).cast("long"), "cnt": F.coalesce("cnt", F.lit(0)).cast("long")})


def rolled(rows: DataFrame, top: int) -> DataFrame:
    """Coded tokens (text_id, word_id, id, ...) with r1.. up to r(top), the numbers of the
    word and of those before it; ABSENT where a place has none or its row is left out."""
    place = Window.partitionBy("text_id").orderBy("word_id")
    back = {f"r{k + 1}": F.when(F.lag("word_id", k).over(place) == F.col("word_id") - k, F.lag("id", k).over(place)) for k in range(1, top)}
    return rows.withColumns({"r1": F.col("id"), **{c: F.coalesce(v, F.lit(ABSENT)) for c, v in back.items()}})


def stacked(rows: DataFrame, words: Dictionary, orders: int, top: int, keep: list[str]) -> DataFrame:
    """A row for each n-gram of order 2 to orders that ends at a rolled token and whose
    words are all known: keep, order, and the columns that n-grams up to top have."""
    items = []
    for o in range(2, orders + 1):
        numbers = [F.col(f"r{k}") for k in range(1, o + 1)]
        packed = words.pack(numbers + [F.lit(ABSENT).cast("long")] * (top - o))
        items.append(F.when(F.least(*numbers) >= FIRST, F.struct(F.lit(o).alias("order"), *[c.alias(n) for n, c in zip(words.columns(top), packed, strict=True)])))
    return rows.select(*keep, F.inline(F.array_compact(F.array(*items))))


def count_grams(passages: DataFrame, top: int, needed: DataFrame | None = None) -> GramCounts:
    """Counts of all n-grams up to an order, or only of those that occur in the
    passages of needed: then other words have no number, and their n-grams end there."""
    spoken = tokens(passages)
    if needed is None:
        words = dictionary(spoken.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))
        corpus = words.words.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    else:
        asked = dictionary(tokens(needed).groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))
        met = cut(coded(spoken, asked).groupBy("id").agg(F.count(F.lit(1)).alias("n")))
        corpus = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        words = Dictionary(cut(asked.words.drop("cnt").join(met, "id", "left").select("word", "id", F.coalesce("n", F.lit(0)).alias("cnt"))), asked.size)
    keys = ["order", *words.columns(top)]
    if top == 1:
        return GramCounts(words, passages.sparkSession.createDataFrame([], "order int, k0 long, cnt long"), 1, corpus)
    ending = lambda df: stacked(rolled(coded(tokens(df), words).where(F.col("id") >= FIRST).select("text_id", "word_id", "id"), top), words, top, top, [])
    grams = ending(passages)
    if needed is not None:
        wanted = cut(ending(needed).distinct())
        grams = grams.join(small_side(wanted, wanted.count(), HEAD), keys, "left_semi")
    return GramCounts(words, cut(grams.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))), top, corpus)


def spoken_grams(passages: DataFrame, top: int) -> DataFrame:
    """(ngram) of every place and order, the words before a word taken from its own text."""
    texts = passages.select(word_array(F.col("text")).alias("w"))
    placed = texts.select("w", F.posexplode("w").alias("at", "word"))
    before = lambda o: F.concat_ws(" ", *[F.get("w", F.col("at") - k) for k in range(o - 1, 0, -1)], "word")
    ending = F.array(F.col("word"), *[F.when(F.col("at") >= o - 1, before(o)) for o in range(2, top + 1)])
    return placed.select(F.explode(ending).alias("ngram")).where("ngram IS NOT NULL")


def order_of(ngram: Column) -> Column:
    """Words hold no blank, so an n-gram's order is its blanks and one."""
    return F.length(ngram) - F.length(F.replace(ngram, F.lit(" "), F.lit(""))) + 1


def ngram_counts(passages: DataFrame, top: int, needed: DataFrame | None = None) -> DataFrame:
    """(order, ngram, cnt) of all n-grams, or only of those in needed(ngram), the
    corpus size as order 0 with an empty one. They leave as they are spoken, so they are
    counted as text by one shuffle."""
    spoken, wanted = spoken_grams(passages, top), None
    if needed is not None:
        wanted = cut(needed.select("ngram").distinct())
        few = wanted.count()
        if few <= HEAD:
            spoken = spoken.join(F.broadcast(wanted), "ngram", "left_semi")
    counts = spoken.groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt"))
    if wanted is not None and few > HEAD:
        counts = counts.join(wanted, "ngram", "left_semi")
    size = passages.where("text IS NOT NULL").agg(F.coalesce(F.sum(F.size(word_array(F.col("text")))), F.lit(0)).cast("long").alias("cnt"))
    return counts.select(order_of(F.col("ngram")).alias("order"), "ngram", "cnt").unionByName(size.select(F.lit(0).alias("order"), F.lit("").alias("ngram"), "cnt"))


@dataclass(frozen=True)
class OwnCounts:
    """texts(text_id, w, c1..): a row a text that has words, its words and for each order
    the corpus's counts of its own n-grams, that of the k-th word's first; corpus is
    order 0."""

    texts: DataFrame
    top: int
    corpus: int


def text_parts(passages: DataFrame) -> tuple[int, int]:
    """About how many words there are, and the parts in which a task takes whole texts."""
    words = (passages.agg(F.sum(F.length("text"))).first()[0] or 0) // WORD_CHARS
    return words, max(int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // TASK_WORDS)


def own_counts(passages: DataFrame, top: int) -> OwnCounts:
    """T11 of a corpus whose own n-grams are looked up.

    Texts are dealt whole into parts. A part sends each of its distinct n-grams once, with
    its own count, as 96 bits of a digest in rising order; where an n-gram's parts meet,
    the counts are added up, and the totals go back in the order in which the n-grams came,
    without them. So a frequent n-gram is a row a part, whatever its count, and texts
    are shuffled once."""
    words, parts = text_parts(passages)
    bits = (words * top // BUCKET_GRAMS).bit_length()
    whole = passages.where("text IS NOT NULL").select("text_id", "text", F.pmod(F.xxhash64("text_id"), F.lit(parts)).cast("int").alias("part"))

    def send(texts: pa.Table) -> pa.Table:
        part, grams = texts.column("part")[0].as_py(), PartGrams(texts.column("text"), top)
        ends = np.searchsorted(grams.keys >> np.uint64(64 - bits), np.arange(1 << bits), "right") if bits else [len(grams.keys)]
        lines, at = [], 0
        for bucket, end in enumerate(ends):
            if end > at:
                lines.append((part, bucket, planes(grams.keys[at:end]), grams.checks[at:end].tobytes(), narrow(grams.counts[at:end])))
            at = end
        return pa.Table.from_batches([to_batch(lines, sent)])

    def add_up(lines: pa.Table) -> pa.Table:
        rows = lines.to_pylist()
        sizes = [len(r["keys"]) // 8 for r in rows]
        keys = np.concatenate([level(r["keys"], n) for r, n in zip(rows, sizes, strict=True)])
        checks = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows])
        order, first = ranked(keys, checks)
        held = np.concatenate([widened(r["counts"], n) for r, n in zip(rows, sizes, strict=True)])[order]
        totals = np.empty(len(keys), np.int64)
        totals[order] = np.add.reduceat(held, np.flatnonzero(first))[np.cumsum(first) - 1]
        back = np.split(totals, np.cumsum(sizes)[:-1])
        return pa.Table.from_batches([to_batch([(r["part"], r["bucket"], len(x), narrow(x)) for r, x in zip(rows, back, strict=True)], returned)])

    def take(texts: pa.Table, lines: pa.Table) -> pa.Table:
        grams = PartGrams(texts.column("text"), top)
        totals = [widened(r["totals"], r["n"]) for r in sorted(lines.to_pylist(), key=lambda r: r["bucket"])]
        counts = grams.spread(np.concatenate(totals) if totals else np.zeros(0, np.int64))
        spoken = grams.sizes > 0
        offsets = lambda o: pa.array(np.concatenate([[0], np.cumsum(np.maximum(grams.sizes[spoken] - (o - 1), 0))]), pa.int32())
        columns = [texts.column("text_id").combine_chunks().filter(pa.array(spoken)), pa.ListArray.from_arrays(offsets(1), grams.spoken)]
        columns += [pa.ListArray.from_arrays(offsets(o), pa.array(c)) for o, c in enumerate(counts, 1)]
        whole = pa.table(columns, names=["text_id", "w", *[f"c{o}" for o in range(1, top + 1)]])
        return pa.Table.from_batches(whole.to_batches(max_chunksize=TEXT_ROWS), whole.schema)

    lined, given = "part int, bucket int, keys binary, checks binary, counts binary", "part int, bucket int, n long, totals binary"
    sent, returned = arrow_schema(lined), arrow_schema(given)
    totals = whole.groupBy("part").applyInArrow(send, lined).groupBy("bucket").applyInArrow(add_up, given)
    ddl = f"text_id {passages.schema['text_id'].dataType.simpleString()}, w array<string>" + "".join(f", c{o} array<long>" for o in range(1, top + 1))
    texts = written(whole.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(take, ddl), "texts", "zstd")
    return OwnCounts(texts, top, texts.agg(F.coalesce(F.sum(F.size("c1")), F.lit(0)).cast("long")).first()[0])


class PartGrams:
    """The distinct n-grams of a part's texts up to an order: keys and checks (together 96
    bits of a digest, which tell n-grams apart) in rising order, and counts; spoken are
    all its words, sizes how many a text has."""

    def __init__(self, texts: pa.ChunkedArray, top: int):
        chunks, sizes, held, chars = [], [], [], 0
        for text in (x.as_py() for x in texts):
            said = words_of(text)
            sizes.append(len(said))
            held += said
            if (chars := chars + len(text)) > CHUNK_CHARS:
                chunks.append(pa.array(held, pa.string()))
                held, chars = [], 0
        self.spoken = pa.concat_arrays([*chunks, pa.array(held, pa.string())])
        self.sizes = np.array(sizes, np.int64)
        coded = self.spoken.dictionary_encode()
        word, size = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
        digests = np.frombuffer(b"".join([hashlib.blake2b(w.encode(), digest_size=16).digest() for w in coded.dictionary.to_pylist()]), np.uint64).reshape(-1, 2)
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)  # where a place's text ends
        place, known = np.arange(len(word)), digests
        self.numbers = [word]
        found = [(digests, np.bincount(word, minlength=len(digests)))]
        for o in range(2, top + 1):
            place = place[place + o <= ends[place]]
            longer = np.zeros(len(word), np.int64)
            pairs, longer[place], n = np.unique(self.numbers[-1][place] * size + word[place + o - 1], return_inverse=True, return_counts=True)
            known = known[pairs // size] * MIXED[0] + digests[pairs % size] * MIXED[1] + np.uint64(o)
            self.numbers.append(longer)
            found.append((known, n))
        both = np.concatenate([d for d, _ in found])
        keys, checks = both[:, 0], (both[:, 1] >> np.uint64(32)).astype(np.uint32)
        self.order, _ = ranked(keys, checks)
        self.keys, self.checks, self.counts = keys[self.order], checks[self.order], np.concatenate([n for _, n in found])[self.order]
        self.kinds = [len(n) for _, n in found]

    def spread(self, totals: np.ndarray) -> list[np.ndarray]:
        """For each order the totals, given in the order of keys, of every n-gram spoken."""
        by_kind, out = np.empty(len(self.order), np.int64), []
        by_kind[self.order] = totals
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        for o, (number, known) in enumerate(zip(self.numbers, np.split(by_kind, np.cumsum(self.kinds)[:-1]), strict=True), 1):
            out.append(known[number[np.arange(len(number)) + o <= ends]])
        return out


def ranked(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of keys and then checks, and which of these begin a new one."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    if ((k[1:] == k[:-1]) & (c[1:] < c[:-1])).any():
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, first


def planes(numbers: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: of numbers that rise or are small most
    bytes are the same as their neighbours, which the shuffle's compression takes away."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def level(line: bytes, n: int) -> np.ndarray:
    """The n numbers of planes."""
    return np.ascontiguousarray(np.frombuffer(line, np.uint8).reshape(-1, n).T).view(f"u{len(line) // n}").ravel()


def narrow(counts: np.ndarray) -> bytes:
    """Counts by planes, in as few bytes each as the greatest needs."""
    return planes(counts.astype(np.min_scalar_type(counts.max())))


def widened(line: bytes, n: int) -> np.ndarray:
    return level(line, n).astype(np.int64)


def own_surprisal(place: Column, counts: OwnCounts) -> list[Column]:
    """T12 of the word at a place of own_counts' texts, at each context length from 0: all
    n-grams have counts, so nothing is backed off; the start of a text shortens the
    history."""
    count = lambda o, at: F.log(F.get(f"c{o}", at))
    scores = [-(count(1, place) - F.log(F.lit(float(counts.corpus))))]
    for o in range(2, counts.top + 1):
        first = place - (o - 1)  # where the n-gram begins, and its history too
        scores.append(F.when(first < 0, scores[-1]).otherwise(-(count(o, first) - count(o - 1, first))))
    return scores


def own_surprisals(texts: pa.RecordBatch, place: np.ndarray, corpus: int) -> list[np.ndarray]:
    """own_surprisal of every word of a batch of own_counts' texts, given its place there, at
    context lengths 0 and 1."""
    c1 = np.log(texts.column("c1").flatten().to_numpy())
    scores = np.log(float(corpus)) - c1
    after = scores.copy()
    later = np.flatnonzero(place > 0)
    after[later] = c1[later - 1] - np.log(texts.column("c2").flatten().to_numpy())
    return [scores, after]


def spelled(grams: GramCounts) -> DataFrame:
    """(order, ngram, cnt); words that the corpus lacks are left out."""
    words, out = grams.words, grams.counts
    for k in range(grams.top):
        named = words.words.select("id", F.col("word").alias(f"w{k}"))
        apart = out.withColumn("id", words.unpack(k))
        out = look_up(apart, named, ["id"], F.col("id") < FIRST + HEAD, words.size <= HEAD, F.col("id") < FIRST + HEAD).drop("id")
    text = F.concat_ws(" ", *[F.col(f"w{k}") for k in reversed(range(grams.top))])
    ones = words.words.where("cnt > 0").select(F.lit(1).alias("order"), F.col("word").alias("ngram"), "cnt")
    size = out.sparkSession.range(1).select(F.lit(0).alias("order"), F.lit("").alias("ngram"), F.lit(grams.corpus).cast("long").alias("cnt"))
    return out.select("order", text.alias("ngram"), "cnt").unionByName(ones).unionByName(size)


def from_strings(counts: DataFrame) -> GramCounts:
    """Stored counts (order, ngram, cnt) over a dictionary of their words; an n-gram's
    words are taken apart, numbered and put side by side again."""
    top, corpus = counts.agg(F.max("order"), F.max(F.when(F.col("order") == 0, F.col("cnt")))).first()
    top = max(top or 1, 1)
    apart = counts.where("order > 0").select("order", "ngram", F.col("cnt").alias("held"), F.posexplode(F.reverse(F.split("ngram", " "))).alias("at", "word"))
    single = F.max(F.when(F.col("order") == 1, F.col("held")))
    words = dictionary(apart.groupBy("word").agg(F.coalesce(single, F.lit(0)).alias("cnt")))
    side = lambda c: F.sum(F.when(F.floor(F.col("at") / words.fit) == c, F.expr(f"shiftleft(id, cast({words.bits} * (at % {words.fit}) as int))")).otherwise(0))
    longer = coded(apart.where("order > 1"), words).groupBy("order", "ngram").agg(*[side(c).alias(n) for c, n in enumerate(words.columns(top))], F.max("held").alias("cnt"))
    return GramCounts(words, cut(longer.drop("ngram")), top, corpus or 0)


def backoff_surprisal(held_out: DataFrame, grams: GramCounts, contexts: list[int], alpha: float = 0.4, pseudo: float = 1.0) -> DataFrame:
    """Stupid Backoff surprisal of every word at each context length.

    Of the orders within the context the highest with a count is taken, alpha for
    each order tried above it; the start of a passage shortens the history for
    free. An unseen word has the pseudo-count over the corpus size. A count whose
    history has none stops the job (T13).

    A word's history of any order is the n-gram one shorter that ends at the word
    before, so its count is known from there and isn't looked up.
    """
    words, wanted = grams.words, max(contexts) + 1
    seen = min(wanted, grams.top)
    spoken = cut(rolled(coded(tokens(held_out), words).select("text_id", "word_id", "id", "cnt"), seen))
    placed = spoken.select("text_id", "word_id", F.lit(1).alias("order"), "cnt")
    if seen > 1:
        keys = ["order", *words.columns(grams.top)]
        known = grams.counts.where((F.col("cnt") > 0) & (F.col("order") <= seen))
        head = F.col("cnt") > grams.corpus * grams.top // HEAD  # HEAD rows at most, as all counts sum to corpus * top
        found = look_up(stacked(spoken, words, seen, grams.top, ["text_id", "word_id"]), known, keys, head, False).where("cnt > 0")
        placed = placed.unionByName(found.select("text_id", "word_id", "order", "cnt"))
    counts = [F.coalesce(F.max(F.when(F.col("order") == o, F.col("cnt"))), F.lit(0)).alias(f"c{o}") for o in range(1, seen + 1)]
    place = Window.partitionBy("text_id").orderBy("word_id")
    rows = placed.repartition("text_id").groupBy("text_id", "word_id").agg(*counts).withColumns({f"d{o}": F.lag(f"c{o - 1}", 1, 0).over(place) for o in range(2, seen + 1)})
    known_or_pseudo = F.when(F.col("c1") > 0, F.col("c1").cast("double")).otherwise(F.lit(float(pseudo)))
    scores = [F.log(known_or_pseudo) - F.log(F.lit(float(grams.corpus)))]
    for o in range(2, wanted + 1):
        shorter = scores[-1] + math.log(alpha)
        if o <= seen:
            c, d = F.col(f"c{o}"), F.col(f"d{o}")
            orphan = F.raise_error(F.concat(F.lit(f"an n-gram of order {o} has a count but none of its history: text "), F.col("text_id").cast("string"), F.lit(", word "), F.col("word_id").cast("string")))
            shorter = F.when(c <= 0, shorter).when(d <= 0, orphan.cast("double")).otherwise(F.log(c) - F.log(d))
        scores.append(F.when(F.col("word_id") + 1 < o, scores[-1]).otherwise(shorter))
    named = rows.withColumn("scores", F.array(*[-s for s in scores]))
    return named.select("text_id", "word_id", *[F.get("scores", F.lit(k)).alias(f"ngram_surprisal_context_{k}") for k in contexts])
