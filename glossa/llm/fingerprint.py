"""Canonical exact digests of whole texts.

A text is put in canonical form (Unicode NFKC, case folded, white space runs to
one space, ends stripped) and hashed with 128-bit xxh3. Rows with one digest
form a bucket; within it every canonical text is compared, byte by byte, with
the least of the bucket's, and a text that differs gets a suffix of its own, so
equal fingerprints mean equal canonical texts.

Texts are shuffled once, into ranges of ids, where each meets the next one; the
last of a range waits for the first of the following range, which is a join of
one row a range. Buckets are found by counting digests (combined before the
shuffle). Only rows of buckets with two rows or more are read again, and equal
texts among them are combined before the comparison, so a hot bucket is a few
rows.

Defined cases: a null text counts as empty; equal texts, repeated rows and
copies share a fingerprint; rows of one id go by the hash of their texts and
then the texts, rows with a null id come last, and so many of them are split
over ranges; a very long text is held whole in one task, with its successor and
the edited text, and no others; an empty table gives an empty result; other
columns are ignored. An edited text's fingerprint is its digest, and likeness is
that of the canonical texts themselves wherever digests agree.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.texts import arrow_schema, chunks, map_chunks, to_batch
from glossa.session import cut, small_side

LAST = 2**63 - 1  # where rows with a null id sort
SHARED_ROWS = 500_000  # digests, about 50 MB: broadcast up to here


def canonical(text: str | None) -> str:
    text = text or ""
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def wide_hash(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def digest(text: str | None) -> str:
    return wide_hash(canonical(text))


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, digest string, form_sha256 string, edited_fingerprint string, near_edited double, near_next double"
#: What a range gives: results, and its open ends (kind 'first' or 'last') with their texts.
OUT = f"kind string, pid int, {RESULT}, text string"


def _pair(doc_id: int | None, text: str, form: str, mark: str, following: str, next_form: str, hashed: Callable) -> tuple:
    """One row's result from its text and the next one's."""
    changed = edited(text, following)
    changed_form = canonical(changed)
    shas = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (changed, form)]
    return doc_id, len(text), shas[0], mark, shas[1], hashed(changed_form), float(form == changed_form), float(form == next_form)


def _walk(hashed: Callable):
    """Rows of one range in order: each is edited with the one after it."""

    schema = arrow_schema(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in chunks(batches):
            out = []
            for row in rows:
                text = row["text"]
                form = canonical(text)
                if held is None:
                    out.append(("first", row["pid"], *[None] * 8, text))
                else:
                    out.append((None, None, *_pair(*held, text, form, hashed), None))
                held = row["doc_id"], text, form, hashed(form)
            pid = rows[-1]["pid"]
            yield to_batch(out, schema)
        if held is not None:
            yield to_batch([("last", pid, held[0], *[None] * 7, held[1])], schema)

    return run


def mark_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", hashed: Callable = wide_hash) -> DataFrame:
    """RESULT's columns: digests of every text and of the text edited with its
    successor's start."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST)).alias("id"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = rows.repartitionByRange(tasks, "id", "tie").sortWithinPartitions("id", "tie", "text")
    walked = cut(ranges.select("doc_id", "text", F.spark_partition_id().alias("pid")).mapInArrow(_walk(hashed), OUT))
    ends = walked.where("kind is not null")
    order = Window.orderBy("pid")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One number a range: the range after each, and the first after the last.
    after = ends.where("kind = 'first'").select("pid", F.coalesce(F.lead("pid").over(order), F.min("pid").over(everything)).alias("next"))
    heads = ends.where("kind = 'first'").select(F.col("pid").alias("next"), F.col("text").alias("following"))
    tails = ends.where("kind = 'last'").select("pid", "doc_id", "text").join(after, "pid").join(heads, "next")

    def close(chunk: list[dict]) -> list[tuple]:
        out = []
        for row in chunk:
            form, next_form = canonical(row["text"]), canonical(row["following"])
            out.append(_pair(row["doc_id"], row["text"], form, hashed(form), row["following"], next_form, hashed))
        return out

    closed = cut(map_chunks(tails.select("doc_id", "text", "following"), close, RESULT))
    return walked.where("kind is null").select(*closed.columns).unionByName(closed)


def collisions(docs: DataFrame, marks: DataFrame, *, doc_id: str = "doc_id", text: str = "text", hashed: Callable = wide_hash) -> DataFrame:
    """(digest, form_sha256) of the canonical texts, all but the least of each, that
    share a digest with another one: none unless digests collide."""
    own = F.coalesce("doc_id", F.lit(LAST))
    shared = cut(marks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    ids = cut(marks.join(small_side(shared, shared.count(), SHARED_ROWS), "digest", "left_semi").select(own.alias("id")).distinct())
    texts = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Equal texts combine before the shuffle, however many there are.
    variants = texts.join(small_side(ids, ids.count(), SHARED_ROWS), "id", "left_semi").select("text").distinct()

    def form(chunk: list[dict]) -> list[tuple]:
        forms = [canonical(row["text"]) for row in chunk]
        return [(hashed(f), f) for f in forms]

    forms = map_chunks(variants, form, "digest string, form string").distinct()
    least = forms.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("form").alias("least")).where("n > 1")
    return cut(forms.join(least, "digest").where("form != least").select("digest", F.sha2("form", 256).alias("form_sha256")))


def fingerprint_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", hashed: Callable = wide_hash) -> DataFrame:
    """Fingerprints of every text, of the text edited with its successor's start,
    and how alike the text is to the edited text and the successor."""
    marks = mark_edits(docs, doc_id=doc_id, text=text, hashed=hashed)
    odd = collisions(docs, marks, doc_id=doc_id, text=text, hashed=hashed).withColumn("suffix", F.col("form_sha256"))
    told = marks.join(small_side(odd, odd.count(), SHARED_ROWS), ["digest", "form_sha256"], "left")
    return told.select("doc_id", "n_chars", "edited_sha256", F.concat_ws("-", "digest", "suffix").alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next")
