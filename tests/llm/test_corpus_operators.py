"""Resampling, byte-string dedup and divergence: odd rows and plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa.llm import divergence, resampling, suffix_dedup
from glossa.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, bucket long, n int, rank int, first string"
rng = random.Random(5)
SIGNS = "ab cd eé日\n"


def junk(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(SIGNS) for _ in range(n))


SHARED = junk(260, 1)
TEXTS = [
    (1, SHARED + junk(90, 2)), (2, junk(50, 3) + SHARED), (3, SHARED + junk(90, 2)), (3, SHARED + junk(90, 2)), (4, "x" * 900), (5, "abc" * 200 + junk(80, 4)), (6, None), (7, ""), (8, junk(120, 5)),
    (None, junk(40, 6) + SHARED[20:250] + junk(40, 7)), (None, None), (9, junk(700, 8) + SHARED), (9, "same id " * 60), (10, " ".join(f"word{k % 7}" for k in range(400))),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "en", "de"][k % 4], [None, "", "s", "t"][k % 3], None, "k", -k, k, 1, 2, "f") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.mark.parametrize("name", ["op11_resampling", "op12_suffix_dedup", "op13_divergence"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want, got = con.execute(ORACLES[name]).fetch_df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    form = lambda df: df[columns].astype(object).where(df[columns].notna(), None).sort_values(columns, key=lambda c: c.astype(str)).reset_index(drop=True)
    assert columns == sorted(got.columns)
    pd.testing.assert_frame_equal(form(got), form(want), check_dtype=False)


def test_empty_tables(spark, empty, docs):
    assert resampling.resample(empty, docs.select("text")).count() == 0 and suffix_dedup.remove_copies(empty).count() == 0 and divergence.source_divergence(empty).count() == 0
    alone = resampling.resample(docs, empty.select("text")).collect()
    assert sum(r["rank"] is not None for r in alone) == sum(r["n_words"] >= 20 for r in alone) // 4 > 0


def plain_removal(rows, keep_first):
    """Every window compared with all others, in the order of id, text hash and place."""
    met = Counter()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2]))
    for k in order:
        data = (rows[k][1] or "").encode()
        met.update(data[i : i + 200] for i in range(len(data) - 199))
    seen, out, known = set(), [None] * len(rows), {}
    for k in order:
        i, text, _ = rows[k]
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 199):
            window = data[at : at + 200]
            if (window in seen) if keep_first else met[window] > 1:
                gone[at : at + 200] = b"\1" * 200
            seen.add(window)
        gone = known.setdefault((i, text), gone) if keep_first else gone
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[k] = (i, len(data), len(data) - len(kept), bytes(gone).strip(b"\0").count(b"\0\1") + (1 in gone), hashlib.sha256(kept).hexdigest())
    return Counter(out)


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("crowd, broadcast", [(suffix_dedup.CROWD, 1000), (0, 0)])
def test_removal_equals_a_plain_one(spark, docs, monkeypatch, keep_first, crowd, broadcast):
    """Also where every anchor is a crowded one and nothing is broadcast."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "KEY_ROWS", broadcast)
    monkeypatch.setattr(suffix_dedup, "TEXT_ROWS", broadcast)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows = [(r["doc_id"], r["text"], r["h"]) for r in hashed]
    got = suffix_dedup.remove_copies(docs, keep_first=keep_first).collect()
    assert Counter(tuple(r) for r in got) == plain_removal(rows, keep_first)
    assert sum(r["n_removed"] for r in got) > 2000


def test_spans_and_bytes_that_are_left(docs):
    for r in suffix_dedup.remove_copies(docs, keep_bytes=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["removed"]) == 2 * r["n_spans"]
        assert sum(b - a for a, b in zip(r["removed"][::2], r["removed"][1::2], strict=True)) == r["n_removed"]


def test_a_long_text_is_the_same_in_slices(spark, monkeypatch):
    text = junk(3000, 11)
    docs = spark.createDataFrame([(1, text + text[500:1500] + "y" * 700), (2, text[100:900])], "doc_id long, text string")
    whole = suffix_dedup.remove_copies(docs, keep_first=False).collect()
    monkeypatch.setattr(suffix_dedup, "SLICE", 256)
    assert sorted(suffix_dedup.remove_copies(docs, keep_first=False).collect()) == sorted(whole) and sum(r["n_removed"] for r in whole) > 2000


@settings(deadline=None, max_examples=60)
@given(st.text("ab", min_size=1, max_size=40), st.integers(0, 10**6))
def test_longest_previous_factors(text, seed):
    """Against all earlier positions, at places in any order."""
    order = sorted(range(len(text)), key=lambda k: text[k:])
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), min(len(text) - a, len(text) - b))  # noqa: B905, E731
    place = list(range(len(text)))
    random.Random(seed).shuffle(place)
    common = [0, *[shared(a, b) for a, b in zip(order, order[1:], strict=False)]]
    got = suffix_dedup.longest_previous([place[k] for k in order], common)
    assert got == [max((shared(a, b) for b in range(len(text)) if place[b] < place[a]), default=0) for a in order]


def test_buckets_are_crc32_of_runs():
    text = "Don't STOP été 3x"
    words = [w for w in "don t stop été 3x".split()]
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    n, met = resampling.buckets(text)
    assert n == len(words) and met.tolist() == [zlib.crc32(r.encode()) % 10000 for r in runs]
    assert resampling.buckets(None)[0] == resampling.buckets("!? \n")[0] == 0


def test_bracket_widens_until_it_holds_the_cutoff(spark, monkeypatch):
    """A sketch that says nonsense costs rounds, not results."""
    rows = spark.createDataFrame([(k, 40, 79, 0, (k * 7919) % 50) for k in range(3000)], "doc_id long, n_words long, n_features long, weight long, score long")
    monkeypatch.setattr(F, "percentile_approx", lambda column, at, accuracy: F.array(F.lit(48), F.lit(49)))
    low, high, above = resampling.bracket(rows, 3000, 1000, "score")
    assert (low, high, above) == (0, 49, 0)
    monkeypatch.undo()
    got = resampling.draw(rows, share=33).where("rank is not null").orderBy("rank").collect()
    want = sorted(rows.collect(), key=lambda r: (-r["score"], r["doc_id"]))[:990]
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want] and [r["rank"] for r in got] == list(range(1, 991))


def test_resampling_takes_what_is_like_the_target(spark, docs):
    alike, other = "red green blue cyan pink".split(), "one two three four five".split()
    say = lambda words, k: " ".join(random.Random(k).choices(words, k=60))
    rows = [(k, say(alike if k % 4 == 0 else other, k)) for k in range(200)]
    drawn = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(say(alike, 999),)], "text string"))
    top, weights = drawn.where("rank is not null").collect(), {k: {r["weight"] for r in drawn.collect() if (r["doc_id"] % 4 == 0) is k} for k in (True, False)}
    assert len(top) == 50 and min(weights[True]) > max(weights[False]) and sum(r["doc_id"] % 4 == 0 for r in top) > 35
    odd = resampling.resample(docs.withColumn("key", F.col("source")), docs.select("text"), carry=("key", "bucket"))
    assert odd.count() == len(TEXTS) and {"key", "bucket"} <= set(odd.columns)
    assert {r["weight"] for r in odd.where("n_words = 0").collect()} == {0}


def test_divergence_equals_a_plain_one(spark, monkeypatch):
    """Exact sums over all terms with small blocks and cells; a group without terms, a
    language without kept terms, a source that holds a third of all rows."""
    vocabulary = [f"{a}{b}" for a in "ka ti ro nu".split() for b in "ab cd efg é".split()]
    weights = [2 ** -(k / 3) for k in range(len(vocabulary))]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))).title(), "en" if k % 5 else None, "s0" if k % 3 == 0 else f"s{k % 4 + 1}") for k in range(400)]
    rows += [(None, None, "xx", "a"), (1, "lone words", "xx", None), (2, "12 34", "en", "none"), (None, None, "one", "one")]
    monkeypatch.setattr(divergence, "DEALT", 3)
    monkeypatch.setattr(divergence, "CELL_WORDS", 40)
    monkeypatch.setattr(divergence, "HELD", 5)
    got = divergence.source_divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), least_docs=10, top=3).collect()
    count, in_docs, groups = Counter(), Counter(), {(r[2] or "", r[3] or "") for r in rows}
    for _, text, lang, source in rows:
        terms = [t for t in (text or "").lower().split() if not t[0].isdigit()]
        count.update((lang or "", source or "", t) for t in terms)
        in_docs.update({(lang or "", t) for t in terms})
    kept = {lang: [t for (l, t), n in in_docs.items() if l == lang and n >= 10] for lang, _ in groups}
    rate = lambda ns, k: 1 + 10**9 * (ns[k] + 5) // (sum(ns) + 5 * len(ns))
    of = lambda lang, source: [count[lang, source, t] for t in kept[lang]]
    want = set()
    for lang, source in groups:
        own, terms = of(lang, source), kept[lang]
        every = [sum(count[lang, s, t] for x, s in groups if x == lang) for t in terms]
        pairs = [(-sum(abs(rate(own, k) - rate(of(lang, s), k)) for k in range(len(terms))), s) for x, s in groups if x == lang and s != source]
        over = [(rate(every, k) - rate(own, k), t) for k, t in enumerate(terms) if own[k] and rate(own, k) > rate(every, k)]
        for part, found, most in (("pair", pairs, 99), ("term", over, 3)):
            want |= {(lang, source, part, item, -value, k) for k, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1) if k <= most}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 40
