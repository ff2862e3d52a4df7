import math
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossa.operators import grams as g
from glossa.operators import joins, regression
from glossa.operators import words as w
from glossa.plans.texts import _rewritten_sql


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_word_table_keeps_odd_words_and_skips_blank(spark):
    df = spark.createDataFrame([(0, " null  NA\tnan é日本 "), (1, "  "), (2, None)], "text_id long, text string")
    assert rows(w.word_table(df), "text_id", "word_id", "word", "word_len") == [(0, 0, "null", 4), (0, 1, "NA", 2), (0, 2, "nan", 3), (0, 3, "é日本", 3)]


def test_ngram_suffixes_reset_at_passages(spark):
    texts = {4: "sun moon sun tide", 9: "tide", 11: " ", 12: "moon  tide\tsun"}
    df = spark.createDataFrame(list(texts.items()), "text_id long, text string")
    want = set()
    for i, text in texts.items():
        parts = text.split()
        want |= {(i, end, o, " ".join(parts[end - o + 1 : end + 1])) for end in range(len(parts)) for o in range(1, 4) if o <= end + 1}
    assert {tuple(r) for r in w.ngrams(df, 3).select("text_id", "word_id", "order", "ngram").collect()} == want


def test_ngrams_of_one_very_long_text(spark):
    df = spark.range(1).select(F.lit(0).alias("text_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda k: F.concat(F.lit("w"), (k % 977).cast("string"))), " ").alias("text"))
    counts = g.ngram_counts(df, 3)
    assert {r["order"]: r["n"] for r in counts.groupBy("order").agg(F.sum("cnt").alias("n")).collect()} == {0: 100_000, 1: 100_000, 2: 99_999, 3: 99_998}


@pytest.mark.parametrize("head, fit", [(g.HEAD, 9), (1, 9), (2, 1), (g.HEAD, 2)])
def test_ngram_counts_whatever_is_broadcast_or_fits(spark, monkeypatch, head, fit):
    """Small heads send most words and n-grams through shuffles; a small fit takes a
    column for each word or two."""
    monkeypatch.setattr(g, "HEAD", head)
    monkeypatch.setattr(g.Dictionary, "fit", property(lambda self: min(fit, 63 // self.bits)))
    texts = ["a rose is a rose is a rose", "is a  rose\ta", "", None, "daisy"]
    want = {}
    for line in texts:
        parts = (line or "").split()
        for o in range(1, 4):
            for at in range(len(parts) - o + 1):
                key = (o, " ".join(parts[at : at + o]))
                want[key] = want.get(key, 0) + 1
        want[0, ""] = want.get((0, ""), 0) + len(parts)
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    got = g.ngram_counts(df, 3)
    assert rows(got, "order", "ngram", "cnt") == sorted((*k, n) for k, n in want.items())
    needed = spark.createDataFrame([(0, "rose is red"), (1, "a rose tulip")], "text_id long, text string")
    some = g.spelled(g.count_grams(df, 3, needed=needed))
    assert rows(some, "order", "ngram", "cnt") == [(0, "", 13), (1, "a", 5), (1, "is", 3), (1, "rose", 4), (2, "a rose", 4), (2, "rose is", 2)]
    back = g.from_strings(got)
    assert rows(g.spelled(back), "order", "ngram", "cnt") == rows(got, "order", "ngram", "cnt") and back.corpus == 13


def test_words_are_numbered_by_frequency(spark):
    counted = spark.createDataFrame([("b", 2), ("a", 9), ("c", 2), ("d", 30)], "word string, cnt long")
    assert rows(g.dictionary(counted).words, "id", "word") == [(2, "d"), (3, "a"), (4, "b"), (5, "c")]


def test_backoff_values(spark):
    corpus = ["red fox ran", "red fox sat here", "the red hen sat", "a hen ran far", "red red fox"]
    texts = {3: "red fox sat far", 5: "hen unknown red fox ran", 8: "zebra", 9: ""}
    alpha, pseudo, seen = 0.3, 0.5, {}
    for line in corpus:
        parts = line.split()
        for end in range(len(parts)):
            for o in range(1, end + 2):
                key = tuple(parts[end - o + 1 : end + 1])
                seen[key] = seen.get(key, 0) + 1
    size = sum(len(line.split()) for line in corpus)

    def score(parts, at, context):
        failed = 0
        for o in range(min(context, at) + 1, 0, -1):
            gram = tuple(parts[at - o + 1 : at + 1])
            if o == 1 or seen.get(gram):
                top, bottom = (seen.get(gram) or pseudo, size) if o == 1 else (seen[gram], seen[gram[:-1]])
                return -math.log(alpha**failed * top / bottom)
            failed += 1

    own = spark.createDataFrame(list(enumerate(corpus)), "text_id long, text string")
    held = spark.createDataFrame(list(texts.items()), "text_id long, text string")
    want = {(i, at, k): score(t.split(), at, k) for i, t in texts.items() for at in range(len(t.split())) for k in range(3)}
    for counts in (g.count_grams(own, 3), g.count_grams(own, 3, needed=held), g.from_strings(g.ngram_counts(own, 3))):
        scored = g.backoff_surprisal(held, counts, [0, 1, 2], alpha, pseudo).collect()
        assert {(r["text_id"], r["word_id"], k): r[f"ngram_surprisal_context_{k}"] for r in scored for k in range(3)} == pytest.approx(want)


def test_backoff_beyond_the_counted_orders(spark):
    """An order that was never counted has no n-gram with a count."""
    own = spark.createDataFrame([(0, "a b c a b")], "text_id long, text string")
    got = {r["word_id"]: (r["ngram_surprisal_context_1"], r["ngram_surprisal_context_2"]) for r in g.backoff_surprisal(own, g.count_grams(own, 2), [1, 2]).collect()}
    assert got[0] == pytest.approx((math.log(5 / 2),) * 2) and got[1] == pytest.approx((0, 0)) and got[2] == pytest.approx((math.log(2), math.log(2 / 0.4)))


def test_backoff_refuses_a_count_without_history(spark):
    counts = spark.createDataFrame([(0, "", 9), (1, "hen", 3), (2, "red hen", 2)], "order int, ngram string, cnt long")
    with pytest.raises(Exception, match="none of its history"):
        g.backoff_surprisal(spark.createDataFrame([(0, "red hen")], "text_id long, text string"), g.from_strings(counts), [1]).collect()


def test_count_violations(spark):
    counts = spark.createDataFrame([(0, "", 0), (1, "a", 0), (2, "a b", 3)], "order int, ngram string, cnt long")
    assert rows(w.count_violations(counts), "violation") == [("empty corpus",), ("history without count",)]


def test_chunks_count_each_token_once(spark):
    for n, size, stride, want in ((12, 5, 2, [(0, 0), (4, 1), (8, 1)]), (9, 9, 4, [(0, 0)]), (23, 10, 4, [(0, 0), (7, 3), (14, 3)]), (8, 3, 3, [(k, 2 * (k > 0)) for k in range(6)])):
        df = spark.createDataFrame([(0, " ".join(f"t{k}" for k in range(n)))], "text_id long, text string")
        chunks = sorted(w.overlapping_chunks(df, size, stride).collect(), key=lambda c: c["chunk"])
        assert [(c["start"], c["n_dropped"]) for c in chunks] == want
        kept = [k for c in chunks for k in range(c["start"] + c["n_dropped"], c["start"] + c["n_tokens"])]
        assert kept == list(range(n))


def test_boundary_correction(spark):
    tokens = [(7.5, 0.25, 0.75, True), (1.25, 0.5, 0.0, False), (6.0, 1.5, 0.0, True), (2.5, 0.125, 0.0, True), (0.5, 0.0625, 0.0, False)]
    t = spark.createDataFrame([(6, k, *x) for k, x in enumerate(tokens)], "text_id long, token_pos int, raw double, bow_fix double, bos_fix double, is_bow boolean")
    got = {r["word_id"]: (r["surprisal"], r["surprisal_buggy"]) for r in w.boundary_surprisal(t, 0.375).collect()}
    assert got == {0: pytest.approx((7.5 - 0.75 + 1.25 + 1.5, 8.75)), 1: pytest.approx((6.0 - 1.5 + 0.125, 6.0)), 2: pytest.approx((2.5 - 0.125 + 0.5 + 0.375, 3.0))}


def test_boundary_clamps_small_negatives_only(spark):
    ddl = "text_id long, token_pos int, raw double, bow_fix double, bos_fix double, is_bow boolean"
    t = spark.createDataFrame([(0, 0, 0.5, 0.0, 0.500007, True), (1, 0, 0.5, 0.0, 0.75, True)], ddl)
    got = {r["text_id"]: r["surprisal"] for r in w.boundary_surprisal(t, 0.0).collect()}
    assert got[0] == 0.0 and got[1] == pytest.approx(-0.25)


def test_byte_alphabet(spark):
    table = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    odd = [b for b in range(256) if b not in table]
    letters = {b: chr(b) for b in table} | {b: chr(256 + k) for k, b in enumerate(odd)}
    for word in ("abc", "é", "日本", "a\tb", "x­y"):
        got = spark.range(1).select(w.byte_alphabet(F.lit(word))).first()[0]
        assert got == "".join(letters[b] for b in word.encode())


def test_rebuild_from_offsets(spark):
    t = spark.createDataFrame([(0, 0, 0, "Hel"), (0, 1, 3, "lo"), (0, 2, 6, "you")], "text_id int, row int, offset int, token string")
    assert w.rebuild_from_offsets(t).first()["text"] == "Hello you"


def test_tokens_by_the_published_rules(spark):
    cases = {"well-known": ["well-known"], "don't": ["don", "'t"], "dogs'": ["dogs", "'"], "'tis": ["'", "tis"], "1990's": ["1990", "'s"], "rock'n'roll": ["rock", "'n'roll"], "a&b": ["a", "&", "b"],
             "3,000": ["3,000"], "one,two": ["one", ",", "two"], "x,5": ["x", ",", "5"], "7,": ["7", ","], "u.s": ["u.s"], "either/or": ["either", "/", "or"], "naïve": ["naïve"], "": []}
    got = {r["word"]: r["t"] for r in spark.createDataFrame([(w_,) for w_ in cases], "word string").select("word", w.word_tokens(F.col("word")).alias("t")).collect()}
    assert got == cases


def test_punctuation_by_the_published_rules(spark):
    cases = {"„Ja“, sagte er – nein…": ('"Ja," sagte er - nein...', '"Ja", sagte er - nein...'), "it’s ( so ) !": ("it's (so)!", "it's (so)!"), "« oui » 5\xa0% 12\xa0000": ('"oui" 5% 12.000', '"oui" 5% 12,000'), "a—b ; c :d": ("a - b; c:d", "a - b; c:d"), "``x''": (' " x " ',) * 2}
    rows_ = spark.createDataFrame([(t,) for t in cases], "t string").select("t", w.normalise_punctuation(F.col("t")).alias("e"), w.normalise_punctuation(F.col("t"), english=False).alias("o")).collect()
    assert {r["t"]: (r["e"], r["o"]) for r in rows_} == cases


def test_punctuation_in_linear_time(spark):
    """a run of dots took time by the square of its length."""
    cases = ["." * 200_000, "." * 200_000 + '" x', " " * 200_000 + "."]
    began = time.monotonic()
    got = spark.createDataFrame([(t,) for t in cases], "t string").select(w.normalise_punctuation(F.col("t"), english=False).alias("o")).collect()
    assert [r["o"] for r in got] == [cases[0], '"' + "." * 200_000 + " x", " ."]
    assert time.monotonic() - began < 60


def test_punctuation_in_one_walk_as_by_the_rules(spark):
    """both columns share a walk, and texts drawn from the rules' signs, nulls and
    spaces come out as the rules say, one after the other, in DuckDB's engine."""
    draw = random.Random(7)
    signs = list("()%:;.,!?'`\"„“”–—´‘’‚…«»\xa0\r\n\t\x0b\x00<aZ5º日😀") + [" ", " ", "  ", "nº", "cm", "ºC", "''"]
    cases = [None, "", '."\x0b."x', *("".join(draw.choices(signs, k=draw.randrange(1, 60))) for _ in range(5_000))]
    t = F.col("t")
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", w.normalise_punctuation(t).alias("e"), w.normalise_punctuation(t, english=False).alias("o"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("plain(") == 1 and "Exchange" not in plan
    drawn = pd.DataFrame({"k": range(len(cases)), "t": cases})  # noqa: F841
    want = duckdb.sql(f"SELECT k, {_rewritten_sql('t', w.PUNCTUATION_RULES + w.ENGLISH_RULES)}, {_rewritten_sql('t', w.PUNCTUATION_RULES + w.OTHER_RULES)} FROM drawn").fetchall()
    assert rows(df, "k", "e", "o") == sorted(want)


def test_lexicon_needs_every_token(spark):
    words = spark.createDataFrame([(0, 0, "Well-known"), (0, 1, "odd-one"), (0, 2, "?"), (0, 3, " It's,")], "text_id long, word_id int, word string")
    lexicon = spark.createDataFrame([("well-known", 1.5), ("odd", 1.0), ("it", 2.0), ("'s", 0.25)], "token string, value double")
    assert rows(w.lexicon_score(words, lexicon), "word_id", "freq") == [(0, 1.5), (1, None), (2, None), (3, 2.25)]
    assert rows(w.lexicon_score(words, lexicon, constant=1.0), "word_id", "freq") == [(0, 1.0), (1, 1.0), (2, None), (3, 1.0)]


def test_realign_and_prefix(spark):
    p = spark.createDataFrame([(0, "The cat, the dog")], "text_id long, text string")
    r = spark.createDataFrame([(0, 1, "the"), (0, 0, "cat"), (0, 0, "cow")], "text_id long, word_id int, word string")
    assert rows(w.realign_words(r, p).na.fill(-1, ["place"]), "word", "place") == [("cat", 1), ("cow", -1), ("the", 2)]
    assert w.short_passages(w.word_table(p), 5).count() == 1


def test_realigned_places_equal_a_plain_search(spark):
    """Readings by several workers, of a text of 50,000 words and of one that isn't there."""
    import random

    rng = random.Random(2)
    text = [rng.choice(["The", "the,", "cat", "dog", "...", "a"]) for _ in range(50_000)]
    own = spark.createDataFrame([(0, " ".join(text)), (1, "The end")], "text_id long, text string")
    asked = [(w_, rng.choice([0, 0, 0, 1, 2]), rng.randrange(50_000), rng.choice(["the", "CAT!", "cow", "!", "a"])) for w_ in range(3) for _ in range(400)]
    asked += [(9, 0, None, "the"), (9, 0, 5, None)]
    clean = lambda x: x.lower().strip(w.PUNCTUATION)
    texts = {0: [clean(x) for x in text], 1: ["the", "end"]}

    def place(i, at, word):
        if at is None or word is None:
            return None
        return next((k for k in range(at, len(texts.get(i, ()))) if texts[i][k] == clean(word)), None)

    got = w.realign_words(spark.createDataFrame(asked, "worker int, text_id long, word_id int, word string"), own)
    assert sorted(map(str, map(tuple, got.select("worker", "text_id", "word_id", "word", "place").collect()))) == sorted(str((*a, place(*a[1:]))) for a in asked)


def test_class_mass(spark):
    logits = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "position int, vocab_id int, logit double")
    weights = spark.createDataFrame([(1, 1.0)], "vocab_id int, weight double")
    p = math.exp(2) / (math.exp(1) + math.exp(2))
    assert w.class_mass(logits, weights).first()["class_surprisal"] == pytest.approx(-math.log(p))


def test_ngrams_are_counted_as_they_are_spoken(spark):
    """All or the needed n-grams by one shuffle: no dictionary is written or spelled."""
    texts = spark.createDataFrame([(1, "a b  a b"), (2, "b"), (3, None), (4, " ")], "text_id long, text string")
    counted = g.ngram_counts(texts, 3)
    assert "Join" not in counted._jdf.queryExecution().toString()
    want = {(0, "", 5), (1, "a", 2), (1, "b", 3), (2, "a b", 2), (2, "b a", 1), (3, "a b a", 1), (3, "b a b", 1)}
    assert {tuple(r) for r in counted.collect()} == want
    needed = spark.createDataFrame([("a b",), ("b",), ("b b",), ("a b",)], "ngram string")
    few = {(0, "", 5), (1, "b", 3), (2, "a b", 2)}
    assert {tuple(r) for r in g.ngram_counts(texts, 2, needed).collect()} == few
    held, g.HEAD = g.HEAD, 1
    try:
        assert {tuple(r) for r in g.ngram_counts(texts, 2, needed).collect()} == few
    finally:
        g.HEAD = held


@pytest.mark.parametrize("name", ["offset_rebuild", "wrong_lags", "budgets", "boundary_scores"])
def test_texts_are_shuffled_once_and_whole(spark, name):
    from glossa.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_COL") == 1


@pytest.mark.parametrize("head, task", [(g.HEAD, g.TASK_WORDS), (4, 3)])
def test_a_corpus_own_counts_and_surprisal(spark, monkeypatch, head, task):
    """Counts of one aren't kept, frequent ones are broadcast (a small head leaves most to
    the shuffle), and texts keep their words' order."""
    monkeypatch.setattr(g, "HEAD", head)
    monkeypatch.setattr(g, "TASK_WORDS", task)
    texts = {0: "a rose is a rose is a rose", 2: "is a  rose\ta", 3: "", 4: None, 5: "daisy", 9: "a a a a"}
    df = spark.createDataFrame(list(texts.items()), "text_id long, text string")
    parts = {i: (t or "").split() for i, t in texts.items()}
    seen = {}
    for ws in parts.values():
        for o in (1, 2, 3):
            for at in range(len(ws) - o + 1):
                seen[tuple(ws[at : at + o])] = seen.get(tuple(ws[at : at + o]), 0) + 1
    counts = g.own_counts(df, 3)
    own = lambda ws, o: [seen[tuple(ws[at : at + o])] for at in range(len(ws) - o + 1)]
    assert {r["text_id"]: (r["w"], r["c1"], r["c2"], r["c3"]) for r in counts.texts.collect()} == {i: (ws, own(ws, 1), own(ws, 2), own(ws, 3)) for i, ws in parts.items() if ws}
    assert counts.corpus == 17
    scores = F.transform("w", lambda _, k: F.struct(*[s.alias(f"s{c}") for c, s in enumerate(g.own_surprisal(k, counts))]))
    got = {(r["text_id"], r["word_id"]): r for r in joins.handed_out(counts.texts, scores, F.size("w"), ["s2"]).collect()}
    want = {(r["text_id"], r["word_id"]): r for r in joins.add_lags(g.backoff_surprisal(df, g.count_grams(df, 3), [0, 2]), ["ngram_surprisal_context_2"]).collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        other = want[key]
        for c in ("s0", "s2", "prev_s2", "prev2_s2", "prev3_s2"):
            assert r[c] == pytest.approx(other[c.replace("s0", "ngram_surprisal_context_0").replace("s2", "ngram_surprisal_context_2")])


def test_designs_of_words_shuffle_no_words(spark):
    """Lags and folds of words come from their texts' rows; before, every word
    was dealt by text, joined by its key, and written with all its columns."""
    from glossa.plans import studies

    rows, _ = studies.reading_design(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Exchange", "Window", "Join", "Sort "))


@pytest.mark.parametrize("task, bucket", [(g.TASK_WORDS, g.BUCKET_GRAMS), (2, 1)])
def test_own_counts_of_repeated_ids_and_odd_white_space(spark, monkeypatch, task, bucket):
    """Texts are told apart as rows and not by their ids, and tasks part words as
    word_array does; before, the counts of texts with one id ran together."""
    monkeypatch.setattr(g, "TASK_WORDS", task)
    monkeypatch.setattr(g, "BUCKET_GRAMS", bucket)
    texts = [(1, "a b a"), (1, "b a\x1cc b"), (None, "a\u00a0b\u2003a"), (None, "\t"), (2, "é \x1f é")]
    df = spark.createDataFrame(texts, "text_id long, text string")
    spoken = {(r["text_id"], tuple(r["w"])) for r in df.select("text_id", w.word_array(F.col("text")).alias("w")).where("size(w) > 0").collect()}
    counts = g.own_counts(df, 2)
    got = {(r["text_id"], tuple(r["w"])): (r["c1"], r["c2"]) for r in counts.texts.collect()}
    assert set(got) == spoken and counts.corpus == 12
    assert got[1, ("a", "b", "a")] == ([4, 4, 4], [2, 2]) and got[1, ("b", "a\x1cc", "b")] == ([4, 1, 4], [1, 1])
    assert got[None, ("a", "b", "a")] == got[1, ("a", "b", "a")] and got[2, ("é", "\x1f", "é")] == ([2, 1, 2], [1, 1])


def test_words_read_out_of_texts_have_their_lags_and_digests(spark, monkeypatch):
    """What Arrow tasks read out of texts is what windows over words give."""
    monkeypatch.setattr(joins, "SLICE_WORDS", 4)
    df = spark.createDataFrame([(k, " ".join("abcdefgh"[j] * (j + k) for j in range(k % 7))) for k in range(1, 12)] + [(None, "x yy zzz uuuu")], "text_id long, text string")
    texts = df.select("text_id", w.word_array(F.col("text")).alias("w")).where("size(w) > 0")
    read = lambda batch, row, place: {"n": np.array([len(x) for x in batch.column("w").flatten().to_pylist()]), "at": place / 2}
    got = joins.read_out(texts, "n long, at double", read, ["n"], 2, "seed")
    rows = texts.select("text_id", F.posexplode("w").alias("word_id", "word")).select("text_id", "word_id", F.md5(F.concat_ws("|", F.lit("seed"), F.col("text_id").cast("string"), "word_id")).alias("digest"), F.length("word").cast("long").alias("n"), (F.col("word_id") / 2).alias("at"))
    want = joins.add_lags(rows, ["n"], most=2).where("word_id >= 2")
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() > 10
    digests, n, _ = joins.word_digests(texts, 2, "seed")
    assert n == got.count() and sorted(r["digest"] for r in digests.collect()) == sorted(r["digest"] for r in got.collect())


def test_folds_of_many_words_take_one_pass(spark, monkeypatch):
    """the digests about each rank, and a repeated text at a rank; where the guess fails the
    counts by prefixes say the same."""
    df = spark.range(0, 400).select((F.col("id") % 399).alias("text_id"), F.sequence(F.lit(1), 30 + (F.col("id") % 7).cast("int")).alias("w"))
    rows = joins.read_out(df, "n double", lambda batch, row, place: {"n": place / 2}, ["n"], 1, "s")
    digests = joins.word_digests(df, 1, "s")
    fold = lambda d: sorted(tuple(r) for r in regression.assign_folds(rows, ["text_id", "word_id"], 10, "s", d).select("text_id", "word_id", "fold").collect())
    want = fold(digests)
    plain = sorted(rows.select("digest").toPandas()["digest"])
    ranks = [f * (len(plain) - 1) // 10 + 1 for f in range(1, 10)]
    near = regression.digest_near(digests[2], digests[1], ranks)
    assert {r: plain[r - 1] for r in ranks} == {r: d for r, (d, _, _) in near.items()} and all(plain.index(d) == below and plain.count(d) == equal for d, below, equal in near.values())
    monkeypatch.setattr(regression, "MANY_DIGESTS", 0)
    assert fold(digests) == want and digests[1] == len(plain) == len(want)
    monkeypatch.setattr(regression, "SPREAD", 0.0)
    assert regression.digest_near(digests[2], digests[1], ranks) is None and fold(digests) == want
