"""Passages, words and n-grams as DataFrames (text_id, word_id, word)."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut, small_side

#: The punctuation that is stripped from words.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WHITE = r"(?U)\s+"


def word_array(text: Column) -> Column:
    """Words of a passage; a blank passage has none."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


#: What the pattern WHITE leaves, and the signs that split() takes for white besides.
WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_WHITE = "\x1c\x1d\x1e\x1f"


def words_of(text: str) -> list[str]:
    """word_array of a string inside a task."""
    return WORD.findall(text) if any(c in text for c in NOT_WHITE) else text.split()


def by_text(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt by text. Passages that are dealt while they are whole are shuffled once:
    windows and joins by text over their words find these where they belong."""
    return rows.repartition(parts, "text_id") if parts else rows.repartition("text_id")


def word_table(passages: DataFrame, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """One row a word with its 0-based place and length in code points."""
    words = passages.select(F.col(text_id).alias("text_id"), F.posexplode(word_array(F.col(text))).alias("word_id", "word"))
    return words.withColumn("word_len", F.length("word"))


def clean_word(word: Column) -> Column:
    """Lower case without ASCII punctuation at the ends."""
    return F.btrim(F.lower(word), F.lit(PUNCTUATION))


def latin_lower(word: Column) -> Column:
    """Only a to z (the empty word passes)."""
    return word.rlike(r"^[a-z]*\z")


def latin_only(word: Column) -> Column:
    """Only letters a to z of either case."""
    return word.rlike(r"^[A-Za-z]*\z")


def has_punctuation_or_space(word: Column) -> Column:
    """Any ASCII punctuation or white space."""
    return word.rlike(r"[\p{Punct}\s]")


def replace_literals(text: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements, in order."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)


def point_fixes(word: Column, fixes: dict[str, str]) -> Column:
    """Whole values that are replaced."""
    return reduce(lambda c, p: F.when(word == p[0], p[1]).otherwise(c), fixes.items(), word)


#: The published rules of the Moses punctuation normaliser, in their order,
#: as (pattern, replacement); those of one language's quotes and numbers apart.
PUNCTUATION_RULES = [
    ("\r", ""), (r"\(", " ("), (r"\)", ") "), (" +", " "), (r"\) ([.!:?;,])", ")$1"), (r"\( ", "("), (r" \)", ")"), ("([0-9]) %", "$1%"), (" :", ":"), (" ;", ";"),
    ("`", "'"), ("''", ' " '), ("[„“”]", '"'), ("–", "-"), ("—", " - "), (" +", " "), ("´", "'"), ("([A-Za-z])[‘’]([A-Za-z])", "$1'$2"), ("[‘‚]", "'"), ("’", '"'), ("''", '"'), ("…", "..."),
    (" « ", ' "'), ("« ?", '"'), (" » ", '" '), (" ?»", '"'), ("\xa0%", "%"), ("nº\xa0", "nº "), ("\xa0:", ":"), ("\xa0ºC", " ºC"), ("\xa0cm", " cm"), ("\xa0([?!;])", "$1"), (",\xa0", ", "), (" +", " "),
]
ENGLISH_RULES = [('"([,.]+)', '$1"'), ("([0-9])\xa0([0-9])", "$1.$2")]
OTHER_RULES = [(',"', '",'), (r'([.]+)"(\s*[^<])', '"$1$2'), ("([0-9])\xa0([0-9])", "$1,$2")]
#: The published rules that part a word into tokens in English: other signs
#: and commas outside numbers stand alone, an apostrophe goes to what follows it.
#: A hyphen parts nothing. {a} stands for letters, {n} for numbers.
TOKEN_RULES = [
    (r"([^{a}{n}\s.'`,-])", " $1 "), ("([^{n}]),", "$1 , "), (",([^{n}])", " , $1"), ("([{n}]),$", "$1 ,"),
    ("([^{a}])'([^{a}])", "$1 ' $2"), ("([^{a}{n}])'([{a}])", "$1 ' $2"), ("([{a}])'([^{a}])", "$1 ' $2"), ("([{a}])'([{a}])", "$1 '$2"), ("([{n}])'(s)", "$1 '$2"),
]


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular replacements, in order."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), rules, text)


def normalise_punctuation(text: Column, english: bool = True) -> Column:
    """Typographic punctuation and its spaces in plain form, in time linear in the
    text. Both languages' forms come from one walk of the common rules, which Spark makes
    once for both columns."""

    def rewrite(texts: pa.Array, rules: list[tuple[str, str]]) -> pa.Array:
        for pattern, to in rules:  # a single space is a run that stays as it is: runs are met from two on
            texts = pc.replace_substring_regex(texts, "  +" if pattern == " +" else pattern, to.replace("$", "\\"))
        return texts

    def plain(texts: pa.Array) -> pa.Array:
        common = rewrite(texts, PUNCTUATION_RULES)
        return pa.StructArray.from_arrays([rewrite(common, ENGLISH_RULES), rewrite(common, OTHER_RULES)], ["english", "other"])

    return F.arrow_udf(plain, "english string, other string")(text.cast("string"))["english" if english else "other"]


def word_tokens(word: Column) -> Column:
    """The tokens of a cleaned word."""
    rules = [(pattern.replace("{a}", r"\p{IsAlphabetic}").replace("{n}", r"\p{N}"), to) for pattern, to in TOKEN_RULES]
    return F.filter(F.split(rewritten(F.concat(F.lit(" "), word, F.lit(" ")), rules), " +"), lambda t: t != "")


def byte_alphabet(word: Column) -> Column:
    """P10: a word's UTF-8 bytes in the printable alphabet of byte-level vocabularies."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "".join(map(chr, odd)), "".join(chr(256 + k) for k in range(len(odd))))


def resolve_duplicates(texts: DataFrame, key: str, preferred: Column) -> DataFrame:
    """T4: distinct rows; where a key has several texts, those that meet the predicate."""
    distinct = texts.distinct()
    return distinct.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).where((F.col("n") == 1) | preferred).drop("n")


def rebuild_passages(words: DataFrame, key: str = "text_id", order: str = "word_id", word: str = "word", distinct: bool = True) -> DataFrame:
    """Passages from word rows that readers repeat, words by place."""
    rows = words.select(key, order, word).distinct() if distinct else words
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(word).alias("word"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["word"]), " ").alias("text"))


def rebuild_from_offsets(tokens: DataFrame, key: str = "text_id", row: str = "row", offset: str = "offset", token: str = "token") -> DataFrame:
    """Passages from sub-word tokens; a gap in the offsets after a token is a space."""
    following = F.lead(offset).over(Window.partitionBy(key).orderBy(row))
    spaced = tokens.withColumn("piece", F.concat(F.col(token), F.when(following - F.col(offset) > F.length(token), " ").otherwise("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(row).alias("at"), "piece")))
    return spaced.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["piece"]), "").alias("text"))


def reference_tokens(readings: DataFrame, passages: DataFrame) -> DataFrame:
    """The passage's word at each reading's place, null where it has none."""
    tokens = word_table(passages).select("text_id", "word_id", F.col("word").alias("ref_token"))
    return readings.join(tokens, ["text_id", "word_id"], "left")


def realign_words(readings: DataFrame, passages: DataFrame) -> DataFrame:
    """T5: the first place at or after word_id where the passage has the cleaned word;
    null place where it has none.

    A search for the next equal word, as of each question: places of a passage's words
    and the distinct questions about them lie in one order by (text, word), the last
    place first, and a question takes the last place that it has passed."""
    clean = clean_word(F.col("word"))
    asked = readings.select("text_id", clean.alias("clean"), F.col("word_id").cast("long").alias("at")).distinct().withColumn("place", F.lit(None).cast("long"))
    places = word_table(passages).select("text_id", clean.alias("clean"), F.col("word_id").cast("long").alias("at"), F.col("word_id").cast("long").alias("place"))
    order = Window.partitionBy("text_id", "clean").orderBy(F.desc("at"), F.col("place").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = places.unionByName(asked).withColumn("next", F.last("place", ignorenulls=True).over(order)).where("place IS NULL")
    answers = passed.select("text_id", F.col("clean").alias("_clean"), F.col("at").alias("_at"), F.col("next").cast("int").alias("place"))
    own = readings.withColumns({"_clean": clean, "_at": F.col("word_id").cast("long")})
    return own.join(answers, ["text_id", "_clean", "_at"], "left").drop("_clean", "_at")


def prefix_sample(words: DataFrame, k: int) -> DataFrame:
    """The first k words of every passage."""
    return words.where(F.col("word_id") < k)


def short_passages(words: DataFrame, k: int) -> DataFrame:
    """T7's violations: passages with fewer than k words."""
    return words.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_words")).where(F.col("n_words") < k)


def subsample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """N rows in the order of a seeded digest of the key (a top-n, not a sort of all)."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def ngrams(passages: DataFrame, max_order: int) -> DataFrame:
    """(order, ngram, text_id, word_id) for every n-gram ending at a word. A
    passage's n-grams are built in one row, each order from the one below, and
    handed out once, so memory grows with the passage's length."""
    grams = passages.select("text_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("g1", F.col("w"))
    for o in range(2, max_order + 1):
        n = F.greatest(F.size("w") - (o - 1), F.lit(0))
        grams = grams.withColumn(f"g{o}", F.zip_with(F.slice(f"g{o - 1}", F.lit(1), n), F.slice("w", F.lit(o), n), lambda head, word: F.concat_ws(" ", head, word)))
    ending = lambda o: F.transform(f"g{o}", lambda g, k: F.struct((k + (o - 1)).alias("word_id"), F.lit(o).alias("order"), g.alias("ngram")))
    rows = [ending(o) for o in range(1, max_order + 1)]
    return grams.select("text_id", F.inline(F.concat(*rows)))


def count_violations(counts: DataFrame) -> DataFrame:
    """N-grams with a count whose history has none, and an empty corpus."""
    parents = counts.select((F.col("order") + 1).alias("order"), F.col("ngram").alias("history"), F.col("cnt").alias("d"))
    grams = counts.where("order > 1").withColumn("history", F.regexp_replace("ngram", r" [^ ]*$", ""))
    orphan = grams.join(parents, ["order", "history"], "left").where("cnt > 0 and coalesce(d, 0) <= 0").select("order", "ngram", F.lit("history without count").alias("violation"))
    return orphan.unionByName(counts.where("order = 0 and cnt <= 0").select("order", "ngram", F.lit("empty corpus").alias("violation")))


def word_frequency(corpus: DataFrame, study: DataFrame) -> DataFrame:
    """Corpus counts of the study's words, from 1 for words it lacks."""
    wanted = cut(study.select("word").distinct())
    counts = word_table(corpus).join(small_side(wanted, wanted.count()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return wanted.join(counts, "word", "left").select("word", (F.coalesce("cnt", F.lit(0)) + 1).alias("freq_count"))


def lexicon_score(words: DataFrame, lexicon: DataFrame, constant: float | None = None) -> DataFrame:
    """The sum of a word's token values; null if any token is unknown or the word
    cleans to nothing. Scored once a distinct word. A language without a lexicon has
    the same constant for every word that isn't empty."""
    clean = clean_word(F.trim(F.col("word")))
    if constant is not None:
        return words.withColumn("freq", F.when(clean != "", F.lit(constant)))
    distinct = words.select("word").distinct()
    tokens = distinct.select("word", F.explode_outer(word_tokens(clean)).alias("token"))
    scored = tokens.join(lexicon.select("token", "value"), "token", "left").groupBy("word").agg(
        F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).alias("freq")
    )
    return words.join(scored, "word", "left")


def context_windows(words: DataFrame, sizes: list[int]) -> DataFrame:
    """At most k preceding words of the same passage; uses_bos where there are none."""
    before = Window.partitionBy("text_id").orderBy("word_id")
    columns = [F.collect_list("word").over(before.rowsBetween(-k, -1)).alias(f"c{k}") for k in sizes]
    wide = words.select("text_id", "word_id", F.col("word").alias("target"), *columns)
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("context")) for k in sizes])
    return wide.select("text_id", "word_id", "target", F.inline(items)).withColumn("uses_bos", F.size("context") == 0)


def overlapping_chunks(passages: DataFrame, size: int, stride: int) -> DataFrame:
    """Chunks of size tokens, each beginning size - stride + 1 tokens after the
    one before; every chunk but the first drops the stride - 1 tokens that it
    shares, so each token counts once."""
    lengths = passages.select("text_id", F.size(word_array(F.col("text"))).alias("n")).where("n > 0")
    step = size - stride + 1
    chunks = F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / F.lit(float(step))).cast("int"))
    rows = lengths.select("text_id", "n", F.explode(chunks).alias("chunk")).withColumn("start", F.col("chunk") * step)
    dropped = F.when(F.col("chunk") == 0, 0).otherwise(stride - 1)
    return rows.select("text_id", "chunk", "start", F.least(F.lit(size), F.col("n") - F.col("start")).alias("n_tokens"), dropped.alias("n_dropped"))


def chunk_tokens(passages: DataFrame, size: int, stride: int) -> DataFrame:
    """The chunks with their tokens, and place, the first token that counts: what
    scores chunks takes tokens whole and keeps the scores from n_dropped on."""
    chunks = overlapping_chunks(passages, size, stride)
    own = passages.select("text_id", word_array(F.col("text")).alias("w"))
    cut_out = F.slice("w", F.col("start") + 1, F.col("n_tokens"))
    return chunks.join(own, "text_id").withColumns({"tokens": cut_out, "place": F.col("start") + F.col("n_dropped")}).drop("w")


def kept_tokens(chunks: DataFrame) -> DataFrame:
    """(text_id, token_pos, token, chunk) of the tokens that count, each once."""
    return chunks.select("text_id", "chunk", "place", "n_dropped", F.posexplode("tokens").alias("k", "token")).where("k >= n_dropped").select("text_id", (F.col("place") + F.col("k") - F.col("n_dropped")).alias("token_pos"), "token", "chunk")


def word_ids_of_tokens(tokens: DataFrame) -> DataFrame:
    """A running count of word starts; a token ends a word where the next starts one."""
    place = Window.partitionBy("text_id").orderBy("token_pos")
    return tokens.withColumn("word_id", F.sum(F.col("is_bow").cast("int")).over(place) - 1).withColumn("is_eow", F.lead("is_bow", 1, True).over(place))


def boundary_surprisal(tokens: DataFrame, final: Column | float, tolerance: float = 1e-5) -> DataFrame:
    """Word surprisal from token scores (raw, bow_fix, bos_fix, is_bow): less the
    mass of starting at its first token, plus that of stopping after its last
    (final at the passage's end); values above -tolerance clamp at 0, lower ones
    stay negative for the checks."""
    place = Window.partitionBy("text_id").orderBy("token_pos")
    marked = word_ids_of_tokens(tokens).withColumn("next_fix", F.coalesce(F.lead("bow_fix").over(place), F.lit(final) if isinstance(final, float) else final))
    first = F.when(F.col("is_bow"), F.when(F.col("token_pos") == 0, F.col("bos_fix")).otherwise(F.col("bow_fix"))).otherwise(0.0)
    corrected = F.sum(F.col("raw") - first + F.when(F.col("is_eow"), F.col("next_fix")).otherwise(0.0))
    return marked.groupBy("text_id", "word_id").agg(
        F.when((corrected < 0) & (corrected >= -tolerance), 0.0).otherwise(corrected).alias("surprisal"), F.sum("raw").alias("surprisal_buggy")
    )


def class_mass(logits: DataFrame, weights: DataFrame) -> DataFrame:
    """-log of the weighted probability of a token class, from long rows
    (position, vocab_id, logit) and class weights (vocab_id, weight)."""
    top = logits.groupBy("position").agg(F.max("logit").alias("top"))
    scaled = logits.join(top, "position").join(small_side(weights, weights.count()), "vocab_id", "left")
    mass = F.exp(F.col("logit") - F.col("top"))
    return scaled.groupBy("position").agg((F.log(F.sum(mass)) - F.log(F.sum(mass * F.coalesce("weight", F.lit(0.0))))).alias("class_surprisal"))
