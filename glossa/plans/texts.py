"""Queries of the word and text operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.operators import grams, words
from glossa.plans.base import SQL_WORDS, WORDS, held_out, passages, query
from glossa.session import table

SQL_HELD = f"hwords AS (SELECT text_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS word_id FROM (SELECT item_id AS text_id, {WORDS} AS w FROM benchmark))"
PUNCT = words.PUNCTUATION.replace("'", "''")
#: The byte alphabet as SQL: bytes that are no printable sign move to 256 and on.
SQL_BYTES = """list_reduce(list_transform(range(octet_length(encode(word))), lambda i: chr(CASE WHEN byte(i) < 33 THEN 256 + byte(i) WHEN byte(i) BETWEEN 127 AND 160 THEN 162 + byte(i) WHEN byte(i) = 173 THEN 323 ELSE byte(i) END)), lambda a, b: a || b)""".replace("byte(i)", "('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::INT")


@query(f"""WITH {SQL_WORDS} SELECT text_id, word_id, replace(replace(word, 'th', 'T.'), 'er,', 'r') AS fixed, CASE word WHEN 'the' THEN '90%' WHEN 'de' THEN 'von' ELSE word END AS point,
 trim(lower(word), '{PUNCT}') AS clean, regexp_full_match(word, '[a-z]*') AS lower_latin, regexp_full_match(word, '[A-Za-z]*') AS latin, regexp_matches(word, '[!-/:-@\\[-`{{-~[:space:]]') AS signs FROM words""")
def word_forms(spark, sf_dir):
    """P6, P7, P8, P11, P12."""
    w, c = words.word_table(passages(spark, sf_dir)), F.col("word")
    return w.select(
        "text_id", "word_id", words.replace_literals(c, {"th": "T.", "er,": "r"}).alias("fixed"), words.point_fixes(c, {"the": "90%", "de": "von"}).alias("point"), words.clean_word(c).alias("clean"),
        words.latin_lower(c).alias("lower_latin"), words.latin_only(c).alias("latin"), words.has_punctuation_or_space(c).alias("signs"),
    )


@query(f"WITH {SQL_HELD} SELECT text_id, word_id, {SQL_BYTES} AS coded FROM hwords")
def byte_alphabet(spark, sf_dir):
    """P10."""
    return words.word_table(held_out(spark, sf_dir)).select("text_id", "word_id", words.byte_alphabet(F.col("word")).alias("coded"))


def _rewritten_sql(text: str, rules: list[tuple[str, str]]) -> str:
    """The rules for DuckDB's engine, which writes groups with a backslash and knows
    letters and numbers by their category."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    for pattern, to in rules:
        text = f"regexp_replace({text}, {quoted(pattern.replace('{a}', r'\p{L}').replace('{n}', r'\p{N}'))}, {quoted(to.replace('$', chr(92)))}, 'g')"
    return text


@query(f"SELECT doc_id, {_rewritten_sql('text', words.PUNCTUATION_RULES + words.ENGLISH_RULES)} AS text, {_rewritten_sql('text', words.PUNCTUATION_RULES + words.OTHER_RULES)} AS other FROM documents")
def plain_punctuation(spark, sf_dir):
    """P9, by the rules for English and for other languages."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", words.normalise_punctuation(text).alias("text"), words.normalise_punctuation(text, english=False).alias("other"))


@query(f"WITH {SQL_WORDS} SELECT text_id, string_agg(word, ' ' ORDER BY word_id) AS text FROM words GROUP BY text_id")
def offset_rebuild(spark, sf_dir):
    """Every word cut in two tokens with their offsets, and put together again."""
    w = words.word_table(words.by_text(passages(spark, sf_dir)))
    starts = w.withColumn("start", F.sum(F.col("word_len") + 1).over(Window.partitionBy("text_id").orderBy("word_id")) - F.col("word_len") - 1)
    halves = [(2 * F.col("word_id"), F.substring("word", 1, 3), F.col("start")), (2 * F.col("word_id") + 1, F.expr("substring(word, 4)"), F.col("start") + F.least(F.lit(3), F.col("word_len")))]
    tokens = starts.select("text_id", F.inline(F.array(*[F.struct(row.alias("row"), token.alias("token"), at.alias("offset")) for row, token, at in halves])))
    return words.rebuild_from_offsets(tokens.where("token != ''"))


@query("""WITH d AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM d)
SELECT user_id, event_type FROM n WHERE n = 1 OR event_type LIKE '%i%'""")
def duplicate_texts(spark, sf_dir):
    """T4: distinct rows, and of several of a key those that a predicate wants."""
    return words.resolve_duplicates(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", F.col("event_type").like("%i%"))


@query(f"""WITH {SQL_HELD}, c AS (SELECT text_id, word_id, word, trim(lower(word), '{PUNCT}') AS clean FROM hwords), r AS (SELECT text_id, greatest(word_id - 2, 0) AS shown, word, clean, word_id AS own FROM c)
SELECT r.text_id, r.own, r.word, min(p.word_id) AS place, any_value(t.word) AS ref_token FROM r LEFT JOIN c p ON p.text_id = r.text_id AND p.word_id >= r.shown AND p.clean = r.clean
LEFT JOIN c t ON t.text_id = r.text_id AND t.word_id = r.shown GROUP BY ALL""")
def realigned_words(spark, sf_dir):
    """Readings whose place lies two words early, found again from there on."""
    texts = held_out(spark, sf_dir)
    shifted = words.word_table(texts).select("text_id", F.greatest(F.col("word_id") - 2, F.lit(0)).alias("word_id"), "word", F.col("word_id").alias("own"))
    return words.realign_words(words.reference_tokens(shifted, texts), texts).select("text_id", "own", "word", "place", "ref_token")


SQL_ODD = """odd AS (SELECT text_id, word_id, CASE word_id % 9 WHEN 4 THEN '"?!"' WHEN 5 THEN word || chr(39) || 's' WHEN 6 THEN word || '-' || word WHEN 7 THEN word || '&' || word || ',' ELSE word END AS word FROM hwords)"""
SQL_TOKENS = f"unnest(string_split_regex({_rewritten_sql(f"' ' || trim(lower(word), '{PUNCT}') || ' '", words.TOKEN_RULES)}, ' +')) AS token"


def _odd_words(spark, sf_dir):
    """Words of the benchmark, some with signs, apostrophes and hyphens, some of signs alone."""
    c, k = F.col("word"), F.col("word_id") % 9
    joined = F.when(k == 4, '"?!"').when(k == 5, F.concat(c, F.lit("'s"))).when(k == 6, F.concat_ws("-", c, c)).when(k == 7, F.concat(c, F.lit("&"), c, F.lit(","))).otherwise(c)
    return words.word_table(held_out(spark, sf_dir)).select("text_id", "word_id", joined.alias("word"))


@query(f"WITH {SQL_HELD}, {SQL_ODD} SELECT text_id, word_id, word, CASE WHEN trim(lower(trim(word)), '{PUNCT}') <> '' THEN 1.0::DOUBLE END AS freq FROM odd")
def constant_frequency(spark, sf_dir):
    """T8 for a language without a lexicon: words of signs alone have no value."""
    w = _odd_words(spark, sf_dir)
    return words.lexicon_score(w, w, constant=1.0).select("text_id", "word_id", "word", "freq")


@query(f"""WITH {SQL_WORDS}, {SQL_HELD}, {SQL_ODD},
lex AS (SELECT token, count(*)::DOUBLE AS value FROM (SELECT {SQL_TOKENS} FROM words) WHERE token <> '' GROUP BY token HAVING count(*) >= 2),
tok AS (SELECT word, {SQL_TOKENS} FROM (SELECT DISTINCT word FROM odd)),
scored AS (SELECT word, CASE WHEN count(value) = count(*) THEN sum(value) END AS freq FROM tok LEFT JOIN lex USING (token) WHERE token <> '' GROUP BY word)
SELECT text_id, word_id, word, freq FROM odd LEFT JOIN scored USING (word)""")
def lexicon_frequency(spark, sf_dir):
    """T8 with the corpus's tokens as lexicon: a word's tokens all count or none does."""
    spoken = words.word_table(passages(spark, sf_dir)).groupBy(words.clean_word(F.col("word")).alias("clean")).agg(F.count(F.lit(1)).alias("n"))
    lexicon = spoken.select(F.explode(words.word_tokens(F.col("clean"))).alias("token"), "n").groupBy("token").agg(F.sum("n").cast("double").alias("value"))
    scored = words.lexicon_score(_odd_words(spark, sf_dir), lexicon.where("value >= 2"))
    return scored.select("text_id", "word_id", "word", "freq")


@query(f"""WITH {SQL_WORDS}, f AS (SELECT word, lead(word) OVER (PARTITION BY text_id ORDER BY word_id) AS following FROM words),
uni AS (SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) >= 2)
SELECT 2 AS "order", word || ' ' || following AS ngram, 'history without count' AS violation FROM f WHERE following IS NOT NULL AND word NOT IN (SELECT word FROM uni) GROUP BY word, following""")
def count_violations(spark, sf_dir):
    """A count table that lost the words seen once."""
    counts = grams.ngram_counts(passages(spark, sf_dir), 2)
    return words.count_violations(counts.where("order != 1 or cnt >= 2"))


@query("""WITH r AS (SELECT user_id AS position, event_id % 50 AS vocab_id, value / 100 AS logit FROM events), w AS (SELECT DISTINCT vocab_id, 1.0::DOUBLE / (1 + vocab_id) AS weight FROM r WHERE logit > 4),
t AS (SELECT position, max(logit) AS top FROM r GROUP BY position)
SELECT r.position, round(ln(sum(exp(logit - top))) - ln(nullif(sum(exp(logit - top) * coalesce(weight, 0)), 0)), 9) AS class_surprisal FROM r JOIN t USING (position) LEFT JOIN w USING (vocab_id) GROUP BY r.position""")
def class_mass(spark, sf_dir):
    """T18."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("position"), (F.col("event_id") % 50).alias("vocab_id"), (F.col("value") / 100).alias("logit"))
    weights = rows.where("logit > 4").select("vocab_id", (1 / (1 + F.col("vocab_id"))).alias("weight")).distinct()
    m = words.class_mass(rows, weights)
    return m.select("position", F.round("class_surprisal", 9).alias("class_surprisal"))
