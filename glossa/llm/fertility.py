"""Quality rules over a public tokeniser's fertility.

Base counts first: words, their characters, symbols, repeated lines and words
in repeated eight-word windows; too few words or too much repetition fails. A
text that passes is tokenised whole with a public byte-level vocabulary, which
measures characters per token, the share of byte-fallback tokens (pieces that
hold no whole character) and the entropy of its tokens in bits.

The bands for the three come from the texts themselves: per script and language
the quartiles over all texts that pass the base rules, and limits SPREAD times
the distance between the quartiles beyond them. Entropy grows with a text's
length, so its quartiles are taken per power of two of tokens. A text outside
its bands is rejected.

One map over the texts gives the figures; what is grouped and judged after it
are rows of a few numbers.

Defined cases: a null or empty text has no words and fails; a text without a
letter is no text of any script and is rejected; a language with fewer than
LEAST_TEXTS texts, or null, takes the bands of its script, and a script with
fewer takes BANDS, the widest that any text may have; a length with fewer takes
the entropy of the next shorter one; a figure that is just a limit is inside it,
and letters of several scripts as often as each other are the first's by name; a
very long text is measured whole; rows are judged each on its own; other columns
are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.texts import map_chunks
from glossa.session import cut

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Fixed values, the outer limits: characters per token (least, most), most byte fallback, least entropy in bits from ENTROPY_TOKENS tokens on.
BANDS = {
    "latin": (1.2, 9.0, 0.30, 3.0),
    "greek": (0.8, 6.0, 0.60, 3.0),
    "cyrillic": (0.8, 6.0, 0.60, 3.0),
    "arabic": (0.6, 6.0, 0.80, 3.0),
    "hebrew": (0.6, 6.0, 0.80, 3.0),
    "cjk": (0.3, 4.0, 1.00, 3.0),
    "hangul": (0.3, 4.0, 1.00, 3.0),
    "other": (0.3, 9.0, 1.00, 3.0),
}
ENTROPY_TOKENS = 64
SPREAD, LEAST_TEXTS = 3.0, 100
LEAST_APART = {"chars": 0.05, "share": 0.02, "entropy": 0.35}  # quartiles count as so far apart at least; for chars times the median
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_ODD = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _vocabulary(content: bytes):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    fallback = np.zeros(max(ranks.values()) + 1, bool)
    for piece, rank in ranks.items():
        try:
            piece.decode()
        except UnicodeDecodeError:
            fallback[rank] = True
    return tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), fallback


def script_of(text: str) -> str:
    """The script of most letters; Latin at once where ASCII letters are half the text."""
    sample = Counter(text) if not text.isascii() else None
    if sample is None:
        return "latin" if re.search("[A-Za-z]", text) else "other"
    seen: Counter = Counter()
    for letter, n in sample.items():
        if letter.isalpha():
            name = unicodedata.name(letter, "OTHER").split()[0].split("-")[0].lower()
            seen[{"hiragana": "cjk", "katakana": "cjk"}.get(name, name)] += n
    best = max(sorted(seen), key=seen.get, default="other")
    return best if best in BANDS else "other"


def repeated_words(words: list[bytes]) -> int:
    """Words in eight-word windows found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.array([hash(w) for w in words], np.int64).view(np.uint64)
    windows = sum(((codes[k : k + n] * _ODD[k]) ^ (codes[k : k + n] >> np.uint64(29)) * _ODD[-k - 1] for k in range(WINDOW)), np.zeros(n, np.uint64))
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    groups: dict = {}
    for at in order[np.append(same, False) | np.append(False, same)].tolist():
        groups.setdefault(tuple(words[at : at + WINDOW]), []).append(at)
    edge = np.zeros(len(words) + 1, np.int64)
    for found in groups.values():
        if len(found) > 1:
            np.add.at(edge, found, 1)
            np.add.at(edge, np.array(found) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(raw.count(bytes([c])) for c in _SPACES)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), chars, sum(raw.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def fertility(text: str, encoding, fallback: np.ndarray) -> tuple[float, float, float, int]:
    """Characters per token, byte-fallback share, token entropy, tokens."""
    ids = encoding.encode_to_numpy(text, disallowed_special=())
    if not len(ids):
        return 0.0, 0.0, 0.0, 0
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    return len(text) / len(ids), float(fallback[ids].mean()), float(-(p * np.log2(p)).sum()), len(ids)


def within(script: str, chars: float, share: float, entropy: float, tokens: int) -> bool:
    least, most, fallback, bits = BANDS[script]
    return least <= chars <= most and share <= fallback and (tokens < ENTROPY_TOKENS or entropy >= bits)


class Bands:
    """Limits by (script, language), where language None stands for all of the script."""

    def __init__(self, groups: list, classes: list) -> None:
        self.limits, self.bits = {}, {}
        for script, lang, (low, middle, high), (less, more) in groups:
            apart = SPREAD * max(high - low, LEAST_APART["chars"] * middle)
            self.limits[script, lang] = low - apart, high + apart, more + SPREAD * max(more - less, LEAST_APART["share"])
        for script, lang, size, (low, high) in sorted(classes, key=lambda c: c[2]):
            self.bits.setdefault((script, lang), []).append((size, low - SPREAD * max(high - low, LEAST_APART["entropy"])))

    def hold(self, script: str, lang: str | None, chars: float, share: float, entropy: float, tokens: int) -> bool:
        if not within(script, chars, share, entropy, tokens):
            return False
        for key in dict.fromkeys(((script, lang), (script, None))):
            if key in self.limits:
                least, most, fallback = self.limits[key]
                if not (least <= chars <= most and share <= fallback):
                    return False
                break
        if tokens >= ENTROPY_TOKENS:
            for key in dict.fromkeys(((script, lang), (script, None))):
                below = [bits for size, bits in self.bits.get(key, ()) if 2**size <= tokens]
                if below:
                    return entropy >= below[-1]
        return True


def fit_bands(figures: DataFrame) -> Bands:
    """Bands from the quartiles of all texts that pass the base rules. Rounded
    figures have so few values that exact quartiles need little memory."""
    judged = figures.where(~F.col("base_failed") & F.col("lettered")).select(
        "script",
        "lang",
        F.round(F.least("chars_per_token", F.lit(20.0)), 3).alias("chars"),
        F.round("fallback_share", 4).alias("share"),
        F.round("entropy", 3).alias("entropy"),
        F.when(F.col("n_tokens") >= ENTROPY_TOKENS, F.floor(F.log2("n_tokens")).cast("int")).alias("size"),
    )
    named, pooled = judged.where("lang is not null"), judged.withColumn("lang", F.lit(None).cast("string"))
    at = lambda c, *q: F.percentile(c, F.lit(list(q))).alias(f"at_{c}")
    groups, classes = [], []
    for part in (named, pooled):
        groups += part.groupBy("script", "lang").agg(F.count(F.lit(1)).alias("n"), at("chars", 0.25, 0.5, 0.75), at("share", 0.25, 0.75)).where(F.col("n") >= LEAST_TEXTS).drop("n").collect()  # a row for LEAST_TEXTS texts at most
        classes += part.where("size is not null").groupBy("script", "lang", "size").agg(F.count(F.lit(1)).alias("n"), at("entropy", 0.25, 0.75)).where(F.col("n") >= LEAST_TEXTS).drop("n").collect()
    return Bands([tuple(r) for r in groups], [tuple(r) for r in classes])


def measure(docs: DataFrame, *, doc_id="doc_id", text="text", lang="lang", vocabulary: str | None = None) -> DataFrame:
    """Base counts and fertility figures for every row."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(chunk: list[dict]) -> list[tuple]:
        encoding, fallback = _vocabulary(content.value)
        out = []
        for row in chunk:
            text = row["text"] or ""
            n, *rest = base_counts(text)
            failed = n < MIN_WORDS or 100 * rest[-1] > REPEAT_PERCENT * n
            script = script_of(text)
            lettered = script != "other" or any(map(str.isalpha, text))
            out.append((row["doc_id"], row["lang"], n, *rest, failed, lettered, script, *fertility(text, encoding, fallback)))
        return out

    ddl = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lettered boolean, script string, chars_per_token double, fallback_share double, entropy double, n_tokens long"
    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    return map_chunks(docs.select(F.col(doc_id).alias("doc_id"), language.alias("lang"), F.col(text).alias("text")), work, ddl)


def apply_rules(docs: DataFrame, *, doc_id="doc_id", text="text", lang="lang", vocabulary: str | None = None) -> DataFrame:
    """Base counts, fertility figures and the verdict for every row."""
    figures = cut(measure(docs, doc_id=doc_id, text=text, lang=lang, vocabulary=vocabulary))
    packed = docs.sparkSession.sparkContext.broadcast(fit_bands(figures))

    def hold(script: pd.Series, lang: pd.Series, chars: pd.Series, share: pd.Series, entropy: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([packed.value.hold(*row) for row in zip(script, lang, chars, share, entropy, tokens, strict=True)], dtype=bool)

    held = F.pandas_udf(hold, "boolean")("script", "lang", "chars_per_token", "fallback_share", "entropy", "n_tokens")
    kept = ~F.col("base_failed") & F.col("lettered") & held
    return figures.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "chars_per_token", "fallback_share", "entropy", "n_tokens")
