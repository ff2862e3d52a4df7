"""Language identification by rank-order profiles of character n-grams.

Letters of any script are lower-cased and stand for themselves, all else is a
gap. A language's profile is its PROFILE most frequent 1-, 2- and 3-grams over
the labelled documents; a document's is its own. The out-of-place distance adds
up, over the document's n-grams, how far each stands from its rank in the
language's profile (PROFILE when absent).

Profiles are fitted on a bounded sample of labelled rows, FIT_ROWS expected of
each language, chosen by hash; every document is scored on its whole text. What
is sent to the workers is PROFILE numbers a language.

Defined cases: a null text, or one without a letter, gives 'und' and score 0,
as does a corpus without labelled rows; n-grams as frequent as each other go by
their code; languages as near as each other by code point; a very long text is
one array of its letters; rows are judged each on its own; other columns are
ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.texts import fold, map_chunks
from glossa.session import cut, small_side

PROFILE = 400
FIT_ROWS = 5_000
BITS = 18  # of a letter's number: Unicode has fewer than 2^18 letters
KIND = 60  # where the length of an n-gram stands in its code


@functools.cache
def _symbols() -> np.ndarray:
    """The number of every letter by code point; 0 for what isn't a letter."""
    letters = np.fromiter((chr(point).isalpha() for point in range(0x110000)), bool, 0x110000)
    return np.where(letters, np.cumsum(letters), 0).astype(np.int64)


def grams(text: str) -> np.ndarray:
    """Codes of the text's n-grams, sorted; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[points]
    if not s.any():
        return s[:0]
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    two = s[:-1] << BITS | s[1:]
    out = np.concatenate((s[s != 0], 1 << KIND | two, 2 << KIND | two[:-1] << BITS | s[2:]))
    out.sort()
    return out


def ranked(ids: np.ndarray, most: int) -> np.ndarray:
    """The most frequent ids of a sorted array, ties by id."""
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    counts = np.diff(np.append(starts, len(ids)))
    return ids[starts[np.argsort(-counts, kind="stable")[:most]]]


def fit_profiles(docs: DataFrame, *, text="text", lang="lang", doc_id="doc_id", held_out=None, rows: int = FIT_ROWS) -> dict[str, list[int]]:
    """{language: n-gram codes by rank} of the labelled rows outside held_out."""
    labelled = docs.where(F.col(lang).isNotNull() & (~held_out if held_out is not None else F.lit(True))).select(F.col(doc_id).alias("of"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    strides = cut(labelled.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / rows).alias("stride")))
    sample = labelled.join(small_side(strides, strides.count()), "lang").where(F.pmod(F.xxhash64("of", F.lit("fit")), F.col("stride")) == 0).select("text", "lang")

    def count(chunk: list[dict]) -> list[tuple]:
        found: dict[str, list[np.ndarray]] = {}
        for row in chunk:
            found.setdefault(row["lang"], []).append(grams(row["text"] or ""))
        return [(lang, g, n) for lang, parts in found.items() for g, n in zip(*(x.tolist() for x in np.unique(np.concatenate(parts), return_counts=True)), strict=True)]

    counts = map_chunks(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= PROFILE).orderBy("lang", "place").collect()  # PROFILE rows a language
    profiles: dict[str, list[int]] = {}
    for row in top:
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def out_of_place(top: np.ndarray, codes: np.ndarray, places: np.ndarray) -> float:
    """Mean displacement of ranked n-grams against a profile (its codes in order, and
    their ranks), as a share of the most it can be."""
    at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
    apart = np.where(codes[at] == top, np.abs(places[at] - np.arange(len(top))), PROFILE)
    return float(apart.sum()) / (PROFILE * len(top))


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, text="text", doc_id="doc_id") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    names = sorted(name for name, codes in profiles.items() if codes)
    packed = docs.sparkSession.sparkContext.broadcast([(np.sort(np.array(profiles[n], np.int64)), np.argsort(np.array(profiles[n], np.int64))) for n in names])

    def judge(chunk: list[dict]) -> list[tuple]:
        out = []
        for row in chunk:
            found = grams(row["text"] or "")
            if not len(found) or not names:
                out.append((row["doc_id"], "und", 0.0))
                continue
            top = ranked(found, PROFILE)
            apart = np.array([out_of_place(top, codes, places) for codes, places in packed.value])
            near = np.maximum(1 - apart, 1e-9)
            best = int(apart.argmin())
            out.append((row["doc_id"], names[best], float(near[best] / near.sum())))
        return out

    return map_chunks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), judge, "doc_id long, lang_pred string, score double")


def detect_languages(docs: DataFrame) -> DataFrame:
    """Profiles from three folds of four, every document scored."""
    profiles = fit_profiles(docs, held_out=fold("doc_id", 4) == 2)
    return identify(docs, profiles).select("doc_id", (F.coalesce(fold("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
