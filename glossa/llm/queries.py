"""The numbered queries over the driver's tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import bpe, divergence, fertility, fingerprint, language, licenses, mixing, near_dedup, resampling, substring_dedup, suffix_dedup, toxicity, url_filter
from glossa.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.apply_rules(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.detect_languages(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_copies(table(spark, sf_dir, "documents"), keep_first=False)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_url_filter,
        op3_substring_dedup,
        op4_toxicity,
        op5_bpe,
        op6_fertility,
        op7_licenses,
        op8_language,
        op9_near_dedup,
        op10_fingerprint,
        op11_resampling,
        op12_suffix_dedup,
        op13_divergence,
    )
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op2_url_filter": url_filter.oracle(),
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op7_licenses": licenses.oracle(),
    "op9_near_dedup": near_dedup.ORACLE,
    "op11_resampling": resampling.ORACLE,
    "op12_suffix_dedup": suffix_dedup.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
