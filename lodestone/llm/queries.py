"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, fmindex, licenses, neardup, perplexity, pii, quality, sentencepieces, suffixes, urls
from lodestone.llm.common import written

RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"), ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Pages whose URL matches are listed, each under its canonical form.
LISTED = "(?i)casino|bets|spam"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    # The list is a table of its own, as it would come from elsewhere; it grows with the pages.
    listed = written(pages.filter(F.col("url").rlike(LISTED)).select("url"))
    return urls.judge(pages, urls.listing(RULES, listed))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.remove_repeats(read(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(read(spark, sf_dir, "documents"), shingle=2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(read(spark, sf_dir, "documents"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_quality_rules": op2_quality_rules,
        "op3_pii": op3_pii,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_minhash": op6_minhash,
        "op7_decontamination": op7_decontamination,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_kneser_ney": op9_kneser_ney,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    from lodestone.llm import oracles

    return oracles.oracle_sql()
