"""The queries of this subpackage, each over its whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodesift.llm import ann, langid, media, mixing, packing, secrets, simhash, substring, suffix_dedup, warc
from lodesift.llm.common import table


def op1_near_duplicate_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicate_passages, op2_best_fit_packing, op3_suffix_dedup, op4_nearest_neighbours, op5_simhash_near_dedup, op6_source_mixing, op7_language_id, op8_warc_round_trip, op9_secret_scan, op10_media_columns)
}

ORACLE_SQL: dict[str, str] = {"op6_source_mixing": mixing.ORACLE, "op8_warc_round_trip": warc.ORACLE, "op9_secret_scan": secrets.ORACLE}
