"""The queries opN_<name> of this package: each operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, license_scan, line_dedup, lm_score, packing, quality_classifier, quality_rules, simhash, warc
from .common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op1_line_dedup_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True, short=True)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).drop("th", "root")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op1_line_dedup_short": op1_line_dedup_short,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extract": op4_html_extract,
    "op5_license_scan": op5_license_scan,
    "op6_simhash": op6_simhash,
    "op7_lm_score": op7_lm_score,
    "op8_decontaminate": op8_decontaminate,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op1_line_dedup_short": line_dedup.ORACLE_SHORT,
    "op2_quality_rules": quality_rules.ORACLE,
    "op5_license_scan": license_scan.oracle(),
    "op10_warc": warc.ORACLE,
}
