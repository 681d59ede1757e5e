"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boosting, bpe, decontaminate, langid, licenses, lines, merkle, quality, simhash, suffixes, toxicity, variants
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(quality.measure(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_units(table(spark, sf_dir, "documents"))


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.vocabulary(table(spark, sf_dir, "documents")))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule of the strictest policy: what fails it, what fails it alone, and what stays without it."""
    return quality.ablation(quality.measure(table(spark, sf_dir, "documents")), "v2")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_byte_bpe,
        op3_quality_rules,
        op4_decontamination,
        op5_suffix_dedup,
        op6_toxicity,
        op7_unit_dedup,
        op8_line_windows,
        op9_language_id,
        op10_simhash,
        op11_merkle_manifest,
        op12_quality_classifier,
        op13_spelling_variants,
        quality_ablation,
    )
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality.ORACLE_SQL,
    "quality_ablation": quality.ABLATION_SQL,
    "op4_decontamination": decontaminate.ORACLE_SQL,
    "op8_line_windows": lines.LINES_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op13_spelling_variants": variants.ORACLE_SQL,
}
