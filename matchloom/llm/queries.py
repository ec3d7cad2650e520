"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import bpe, co_training, decontamination, fill_in_middle, filter_audit, line_dedup, merkle_audit, mixing, quality_rules, secrets, simhash_dedup, substring_dedup, toxicity
from matchloom.llm.common import table


def _merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_audit.audit_report(table(spark, sf_dir, "pages"))


def _co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_training.co_training_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*quality_rules.COLUMNS)


def _substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup_report(table(spark, sf_dir, "documents"))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_report(table(spark, sf_dir, "documents"))


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle_report(table(spark, sf_dir, "documents"))


def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_audit": _merkle,
    "op2_co_training": _co_training,
    "op3_quality_rules": _rules,
    "op4_substring_dedup": _substring,
    "op5_toxicity": _toxicity,
    "op6_line_dedup": _lines,
    "op7_simhash_dedup": _simhash,
    "op8_mixing": _mixing,
    "op9_secrets": _secrets,
    "op10_decontamination": _decontamination,
    "op11_filter_audit": _filter_audit,
    "op12_fill_in_middle": _fill_in_middle,
    "op13_bpe": _bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_merkle_audit": merkle_audit.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
    "op10_decontamination": decontamination.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
