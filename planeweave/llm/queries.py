"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, exact_topk, fill_in_middle, language_id, lattice_lm, license_scan, line_dedup, oracle, oracle_structure
from . import ordinal_quality, packing, pii, quality_rules, simhash_dedup, source_mix
from .common import table


def tokenizer(name: str) -> str:
    """Default place of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_files() -> tuple[str, str, str]:
    """Vocabulary, the same vocabulary as ranks, and the pattern that splits texts."""
    import public_tokenizers

    return tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_lattice_lm(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    return lattice_lm.lattice_lm(table(spark, sf_dir, "documents"), ranks or tokenizer("byte_bpe_50k.tiktoken"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.source_mix(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.ordinal_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.conversation_repair(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules, op2_lattice_lm, op3_license_scan, op4_exact_topk, op5_source_mix, op6_packing,
        op7_simhash_dedup, op8_ordinal_quality, op9_pii, op10_language_id,
        op11_conversation_repair, op12_fill_in_middle, op13_line_dedup, pipeline,
    )

}
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL | oracle_structure.ORACLE_SQL
