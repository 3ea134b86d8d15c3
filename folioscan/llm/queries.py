"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import hard_negatives, license_scans, mixing, neighbours, ngram_join, packing, quality_classifier, quality_rules, secret_scans, spelling, substring_dedup, token_counts, url_filters
from folioscan.llm.shared import read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(read_table(spark, sf_dir, "pages"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scanned(read_table(spark, sf_dir, "documents")).drop("matches")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digested(secret_scans.scanned(read_table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(read_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(read_table(spark, sf_dir, "documents")).drop("cid", "root")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(spelling.vocabulary(read_table(spark, sf_dir, "documents")))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality_classifier.train_on(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.judged(quality_classifier.scored(docs, model))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(hard_negatives.relabelled(read_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_url_filters, op3_license_scans, op4_secret_scans, op5_mixing, op6_neighbours, op7_substring_dedup, op8_ngram_join, op9_quality_rules, op10_token_counts, op11_spelling_variants, op12_quality_classifier, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": url_filters.oracle_sql(), "op3_license_scans": license_scans.oracle_sql(), "op5_mixing": mixing.oracle_sql(),
        "op7_substring_dedup": substring_dedup.oracle_sql(), "op8_ngram_join": ngram_join.oracle_sql(), "op9_quality_rules": quality_rules.oracle_sql(), "op11_spelling_variants": spelling.oracle_sql(), "op13_hard_negatives": hard_negatives.oracle_sql(),
    }
