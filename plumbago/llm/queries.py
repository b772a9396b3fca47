"""The corpus operators applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm import lines, mixing, one_permutation, pieces, quality_rules, simhash, sql, substrings, token_files, toxicity, weak_quality
from plumbago.llm.common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.encode_to_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(spark, files)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeated(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.linked_components(documents(spark, sf_dir))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.deduplicate_lines(documents(spark, sf_dir), whole=True)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_permutation.edited(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        one_permutation.text_of(F.col("packed")).alias("fingerprint"),
        one_permutation.text_of(F.col("edited_packed")).alias("edited_fingerprint"),
        one_permutation.likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        one_permutation.likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return weak_quality.score(docs, weak_quality.fit(docs))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_files": op2_token_files,
    "op3_substrings": op3_substrings,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_lines": op6_lines,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_weak_quality": op9_weak_quality,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY_RULES,
}
