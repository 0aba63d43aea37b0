"""The operators over the given tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wellspan.llm import align, bpe, counting, decontaminate, jaccard, mixing, phrases, pii, quality, repeats, rules, sharding, vectors
from wellspan.llm.common import read


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.found(read(spark, sf_dir, "documents")))


def op2_quality_rules_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(read(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(rules.ledger(read(spark, sf_dir, "documents"))).drop("policy")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.counted(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(read(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("digest")


def op13_shard_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bootstrapped_pii, op2_quality_rules_ensemble, op3_prefix_tree_join, op4_feistel_shards, op5_rule_ledger, op6_bpe_round_trip, op7_suffix_array_repeats, op8_token_counts, op9_source_mix, op10_cross_polytope,
        op11_token_alignment, op12_suffix_decontamination, op13_shard_phrases,
    )
}
ORACLE: dict[str, str] = {"op9_source_mix": mixing.MIX_SQL, "op12_suffix_decontamination": decontaminate.REPORT_SQL, "op13_shard_phrases": phrases.COLLOCATIONS_SQL}
