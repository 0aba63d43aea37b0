"""From raw documents to token digests: quality, near-duplicates, personal data, mix, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wellspan.llm import bpe, jaccard, mixing, pii, quality
from wellspan.llm.common import keep_result, keep_table, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.classified(docs, read(spark, sf_dir, "labels"), quality.Fit(), *COLUMNS[1:]).filter("predicted = 1").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group; documents without an id are in no group."""
    firsts = keep_result(spark, lambda: jaccard.joined(docs).filter("doc_id = component_id").select("doc_id").distinct())
    stay = docs.select(COLUMNS).join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.select(COLUMNS).filter("doc_id is null"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind."""
    rows = pii.found(docs, pii.Bootstrap(), *COLUMNS[1:4])
    clean = F.when(F.size("spans") > 0, pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return rows.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    return mixing.repeated(docs.select(COLUMNS))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their round trip for every row."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("personal_data", without_personal_data), ("mix", to_target_weights), ("tokens", token_digests)]

#: The classifier's fit and the merges of the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
