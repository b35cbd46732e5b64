"""The queries of this subpackage, by the names under which they are registered, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, differencing_packing, grouping_packing, jaccard_join, mil_toxicity, prefix_trie, pu_quality, ring_sharding, sql, suffix_dedup, tiff_media, trie_tokens, turn_repair,
    xent_scoring,
)
from .common import table


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.shard(table(spark, sf_dir, "documents"))


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_media.report(table(spark, sf_dir, "documents"))


def op4_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = grouping_packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return grouping_packing.pack(cut)


def op6_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return trie_tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_xent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xent_scoring.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(table(spark, sf_dir, "conversations"))


def op12_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return differencing_packing.pack(differencing_packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pu_quality, op2_ring_sharding, op3_tiff_media, op4_mil_toxicity, op5_grouping_packing, op6_trie_tokens, op7_xent_scoring,
        op8_decontaminate, op9_suffix_dedup, op10_jaccard_join, op11_turn_repair, op12_differencing_packing, op13_prefix_trie,
    )
}
SQL: dict[str, str] = {"op11_turn_repair": sql.OP11, "op13_prefix_trie": sql.OP13}
