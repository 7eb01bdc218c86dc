"""One query per operator, over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import alignment, bpe, digests, factors, licenses, likelihood, neardup, negatives, packs, quality, secrets, shards, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and `keep` of every document; a row per row, a null text rated as an empty one."""
    return quality.quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document, and `keep` for one row of each; a row per row."""
    return neardup.near_duplicate_query(table(spark, sf_dir, "documents"))


def op3_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed windows, repeated rows each; a null text is the closing id alone."""
    return packs.pack_digest(table(spark, sf_dir, "documents"))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, with the owners and repositories of each value; a row per row."""
    return secrets.secret_query(table(spark, sf_dir, "documents"))


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and grown shard of every document; equal ids, null ones too, share a shard."""
    return shards.shard_digest(table(spark, sf_dir, "documents"))


def op6_sentence_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences, rules and licences of every document; a row per row."""
    return licenses.licence_query(table(spark, sf_dir, "documents"))


def op7_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every query vector, ties to the smaller id; repeated rows count each."""
    return topk.top_k_query(table(spark, sf_dir, "embeddings"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document; a row per row, a null text as an empty one."""
    return bpe.encode_digest(table(spark, sf_dir, "documents"))


def op9_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; repeated rows follow each other."""
    return digests.digest_documents(table(spark, sf_dir, "documents"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed and mean log-probability of every document's words; equal texts get equal scores."""
    return likelihood.likelihood_query(table(spark, sf_dir, "documents"))


def op11_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups, links and corpus-wide pair counts of every document; a row per row."""
    return alignment.alignment_digest(table(spark, sf_dir, "documents"))


def op12_relative_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document because a window over them starts earlier; rows equal in id and text are one document."""
    return factors.repeat_digest(table(spark, sf_dir, "documents"))


def op13_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; an empty table or one without partners gives no rows."""
    return negatives.hard_negative_query(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_ordinal_quality": (op1_ordinal_quality, None),
    "op2_weighted_minhash": (op2_weighted_minhash, None),
    "op3_tiered_packing": (op3_tiered_packing, None),
    "op4_secret_ownership": (op4_secret_ownership, secrets.SQL),
    "op5_jump_shards": (op5_jump_shards, None),
    "op6_sentence_licenses": (op6_sentence_licenses, licenses.SQL),
    "op7_columnar_topk": (op7_columnar_topk, topk.SQL),
    "op8_bpe_automaton": (op8_bpe_automaton, None),
    "op9_quartile_digest": (op9_quartile_digest, digests.SQL),
    "op10_pseudo_likelihood": (op10_pseudo_likelihood, None),
    "op11_interval_alignment": (op11_interval_alignment, None),
    "op12_relative_factors": (op12_relative_factors, factors.SQL),
    "op13_hilbert_negatives": (op13_hilbert_negatives, negatives.SQL),
}
