"""One query for each operator, with production parameters, over whole tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, langid, neighbours, packing, quality, repetition, sharding, simhash, substrings, suffixes, trie, whitening, windows
from .common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where(F.col("vec_id") % 20 == 0), n=20)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.digest_of(substrings.deduplicate(table(spark, sf_dir, "documents"), size=20))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, size=4096, end_id=1)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.digest_of(suffixes.deduplicate(table(spark, sf_dir, "documents"), size=50))


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition.filter_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversations_trie(table(spark, sf_dir, "conversations"), grafts=True)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)


def queries() -> dict:
    found = [op1_bpe, op2_simhash, op3_language, op4_embedding_dedup, op5_neighbours, op6_shards, op7_quality, op8_substrings, op9_packing, op10_suffixes, op11_repetition, op12_prefix_trie, op13_whitening]
    return {f.__name__: f for f in found}
