"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, line_chunks, linkgraph, mixing, simhash, suffix_repeats, toxicity, vectors, warc, winnowing
from lodestone.llm._shared import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_chunks.dedup_passages(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", *line_chunks.STATS, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).drop("target_uri")


def op4_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.verdicts(read(spark, sf_dir, "pages")).drop("trust", "distrust")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("copies")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_chunk_dedup": op2_line_chunk_dedup,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_url_link_graph": op4_url_link_graph,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_pivotal_mixing": op8_pivotal_mixing,
    "op9_language_id": op9_language_id,
    "op10_winnowing_decontamination": op10_winnowing_decontamination,
}

SQL: dict[str, str] = {
    "op3_warc_chunks": warc.SQL,
    "op4_url_link_graph": linkgraph.sql(),
    "op6_embedding_near_dedup": vectors.SQL,
    "op10_winnowing_decontamination": winnowing.SQL,
}
