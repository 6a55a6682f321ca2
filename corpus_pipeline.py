"""A corpus from raw documents to a mix, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns
the columns of ``documents``; the last one repeats rows as the mix takes them and numbers
the copies. ``run`` writes what each stage returns to the shared folder and reads it
again, so a lost executor never reaches back beyond one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_chunks, mixing, simhash, toxicity, winnowing
from lodestone.llm._shared import fresh, read, table

#: Learned scores, fingerprints and hashed random choices have no counterpart in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier leave the texts; every document stays, and ``n_chars`` follows its text."""
    kept = line_chunks.dedup_passages(docs)
    changed = F.col(fresh(docs, "n_removed_lines")) > 0
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that pairs of 0.8 Jaccard similarity on five-word shingles connect.

    SimHash balls nominate pairs, bands of min-hashes those beyond the balls; the shingle sets decide.
    """
    return simhash.keep_one(docs, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return winnowing.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; ``copy`` numbers the copies."""
    return mixing.repeat(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
