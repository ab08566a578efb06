"""Corpus pipeline: toxicity filter, exact dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and returns a DataFrame with the columns of ``documents``; the last one
returns the packed pieces with their ids. A driver writes each stage's result
and hands it on, or calls ``run``, which chains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skufold.llm import exact_dedup, mixing, packing, simhash, toxicity
from skufold.llm.queries import table, tokenizer_path
from skufold.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of documents that are not held out; drop what scores
    toxicity.THRESHOLD or more. Clean, empty and unlabelled documents stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, against a fresh index."""
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index"))
    kept = exact_dedup.deduplicate(docs, index, "corpus")
    index.close()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints at 2 or fewer bits stays."""
    return simhash.near_deduplicate(docs, shingle=3, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their shares of 150 % of all words, whole epochs first."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 ids, one row per piece with its ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_windows),
]
#: Fingerprints and tokenizers have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
