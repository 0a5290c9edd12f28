"""A corpus from ``documents``: good ones, without near copies, without repeated passages, without private values, packed.

``run`` applies ``STAGES`` in order.  Each stage writes its result to the shared folder as Parquet and the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import near_copies as copies
from driftwell.llm import packing, pii, quality_rules, substrings
from driftwell.llm.common import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a Jaccard similarity of five-word shingles of at least 0.8."""
    return copies.keep_first(docs, shingle=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in a smaller document; those of which nothing is left go."""
    out = substrings.remove_repeats(docs).filter("n_words > n_removed")
    text = F.col("text")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars"))).select(*docs.columns)


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with private values replaced by pseudonyms."""
    out = pii.pseudonymised(docs, pii.session_key(docs))
    return out.withColumn("n_chars", F.when(F.col("n_private") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their bins."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_copies),
    ("substring dedup", passages),
    ("pii", private_values),
    ("best-fit packing", bins),
]

#: SQL has no word hashes of this kind, no transitive closure of near links and no packing; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stash(docs, "pipeline")
    return docs
