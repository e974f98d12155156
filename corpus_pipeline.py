"""Five stages from raw documents to packed sequences; each takes and, but for the last, returns rows of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from procmatch.llm import decontaminate, omh, packing, pii, toxicity
from procmatch.llm.common import read_table, stored

#: The key of the surrogates; a real run brings its own.
KEY = "procmatch-demo-key"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return omh.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that are mostly such."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates."""
    return pii.pseudonymize(docs, KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("row")


STAGES = [("toxicity", toxicity_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Learnt scores, sketches and tokenizers have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
