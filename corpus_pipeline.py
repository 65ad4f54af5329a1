"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandemlab.llm import exact_dedup, minhash_dedup, mixing, packing, quality
from tandemlab.llm.common import forget, settled
from tandemlab.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality.keep_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased), the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the least doc_id."""
    return minhash_dedup.keep_one(docs, shingle=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("packing", packed_sequences),
]

#: The minima, the sampling order and the tokenizer have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is a table of its own; what the stage cut on its way
    goes when it is written, and the table of the stage before it too."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        made = settled(lambda f=stage, before=docs: f(spark, before, sf_dir), name.replace(" ", "-"))
        if spent is not None:
            forget(spent)
        docs = spent = made
    return STAGES[-1][1](spark, docs, sf_dir)
