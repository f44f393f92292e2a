"""A training corpus from documents: quality rules, near-duplicates, repeated passages, source weights, packing.

Part of the training-data subpackage. Each stage gets the documents that its predecessor kept, as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import mixing, packing, rules, simhash, units
from tessera.llm.common import written
from tessera.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null, empty and wordless texts among them. Rows that repeat are judged alike; an empty table stays empty."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest doc_id: five-word shingles, likeness 0.8 by whole sets.

    Null, empty and wordless texts are one group. Rows with a null doc_id stay, as do all rows that repeat the smallest
    doc_id of their group; an empty table stays empty.
    """
    return simhash.keep_one(docs, k=5, radius=16, likeness=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated units go, but for the earliest (smallest doc_id, null last); a document that is left without words goes with them, as null and empty ones do. Rows that repeat lose alike; an empty table stays empty."""
    return units.cleaned(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; texts without words are never taken, a null source is a source of its own, rows that repeat each count; an empty table stays empty."""
    return mixing.apply_mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its place in a sequence. Each row packs on its own, repeated and null doc_ids included; null and empty texts give one piece, the end id; an empty table gives no row."""
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), derive={"ids_crc32": F.crc32})


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_weights", source_weights),
    ("sequences", sequences),
]

#: Merging subwords and expectation-maximisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
