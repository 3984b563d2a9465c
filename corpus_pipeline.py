"""The corpus pipeline: quality rules, near-duplicates, repeated substrings, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has
kept. All but the last return the columns of documents: doc_id, text, lang,
source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm._shared import staged
from wayfold.llm.decontamination import clean_of
from wayfold.llm.near_dedup import one_of_each
from wayfold.llm.packing import pack
from wayfold.llm.quality_rules import keep_good
from wayfold.llm.suffix_dedup import dedup_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a certified cutoff go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, size=5, percent=80)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document with a smaller doc_id has too are cut; n_chars is counted anew."""
    out = dedup_texts(docs, 50, carry=["lang", "source"])
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark items go."""
    return clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated substrings", repeated_substrings),
    ("decontamination", decontaminate),
    ("packing", packing),
]
#: Sketches, suffix order and the plan of the packing have no SQL; the operators of the stages are tested against brute force or SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "pipeline")
    return docs
