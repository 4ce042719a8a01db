"""A corpus pipeline over `documents`: judge, trim, thin out, decontaminate and pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filequarry.llm import decontaminate, linededup, packing, quality, simhash
from filequarry.llm.common import shared_dir, table
from filequarry.llm.queries import byte_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def trim(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts, and texts of which nothing is left go whole; n_chars follows."""
    out = linededup.line_dedup(docs.select(*COLUMNS))
    out = out.where((F.size("runs") == 0) | (F.length(F.trim("text")) > 0))
    n = F.when(F.size("runs") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def thin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, with 0.8 or more of their shingles of five words in common, one document stays."""
    return simhash.near_dedup(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of packed sequences."""
    return packing.pack(docs, byte_bpe()).drop("text_key")


STAGES = [
    ("quality classifier", judge),
    ("line dedup", trim),
    ("SimHash near-dedup", thin),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The stages are no SQL: a model, hashes, alignments and a fitted plan decide. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
    return docs
