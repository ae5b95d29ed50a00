"""Training corpus from documents: filter, dedup, near dedup, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns
of documents; the last returns the packed pieces. Stages accept what their operators accept:
nulls, empty texts, repeated rows and empty tables; columns beyond those of documents are dropped.
A row without an identifier goes at the first stage, which is the only one that drops it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commercelake.llm import exact_dedup, jaccard_join, mixing, packing, quality
from commercelake.llm.queries import vocabulary
from commercelake.session import cut_lineage, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    kept = quality.verdicts(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_id"], "left_semi").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the least identifier; different texts never merge."""
    kept = exact_dedup.keep_one(docs).select(*COLUMNS)
    kept = kept.withColumn("_sha", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    return kept.dropDuplicates(["doc_id", "_sha"]).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, that with the least identifier."""
    ship_package(spark)
    return jaccard_join.keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; repeats of a document are told apart by copy."""
    ship_package(spark)
    return packing.packed(docs, vocabulary(), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The first stage's distances and the packing are no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
