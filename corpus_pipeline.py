"""The corpus pipeline: language ID, near duplicates, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmart.llm import _common, decontam, forest, langid, packing, suffixes


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without any letter go. Without a model (no row names a language) all with letters stay."""
    trees = langid.fit_documents(docs)
    if not trees:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = langid.predict(docs, trees).where(F.col("lang_pred") != langid.UNKNOWN).drop("lang_pred", "score")
    return known.toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; rows that repeat its id and text go. Rows without an id stay."""
    name = "first_id" + "_" * max(len(c) for c in docs.columns)  # longer than any column of theirs
    first = forest.near_duplicates(docs).where("doc_id = class_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, docs["doc_id"].cast("long") == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that start earlier; n_chars follows the text."""
    left = suffixes.remove(docs)
    return left.withColumn("n_chars", F.length("text").cast(left.schema["n_chars"].dataType))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: where each document's tokens stand in sequences of at most 4096 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: SQL cannot express the byte context trees, the hashes' join or the packing plan: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = _common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = _common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
