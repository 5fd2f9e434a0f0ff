"""The training-data pipeline: five numbered operators, each over all documents that the stage before kept.

Every stage but the last returns the columns of documents. Rows whose id is null pass the stages that work by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.llm import decontaminate as DC, jaccard as JC, mixing as MX, pii as PI, toxicity as TX
from auditlake.llm.common import documents
from auditlake.session import durable


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = TX.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return TX.score_documents(docs, model).where("tox_score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8 or more.

    Of rows that are equal in all columns one stays.
    """
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NOT NULL AND n > 1").select(F.col("doc_id").alias("several"))
    if not several.isEmpty():
        again = docs.doc_id == F.col("several")
        docs = durable(docs.join(several, again, "left_anti").unionByName(docs.join(several, again, "left_semi").dropDuplicates()))
    return JC.one_of_each(docs, n=5, threshold="0.8")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of benchmark items."""
    return DC.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = PI.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix: their columns, the target of their source, and how many of their words the mix takes.

    Rows that share an id show what the mix takes from them together.
    """
    mixed = MX.mixed_documents(docs).groupBy(F.col("id").alias("mixed_id")).agg(
        F.sum("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"))
    return docs.join(mixed.where("taken > 0"), F.col("doc_id").eqNullSafe(F.col("mixed_id"))).drop("mixed_id")


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing),
]
#: trained models and keyed permutations can't be said in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
