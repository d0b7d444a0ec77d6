"""A training corpus from raw documents: quality, exact copies, near copies, mix, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; ``run``
writes each as Parquet in the shared folder and rereads it for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubal.llm import exact_dedup, mixing, packing, quality, simhash_wide
from tubal.llm.common import materialize, table
from tubal.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. It learns from the labels of raw documents."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    training = quality.training_sample(docs, table(spark, sf_dir, "labels").where(remainder != 1))
    return quality.score_quality(docs, training).where("score >= 0.5").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each text the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word Jaccard similarity of 0.8 or more the document with the smallest id."""
    return simhash_wide.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, one row for each stretch of a document that it takes."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row for each piece."""
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mix_stage), ("packing", packing_stage)]

#: SQL cannot express the classifier, the fingerprints or the tokens; the tests hold the pipeline to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
