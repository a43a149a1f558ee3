"""Corpus pipeline over `documents`: quality rules, near copies, repeated passages, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of `documents`. `run` writes each stage's rows as Parquet below the shared checkpoint folder and reads them again.

Defined cases: rows with a null id are judged, mixed and packed like others but have no near copies and lose no
passages; a text that loses all its passages stays as an empty text until the mixing, which selects texts with words only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from chargeload.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_rules.judge(docs.select(*COLUMNS), rules).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id."""
    others = jaccard_join.near_copies(docs.select("doc_id", "text")).where("class_id <> doc_id").select("doc_id")
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; a character of which a byte goes goes whole."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True)
    left = out.withColumn("text", F.when(F.size("dedup.spans") > 0, F.col("dedup.kept")).otherwise(F.col("text")))
    return left.withColumn("n_chars", F.when(F.size("dedup.spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix, once for each epoch that takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document with its bin."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Near copies and repeated passages are beyond SQL; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
