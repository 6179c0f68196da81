"""Corpus pipeline: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
`documents`; the last returns the packing plan.  Stages are written as Parquet to the shared folder and reread,
so a lost executor repeats part of one stage.  Empty inputs give empty outputs; other cases are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm import best_fit, decontaminate, line_crf, prefix_tree_join, surrogates
from slatewise.llm.queries import PII_KEY, held_out, table
from slatewise.session import work_path

#: The field that labels lines, and the transitions fitted on labels, have no form in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    model = line_crf.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return line_crf.score(docs, model, score_col="_score").where("_score >= 0.5").drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, that of the smallest id."""
    return prefix_tree_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""
    replaced = surrogates.replace_pii(docs, PII_KEY, count_col="_mentions")
    return replaced.withColumn("n_chars", F.when(F.col("_mentions") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in training sequences."""
    return best_fit.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("PII", personal_data),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
