"""Preparation of a training corpus: toxicity, quality, near duplicates, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents and keep the rows that they accept; the last returns
the packed pieces. Null and empty texts are texts without words to every stage; columns of any name come through; repeated
rows are judged each for itself, but for near duplicates, of which one stays; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridlake.functions.durable import shared_folder
from gridlake.llm import decontaminate, ngram_join, packing, quality, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, fitted on the labelled rows of docs, doesn't mark as toxic. Without labels of both kinds all share one score."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality model, fitted on the labelled rows of docs, accepts; without labels all of them."""
    model = quality.train(docs, _labels(spark, sf_dir))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that 0.8-similar sets of five-word shingles link: of the smallest doc_id, null ids last. Texts without
    words stay, one a doc_id, and all of those without a doc_id."""
    return ngram_join.keep_one(docs, words_each=5, percent=80).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no ten-word window of a benchmark item occurs (an item of fewer words is one window)."""
    found = decontaminate.annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in bins of 2,048 words; a text without words is one piece of size 0."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the classifiers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
