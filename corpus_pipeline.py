"""The corpus pipeline over `documents`: language, quality, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), calls one operator of ``quernstone.llm`` on all its
input, and returns a DataFrame that `run` writes and reads again for the next stage. All but
the last return the columns of documents:

1. language_id: documents of no learned language, or below the operator's confidence, go.
2. quality: documents that the classifier predicts as label 0 go. It learns from `labels`
   outside the held-out fold.
3. near_dedup: of each component of near-duplicates the document with the least id stays (null
   ids last), and of rows that repeat an id and its text one row.
4. suffix_dedup: passages of 400 bytes that the kept documents repeat are cut from `text`, and
   `n_chars` is counted anew. Documents stay, if need be with an empty text.
5. packing: the pieces of the remaining texts and their places in sequences.

Extra columns pass through the stages. Null texts are empty, and null ids are ids like others. An
empty table goes through all stages and packs to nothing. SQL cannot express the stages (models,
tokenizers), so tests hold each against plain Python on small tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import language, minhash, packing, quality, repeats
from quernstone.llm.common import Staging, fresh

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = language.identify_documents(spark, docs)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_copies(spark, docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.remove(spark, docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again."""
    staged = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = staged.put(name, stage(spark, docs, sf_dir))
        if before:
            staged.drop(before)
        before = name
    return docs
