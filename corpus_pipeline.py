"""From raw documents to token ids: five stages, each one operator, each written and read again before the next.

1. language ID: learns from the labelled documents of its input and predicts every document's language.  A document without a label
   gets the prediction as its ``lang``.  Only documents without any letter are rejected, whatever the prediction and its score; where
   nothing was learned no label is filled.
2. exact dedup: of texts equal up to white space, the one with the smallest id stays.
3. MinHash near-dedup: five words a shingle, a similarity of 0.8; one document of each group stays.
4. mixing: sources to target weights; a document comes out never, once or twice.
5. BPE: the token ids of every row, with digests of ids and decoded text.

Every stage but the last returns the columns of its input, whatever other columns it has.  Null ids, languages and sources pass
through; a null, empty or wordless text has no letter and goes in the first stage; a very long text is one document
throughout; of repeated rows the second stage keeps one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe, vocabulary
from tidemark.llm.common import materialise, rows_again
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.langid import BUCKETS, UNKNOWN, Model, identify, train
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near_dedup import near_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs)
    if not model.languages:  # one language is predicted for all texts with letters
        model = Model(np.zeros((1, BUCKETS), np.float32), ["any"])
        return rows_again(identify(docs, model, whole=True).filter(F.col("lang_pred") != UNKNOWN), docs)
    told = identify(docs, model, whole=True).filter(F.col("lang_pred") != UNKNOWN)
    row = F.col("row").withField("`lang`", F.coalesce(F.col("row").getField("lang"), F.col("lang_pred")))
    return rows_again(told.select(row.alias("row")), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe(docs, vocabulary(), ids=True, keep=("source",)).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix_sources), ("bpe", encode)]

#: Neither the classifier nor the tokenizer can be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
