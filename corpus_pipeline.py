"""Corpus cleaning and packing as five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's docs.  All stages but
the last return the columns of documents.  Every stage takes empty inputs, null
and empty texts, repeated rows and extra columns as its operator's text says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circula.llm import forest, packing, secrets, substrings, toxicity
from circula.llm.tables import Staging, importable, read_table, unused

TOXIC = 0.5             # documents that score this or more go
SHINGLE, SIMILAR = 5, 80  # words of a shingle, percent of a near copy
WINDOW = 35             # words of a passage that goes if it repeats
CAPACITY, END_ID = 1024, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC, by a model of the labelled documents of ``sf_dir``."""
    importable(spark)
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    name = unused("tox_score", docs.columns)
    return toxicity.score(docs, model, name=name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; documents
    without an id stay.  Rows that share an id are documents of their own: equal texts are one, unlike
    texts all stay, and of near copies with the smallest id the one with the smallest hash stays."""
    importable(spark)
    stage = Staging(spark, "pipeline-forest")
    own, first = unused("_own", docs.columns), unused("_first", docs.columns)
    named = docs.where("doc_id is not null").withColumn(own, F.col("doc_id").cast("long"))
    texts = named.select(own, F.xxhash64("text").alias("h")).distinct()
    repeated = stage.keep(texts.groupBy(own).count().where("count > 1").select(F.col(own).alias(first)), "repeated")
    if not repeated.isEmpty():  # a hash of the row is the id of each of those
        named = named.join(repeated, F.col(own) == F.col(first), "left").withColumn(
            own, F.when(F.col(first).isNull(), F.col(own)).otherwise(F.xxhash64(own, "text"))).drop(first)
    found = forest.near_duplicates(named.select(F.col(own).alias("doc_id"), "text"), SHINGLE, SIMILAR, stage)
    if repeated.isEmpty():
        chosen = found.where("doc_id = component_id").select(F.col("doc_id").alias(first)).distinct()
    else:
        ids = named.select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("id")).distinct()
        chosen = found.join(ids, F.col("doc_id") == F.col("row")).groupBy("component_id").agg(
            F.min(F.struct("id", "row"))["row"].alias(first)).select(first)
    kept = named.join(chosen, F.col(own) == F.col(first), "left_semi").dropDuplicates([own])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of WINDOW words or more that repeat in what is left."""
    importable(spark)
    return substrings.remove(docs, WINDOW, Staging(spark, "pipeline-substrings"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    importable(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of CAPACITY tokens."""
    importable(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                                  CAPACITY, END_ID)
    return packing.pack(pieces, CAPACITY, Staging(spark, "pipeline-packing"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substrings", drop_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL has no form for the trained classifier, nor for the tokenizer's ids.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on documents; the result of the last one."""
    stage = Staging(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage.keep(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
