"""Registered queries of the operators in this subpackage.

Each ``opN_<name>`` applies its operator with production parameters to its
whole table and derives the result columns.  ``ORACLE`` has DuckDB SQL for
those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circula.llm import (
    bpe,
    caps,
    chat,
    codes,
    forest,
    line_crf,
    packing,
    quality,
    records,
    resampling,
    secrets,
    substrings,
    toxicity,
)
from circula.llm.tables import Staging, importable, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by the subsequence-kernel SVM, trained
    on labelled rows whose crc32(doc_id) is not a multiple of 5."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document: base counts, and Jensen-Shannon
    distance to its language's character classes and common words."""
    docs = read_table(spark, sf_dir, "documents")
    return quality.measure(docs, quality.references(docs))


@query
def op8_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by patterns and by marginal compressed bytes."""
    return secrets.scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_novel",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens by length patterns
    fitted to the histogram."""
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                                  1024, 2)
    return packing.pack(pieces, 1024, Staging(spark, "packing"))


@query
def op5_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted by the
    mapping of their fingerprint and read back from the output."""
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    turns = chat.turn_rows(table.union(extra), "conv_id", "turn")
    return chat.read_back(chat.format_turns(turns))


ORACLE["op5_chat_fingerprint"] = chat.oracle(
    "SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))")


@query
def op9_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by a sentencepiece model made from the ranks, and decoded again."""
    return bpe.digests(read_table(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as framed records in order of doc_id, and read back."""
    stage = Staging(spark, "records")
    dest = stage.path("files")
    records.write(read_table(spark, sf_dir, "documents"), dest, public_tokenizers.path("word_bpe_49k.json"), 2, 49_408, stage)
    rows = stage.keep(records.read(spark, dest), "rows")
    stage.drop("files", "names")
    return records.placed(rows)


@query
def op3_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 35 words that also start elsewhere."""
    return substrings.digests(read_table(spark, sf_dir, "documents"), 35, Staging(spark, "substrings"))


ORACLE["op3_suffix_automata"] = substrings.oracle(35)


@query
def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, by 4-word shingles and a similarity of 0.8."""
    docs = read_table(spark, sf_dir, "documents")
    return forest.near_duplicates(docs, 4, 80, Staging(spark, "forest")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@query
def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of one label with a cosine of 0.93 or more."""
    return caps.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.93, Staging(spark, "caps")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE["op6_cap_filters"] = caps.oracle(0.93)

@query
def op13_bit_sliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of every document towards the benchmark texts, by bit-sliced sums, and the draw of a tenth."""
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                               Staging(spark, "resampling"))


ORACLE["op13_bit_sliced_resampling"] = resampling.oracle(10_000, 10, 20, "2024")


@query
def op12_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a conditional random field over its
    lines, trained on labelled rows whose crc32(doc_id) is not a multiple of 5."""
    docs = read_table(spark, sf_dir, "documents")
    model = line_crf.fit(docs, read_table(spark, sf_dir, "labels"))
    return line_crf.score(docs, model, ["doc_id"]).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        F.col("line_quality").alias("score"),
        (F.col("line_quality") >= 0.3).cast("int").alias("predicted"))


@query
def op11_drake_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by integer k-means of their parts with adaptive bounds."""
    coded, books = codes.compress(read_table(spark, sf_dir, "embeddings"), Staging(spark, "codes"))
    return codes.with_label_error(coded, books)


ORACLE["op11_drake_hamerly"] = codes.oracle(8, 16, 6, 4096)
