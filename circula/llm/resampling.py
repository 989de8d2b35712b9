"""Importance resampling towards a target distribution, by bit-sliced sums.

A feature is a run of 1 to ``max_words`` consecutive words (joined by one
space, A-Z lower-cased, repeats counted); its bucket is the crc32 of its bytes
modulo ``buckets``.  A bucket's gain says how much commoner it is in the target
than in the corpus:

    floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))

with s and t features of the bucket, S and T features in all.  A document's
weight is the floored mean of the gains of its features, 0 without any.

The sum of gains is *bit-sliced*.  A document's counts by bucket are cut into
planes of ``buckets`` bits: plane i has the bits of weight 2**i of all counts.  The
gains are cut likewise, into planes of their magnitudes with the positive
ones apart from the negative.  Then

    sum = sum over i, j of 2**(i + j) * (popcount(count_i & plus_j) - popcount(count_i & minus_j))

which is exact in integers.  Gains are ``buckets`` numbers, whatever the corpus, so they go
with the tasks; counts by bucket are summed in each task before Spark adds them.

``draw`` keeps the share of the eligible documents with the highest scores,
weight plus Gumbel noise of a hash of the id, which draws without replacement in
proportion to exp(weight / 1000).  The scores' histogram gives the lowest
score that can be drawn, and only rows from there on are sorted and numbered.

Null and empty texts have no features.  Repeated rows are documents of their
own.  A null id has the hash of the bare seed and comes last among ties.  An empty
target or corpus has zero counts; no documents give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.tables import Staging, extended, unused
from circula.llm.words import LOWER, WHITE, Words, runs
from circula.llm.workers import free
from circula.operators.ranking import sequence_numbers

DOCS = 256       # documents whose planes are made at once
LONG_WORD = 64   # bytes from which a feature is hashed by itself
#: A-Z to a-z, and every byte that no word has to a space.
PLAIN = LOWER.copy()
PLAIN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


@dataclass(frozen=True)
class Features:
    buckets: int = 10_000
    max_words: int = 1


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each ``data[start:end]``, all of them a byte at a time."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, size = start[order], size[order]
    far = int(np.searchsorted(-size, -LONG_WORD, "left"))  # the first ``far`` are longer
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[far]) if far < len(size) else 0):
        live = slice(far, int(np.searchsorted(-size, -j, "left")))
        crc[live] = _CRC[(crc[live] ^ data[at[live] + j]) & 255] ^ (crc[live] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(far):
        crc[k] = zlib.crc32(data[at[k]:at[k] + size[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def buckets_of(column: pa.Array, rule: Features) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, documents, each feature's document from there, its bucket) for runs of a text column."""
    for at, raw, bounds in runs(column):
        w = Words(PLAIN[raw], bounds)
        doc, data, start, end = w.doc, w.data, w.start, w.end
        if rule.max_words > 1 and len(start):  # words of a document side by side, one space between
            stay = ~WHITE[data]
            stay[end[end < len(data)]] = True
            place = np.cumsum(stay) - 1
            data, start, end = data[stay], place[start], place[end - 1] + 1
        docs, found = [], []
        for n in range(1, rule.max_words + 1):
            whole = np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:]) if len(doc) >= n else np.zeros(0, np.int64)
            docs.append(doc[whole])
            found.append(crc32s(data, start[whole], end[whole + n - 1]) % np.uint32(rule.buckets))
        yield at, len(bounds) - 1, np.concatenate(docs), np.concatenate(found).astype(np.int64)


def bucket_counts(docs: DataFrame, rule: Features) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches):
        free()
        total = np.zeros(rule.buckets, np.int64)
        for b in batches:
            for _, _, _, found in buckets_of(b.column(0), rule):
                total += np.bincount(found, minlength=rule.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(rule.buckets, np.int64)
    counted = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in counted.collect():  # ``buckets`` rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, from the features by bucket."""
    k = len(corpus)
    big_s, big_t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((int(t) + 1) * (big_s + k)) / ((int(s) + 1) * (big_t + k))))
                     for s, t in zip(corpus, target, strict=True)], np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 (uint8) as rows of 64-bit words, filled up with zeros."""
    body = np.packbits(bits, axis=1)
    return np.pad(body, ((0, 0), (0, -body.shape[1] % 8))).view(np.uint64)


class GainPlanes:
    """Gains as bitplanes: ``plus[j]`` and ``minus[j]`` have the bits of weight 2**j of the magnitudes."""

    def __init__(self, gain: np.ndarray):
        self.buckets = len(gain)
        size = int(np.abs(gain).max(initial=0)).bit_length()
        j = np.arange(size)[:, None]
        self.plus, self.minus = (_packed(((np.maximum(g, 0)[None] >> j) & 1).astype(np.uint8)) if size else []
                                 for g in (gain, -gain))

    def sums(self, n_docs: int, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Exact sum of gains of each of ``n_docs`` documents' features."""
        counts = np.bincount(doc * self.buckets + bucket, minlength=n_docs * self.buckets)
        there = np.flatnonzero(counts)
        many = counts[there]
        out = np.zeros(n_docs, np.int64)
        for i in range(int(many.max(initial=0)).bit_length()):
            bits = np.zeros(n_docs * self.buckets, np.uint8)
            bits[there[(many >> i) & 1 == 1]] = 1
            plane = _packed(bits.reshape(n_docs, self.buckets))
            own = np.flatnonzero(plane.any(1))  # a few long documents have the high planes
            plane = plane[own]
            for j, (plus, minus) in enumerate(zip(self.plus, self.minus, strict=True)):
                ones = (np.bitwise_count(plane & plus).sum(1, dtype=np.int64)
                        - np.bitwise_count(plane & minus).sum(1, dtype=np.int64))
                out[own] += ones << (i + j)
        return out


def weights(docs: DataFrame, gain: np.ndarray, rule: Features, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) of every row, n_words, n_features and weight."""
    keep = keep if keep is not None else ["doc_id"]
    names = [*keep, "n_words", "n_features", "weight"]

    def run(batches):
        free()
        planes = GainPlanes(gain)
        for b in batches:
            for at, n_docs, doc, bucket in buckets_of(b.column(0), rule):
                order = np.argsort(doc, kind="stable")  # runs of several words come after single ones
                doc, bucket = doc[order], bucket[order]
                n = np.bincount(doc, minlength=n_docs)
                # n words have n + (n - 1) + ... features, so their number follows from n_features
                words = n if rule.max_words == 1 else _words(n, rule.max_words)
                ends = np.concatenate([[0], np.cumsum(n)])
                sums = np.concatenate([planes.sums(min(DOCS, n_docs - lo), doc[ends[lo]:ends[min(n_docs, lo + DOCS)]] - lo,
                                                   bucket[ends[lo]:ends[min(n_docs, lo + DOCS)]])
                                       for lo in range(0, n_docs, DOCS)])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(1 + k).slice(at, n_docs) for k in range(len(keep))), pa.array(words, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(sums // np.maximum(n, 1), pa.int64())], names)

    rows = docs.select(F.col("text").alias(unused("_r_text", keep)), *keep)
    return rows.mapInArrow(run, extended(docs.select(*keep).schema, "n_words long, n_features long, weight long"))


def _words(features: np.ndarray, longest: int) -> np.ndarray:
    """Words of a text with so many runs of 1 to ``longest`` words."""
    low = np.arange(longest + 1)
    table = (low * (low + 1)) // 2  # runs of texts of up to ``longest`` words
    short = np.searchsorted(table, features)
    return np.where(features <= table[-1], short, longest + (features - table[-1]) // longest)


def draw(rows: DataFrame, stage: Staging, percent: int, min_words: int, seed: str) -> DataFrame:
    """All rows of ``weights`` (with doc_id) with score, and with rank where the
    row is among the floor(percent * N / 100) highest scores of the N rows that
    have ``min_words`` words."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stage.keep(rows.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = F.col("n_words") >= min_words
    # scores are whole thousandths of logarithms: some 10**5 distinct values at most, whatever the corpus
    counts = scored.where(able).groupBy("score").count().orderBy(F.desc("score")).collect()
    size = percent * sum(n for _, n in counts) // 100
    lowest, above = None, 0
    for value, n in counts:
        if above >= size:
            break
        lowest, above = value, above + n
    near = able & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("n_features"), F.asc("n_words")]
    ranked = sequence_numbers(scored.where(near), order, out_col="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    return ranked.select(*scored.columns, "rank").unionByName(
        scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, stage: Staging, rule: Features | None = None, percent: int = 10,
             min_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (columns doc_id and
    text; others may be there) for the texts of ``target``."""
    rule = rule or Features()
    gain = gains(bucket_counts(docs, rule), bucket_counts(target, rule))
    return draw(weights(docs, gain, rule), stage, percent, min_words, seed)


def oracle(buckets: int, percent: int, min_words: int, seed: str) -> str:
    """DuckDB SQL for ``resample`` with runs of one word; crc32 is folded over a table made by its rule."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: {step})"
    words = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH crc AS MATERIALIZED (SELECT {table} AS tbl),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words.format('text')} AS ws FROM documents),
dw AS MATERIALIZED (SELECT r, unnest(ws) AS w FROM d),
bw AS MATERIALIZED (SELECT unnest({words.format('text')}) AS w FROM benchmark),
known AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
coded AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS b FROM known, crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN coded USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN coded USING (w) GROUP BY b),
g AS (SELECT k.b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM dw) + {buckets}))::DOUBLE
      / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bw) + {buckets}))::DOUBLE))::BIGINT AS gain
      FROM (SELECT unnest(range({buckets})) AS b) k LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
sums AS (SELECT r, sum(gain) AS total FROM dw JOIN coded USING (w) JOIN g USING (b) GROUP BY r),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_features,
      CASE WHEN len(ws) = 0 THEN 0 ELSE floor(total::DOUBLE / len(ws)) END::BIGINT AS weight,
      ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN sums USING (r)),
y AS (SELECT doc_id, n_features AS n_words, n_features, weight,
      (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features) AS place,
      (SELECT count(*) FROM y WHERE n_words >= {min_words}) AS n FROM y WHERE n_words >= {min_words})
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank FROM z
UNION ALL SELECT doc_id, n_words, n_features, weight, score, NULL FROM y WHERE n_words < {min_words}"""
