"""Embedding near-dedup by spherical-cap filters.

A filter is a direction; it holds the vectors whose cosine with it exceeds a
height.  The directions are a *structured random product code*: the space is
rotated at random and cut into blocks, each block has a list of random
words, and a direction has one word in each block.  A vector is *list-decoded*
to all directions above the height: partial sums over the blocks are kept only while the
best words of the blocks to come could still lift them above it, so
the cost follows the list and not the number of directions.  The height is set so
that a vector has ``LISTED`` directions on average; every vector has its
``AT_LEAST`` best ones in any case.

Vectors of one label that share a filter are compared by cosine in double
precision.  The number of directions grows with the largest label, so that a filter holds
about ``HELD`` unrelated vectors at any size.  Equal vectors are one class.
A filter that holds more than ``BLOCK`` classes is compared in pairs of
blocks, each a task of its own.  A pair that shares several filters counts in
the smallest, so links are summed without listing pairs: a task returns
the links of each of its vectors, and edges that connect those it found linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.components import components
from circula.llm.tables import Staging
from circula.llm.workers import free

LISTED, AT_LEAST = 24, 12
HELD = 48
BLOCK = 1024
DIRECTIONS_AT_ONCE = 2048  # columns of a matrix of who has which direction
SEED = 20_240_501


class Code:
    """Product code for vectors of one dimension with about ``directions`` directions."""

    def __init__(self, dimension: int, directions: int):
        rng = np.random.default_rng([SEED, dimension])
        blocks = 2 if directions <= 1 << 14 else 3 if directions <= 1 << 21 else 4
        self.blocks = max(1, min(blocks, dimension // 4))
        self.size = max(2, round(directions ** (1 / self.blocks)))
        self.turn = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        self.cuts = [dimension * k // self.blocks for k in range(self.blocks + 1)]
        self.words = []
        for k in range(self.blocks):
            w = rng.normal(size=(self.size, self.cuts[k + 1] - self.cuts[k]))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(self.blocks))
        share = min(0.5, LISTED / self.size ** self.blocks)
        self.height = NormalDist().inv_cdf(1 - share) / np.sqrt(dimension)

    def lists(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of the directions of each unit vector."""
        x = unit @ self.turn
        scores = [x[:, a:b] @ w.T for a, b, w in zip(self.cuts, self.cuts[1:], self.words, strict=False)]
        best = [s.max(1) for s in scores]
        out = []
        for i in range(len(x)):
            height = self.height
            while True:
                held, number = np.zeros(1), np.zeros(1, np.int64)
                for k, s in enumerate(scores):
                    rest = sum(b[i] for b in best[k + 1:])
                    held = (held[:, None] + s[i][None]).ravel()
                    number = (number[:, None] * self.size + np.arange(self.size)[None]).ravel()
                    able = held + rest >= height
                    held, number = held[able], number[able]
                if len(number) >= min(AT_LEAST, self.size ** self.blocks):
                    break
                height -= 0.25 / np.sqrt(x.shape[1])  # too few: its best directions, from a lower height
            if height < self.height:
                number = number[np.argsort(-held, kind="stable")[:AT_LEAST]]
            out.append(np.sort(number))
        return out


def _valid(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id, label and value (array of double) of the rows that can link."""
    value = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                          value.alias("value"))
    good = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("value").isNotNull()
            & F.forall("value", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("value", lambda x: x != 0))
    return rows.where(good)


def _units(column: pa.Array) -> list[np.ndarray]:
    """Vectors of a list column at length 1 (scaled first, so that no square overflows)."""
    unit = []
    for v in column:
        x = np.array(v.values.to_numpy(zero_copy_only=False), np.float64)
        x = x / np.abs(x).max()
        unit.append(x / np.linalg.norm(x))
    return unit


def _filtered(classes: DataFrame, directions: int) -> DataFrame:
    """A row for each class and direction: bucket, node, copies, unit vector and list of directions (binary)."""
    names = ["label", "dim", "filter", "node", "copies", "unit", "listed"]

    def run(batches):
        free()
        codes: dict[int, Code] = {}
        for b in batches:
            if not b.num_rows:
                continue
            unit = _units(b.column(3))
            dims = np.array([len(u) for u in unit])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if int(d) not in codes:
                    codes[int(d)] = Code(int(d), directions)
                code = codes[int(d)]
                for lo in range(0, len(at), 1024):
                    some = at[lo:lo + 1024]
                    lists = code.lists(np.stack([unit[i] for i in some]))
                    own = np.repeat(some, [len(x) for x in lists])
                    rows = pa.array(own, pa.int64())
                    bodies = pa.array([unit[i].tobytes() for i in some], pa.binary())
                    said = pa.array([x.tobytes() for x in lists], pa.binary())
                    place = pa.array(np.repeat(np.arange(len(some)), [len(x) for x in lists]), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(2).take(rows), pa.array(np.full(len(own), d), pa.int32()),
                         pa.array(np.concatenate(lists), pa.int64()), b.column(0).take(rows),
                         b.column(1).take(rows), bodies.take(place), said.take(place)], names)

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("node", "copies", "label", "value").mapInArrow(
        run, f"label {kind}, dim int, filter long, node long, copies long, unit binary, listed binary")


def _groups(links: np.ndarray) -> np.ndarray:
    """Smallest index reached from each by links (square boolean matrix)."""
    root = np.arange(len(links))
    while True:
        new = np.minimum(root, np.where(links, root[None], len(links)).min(1))
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _compare(filter_: int, left: np.ndarray, right: np.ndarray, node: np.ndarray, copies: np.ndarray,
             unit: np.ndarray, lists: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links counted in this filter by member, and edges of all that it finds
    linked; members ``left`` are compared with members ``right``."""
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    near = unit[a] @ unit[b].T >= least
    near &= a[:, None] != b[None]
    links = np.zeros(len(node), np.int64)
    if not near.any():
        return links, a[:0], a[:0]
    hit = np.zeros(len(node), bool)
    hit[a[near.any(1)]] = True
    hit[b[near.any(0)]] = True
    # of those, the directions before this one: a pair that shares one is counted there
    before = [lists[i][lists[i] < filter_] if hit[i] else lists[i][:0] for i in range(len(node))]
    known, place = np.unique(np.concatenate(before), return_inverse=True)
    owner = np.repeat(np.arange(len(node)), [len(x) for x in before])
    count = near.copy()
    for lo in range(0, len(known), DIRECTIONS_AT_ONCE):
        some = (place >= lo) & (place < lo + DIRECTIONS_AT_ONCE)
        has = np.zeros((len(node), min(DIRECTIONS_AT_ONCE, len(known) - lo)), np.float32)
        has[owner[some], place[some] - lo] = 1
        count &= has[a] @ has[b].T == 0
    if left is right:
        links[a] = count @ copies[b]
    else:
        links[a] += count @ copies[b]
        links[b] += count.T @ copies[a]
    full = np.zeros((len(node), len(node)), bool)
    full[np.ix_(a, b)] = near
    full |= full.T
    root = _groups(full)
    moved = np.flatnonzero(root != np.arange(len(node)))
    return links, moved, root[moved]


def _linked(parts: DataFrame, least: float) -> DataFrame:
    """(a, b, n): links n of class a, or (with n null) an edge from a to b.
    A part is one filter's members, or two blocks of them."""
    keys = ["label", "dim", "filter", "i", "j"]
    ordered = parts.repartition(*keys).sortWithinPartitions(*keys)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
             pa.array(cols[2], pa.int64(), mask=cols[2] < 0)], ["a", "b", "n"])

    def judged(key: tuple, rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        side, node, copies, unit, lists = zip(*rows, strict=True)
        side, node = np.array(side), np.array(node)
        at = (side == key[3], side == key[4])
        at = (at[0], at[0]) if key[3] == key[4] else at
        links, moved, root = _compare(key[2], *at, node, np.array(copies), np.stack([np.frombuffer(u) for u in unit]),
                                      [np.frombuffer(x, np.int64) for x in lists], least)
        has = np.flatnonzero(links)
        return [(node[has], node[has], links[has]), (node[moved], node[root], np.full(len(moved), -1))]

    def run(batches) -> Iterator[pa.RecordBatch]:
        free()
        key, rows, found, size = None, [], [], 0
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for r in zip(*columns, strict=True):
                if r[:5] != key:
                    if rows:
                        found += judged(key, rows)
                        size += len(rows)
                        if size > 50_000:
                            yield batch(found)
                            found, size = [], 0
                    key, rows = r[:5], []
                rows.append(r[5:])
        if rows:
            found += judged(key, rows)
        yield batch(found)

    return ordered.select(*keys, "side", "node", "copies", "unit", "listed").mapInArrow(
        run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float, stage: Staging, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links and component_id of every row (columns vec_id, label and
    ``vector``).  Links join rows of one label with a cosine of ``least`` or more;
    rows with a null id or label, or a vector that is null, zero or has a null or
    non-finite component, link with nothing, nor do vectors of different lengths.  Rows without an id
    have a null component."""
    rows = _valid(vectors, vector).withColumn("_a", F.xxhash64("label", "value")).withColumn(
        "_b", F.hash(F.lit(3), "value", "label"))
    rows = stage.keep(rows, "vectors")
    classes = stage.keep(rows.groupBy("label", "_a", "_b").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("value").alias("value")), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    directions = max(64, LISTED * largest // HELD)
    listed = stage.keep(_filtered(classes, directions), "listed")
    keys = ["label", "dim", "filter"]
    held = stage.keep(listed.groupBy(*keys).count().where(F.col("count") > BLOCK)
                      .withColumn("_blocks", F.ceil(F.col("count") / BLOCK)).drop("count"), "crowded")
    blocked = listed.join(held, keys, "left")
    side = F.pmod(F.xxhash64("node"), F.coalesce("_blocks", F.lit(1))).cast("int")
    blocked = blocked.withColumn("side", side).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)).cast("int") - 1)))
    parts = blocked.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    found = stage.keep(_linked(parts, least), "links")
    stage.drop("listed")
    links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    own = rows.join(classes.drop("value").withColumnRenamed("label", "_label"),
                    (rows["label"] == F.col("_label")) & (rows["_a"] == classes["_a"])
                    & (rows["_b"] == classes["_b"])).select("vec_id", "node", "copies")
    own = stage.keep(own.join(links, F.col("node") == F.col("a"), "left").select(
        "vec_id", "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "own")
    edges = found.where("n is null").select("a", "b").unionByName(
        own.select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    joined = stage.keep(components(edges, stage), "component")
    counted = stage.keep(own.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
                         .join(joined, F.col("vec_id") == F.col("node"), "left")
                         .select(F.col("vec_id").alias("_id"), "n_links", "component"), "counted")
    stage.drop("vectors", "classes", "links", "own", "component", "crowded")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(
        counted, F.col("vec_id") == F.col("_id"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))


def oracle(least: float) -> str:
    """DuckDB SQL for ``near_duplicates`` over the table embeddings, with kept."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {least}),
 r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT p.y, r.m FROM r JOIN p ON r.n = p.x AND r.m < p.y),
 c AS (SELECT n, min(m) AS m FROM r GROUP BY n),
 k AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(k.n, 0) AS n_links, c.m AS component_id, vec_id = c.m AS kept
FROM embeddings JOIN c ON c.n = vec_id LEFT JOIN k ON k.x = vec_id"""
