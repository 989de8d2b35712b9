"""MinHash near-dedup by an LSH forest, with links confirmed on full sets.

A document's *set* is the hashes of its distinct shingles (``words`` words,
A-Z lower-cased); documents of one set are one class and one copy goes on.

*Forest.*  Each of ``TREES`` trees has a signature of its own for a set, a list of ``LEVELS`` minimum
hashes; in the order of a tree's signatures, sets with a common prefix lie side by side, in one *region*.
The orders are not sorted: a region is a group by the hash of the prefix, which finds all sets that
share ``BASE`` entries, where a sorted order would compare neighbours only (README names this
under the choices that differ).  Two sets with a
similarity of 0.8 share no region in any tree with probability
(1 - 0.8**BASE)**TREES, 1e-5.

*Confirmation.*  Regions with two sets or more join their sets to *groups*.  In
a group that fits a task (``GROUP_ITEMS`` shingles), the links are found
exactly: a search from set to set counts common shingles by an inverted
index over the sets not yet reached.  In a larger group the depth adapts:
every tree cuts it into regions of longer common prefixes that fit, those are
searched, and then the sets outside the group's largest component are compared with *all*
sets of the group, in blocks.  So within a group no link is lost and no
task has more than a bounded number of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.components import components
from circula.llm.tables import Staging
from circula.llm.words import LOWER, Words, mix, runs, shingles
from circula.llm.workers import free

TREES, BASE, LEVELS = 16, 3, 6
GROUP_ITEMS = 1_500_000  # shingles that a task searches at once


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a run of text, end to
    end, and where each document's begin (one more entry at the end)."""
    w = Words(LOWER[data], bounds)
    h = w.hashes()
    n_docs = len(bounds) - 1
    key = shingles(h, words)
    at = np.flatnonzero(w.doc[:len(key)] == w.doc[words - 1:]) if len(key) else np.zeros(0, np.int64)
    few = np.flatnonzero((w.counts > 0) & (w.counts < words))  # all words are their one shingle
    short = np.zeros(len(few), np.uint64)
    for k, d in enumerate(few):
        own = h[w.first[d]:w.first[d + 1]]
        short[k] = shingles(own, len(own))[0] ^ np.uint64(len(own))
    doc = np.concatenate([w.doc[at], few])
    value = np.concatenate([key[at], short])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(n_docs + 1))


def signatures(value: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n minimum hashes (unsigned 32-bit) of each set; all ones for an empty set."""
    size = np.diff(first)
    full = np.flatnonzero(size)
    out = np.full((len(size), n), 0xFFFFFFFF, np.uint32)
    if len(full):
        for k, m in enumerate(_multipliers(n)):
            out[full, k] = np.minimum.reduceat(((value * m) >> np.uint64(32)).astype(np.uint32), first[full])
    return out


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64), pa.int64())


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size, class_a and class_b (hash of the set), and trees: per tree
    the hash of the first BASE entries and then the LEVELS - BASE others."""
    names = ["doc_id", "size", "class_a", "class_b", "trees"]
    depth = LEVELS - BASE + 1

    def run(batches):
        free()
        for b in batches:
            for at, data, bounds in runs(b.column(1)):
                value, first = shingle_sets(data, bounds, words)
                size = np.diff(first)
                sums = np.zeros((2, len(value) + 1), np.uint64)
                np.cumsum(mix(value), out=sums[0, 1:])
                np.cumsum(mix(value ^ np.uint64(0xA0761D6478BD642F)), out=sums[1, 1:])
                ones = signatures(value, first, TREES * LEVELS).astype(np.uint64)
                trees = np.zeros((len(size), TREES, depth), np.uint64)
                for t in range(TREES):
                    own = ones[:, t * LEVELS:(t + 1) * LEVELS]
                    for k in range(BASE):
                        trees[:, t, 0] = mix(trees[:, t, 0] + own[:, k] + np.uint64(t + 1))
                    trees[:, t, 1:] = own[:, BASE:]
                lists = pa.FixedSizeListArray.from_arrays(_longs(trees.ravel()), TREES * depth)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(size)), pa.array(size, pa.int64()),
                     _longs(sums[0, first[1:]] - sums[0, first[:-1]]),
                     _longs(sums[1, first[1:]] - sums[1, first[:-1]]), lists.cast(pa.list_(pa.int64()))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, size long, class_a long, class_b long, trees array<long>")


def search(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join all linked sets: (id, id of the component's first set).
    Sets are linked with ``percent`` * union <= 100 * common items."""
    n = len(ids)
    items, where = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum([0] + [len(s) for s in sets])
    size = np.diff(cut)
    owner = np.repeat(np.arange(n), size)
    free = np.ones(n, bool)
    left, built, edges = n, 0, []

    def index():
        keep = free[owner]
        order = np.argsort(where[keep], kind="stable")
        return owner[keep][order], np.searchsorted(where[keep][order], np.arange(len(items) + 1))

    for seed in range(n):
        if not free[seed]:
            continue
        free[seed] = False
        left -= 1
        todo = [seed]
        while todo and left:
            if left < built / 2 or not built:  # the index holds the sets not reached when it was made
                posted, start = index()
                built = left
            at = todo.pop()
            own = where[cut[at]:cut[at + 1]]
            lists = [posted[start[i]:start[i + 1]] for i in own]
            common = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
            near = np.flatnonzero(free & (common > 0))
            hit = near[100 * common[near] >= percent * (size[at] + size[near] - common[near])]
            free[hit] = False
            left -= len(hit)
            todo += hit.tolist()
            edges += [(int(ids[i]), int(ids[seed])) for i in hit]
    return edges


def _searched(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) found within each task's groups; members: doc_id, class_a, class_b, part (a group's hash)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(
        members, F.col("_id") == F.col("doc_id")).select("part", "doc_id", "class_a", "class_b", "text")
    ordered = texts.repartition("part").sortWithinPartitions("part", "doc_id")

    def run(batches):
        free()
        held, ids, sets, met = None, [], [], set()

        def close() -> pa.RecordBatch:
            edges = search(np.array(ids), sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], ["a", "b"])

        for b in batches:
            parts = b.column(0).to_pylist()
            docs_, a_, b_ = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for at, data, bounds in runs(b.column(4)):
                value, first = shingle_sets(data, bounds, words)
                one = np.concatenate([[np.uint64(0)], np.cumsum(mix(value))]).astype(np.uint64)
                sums = (one[first[1:]] - one[first[:-1]]).view(np.int64)
                for i in range(len(bounds) - 1):
                    if parts[at + i] != held:
                        if len(ids) > 1:
                            yield close()
                        held, ids, sets, met = parts[at + i], [], [], set()
                    # of rows with one id, those with the class's set; of equal rows, one
                    key = (int(docs_[at + i]), int(a_[at + i]), int(b_[at + i]))
                    if sums[i] == key[1] and key not in met:
                        met.add(key)
                        ids.append(key[0])
                        sets.append(value[first[i]:first[i + 1]].copy())
        if len(ids) > 1:
            yield close()

    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int, percent: int, stage: Staging) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach)
    of every row.  Empty and null texts have no shingles and link with
    nothing.  Rows with one id count as linked; rows without an id get a null component."""
    all_sets = stage.keep(sets_of(docs, words), "sets")
    classes = stage.keep(
        all_sets.where("size > 0 and doc_id is not null").groupBy("class_a", "class_b")
        .agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("trees").alias("trees")), "classes")
    depth = LEVELS - BASE + 1
    places = (classes.select("node", F.posexplode("trees").alias("at", "entry"))
              .where(F.col("at") % depth == 0).select("node", F.expr(f"at div {depth}").alias("tree"),
                                                      F.col("entry").alias("prefix")))
    least = stage.keep(places.groupBy("tree", "prefix").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n"))
                       .where("n > 1").drop("n"), "regions")
    stars = places.join(least, ["tree", "prefix"]).where("node <> root").select(
        F.col("node").alias("a"), F.col("root").alias("b"))
    groups = stage.keep(components(stars, stage, "groups").withColumnRenamed("component", "part"), "grouped")
    members = stage.keep(classes.join(groups, "node"), "members")
    stage.drop("regions")
    weight = stage.keep(members.groupBy("part").agg(F.sum("size").alias("_items"), F.count(F.lit(1)).alias("_n")),
                        "weights")
    sized = members.join(weight, "part")
    fits = sized.where(F.col("_items") <= GROUP_ITEMS)
    large = stage.keep(sized.where(F.col("_items") > GROUP_ITEMS), "large")
    plain = ["doc_id", "class_a", "class_b", "part"]
    found = _searched(fits.select(F.col("node").alias("doc_id"), *plain[1:]), docs, words, percent)
    edges = stage.keep(found, "edges")
    if large.limit(1).count():
        deep = stage.keep(_searched(_adapted(large, depth).select(*plain), docs, words, percent), "deep_edges")
        known = stage.keep(components(deep, stage, "deep"), "deep_components")
        rest = stage.keep(_searched(_leftover(large, known, stage).select(*plain), docs, words, percent), "rest_edges")
        edges = edges.unionByName(deep).unionByName(rest)
    # rows with one id but different sets are one document
    again = (all_sets.where("doc_id is not null and size > 0").join(
        classes.select("class_a", "class_b", "node"), ["class_a", "class_b"]).where("doc_id <> node")
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    joined = stage.keep(components(edges.unionByName(again), stage, "linked"), "result")
    stage.drop("classes", "members", "weights", "large", "edges", "deep_edges", "rest_edges", "grouped")
    return all_sets.select("doc_id", F.col("size").alias("n_shingles")).join(
        joined, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _adapted(large: DataFrame, depth: int) -> DataFrame:
    """Members of groups too large for a task, once in each tree, by the
    shortest prefix whose region fits; a region that never fits is cut into
    blocks by hash (its sets meet in other trees and in ``_leftover``)."""
    rows = large.select("node", "class_a", "class_b", "part", "size", F.explode(
        F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)),
                    lambda t: F.struct(t.alias("tree"), F.slice("trees", t * depth + 1, depth).alias("path"))))
        .alias("x")).select("node", "class_a", "class_b", "part", "size", "x.tree", "x.path")
    for k in range(depth):
        rows = rows.withColumn(f"_r{k}", F.xxhash64("part", "tree", F.slice("path", 1, k + 1)))
    for k in range(depth):
        items = rows.groupBy(f"_r{k}").agg(F.sum("size").alias(f"_s{k}"))
        # a derived key keeps an exchange under both sides, so that AQE can split a hot region
        rows = rows.join(items.withColumnRenamed(f"_r{k}", "_key"), F.col(f"_r{k}") == F.col("_key")).drop("_key")
    chosen = F.xxhash64(F.col(f"_r{depth - 1}"),
                        F.pmod(F.xxhash64("node"), F.ceil(F.col(f"_s{depth - 1}") / GROUP_ITEMS)))
    for k in reversed(range(depth)):
        chosen = F.when(F.col(f"_s{k}") <= GROUP_ITEMS, F.col(f"_r{k}")).otherwise(chosen)
    return rows.select(F.col("node").alias("doc_id"), "class_a", "class_b", chosen.alias("part"))


def _leftover(large: DataFrame, known: DataFrame, stage: Staging) -> DataFrame:
    """Sets outside the largest component of their group, with every block of
    the group: a part has a block and a bundle of such sets."""
    now = large.join(known.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "node", "class_a", "class_b", "part", "size", "_items", F.coalesce("component", "node").alias("component"))
    now = stage.keep(now, "large_known")
    count = now.groupBy("part", "component").agg(F.count(F.lit(1)).alias("n"))
    best = stage.keep(count.groupBy("part").agg(F.max_by("component", F.struct("n", -F.col("component")))
                                                .alias("_best")), "largest")
    outside = stage.keep(now.join(best, "part").where("component <> _best"), "outside")
    bundles = outside.groupBy("part").agg(F.sum("size").alias("_out"))
    half = GROUP_ITEMS // 2
    bundles = stage.keep(bundles.withColumn("_bundles", F.ceil(F.col("_out") / half)), "bundles")
    blocks = F.ceil(F.col("_items") / half)
    whole = now.join(bundles, "part").select(
        F.col("node").alias("doc_id"), "class_a", "class_b",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("_bundles") - 1), lambda k: F.xxhash64(
            "part", F.pmod(F.xxhash64("node"), blocks), k))).alias("part"))
    loose = outside.join(bundles, "part").select(
        F.col("node").alias("doc_id"), "class_a", "class_b",
        F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.xxhash64(
            "part", b, F.pmod(F.xxhash64("node"), F.col("_bundles"))))).alias("part"))
    return whole.unionByName(loose).distinct()
