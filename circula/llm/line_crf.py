"""Quality of documents by a linear-chain conditional random field over lines.

A text is a chain of its \\n-separated lines, and every line is good or bad.
A line's features are rates of its characters and words (capitals, signs,
words without letters, repeated words, words of 8-word windows that the text
has twice, an equal earlier line and so on) and the same features of the lines before and
after it.  The field has one weight for each feature (towards good), a weight for each
pair of neighbouring labels and one for a good first line.  The forward-backward
pass gives the marginal of each line, and a document's quality is the mean of P(good),
weighted by the lines' lengths (characters, and one for the line end).

Training takes its line labels from the labels of documents.  It reads at most
``Sample.documents`` documents a label, chosen by a hash of their id, cuts them into chains of
``Sample.lines`` lines and takes at most ``Sample.chains`` chains a label, by hash; chains of a
label weigh as much as the label has documents.  The fit is by limited-memory BFGS.

Null and empty texts are one empty line, which has a score like every other
line.  Repeated rows are documents of their own (equal texts have equal scores).  Labels
of null, ids of null and ids without a document teach nothing; an id with several labels is good if
they mostly are.  Without any labels every score is 0.5; with labels of one kind,
all scores are on that kind's side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.quality import _BEYOND, _DIGIT, _LOWER, _SPACE, _STOP, _UPPER, CLASS, REPEAT, SYMBOL
from circula.llm.tables import extended, unused
from circula.llm.words import Words, runs, shingles
from circula.llm.workers import free

OWN = ("blank", "length", "words", "capitals", "digits", "signs", "stops", "signed_words", "bare_words",
       "capital_words", "repeated_words", "twice_in_a_row", "covered", "seen_line", "word_length")
#: Own features, those of the line before and after, and: first, last, equal to the line before, constant.
SIZE = 3 * len(OWN) + 4
_BAR = ord("|")


@dataclass(frozen=True)
class Sample:
    """Bounds of a fit."""

    documents: int = 3000
    chains: int = 6000
    lines: int = 64
    ridge: float = 0.1
    steps: int = 80


def _covered(w: Words, h: np.ndarray) -> np.ndarray:
    """For each word, whether a window of REPEAT words covers it that its text has twice."""
    key = shingles(h, REPEAT)
    at = np.flatnonzero(w.doc[:len(key)] == w.doc[len(h) - len(key):]) if len(key) else np.zeros(0, np.int64)
    change = np.zeros(len(h) + 1, np.int64)
    if len(at):
        key = key[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, where, n = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[n[where] > 1]
        np.add.at(change, twice, 1)
        np.add.at(change, twice + REPEAT, -1)
    return np.cumsum(change[:-1]) > 0


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each line; every document has one at least."""
    ends = np.flatnonzero(data == 10)
    n_docs = len(bounds) - 1
    owner = np.searchsorted(bounds, ends, "right") - 1
    doc = np.concatenate([np.arange(n_docs), owner])
    start = np.concatenate([bounds[:-1], ends + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.where(last, bounds[doc + 1], np.append(start[1:], 0) - 1)
    return doc, start, end


def _own_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, its own features, first / last / equal to the line before / constant, its weight)."""
    doc, start, end = _lines(data, bounds)
    n = len(doc)
    last = np.append(doc[1:] != doc[:-1], True)
    owner = np.repeat(np.arange(n), end - start + ~last)  # of each byte, line ends included
    kinds = np.bincount(owner * 9 + CLASS[data], minlength=9 * n).reshape(n, 9)
    chars = kinds[:, :8].sum(1) - ~last
    dark = np.maximum(1, kinds[:, :8].sum(1) - kinds[:, _SPACE])
    letters = np.maximum(1, kinds[:, _LOWER] + kinds[:, _UPPER] + kinds[:, _BEYOND])
    w = Words(data, bounds)
    h = w.hashes()
    line = owner[w.start] if len(w.start) else np.zeros(0, np.int64)
    count = np.bincount(line, minlength=n)
    words = np.maximum(1, count)

    def share(which: np.ndarray) -> np.ndarray:
        return np.bincount(line[which], minlength=n) / words

    def inside(mask: np.ndarray) -> np.ndarray:
        """Bytes of each word that are in the mask."""
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[w.end] - sums[w.start]

    small, large = inside((data >= 97) & (data <= 122)), inside((data >= 65) & (data <= 90))
    again = np.zeros(len(h), bool)
    order = np.lexsort((np.arange(len(h)), h, line))
    if len(h) > 1:
        same = (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1])
        again[order[1:][same]] = True
    in_a_row = np.zeros(len(h), bool)
    in_a_row[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    whole = _line_hashes(data, start, end, doc)
    seen, as_before = np.zeros(n, bool), np.zeros(n, bool)
    order = np.lexsort((np.arange(n), whole))
    seen[order[1:][whole[order][1:] == whole[order][:-1]]] = True
    as_before[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
    own = np.column_stack([
        count == 0, np.log1p(chars) / 8, np.log1p(count) / 6, kinds[:, _UPPER] / letters, kinds[:, _DIGIT] / dark,
        np.bincount(owner[SYMBOL[data]], minlength=n) / dark, kinds[:, _STOP] / dark,
        share(SYMBOL[data[w.end - 1]] if len(w.end) else np.zeros(0, bool)),
        share(small + large + inside(data >= 128) == 0), share((large > 1) & (small == 0)),
        share(again), share(in_a_row), share(_covered(w, h)), seen & (count > 0),
        np.minimum(30, dark / words) / 10]).astype(np.float32)
    first = np.insert(last[:-1], 0, True)
    place = np.column_stack([first, last, as_before & (count > 0), np.ones(n)]).astype(np.float32)
    return doc, own, place, chars + 1.0


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document of each line, all of its features) of a run of texts."""
    doc, own, place, _ = _own_features(data, bounds)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[place[:, 0] > 0] = 0
    after[place[:, 1] > 0] = 0
    return doc, np.hstack([own, before, after, place])


def _line_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash of each line's bytes and its document, by sums of mixed (byte, place) pairs."""
    powers = np.full(int((end - start).max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    size = end - start
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        (data.astype(np.uint64) + np.uint64(1)) * powers[_places(len(data), start, size)], dtype=np.uint64)])
    h = sums[end] - sums[start]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _places(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Place in its line of each byte (0 for line ends)."""
    some = size > 0
    out = np.zeros(n, np.int64)
    spread = np.repeat(start[some], size[some])
    at = spread + np.arange(len(spread)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
    out[at] = at - spread
    return out


@dataclass
class Chains:
    """Chains side by side: lines sorted so that step k has the k-th lines of the first ``live[k]`` chains."""

    order: np.ndarray  # chain numbers, longest first
    first: np.ndarray  # first line of each chain, in that order
    live: np.ndarray   # chains that have a k-th line

    @classmethod
    def of(cls, sizes: np.ndarray) -> Chains:
        order = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        falling = -sizes[order]
        live = np.searchsorted(falling, -np.arange(int(sizes.max(initial=0))), "left")
        return cls(order, first, live)


def marginals(unary: np.ndarray, pair: np.ndarray, opening: float, chains: Chains,
              with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, the expected label pairs of each chain (chain, 2, 2; zeros unless
    asked for) and each chain's log partition, in the chains' order.  ``unary`` is a line's score for good."""
    n_chains = len(chains.order)
    ahead, back = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    for k, m in enumerate(chains.live):
        at = chains.first[:m] + k
        if k == 0:
            ahead[at, 1] = unary[at] + opening
        else:
            before = ahead[at - 1]
            ahead[at] = np.logaddexp(before[:, :1] + pair[0], before[:, 1:] + pair[1])
            ahead[at, 1] += unary[at]
    total = np.zeros(n_chains)
    pairs = np.zeros((n_chains, 2, 2))
    for k in range(len(chains.live) - 1, -1, -1):
        m, more = chains.live[k], chains.live[k + 1] if k + 1 < len(chains.live) else 0
        at = chains.first[:m] + k
        total[more:m] = np.logaddexp(ahead[at[more:], 0], ahead[at[more:], 1])
        if more:
            own = at[:more]
            later = back[own + 1].copy()
            later[:, 1] += unary[own + 1]
            back[own] = np.logaddexp(pair[:, 0] + later[:, :1], pair[:, 1] + later[:, 1:])
            if not with_pairs:
                continue
            pairs[:more] += np.exp(ahead[own][:, :, None] + pair[None] + later[:, None, :] - total[:more, None, None])
    score = ahead + back
    return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700))), pairs, total


@dataclass
class Model:
    weight: np.ndarray   # of each feature, towards good
    pair: np.ndarray     # [label before, label], 0 bad and 1 good
    opening: float       # towards a good first line

    def _unary(self, own: np.ndarray, place: np.ndarray) -> np.ndarray:
        k = len(OWN)
        parts = np.stack([self.weight[:k], self.weight[k:2 * k], self.weight[2 * k:3 * k]], 1)
        said = own.astype(np.float64) @ parts
        out = said[:, 0] + place @ self.weight[3 * k:]
        out[1:] += np.where(place[1:, 0] > 0, 0, said[:-1, 1])
        out[:-1] += np.where(place[:-1, 1] > 0, 0, said[1:, 2])
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """Quality of each text of a string column."""
        out = []
        for _, data, bounds in runs(column):
            doc, own, place, size = _own_features(data, bounds)
            chains = Chains.of(np.bincount(doc, minlength=len(bounds) - 1))
            good, _, _ = marginals(self._unary(own, place), self.pair, self.opening, chains)
            out.append(np.bincount(doc, good * size) / np.bincount(doc, size))
        return np.concatenate(out) if out else np.zeros(0)


def _loss(theta: np.ndarray, x: np.ndarray, chains: Chains, sizes: np.ndarray, good: np.ndarray,
          weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Weighted negative log likelihood with its gradient; ``good``, ``sizes`` and ``weight`` are by chain."""
    w, pair, opening = theta[:SIZE], theta[SIZE:SIZE + 4].reshape(2, 2), theta[SIZE + 4]
    unary = x @ w
    p, pairs, total = marginals(unary, pair, opening, chains, True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = np.bincount(owner, unary, len(sizes))
    said = np.where(good, own + opening + (sizes - 1) * pair[1, 1], (sizes - 1) * pair[0, 0])[chains.order]
    weighed = weight[chains.order]
    loss = (weighed * (total - said)).sum() + ridge / 2 * (theta ** 2).sum()
    slope = np.empty_like(theta)
    slope[:SIZE] = x.T @ (weight[owner] * (p - good[owner]))
    happens = np.zeros((len(sizes), 2, 2))
    is_good = good[chains.order]
    happens[:, 1, 1], happens[:, 0, 0] = is_good * (sizes[chains.order] - 1), ~is_good * (sizes[chains.order] - 1)
    slope[SIZE:SIZE + 4] = (weighed[:, None, None] * (pairs - happens)).sum(0).ravel()
    slope[SIZE + 4] = (weighed * (p[chains.first] - is_good)).sum()
    return loss, slope + ridge * theta


def train(chains: list[tuple[bool, np.ndarray]], n_good: float, n_bad: float, sample: Sample | None = None) -> Model:
    """Fit on (good, features of the lines) chains; a label's chains weigh together as its
    share of ``n_good`` and ``n_bad`` documents says."""
    sample = sample or Sample()
    theta = np.zeros(SIZE + 5)
    if chains:
        good = np.array([g for g, _ in chains])
        sizes = np.array([len(x) for _, x in chains])
        x = np.concatenate([x for _, x in chains]).astype(np.float64)
        part = np.where(good, n_good / max(1, good.sum()), n_bad / max(1, (~good).sum()))
        weight = part * len(chains) / part.sum()
        side = Chains.of(sizes)
        theta = _minimum(lambda t: _loss(t, x, side, sizes, good, weight, sample.ridge), theta, sample.steps)
    return Model(theta[:SIZE], theta[SIZE:SIZE + 4].reshape(2, 2), float(theta[SIZE + 4]))


def _minimum(loss, theta: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with a halving line search."""
    value, slope = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, turns = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (s @ y)
            way -= a * y
            turns.append(a)
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.linalg.norm(way))
        for (s, y), a in zip(past, reversed(turns), strict=True):
            way += (a - (y @ way) / (s @ y)) * s
        fall, size = slope @ way, 1.0
        while True:
            new = theta - size * way
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * fall or size < 1e-8:
                break
            size /= 2
        s, y = new - theta, new_slope - slope
        done = value - new_value <= 1e-7 * abs(value)
        if new_value <= value:
            theta, value, slope = new, new_value, new_slope
        if done:
            break
        if s @ y > 1e-12:
            past = [*past[-memory + 1:], (s, y)]
    return theta


def fit(docs: DataFrame, labels: DataFrame, sample: Sample | None = None, label_col: str = "quality") -> Model:
    """Train on documents whose id has a label and a crc32 (of the id as text)
    that 5 does not divide."""
    sample = sample or Sample()
    key = F.col("doc_id")
    marked = (labels.select(key.cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_good"))
              .where(key.isNotNull() & F.col("_good").isin(0, 1)
                     & (F.crc32(key.cast("string").cast("binary")) % 5 != 0))
              .groupBy("doc_id").agg((F.avg("_good") >= 0.5).alias("_good")))
    many = {r["_good"]: r["count"] for r in marked.groupBy("_good").count().collect()}
    order = F.xxhash64(F.lit(12), key)
    chosen = marked.where(F.col("_good")).orderBy(order, key).limit(sample.documents).union(
        marked.where(~F.col("_good")).orderBy(order, key).limit(sample.documents))

    def cut(batches):
        free()
        for b in batches:
            goods = b.column(1).to_numpy(zero_copy_only=False)
            for at, data, bounds in runs(b.column(0)):
                doc, x = line_features(data, bounds)
                firsts = np.searchsorted(doc, np.arange(len(bounds) - 1))
                ends = np.append(firsts[1:], len(doc))
                parts = [(goods[at + d], x[lo:min(lo + sample.lines, ends[d])].tobytes())
                         for d in range(len(firsts)) for lo in range(firsts[d], ends[d], sample.lines)]
                for lo in range(0, len(parts), 256):
                    some = parts[lo:lo + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g for g, _ in some], pa.bool_()), pa.array([c for _, c in some], pa.binary())],
                        ["good", "chain"])

    texts = (docs.select(key.cast("long").alias("doc_id"), F.col("text").alias("_c_text"))
             .join(F.broadcast(chosen), "doc_id").select("_c_text", "_good"))  # 2 * sample.documents rows at most
    rows = texts.mapInArrow(cut, "good boolean, chain binary")
    by = [F.xxhash64(F.lit(13), "chain"), F.col("chain")]
    some = [rows.where(F.col("good") == g).orderBy(*by).limit(sample.chains) for g in (True, False)]
    got = [(r["good"], np.frombuffer(r["chain"], np.float32).reshape(-1, SIZE)) for r in some[0].union(some[1]).collect()]
    return train(got, many.get(True, 0), many.get(False, 0), sample)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "line_quality") -> DataFrame:
    """``keep`` columns of every row (all by default) with the column ``name``, 0 to 1."""
    keep = keep if keep is not None else docs.columns

    def run(batches):
        free()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*(b.column(1 + k) for k in range(len(keep))), pa.array(model.scores(b.column(0)), pa.float64())],
                [*keep, name])

    rows = docs.select(F.col("text").alias(unused("_c_text", keep)), *keep)
    return rows.mapInArrow(run, extended(docs.select(*keep).schema, f"{name} double"))
