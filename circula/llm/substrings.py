"""Substring dedup: matching statistics of documents on suffix automata.

A *window* is ``window`` consecutive words; a word goes if it lies in a window
whose words also start anywhere else, in the same document or another.

*Pieces.*  Every window has an anchor, the smallest hash of its shingles of
``SHINGLE`` words, so equal windows have equal anchors.  Consecutive windows
of one anchor (``MOST`` at most) make a piece.  A window can only repeat if
its anchor does, and only pieces of repeated anchors go on; equal pieces are
counted together, and all windows of a piece that is there twice repeat.

*Reference shards.*  Pieces that are there once, and all others of their
anchor, are dealt to shards by anchor.  A shard's task reads its pieces in order of
anchors and builds suffix automata over the word hashes of about
``SHARD_WORDS`` words each, with the number of places of every state.  The same
pieces are then streamed through the automaton.  Where the matching statistic
reaches the window and its state has two places, the window repeats; the
maximal runs of such words are removed.  An automaton only meets the documents' pieces
that can match it, so the work grows with the text and not with its square.

*Hot anchors*, with more than ``HOT_WORDS`` words in distinct pieces, would
make one large automaton: a passage that many documents share gives each of them
pieces that cross its edge.  Such an anchor's windows are dealt a second time, by the
smallest shingle that is not common among the anchor's pieces, so that a window goes
with the words around the passage.  Windows in a row that stay together are a
piece again, equal ones are counted together, and the new, smaller groups go to automata.
Groups that are still hot are dealt again; the ``LEVELS``-th time deals each window by all of its
words, after which a group holds equal windows only.  Common shingles are those of a
``1 / COMMON`` share of an anchor's pieces or more, found by counting those that are common in one
task (one that is common in all is so in some task).

Rows with equal texts and ids are documents of their own.  Null and empty texts have no
words; texts shorter than a window stay whole.  Hashes of words have 64 bits,
those of pieces and windows are used together with their anchors' 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.tables import Staging, extended, unused
from circula.llm.words import Words, mix, runs, shingles
from circula.llm.workers import free

SHINGLE = 8
MOST = 28               # windows of a piece, one bit each
SHARD_WORDS = 20_000    # words of one automaton, unless a single anchor has more
HOT_WORDS = 40_000
COMMON = 16             # a shingle of one in so many pieces of a hot anchor deals no windows
LEVELS = 4
SALTS = 16              # parts of a hot anchor's pieces when its common shingles are joined


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(max(n, 1), b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """Smallest of ``span`` values from each place on."""
    n, width = len(values) - span + 1, 1
    while 2 * width <= span:  # smallest of ``width`` values from each place, doubled
        values = np.minimum(values[:len(values) - width], values[width:])
        width *= 2
    rest = span - width
    return np.minimum(values[:n], values[rest:rest + n])


def _cut(h: np.ndarray, doc: np.ndarray, anchor: np.ndarray,
         window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of windows with the anchors ``anchor`` over word hashes ``h`` of the documents ``doc``: first word,
    number of windows, hash of the words, and whether a window is in the piece twice."""
    n = len(anchor)
    whole = doc[:n] == doc[window - 1:]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    run = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    first |= whole & ((np.arange(n) - run) % MOST == 0)
    start = np.flatnonzero(first)
    piece = np.cumsum(first) - 1
    size = np.bincount(piece[whole], minlength=len(start)) if len(start) else start
    powers, inverse = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[:len(h)], out=sums[1:])
    key = mix((sums[start + size + window - 1] - sums[start]) * inverse[start] + size.astype(np.uint64))
    one = (sums[window:] - sums[:-window]) * inverse[:n]  # every window alone
    twice = np.zeros(n, bool)
    for p in range(1, min(MOST, n)):
        twice[:-p] |= (one[p:] == one[:-p]) & (piece[p:] == piece[:-p]) & whole[p:] & whole[:-p]
    inner = np.bincount(piece[twice], minlength=len(start)) > 0 if len(start) else first[:0]
    return start, size, key, inner


class _Pieces:
    """Pieces of the documents in a run of text: word index ``start``, number
    of windows ``size``, ``anchor``, hash ``key`` of the words, and whether a
    window is in the piece twice (``inner``)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, window: int):
        self.words = w = Words(data, bounds)
        self.hashes = h = w.hashes()
        if len(h) < window:
            self.start = self.size = np.zeros(0, np.int64)
            self.anchor = self.key = np.zeros(0, np.uint64)
            self.inner = np.zeros(0, bool)
            return
        anchor = _smallest(shingles(h, SHINGLE), window - SHINGLE + 1)
        self.start, self.size, self.key, self.inner = _cut(h, w.doc, anchor, window)
        self.anchor = anchor[self.start]


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64), pa.int64())


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Anchors that are there twice."""
    def run(batches):
        free()
        for b in batches:
            for _, data, bounds in runs(b.column(0)):
                p = _Pieces(data, bounds, window)
                keys, where = np.unique(p.anchor, return_inverse=True)
                n = np.bincount(where, 1 + p.inner, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([_longs(keys), pa.array(n, pa.int64())], ["anchor", "n"])

    return (docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor")
            .agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))


def _places(docs: DataFrame, window: int) -> DataFrame:
    """All pieces of all documents: anchor, key, doc_id, text_hash, place (word of the document) and size."""
    names = ["anchor", "key", "doc_id", "text_hash", "place", "size"]

    def run(batches):
        free()
        for b in batches:
            for at, data, bounds in runs(b.column(2)):
                p = _Pieces(data, bounds, window)
                owner = p.words.doc[p.start]
                rows = pa.array(owner + at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [_longs(p.anchor), _longs(p.key), b.column(0).take(rows), b.column(1).take(rows),
                     pa.array(p.start - p.words.first[owner], pa.int32()), pa.array(p.size, pa.int32())], names)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(
        run, "anchor long, key long, doc_id long, text_hash long, place int, size int")


def _texts_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Word hashes of the pieces at the places ``wanted``: anchor, key, n, size, words (binary)."""
    lists = (wanted.groupBy("doc_id", "text_hash")
             .agg(F.collect_list(F.struct("anchor", "key", "n", "size", "place")).alias("pieces")))
    joined = docs.alias("d").join(
        lists.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
        & (F.col("d.text_hash") == F.col("w.text_hash"))).select("d.text", "w.pieces")
    names = ["anchor", "key", "n", "size", "words"]

    def run(batches):
        free()
        for b in batches:
            pieces = b.column(1)
            for at, data, bounds in runs(b.column(0)):
                w = Words(data, bounds)
                h = w.hashes()
                out: list[list] = [[] for _ in names]
                for i in range(len(bounds) - 1):
                    for p in pieces[at + i].as_py():
                        lo = w.first[i] + p["place"]
                        for to, name in zip(out, names[:4], strict=False):
                            to.append(p[name])
                        out[4].append(h[lo:lo + p["size"] + window - 1].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], names)

    found = joined.mapInArrow(run, "anchor long, key long, n long, size int, words binary")
    return found.dropDuplicates(["anchor", "key"])  # rows that are equal in id and text give a piece twice


class Automaton:
    """Suffix automaton of several sequences; ``places`` of a state is the
    number of places, weighted by sequence, where its words end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def add(self, words: list[int], weight: int = 1) -> None:
        nexts, link, length, places = self.next, self.link, self.length, self.places
        last = 0
        for c in words:
            q = nexts[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
            elif q is not None:
                last = self._split(last, c, q)
            else:
                cur = len(nexts)
                nexts.append({})
                link.append(0)
                length.append(length[last] + 1)
                places.append(0)
                p = last
                while p >= 0:
                    q = nexts[p].get(c)
                    if q is not None:
                        link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                        break
                    nexts[p][c] = cur
                    p = link[p]
                last = cur
            places[last] += weight

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.places.append(0)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def close(self) -> None:
        """Count the places of every state, once all sequences are in."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[s]] += self.places[s]

    def repeated(self, words: list[int], window: int) -> int:
        """Bits of the windows of ``words`` that end in two places or more."""
        state, matched, bits = 0, 0, 0
        nexts, link, length, places = self.next, self.link, self.length, self.places
        for i, c in enumerate(words):
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(c)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            while length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if matched >= window and places[state] > 1:
                bits |= 1 << (i - window + 1)
        return bits


def _automata(pieces: DataFrame, window: int) -> DataFrame:
    """anchor, key and bits of the windows that repeat, of the pieces that are there once."""
    ordered = pieces.repartition("anchor").sortWithinPartitions("anchor")

    def judged(shard: list[tuple]) -> tuple[list, list, list]:
        made = Automaton()
        for _, _, n, words in shard:
            made.add(words, n)
        made.close()
        out = [(a, k, made.repeated(words, window)) for a, k, n, words in shard if n == 1]
        return tuple(list(x) for x in zip(*(r for r in out if r[2]), strict=True)) or ([], [], [])

    def run(batches):
        free()
        shard, words = [], 0
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                       b.column(4), strict=True)
            for anchor, key, n, said in rows:
                if words > SHARD_WORDS and anchor != shard[-1][0]:  # a shard has whole anchors
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in judged(shard)],
                                                     ["anchor", "key", "bits"])
                    shard, words = [], 0
                shard.append((anchor, key, n, np.frombuffer(said.as_py(), np.uint64).tolist()))
                words += len(shard[-1][3])
        if shard:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in judged(shard)],
                                             ["anchor", "key", "bits"])

    return ordered.mapInArrow(run, "anchor long, key long, bits long")


class _Beside:
    """Words of a batch's pieces (columns anchor, key, n, size, words) side by side."""

    def __init__(self, b: pa.RecordBatch):
        said = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(4)]
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *said])
        sizes = np.array([len(x) for x in said], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.piece = np.repeat(np.arange(len(said)), sizes)
        self.anchor = b.column(0).to_numpy().view(np.uint64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of all places, apart by anchor, and which of them are in one piece."""
        s = shingles(self.hashes, SHINGLE)
        return s, self.piece[:len(s)] == self.piece[SHINGLE - 1:SHINGLE - 1 + len(s)]


def _common(pieces: DataFrame) -> DataFrame:
    """anchor and its common shingles (a list of at most some thousands)."""
    def run(batches):
        free()
        for b in batches:
            x = _Beside(b)
            s, whole = x.shingles()
            at = np.flatnonzero(whole)
            both = np.unique(np.column_stack([x.anchor[x.piece[at]], s[at], x.piece[at].astype(np.uint64)]), axis=0)
            pairs, n = np.unique(both[:, :2], axis=0, return_counts=True)
            anchors, many = np.unique(x.anchor, return_counts=True)
            often = n * 2 * COMMON >= many[np.searchsorted(anchors, pairs[:, 0])]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([_longs(pairs[often, 0]), _longs(anchors)]),
                 pa.concat_arrays([_longs(pairs[often, 1]), pa.nulls(len(anchors), pa.int64())]),
                 pa.array(np.concatenate([n[often], many]), pa.int64())], ["anchor", "shingle", "n"])

    counts = pieces.mapInArrow(run, "anchor long, shingle long, n long").groupBy("anchor", "shingle").agg(
        F.sum("n").alias("n"))
    many = counts.where("shingle is null").select("anchor", F.col("n").alias("many"))
    return (counts.where("shingle is not null").join(many, "anchor").where(F.col("n") * (2 * COMMON) >= F.col("many"))
            .groupBy("anchor").agg(F.collect_list("shingle").alias("common")))


def _dealt_again(pieces: DataFrame, window: int, level: int, stage: Staging) -> DataFrame:
    """Pieces of the windows of hot anchors' pieces: anchor (a new one), key, n, size, words, and where they are: piece_anchor, piece_key and at."""
    names = ["anchor", "key", "n", "size", "words", "piece_anchor", "piece_key", "at"]

    def run(batches):
        free()
        for b in batches:
            if not b.num_rows:
                continue
            x = _Beside(b)
            if level + 1 < LEVELS:
                s, _ = x.shingles()
                mark = mix(x.anchor)  # shingles are told apart by anchor
                _, rows = np.unique(x.anchor, return_index=True)
                common = [np.array(b.column(5)[i].as_py() or [], np.int64).view(np.uint64) ^ mark[i] for i in rows]
                s[np.isin(s ^ mark[x.piece][:len(s)], np.concatenate(common))] = np.uint64(0xFFFFFFFFFFFFFFFF)
                again = _smallest(s, window - SHINGLE + 1)
            else:
                again = shingles(x.hashes, window)
            start, size, key, _ = _cut(x.hashes, x.piece, again, window)
            own = x.piece[start]
            rows = pa.array(own, pa.int64())
            words = pa.array([x.hashes[lo:lo + n + window - 1].tobytes() for lo, n in zip(start, size, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [_longs(mix(again[start] + x.anchor[own] * np.uint64(0x9E3779B97F4A7C15))), _longs(key),
                 b.column(2).take(rows), pa.array(size, pa.int32()), words, b.column(0).take(rows),
                 b.column(1).take(rows), pa.array(start - x.first[own], pa.int32())], names)

    if level + 1 < LEVELS:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        common = stage.keep(_common(pieces), f"common{level}").select("anchor", "common", salts)
        pieces = pieces.withColumn("_salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(
            common, ["anchor", "_salt"], "left").select("anchor", "key", "n", "size", "words", "common")
    return pieces.mapInArrow(run, "anchor long, key long, n long, size int, words binary, "
                                  "piece_anchor long, piece_key long, at int")


def _judged(pieces: DataFrame, window: int, stage: Staging, level: int = 0) -> DataFrame:
    """anchor, key and bits of the windows that repeat, of the pieces (anchor, key, n, size, words) that are there once."""
    sizes = pieces.groupBy("anchor").agg(F.sum(F.col("size") + (window - 1)).alias("_words"))
    hot = stage.keep(sizes.where(F.col("_words") > HOT_WORDS).select("anchor"), f"hot{level}")
    if level == LEVELS or hot.isEmpty():  # equal windows only, whose number is that of the groups
        return _automata(pieces, window)
    # at most one anchor for each HOT_WORDS words of the text; the joins are shuffle joins unless that is little
    cool = _automata(pieces.join(hot, "anchor", "left_anti"), window)
    dealt = stage.keep(_dealt_again(pieces.join(hot, "anchor", "left_semi"), window, level, stage), f"dealt{level}")
    distinct = stage.keep(dealt.groupBy("anchor", "key").agg(
        F.sum("n").alias("n"), F.first("size").alias("size"), F.first("words").alias("words")), f"distinct{level}")
    open_ = distinct.where("n = 1").select("anchor").distinct()
    found = _judged(distinct.join(open_, "anchor", "left_semi"), window, stage, level + 1)
    whole = distinct.where("n > 1").select("anchor", "key", F.expr("shiftleft(1L, size) - 1").alias("bits"))
    again = dealt.where("n = 1").drop("words").join(found.unionByName(whole), ["anchor", "key"])
    again = again.groupBy("piece_anchor", "piece_key").agg(F.bit_or(F.expr("shiftleft(bits, at)")).alias("bits"))
    return cool.unionByName(again.select(F.col("piece_anchor").alias("anchor"), F.col("piece_key").alias("key"), "bits"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                       F.coalesce("text", F.lit("")).alias("text"))


def repeated(docs: DataFrame, window: int, stage: Staging) -> DataFrame:
    """doc_id, text_hash and spans (place of a piece, its windows that repeat as
    bits) of every document with a repeated window."""
    if window < SHINGLE:
        raise ValueError(f"a window has at least {SHINGLE} words")
    keyed = _keyed(docs)
    anchors = stage.keep(_anchors(keyed, window), "anchors")
    places = stage.keep(_places(keyed, window).join(anchors, "anchor"), "places")
    stage.drop("anchors")
    first = F.min(F.struct("doc_id", "text_hash", "place")).alias("first")
    distinct = stage.keep(places.groupBy("anchor", "key").agg(
        F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), first), "distinct")
    groups = stage.keep(distinct.where("n = 1").select("anchor").distinct(), "groups")
    asked = distinct.join(groups, "anchor").select(
        "anchor", "key", "n", "size", "first.doc_id", "first.text_hash", "first.place")
    texts = stage.keep(_texts_of(keyed, asked, window), "pieces")
    whole = distinct.where("n > 1").select(
        "anchor", "key", F.expr("shiftleft(1L, size) - 1").alias("bits"))
    masks = stage.keep(whole.unionByName(_judged(texts, window, stage)), "masks")
    stage.drop("pieces", "groups", "distinct")
    stage.drop(*(f"{name}{k}" for k in range(LEVELS + 1) for name in ("hot", "common", "dealt", "distinct")))
    found = (places.join(masks, ["anchor", "key"]).groupBy("doc_id", "text_hash")
             .agg(F.collect_list(F.struct("place", "bits")).alias("spans")))
    found = stage.keep(found, "spans")
    stage.drop("places", "masks")
    return found


def _gone(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Whether each of a document's n words goes."""
    change = np.zeros(n + 1, np.int64)
    for s in spans:
        bits, at = s["bits"], s["place"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            run = ((bits >> low) + 1 & ~(bits >> low)).bit_length() - 1  # windows in a row
            change[at + low] += 1
            change[min(n, at + low + run - 1 + window)] -= 1
            bits &= ~(((1 << run) - 1) << low)
    return np.cumsum(change[:-1]) > 0


def _with_spans(docs: DataFrame, window: int, stage: Staging) -> DataFrame:
    """All columns of ``docs`` and, last, the spans that go."""
    found = repeated(docs, window, stage)
    own = docs.columns
    key, there, text, spans = (unused(f"_sub_{x}", own) for x in ("key", "id", "text", "spans"))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = found.select(F.col("doc_id").alias(there), F.col("text_hash").alias(text), F.col("spans").alias(spans))
    return keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(there))
                      & (F.col(key) == F.col(text)), "left").select(*own, spans)


def remove(docs: DataFrame, window: int, stage: Staging) -> DataFrame:
    """All rows and columns of ``docs``; the kept words of a text that loses
    words are joined by one space, other texts stay as they are."""
    at = docs.columns.index("text")

    def run(batches):
        free()
        for b in batches:
            spans, texts = b.column(b.num_columns - 1), b.column(at)
            hit = [i for i in range(len(texts)) if spans[i].is_valid]
            if hit:
                new = texts.to_pylist()
                for i in hit:
                    words = new[i].encode().split()
                    gone = _gone(len(words), spans[i].as_py(), window)
                    new[i] = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
                texts = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(
                [texts if k == at else b.column(k) for k in range(b.num_columns - 1)], b.schema.names[:-1])

    return _with_spans(docs, window, stage).mapInArrow(run, docs.schema)


def digests(docs: DataFrame, window: int, stage: Staging) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept words, joined by one space, of every row."""
    from hashlib import sha256

    def run(batches):
        free()
        for b in batches:
            texts, spans = b.column(1), b.column(2)
            n, removed, said = [], [], []
            for i, text in enumerate(texts.to_pylist()):
                words = (text or "").encode().split()
                n.append(len(words))
                if spans[i].is_valid:
                    gone = _gone(len(words), spans[i].as_py(), window)
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                removed.append(n[-1] - len(words))
                said.append(sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(said, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_spans(docs.select("doc_id", "text"), window, stage)
    return rows.mapInArrow(run, extended(rows.select("doc_id").schema,
                                         "n_words long, n_removed long, kept_sha256 string"))


def oracle(window: int) -> str:
    """DuckDB SQL for ``digests`` over the table documents."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT r, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window}),
 k AS (SELECT s.r, s.i, md5(array_to_string(w[s.i:s.i + {window - 1}], ' ')) AS h FROM s JOIN d ON s.r = d.r),
 t AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
 g AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS p FROM k JOIN t ON k.h = t.h),
 l AS (SELECT r, list(p) AS ps FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
 sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
  list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' '), ''))
  AS kept_sha256
FROM d LEFT JOIN l ON d.r = l.r"""
