"""Quality rules: divergence of a document from references of its language.

Two histograms describe a document: the classes of its characters, and its
common words.  The *references* are the same histograms over all documents of
its language (null languages count as one), with the most frequent words of
that language as its common words.  A document is compared by the Jensen-Shannon distance (root of the divergence
in bits, 0 to 1).  Guards: a document under ``min_chars`` characters has no
class distance, one under ``min_words`` words no word distance, and one of a
language with fewer than ``reference_words`` words in all has neither; they are
null and reject nothing.

References are pre-aggregated in each task (distinct words of each language),
summed by Spark, and have at most ``Rules.common_words`` words for each
language.  Up to ``HELD`` languages' references are sent to the tasks; if there are
more, all of them stay a table that is joined to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from circula.llm.tables import Staging, extended
from circula.llm.words import WHITE, Words, runs, shingles
from circula.llm.workers import free

#: Character classes by byte; a UTF-8 continuation byte belongs to the byte that it follows.
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "beyond", "control")
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _BEYOND, _CONTROL, _NONE = range(9)
CLASS = np.full(256, _MARK, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = _LOWER, _UPPER, _DIGIT
CLASS[:32], CLASS[127] = _CONTROL, _CONTROL
CLASS[WHITE] = _SPACE
CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = _STOP
CLASS[128:192], CLASS[192:] = _NONE, _BEYOND
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
REPEAT = 8  # words of a window whose repetition counts
HELD = 10_000  # languages whose references a task holds, about 1 KB each


@dataclass(frozen=True)
class Rules:
    """Thresholds; see the module's text for their meaning."""

    min_words: int = 50
    min_chars: int = 200
    max_class_distance: float = 0.3
    max_word_distance: float = 0.75
    common_words: int = 64
    reference_words: int = 5000


def _flush(lang: str, keys: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
    n = len(CLASSES)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * (len(keys) + n), pa.string()),
         pa.array([True] * len(keys) + [False] * n, pa.bool_()),
         pa.array(np.concatenate([keys.view(np.int64), np.arange(n)]), pa.int64()),
         pa.array(np.concatenate([counts, classes[:n]]).astype(np.int64), pa.int64())],
        ["lang", "is_word", "item", "n"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _by_language(langs: np.ndarray, owner: np.ndarray):
    """Each language with the places of its documents and those of their words (``owner`` has a word's document)."""
    names, code = np.unique(langs.astype(object), return_inverse=True)
    code = code.astype(np.uint16 if len(names) < 1 << 16 else np.uint32)
    docs, words = np.argsort(code, kind="stable"), np.argsort(code[owner], kind="stable")
    ends, word_ends = (np.cumsum(np.bincount(c, minlength=len(names))) for c in (code, code[owner]))
    for k, name in enumerate(names):
        yield (name, docs[ends[k - 1] if k else 0:ends[k]], words[word_ends[k - 1] if k else 0:word_ends[k]])


def _counted(batches):
    free()
    held: dict[str, list] = {}
    classes: dict[str, np.ndarray] = {}
    waiting = 0
    for b in batches:
        langs = b.column(1).fill_null("").to_numpy(zero_copy_only=False)
        for at, data, bounds in runs(b.column(0)):
            w = Words(data, bounds)
            h = w.hashes()
            own = langs[at:at + len(bounds) - 1]
            kinds = CLASS[data]
            for lang, mine, its in _by_language(own, w.doc):
                part = kinds if len(mine) == len(own) else np.concatenate(
                    [kinds[bounds[i]:bounds[i + 1]] for i in mine])
                classes[lang] = classes.get(lang, 0) + np.bincount(part, minlength=9)
                held.setdefault(lang, []).append(np.unique(h[its], return_counts=True))
                waiting += len(held[lang][-1][0])
            if waiting > 1_000_000:  # words in memory are bounded; the rest is summed by Spark
                held = {lang: [_merged(parts)] for lang, parts in held.items()}
                waiting = sum(len(parts[0][0]) for parts in held.values())
                if waiting > 500_000:
                    for lang, parts in held.items():
                        yield _flush(lang, *parts[0], classes[lang])
                    held, classes, waiting = {}, {}, 0
    for lang, parts in held.items():
        yield _flush(lang, *_merged(parts), classes[lang])


#: Hashes of a language's common words, their counts with the count of all
#: other words last, and counts of the character classes.
Reference = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class References:
    """By language; languages without enough words are in none.  With a
    ``table`` (lang and ref), ``known`` is empty."""

    known: dict[str, Reference]
    table: DataFrame | None = None


def _reference(size: int, words: list, classes: list) -> Reference:
    keys = np.array([k for k, _ in words], np.int64).view(np.uint64)
    order = np.argsort(keys)
    n = np.array([n for _, n in words], np.float64)[order]
    by_class = np.zeros(len(CLASSES))
    for k, m in classes:
        by_class[k] = m
    return keys[order], np.append(n, size - n.sum()), by_class


def references(docs: DataFrame, rules: Rules | None = None) -> References:
    """Language references from all of ``docs`` (columns text and lang)."""
    rules = rules or Rules()
    parts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).mapInArrow(
        _counted, "lang string, is_word boolean, item long, n long")
    total = parts.groupBy("lang", "is_word", "item").agg(F.sum("n").alias("n"))
    # the sums are read twice below; distinct words only, far fewer than the words
    total = total.persist()
    try:
        item = F.struct("item", "n")
        best = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
        common = (total.where("is_word").withColumn("at", F.row_number().over(best))
                  .where(F.col("at") <= rules.common_words).groupBy("lang").agg(F.collect_list(item).alias("words")))
        whole = (total.groupBy("lang").agg(F.sum(F.when(F.col("is_word"), F.col("n"))).alias("size"),
                                           F.collect_list(F.when(~F.col("is_word"), item)).alias("classes"))
                 .where(F.col("size") >= rules.reference_words))
        table = whole.join(common, "lang").select("lang", F.struct("size", "words", "classes").alias("ref"))
        rows = table.limit(HELD + 1).collect()
        if len(rows) > HELD:
            return References({}, Staging(docs.sparkSession, "quality").keep(table, "references"))
    finally:
        total.unpersist()
    return References({r["lang"]: _reference(*r["ref"]) for r in rows})


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` to the counts ``q``;
    0 where either has no counts."""
    a = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    b = (q / max(q.sum(), 1e-300))[None]
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(a > 0, a * np.log2(a / m), 0) + np.where(b > 0, b * np.log2(b / m), 0)).sum(1) / 2
    return np.sqrt(np.clip(np.where((p.sum(1) > 0) & (q.sum() > 0), d, 0), 0, 1))


def _repeated_words(w: Words, h: np.ndarray) -> np.ndarray:
    """Words of each document that a window of REPEAT words covers which its text has twice."""
    key = shingles(h, REPEAT)
    whole = w.doc[:len(key)] == w.doc[REPEAT - 1:] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(len(w.counts), np.int64)
    key = key[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # apart by document
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + REPEAT, -1)
    return np.bincount(w.doc[np.cumsum(change[:-1]) > 0], minlength=len(w.counts))


def _repeated_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, refs: References, rules: Rules | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``keep`` columns (doc_id by default), n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance and kept.  Null texts have no words (and
    so fail the base rules); repeated rows give repeated rows."""
    known, joined = refs.known, refs.table is not None
    rules = rules or Rules()
    keep = keep if keep is not None else ["doc_id"]
    names = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             "class_distance", "word_distance", "kept"]

    def run(batches):
        free()
        for b in batches:
            langs = b.column(1).to_numpy(zero_copy_only=False)
            have = known
            if joined:
                found = {lang: b.column(2 + len(keep))[i].as_py() for i, lang in reversed(list(enumerate(langs)))}
                have = {lang: _reference(r["size"], [(x["item"], x["n"]) for x in r["words"]],
                                         [(x["item"], x["n"]) for x in r["classes"]])
                        for lang, r in found.items() if r is not None}
            for at, data, bounds in runs(b.column(0)):
                w = Words(data, bounds)
                h, n_docs = w.hashes(), len(bounds) - 1
                size = np.diff(bounds)
                owner = np.repeat(np.arange(n_docs), size)
                kinds = CLASS[data]
                by_class = np.bincount(owner * 9 + kinds, minlength=9 * n_docs).reshape(n_docs, 9)[:, :8]
                chars = by_class.sum(1)
                dark = chars - by_class[:, _SPACE]
                symbols = np.bincount(owner[SYMBOL[data]], minlength=n_docs)
                raw = data.tobytes()
                lines = np.array([_repeated_lines(raw[bounds[i]:bounds[i + 1]]) for i in range(n_docs)], np.int64)
                repeats = _repeated_words(w, h)
                base = (w.counts < 20) | (100 * repeats > 30 * w.counts)
                far_class, far_word = np.zeros(n_docs), np.zeros(n_docs)
                unlike = np.zeros(n_docs, bool)  # documents with nothing to be compared with
                for lang, mine, its in _by_language(langs[at:at + n_docs], w.doc):
                    if lang not in have:
                        unlike[mine] = True
                        continue
                    common, of_words, of_classes = have[lang]
                    k = len(common)
                    far_class[mine] = js_distance(by_class[mine].astype(float), of_classes)
                    new = np.zeros(n_docs, np.int64)
                    new[mine] = np.arange(len(mine))
                    hs = h[its]
                    slot = np.searchsorted(common, hs)
                    hit = slot < k
                    hit[hit] = common[slot[hit]] == hs[hit]
                    slot = np.where(hit, slot, k)
                    counts = np.bincount(new[w.doc[its]] * (k + 1) + slot, minlength=len(mine) * (k + 1))
                    far_word[mine] = js_distance(counts.reshape(len(mine), k + 1).astype(float), of_words)
                no_class, no_word = unlike | (chars < rules.min_chars), unlike | (w.counts < rules.min_words)
                kept = (~base & (no_class | (far_class <= rules.max_class_distance))
                        & (no_word | (far_word <= rules.max_word_distance)))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(2 + i).slice(at, n_docs) for i in range(len(keep))),
                     pa.array(w.counts, pa.int64()), pa.array(dark, pa.int64()), pa.array(symbols, pa.int64()),
                     pa.array(lines, pa.int64()), pa.array(repeats, pa.int64()), pa.array(base, pa.bool_()),
                     pa.array(far_class, pa.float64(), mask=no_class), pa.array(far_word, pa.float64(), mask=no_word),
                     pa.array(kept, pa.bool_())], names)

    rows = docs.select(F.col("text").alias("_q_text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_q_lang"), *keep)
    if joined:
        its = refs.table.select(F.col("lang").alias("_q_key"), F.col("ref").alias("_q_ref"))
        rows = rows.join(its, F.col("_q_lang") == F.col("_q_key"), "left").drop("_q_key")
    return rows.mapInArrow(run, extended(docs.select(*keep).schema, (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, class_distance double, word_distance double, kept boolean")))
