"""Toxicity: a support vector machine on a subsequence string kernel.

The kernel is the gap-weighted subsequence kernel: it counts the common
subsequences of ``P`` letters of two words, each weighted by ``GAP`` to the
power of the lengths it spans in both, and is scaled to 1 for equal words.  A
letter inserted into an insult lowers the value a little instead of breaking
the match; dashes and the like between its letters are left out before.  The
SVM's kernel is the Gaussian one in that kernel's feature space.

*Nyström landmarks* are words of the training sentences: words that together
cover the toxic documents, and the clean words that a first round called most toxic.  A word's features
are its kernel values with the landmarks, multiplied by the inverse root of
the landmarks' own kernel matrix, and a linear SVM is trained on them.  A
document is judged by the margin of its best word, the margins above 0 of all
its words, and the number above DOUBT, among how many (runs of single letters, as in
"i d i o t", count as one word too).
Training sentences have their document's label, but most words of a toxic
document are clean.  So training starts from the words that mark toxic
documents and is repeated with those words of toxic documents that the last
round called toxic (multiple-instance SVM).  Documents whose label looks wrong
thus have no say, and copies of a document count once.  A
logistic fit turns these into a score.  The toxic
landmarks are also given as training words with one letter put in.

Training reads a bounded sample (``Sample``); everything else reads all rows.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.tables import extended, together
from circula.llm.workers import held

P = 3           # letters of a counted subsequence
GAP = 0.7       # weight of each letter that a subsequence spans
SHARP = 3.0     # the SVM's kernel is exp(SHARP * (k - 1)), with k the scaled subsequence kernel
WORD_CHARS = 24  # kernel pieces of longer words: all windows of this many letters, half overlapping
NEAR, FAMILY = 0.5, 0.2  # kernel values from which two clean, or toxic, landmarks are too much alike
DOUBT = -0.5    # margin from which a word may be toxic
FEATURES = 5    # of a document
COST = 1.0      # of the SVM's squared hinge loss
LANDMARK_CHARS = 10  # longest landmark
SENTENCE_CHARS = 2000  # of a part of a training sentence; scoring reads whole texts
CACHE_WORDS = 200_000  # words in each of the two halves of what a Python worker remembers
TOGETHER = 500_000     # characters of texts whose words are learned at once

START = "\x02"    # stands before every word, as a letter
LEVELS = (1e-7, 1e-5, 1e-3, 1e-2)  # of chance for words that mark toxic documents
_ODD = [2654435761, 2246822519, 3266489917, 668265263, 374761393, 40503 * 65537, 2891336453, 1664525]

_END = re.compile(r"[.!?\n]+(?=\s|$)")
_MARKS = str.maketrans("", "", "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
_SPACED = re.compile(r"(?:(?<=\s)|^)\w(?:\s\w){2,}(?=\s|$)")


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample, chosen by hash of the id: documents of
    each label, and sentences in all.  ``landmarks`` are chosen at first, two
    of three toxic; more follow until every marked toxic document is covered."""

    documents: int = 1500
    sentences: int = 150_000
    landmarks: int = 32


def _bare(word: str) -> str:
    return word if word.isalnum() else word.translate(_MARKS)


def words(text: str | None) -> set[str]:
    """Distinct words of the lower-cased text, and those spelled in single
    letters (of three kinds at least)."""
    if not text:
        return set()
    text = text.lower()
    found = set(text.split())
    if sum(len(w) == 1 for w in found) > 2:
        found.update("".join(w.split()) for w in _SPACED.findall(text))
    return found


def sentences(text: str | None) -> list[str]:
    return [p for p in _END.split(text) if p.strip()] if text else []


def _pieces(word: str) -> list[str]:
    """The word, or windows of WORD_CHARS letters of a longer one, half overlapping, as in scoring."""
    if len(word) <= WORD_CHARS:
        return [word]
    return [word[at:at + WORD_CHARS] for at in range(0, len(word) - WORD_CHARS // 2, WORD_CHARS // 2)]


def _parts(sentence: str) -> list[str]:
    """The sentence in parts of at most SENTENCE_CHARS, cut at white space where there is some."""
    out = []
    while len(sentence) > SENTENCE_CHARS:
        cut = next((i for i in range(SENTENCE_CHARS, 0, -1) if sentence[i].isspace()), SENTENCE_CHARS)
        out.append(sentence[:cut])
        sentence = sentence[cut:]
    return [*out, sentence]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), max(1, int(size.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(
        "".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


class Kernel:
    """Scaled subsequence kernel of words with a fixed list of landmark words."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        landmarks = [START + w for w in landmarks]
        codes, size = _codes(landmarks)
        letters = np.unique(codes[codes > 0])
        # match[j][k + 1, m]: weight of letter k at place j of landmark m; match[j][0] is for other letters
        self.letters = letters
        self.match = np.zeros((len(letters) + 1, codes.shape[1], len(landmarks)), np.float32)
        for k, c in enumerate(letters):
            self.match[k + 1] = (codes == c).T * np.float32(GAP * GAP)
        self.holds = self.match.any(axis=2)  # whether a landmark has the letter at the place
        self.match = np.ascontiguousarray(self.match.transpose(1, 0, 2))
        self.scale = np.sqrt(np.maximum([_self(w) for w in landmarks], 1e-12)).astype(np.float32)

    def values(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with each landmark; a long word counts by its best piece."""
        pieces, owner = [], []
        for i, w in enumerate(words):
            w = START + w
            if len(w) <= WORD_CHARS:
                pieces.append(w)
                owner.append(i)
            else:
                for at in range(0, len(w) - WORD_CHARS // 2, WORD_CHARS // 2):
                    pieces.append(w[at:at + WORD_CHARS])
                    owner.append(i)
        out = np.full((len(words), len(self.landmarks)), np.exp(-SHARP), np.float32)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.array(owner, np.int64)
        for n in np.unique(size):  # words of one length together, as one array
            if n < P:
                continue  # too short to share a subsequence of P letters
            at = np.flatnonzero(size == n)
            for lo in range(0, len(at), 512):
                some = at[lo:lo + 512]
                got = self._equal([pieces[i] for i in some])
                if len(pieces) == len(words):
                    out[owner[some]] = got
                else:
                    np.maximum.at(out, owner[some], got)
        return out

    def _equal(self, words: list[str]) -> np.ndarray:
        codes, _ = _codes(words)
        place = np.searchsorted(self.letters, codes)
        place[place == len(self.letters)] = 0
        index = np.where(self.letters[place] == codes, place + 1, 0)
        total = np.zeros((len(words), len(self.landmarks)), np.float32)
        # tails[i]: weighted common subsequences of i letters that end before the place at hand, by
        # place in the landmark, the gaps after them counted on both sides
        places, gap = len(self.match), np.float32(GAP)
        tails = [np.zeros((places, len(words), len(self.landmarks)), np.float32) for _ in range(P - 1)]
        for s in range(codes.shape[1]):
            at = index[:, s]
            live = np.flatnonzero(self.holds[np.unique(at)].any(axis=0))
            step = {j: self.match[j][at] for j in live.tolist()}  # by place: word, landmark
            for j in step:
                total += step[j] * tails[P - 2][j]
            fresh = [np.zeros_like(t) for t in tails]
            for i in range(P - 1):
                for j in range(live[0] if len(live) else places, places - 1):
                    np.multiply(fresh[i][j], gap, out=fresh[i][j + 1])
                    if j in step:
                        fresh[i][j + 1] += step[j] * tails[i - 1][j] if i else step[j]
            for t, f in zip(tails, fresh, strict=True):
                t *= gap
                t += f
        own = np.sqrt(np.maximum(_selves(codes), 1e-12)).astype(np.float32)
        return np.exp(np.float32(SHARP) * (total / (own[:, None] * self.scale[None]) - 1))


def _selves(codes: np.ndarray) -> np.ndarray:
    """Kernel of each word (words of one length) with itself."""
    size = codes.shape[1]
    same = (codes[:, :, None] == codes[:, None, :]) * np.float32(GAP * GAP)
    part = same
    decay = np.tril(np.float32(GAP) ** (np.arange(size)[:, None] - np.arange(size)[None] - 1), -1).astype(np.float32)
    for _ in range(P - 1):
        part = same * (decay @ part @ decay.T)
    return part.sum((1, 2))


def _self(word: str) -> float:
    return float(_selves(_codes([word[:WORD_CHARS]])[0])[0]) if word else 0.0


class Model:
    """A trained scorer; ``weights`` has the inverse root of the landmark
    matrix in it, ``fit`` weighs a document's features and a constant."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, fit: np.ndarray):
        self.landmarks, self.weights, self.bias, self.fit = landmarks, weights, bias, fit


def _summary(margins: np.ndarray, bias: float) -> tuple[float, ...]:
    """A document's features: its best word, the toxic words by their margins
    (1 at most), the words that may be toxic, how many words there are, and a constant."""
    return (min(1.0, float(margins.max(initial=bias))), math.log1p(np.clip(margins, 0, 1).sum()),
            math.log1p(int((margins > DOUBT).sum())), math.log1p(len(margins)), 1.0)


class Scorer:
    """Scores texts with a model; remembers the margins of words it has met."""

    def __init__(self, model: Model):
        self.model, self.kernel = model, Kernel(model.landmarks)
        self.known: dict[str, float] = {}  # by word, as it stands or without marks
        self.older: dict[str, float] = {}  # the words known before, without those met since

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words.difference(self.known)) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        plain = {}
        for w in words.difference(known):
            margin = older.pop(w, None)
            if margin is None:
                plain[w] = _bare(w)
            else:
                known[w] = margin
        new = []
        for b in set(plain.values()).difference(known):
            margin = older.pop(b, None)
            if margin is None:
                new.append(b)
            else:
                known[b] = margin
        known.update(zip(new, (self.kernel.values(new) @ self.model.weights + self.model.bias).tolist(), strict=True))
        known.update([(w, known[b]) for w, b in plain.items()])

    def features(self, texts: list[str | None]) -> np.ndarray:
        bags = [words(t) for t in texts]
        met = set().union(*bags)
        if not met <= self.known.keys():
            self.learn(met)
        get = self.known.__getitem__
        return np.array([_summary(np.fromiter(map(get, bag), np.float64, len(bag)), self.model.bias)
                         for bag in bags]).reshape(-1, FEATURES)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.model.fit, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by damped Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    reg = np.eye(a.shape[1])
    reg[-1, -1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float(w @ reg @ w + cost * (weight * np.maximum(0, 1 - y * (a @ w)) ** 2).sum())

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(60):
        on = y * (a @ w) < 1
        h = reg + cost * (a[on] * weight[on, None]).T @ a[on]
        step = np.linalg.solve(h, cost * a[on].T @ (weight[on] * y[on])) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if new > now * (1 - 1e-9):
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic fit of P(y = 1) with Platt's smoothed targets, by damped Newton steps; the last column is constant."""
    p, n = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    reg = np.full(x.shape[1], 0.05)
    reg[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        s = z @ w
        return float((weight * (np.logaddexp(0, s) - t * s)).sum() + (reg * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        v = weight * (q * (1 - q) + 1e-9)
        step = -np.linalg.solve((z * v[:, None]).T @ z + np.diag(reg), z.T @ (weight * (q - t)) + reg * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if new > now - 1e-9:
            break
        w, now = w + size * step, new
    w = w / scale
    w[-1] -= (w[:-1] * mean[:-1]).sum()
    return w


def _covering(marking: set, bad: Counter, seen: dict, toxic: list, many: int) -> list[str]:
    """Words unlike one another that together cover the toxic documents, twice if they can, and then the most
    frequent others.  The first ``many`` are of LANDMARK_CHARS letters at most and among the 400 most frequent;
    words of any kind follow while a toxic document has marking words and none of them is like a chosen one."""
    every = sorted(marking, key=lambda w: (-bad[w], w))
    short = [w for w in every if len(w) <= LANDMARK_CHARS][:400]
    chosen: list[str] = []
    left = {d: 2 for d in toxic}  # documents to cover, each so many times
    covers = {w: [] for w in every}
    for d in toxic:
        for w in seen[d] & marking:
            covers[w].append(d)
    bare = {d for ds in covers.values() for d in ds}  # documents without a word like a chosen one

    def take(best: str, free: list[str]) -> list[str]:
        chosen.append(best[:WORD_CHARS - 1])
        for d in covers[best]:
            left[d] -= 1
        bare.difference_update(covers[best])
        near = Kernel(chosen[-1:]).values(free)[:, 0] >= FAMILY
        for w, alike in zip(free, near, strict=True):
            if alike:
                bare.difference_update(covers[w])
        # of a family of words one is enough
        return [w for w, alike in zip(free, near, strict=True) if not alike and w != best]

    free = [w for w in every if covers[w]]
    while len(chosen) < many and (pure := [w for w in short if w in set(free)]):
        free = take(max(pure, key=lambda w: (sum(left[d] > 0 for d in covers[w]), len(covers[w]), w)), free)
    while bare and free:
        free = take(max(free, key=lambda w: (sum(d in bare for d in covers[w]), len(covers[w]), w)), free)
    return chosen or ["none"]


def _altered(word: str) -> list[str]:
    """The word with one letter put in: each place takes the letter of another place."""
    n = len(word)
    return [word[:i] + word[(2 * i + 1) % n] + word[i:] for i in range(1, n)] if n > P else []


def _features(vocabulary: list[str], marks: list[str]) -> np.ndarray:
    if not marks:
        return np.zeros((len(vocabulary), 0), np.float32)
    kernel = Kernel(marks)
    return np.concatenate([kernel.values(vocabulary[i:i + 20_000]) for i in range(0, len(vocabulary), 20_000)])


def _spread(ordered: list[str], many: int) -> list[str]:
    """The first words that are not near to one taken before."""
    out: list[str] = []
    if ordered:
        near = Kernel(ordered).values(ordered)
        taken: list[int] = []
        for i in range(len(ordered)):
            if len(taken) < many and all(near[i, j] < NEAR for j in taken):
                taken.append(i)
        out = [ordered[i] for i in taken]
    return out


def _root(marks: list[str]) -> np.ndarray:
    values, vectors = np.linalg.eigh(Kernel(marks).values(marks).astype(np.float64))
    return vectors @ np.diag(np.maximum(values, 1e-2) ** -0.5) @ vectors.T


def _instances(x: np.ndarray, marked: np.ndarray, clean: np.ndarray, in_bad: np.ndarray, in_good: np.ndarray,
               bags: list[np.ndarray]) -> tuple[np.ndarray, float, np.ndarray]:
    """Multiple-instance SVM: weights, bias and margins of all words.  A word
    counts as toxic by ``in_bad`` if it is marked or the last round called it
    toxic, and as clean by ``in_good``, so that margins follow how often words
    like it come from toxic documents."""
    if not marked.any():
        return np.zeros(x.shape[1]), -1.0, np.full(len(x), -1.0)
    as_toxic = marked
    held = np.flatnonzero(in_good > 0)
    for _ in range(5):
        own = np.flatnonzero(as_toxic)
        use = np.concatenate([own, held])
        sign = np.repeat([1.0, -1.0], [len(own), len(held)])
        weight = np.concatenate([in_bad[own], in_good[held]]) * (1000 / in_bad[own].sum())
        w, bias = _svm(x[use], sign, weight)
        f = x @ w + bias
        again = marked.copy()
        for bag in bags:  # a document without any has a wrong label, or insults that are in no other
            again[bag[f[bag] > 0]] = True
        again &= ~clean
        if (again == as_toxic).all():
            break
        as_toxic = again
    return w, bias, f


def _marking(bad: Counter, good: Counter, n_bad: int, n_good: int, seen: dict, toxic: list) -> set[str]:
    """Words that are in more toxic documents than chance explains: by the
    strictest level of ``LEVELS`` at which they cover half of the toxic documents, or the last one."""
    share = n_bad / (n_bad + n_good)
    table: dict[tuple[int, int], float] = {}
    for key in {(b, good[w]) for w, b in bad.items() if b > 1}:
        table[key] = _tail(*key, share)
    found: set[str] = set()
    for level in LEVELS:
        found = {w for w, b in bad.items() if b > 1 and len(w) >= P and table[b, good[w]] < level}
        if sum(not found.isdisjoint(seen[d]) for d in toxic) >= len(toxic) / 2:
            break
    return found


def _tail(b: int, g: int, share: float) -> float:
    """Chance that of b + g documents b or more are toxic, if each is with probability ``share``."""
    n = b + g
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
            + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(b, n + 1)]
    return math.exp(max(logs)) * sum(math.exp(x - max(logs)) for x in logs)


def _apart(seen: dict, label: dict) -> list:
    """Documents without those that share half of their minimum hashes with an
    earlier one of the same label: copies would make all of their words marks."""
    met: dict = {}
    out = []
    for d in sorted(seen):
        words_ = [w for w in seen[d] if w]
        if not words_:
            out.append(d)
            continue
        codes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words_], np.uint64)
        mins = [int(((codes * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in _ODD]
        near = Counter(e for k, v in enumerate(mins) for e in met.get((label[d], k, v), ()))
        if near and near.most_common(1)[0][1] >= len(_ODD) // 2:
            continue
        out.append(d)
        for k, v in enumerate(mins):
            met.setdefault((label[d], k, v), []).append(d)
    return out


def train(rows: list[tuple], sample: Sample | None = None, share: float | None = None) -> Model:
    """Fit a model on (document, label, sentence) rows; ``share`` is the share
    of toxic documents that scores are fitted to (that of the rows by
    default).  With rows of one label only, every text scores near that label
    (near 0 without rows)."""
    sample = sample or Sample()
    seen: dict = {}
    label: dict = {}
    for d, y, text in rows:
        seen.setdefault(d, set()).update(p for w in words(text) for p in _pieces(_bare(w)))
        label[d] = int(y)
    kinds = set(label.values())
    if len(kinds) < 2:
        return Model(["none"], np.zeros(1), 0.0, np.array([0] * (FEATURES - 1) + [5.0 if kinds == {1} else -5.0]))
    ids = _apart(seen, label)
    toxic = [d for d in ids if label[d]]
    n_good = len(ids) - len(toxic)
    bad, good = Counter(), Counter()
    for d in ids:
        (bad if label[d] else good).update(seen[d])
    marking = _marking(bad, good, len(toxic), n_good, seen, toxic)
    marks = _covering(marking, bad, seen, toxic, sample.landmarks * 2 // 3)
    altered = sorted({v for w in marks for v in _altered(w)} - bad.keys() - good.keys())
    vocabulary = sorted(bad.keys() | good.keys()) + altered
    place = {w: i for i, w in enumerate(vocabulary)}
    bags = {d: np.array([place[w] for w in sorted(seen[d])], np.int64) for d in ids}
    marked = np.array([w in marking for w in vocabulary])
    marked[len(vocabulary) - len(altered):] = True
    clean = np.array([good[w] > 0 for w in vocabulary]) & ~marked
    share = share if share else len(toxic) / len(ids)
    in_bad = np.array([bad[w] for w in vocabulary]) * share / len(toxic)
    in_good = np.array([good[w] for w in vocabulary]) * (1 - share) / max(1, n_good)
    in_bad[len(vocabulary) - len(altered):] = 0.1 * in_bad[marked].sum() / max(1, len(altered))
    x = _features(vocabulary, marks)
    for turn in range(2):
        root = _root(marks)
        w, bias, f = _instances((x @ root).astype(np.float32), marked, clean, in_bad, in_good, [bags[d] for d in toxic if len(bags[d])])
        if turn == 0:
            order = np.argsort(-np.where(clean, f, -np.inf), kind="stable")[:400]
            hard = _spread([vocabulary[i] for i in order if clean[i] and P <= len(vocabulary[i]) <= LANDMARK_CHARS],
                           max(sample.landmarks - len(marks), len(marks) // 2))
            x = np.hstack([x, _features(vocabulary, hard)])
            marks = marks + hard
    marked_docs = np.array([_summary(f[bags[d]], bias) for d in ids])
    y = np.array([label[d] for d in ids])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    used = list(range(FEATURES))
    while True:
        fit_ = np.zeros(FEATURES)
        fit_[used] = _logistic(marked_docs[:, used], y, weight)
        against = [k for k in used[:-2] if fit_[k] < 0]
        if not against:  # more toxic words never lower a score
            return Model(marks, root @ w, bias, fit_)
        used.remove(min(against, key=lambda k: fit_[k]))


def fit(docs: DataFrame, labels: DataFrame, sample: Sample | None = None, label_col: str = "toxic") -> Model:
    """Train on documents whose id has a label and a crc32 (of the id as text)
    that 5 does not divide.  An id with several labels counts as toxic if one
    of them is 1; null ids, labels and texts are left out."""
    sample = sample or Sample()
    key = F.col("doc_id")
    marked = (labels.select(key, F.col(label_col).cast("int").alias("_toxic"))
              .where(key.isNotNull() & F.col("_toxic").isNotNull()
                     & (F.crc32(key.cast("string").cast("binary")) % 5 != 0))
              .groupBy(key).agg(F.max("_toxic").alias("_toxic")))
    share = marked.agg(F.avg((F.col("_toxic") == 1).cast("double"))).first()[0]
    order = F.xxhash64(F.lit(7), key)
    some = [marked.where(F.col("_toxic") == k).orderBy(order, key).limit(sample.documents) for k in (0, 1)]
    chosen = some[0].union(some[1])  # at most 2 * sample.documents rows, so it may be broadcast

    def split(batches):
        for b in batches:
            d, y, text = (b.column(k).to_pylist() for k in range(3))
            cut = [(i, label, p) for i, label, t in zip(d, y, text, strict=True)
                   for s in sentences(t) for p in _parts(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in cut], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string()))],
                ["_d", "_y", "_s"])

    parts = (docs.select(key.cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
             .select("doc_id", "_toxic", "text").mapInArrow(split, "_d long, _y int, _s string"))
    rows = parts.orderBy(F.xxhash64(F.lit(11), "_d", "_s"), "_d", "_s").limit(sample.sentences).collect()
    rows = [tuple(r) for r in rows]  # not the Row objects, which are larger
    return train(rows, sample, share)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "tox_score") -> DataFrame:
    """``keep`` columns of every row (all by default) with the column ``name``,
    0 to 1.  Null and empty texts score by the bias alone."""
    keep = keep if keep is not None else docs.columns
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at = rows.columns.index("text")
    mark = uuid.uuid4().hex

    def run(batches):
        scorer = held(mark, lambda: Scorer(model))  # the model is a few kB and goes with the task
        for b in batches:
            out = [scorer.scores(texts) for texts in together(b.column(at), TOGETHER)]
            got = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), got], [*keep, name])

    return rows.mapInArrow(run, extended(rows.select(*keep).schema, f"{name} double"))
