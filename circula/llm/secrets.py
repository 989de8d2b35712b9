"""Secret scans: fixed patterns, and strings that a primed zstandard finds new.

Spans count code points, the end excluded.  The patterns find assignments,
access keys and hex strings, each kind leftmost and without overlap.  Beyond
them a *candidate* is any run of at least ``MIN_RUN`` characters of
``[A-Za-z0-9+/_.=-]`` near a word of a sensitive context (before or behind it), without the part up to its
last ``=`` (a name that is assigned to).

Zstandard's dictionary is trained on identifiers: the names in Python's own library, and the
commonest words of the corpus, counted over all of it.  A trained dictionary also holds the code of the literals,
so letters that identifiers rarely have cost more bits, and strings of known parts cost few.  The *marginal bits* of a
candidate are what it adds to a stream that begins with a pad, the dictionary holding the text before its
first place too; the mean over several pads takes away the rounding to bytes.  Letters are folded to
lower case with a mark at each change of case, so that constants cost what names cost.

A candidate is reported, as kind "novel", if its bits a character reach the threshold of its character set.
The thresholds are measured, when the dictionary is trained, on random keys of each set (``MISSED`` of
them fall under it), and where names have several parts also on names that the dictionary has not seen.  If a candidate does not, its part behind the last
``/ . _ -`` is tried alone.  A reported string is reported at all of its places in the text, but for places that
overlap a pattern's span.
"""

from __future__ import annotations

import functools
import importlib
import itertools
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.tables import Staging, extended, unused
from circula.llm.words import runs
from circula.llm.workers import free

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

MIN_RUN = 16
CONTEXT = 64   # code points between a candidate and the sensitive word
BEFORE = 512   # code points before a candidate that prime the compressor
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SENSITIVE = ("auth", "bearer", "credential", "private", "passphrase", "pwd", "signature", "session", "cookie",
             "api", "key", "secret", "token", "passw", "access")
_NEAR = re.compile("|".join(SENSITIVE), re.I | re.A)

#: Modules of Python's library whose names are taken as identifiers that code has.
MODULES = ("argparse ast asyncio base64 bisect calendar cmd codecs collections configparser contextlib copy csv ctypes "
           "dataclasses datetime decimal difflib dis email enum fileinput fractions ftplib functools glob gzip hashlib heapq "
           "html http imaplib importlib inspect io ipaddress itertools json keyword linecache locale logging mailbox "
           "mimetypes multiprocessing operator optparse os pathlib pdb pickle platform plistlib poplib pprint profile "
           "queue random re sched secrets select selectors shelve shlex shutil signal smtplib socket socketserver "
           "sqlite3 ssl statistics string struct subprocess symtable sys sysconfig tarfile tempfile textwrap threading "
           "time timeit tokenize trace traceback types typing unittest urllib uuid warnings wave weakref webbrowser "
           "xml zipfile zoneinfo").split()
#: Parts of addresses and paths that any text has.
PLACES = ("http:// https:// www. mail. ftp. example.com example.org .com .org .net .edu .io @example.com localhost:8080 "
          "127.0.0.1 /usr/local/bin /usr/share /home/user /etc/ /var/log /tmp/ src/main/ lib/ test/ docs/ build/ "
          ".json .yaml .xml .html .txt .csv .md .py .js .java .png .zip index.html README.md v1.0 2.0 _1 _2").split()
WORDS = 20_000         # of the corpus that the dictionary is trained on, the commonest ones (or somewhat fewer)
MIN_WORD = 6
DICTIONARY = 32_768    # bytes
SAMPLES = 3000
PADS = 4
KEYS = 400             # of each alphabet and length that a threshold is measured on
LENGTHS = (16, 40)
MISSED = 0.0025        # share of them that a threshold may miss
KNOWN = 0.97           # share of unseen names that the threshold of a set with parts leaves out,
MOST_MISSED = 0.04     # but for keys of the set: no more than this share may be missed for it
ALPHABETS = {"letters": ("abcdefghijklmnopqrstuvwxyz",),
             "cases": ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",),
             "digits": ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
                        "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"),
             "parted digits": ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_",),
             "numbers": ("0123456789",)}
#: A zstandard dictionary's tables end with its three first offsets, which the trainer sets to 1, 4 and 8.
_OFFSETS = struct.pack("<3I", 1, 4, 8)
_HEXES = np.zeros(256, bool)
_HEXES[[ord(c) for c in "0123456789abcdef"]] = True
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def folded(text: str) -> str:
    """Lower case, with a mark before a capital and another before several."""
    text = re.sub(r"[A-Z]{2,}", lambda m: "|" + m.group().lower(), text)
    return re.sub(r"[A-Z]", lambda m: "^" + m.group().lower(), text)


def character_set(text: str) -> str:
    """The set whose threshold a candidate has."""
    if not re.search("[A-Za-z]", text):
        return "numbers"
    if re.search("[0-9]", text):
        return "parted digits" if re.search("[_.-]", text) else "digits"
    if re.search("[_.=/+-]", text):
        return "parts"
    return "letters" if text.islower() or text.isupper() else "cases"


class Novelty:
    """A trained dictionary, and the threshold of each character set in bits a character."""

    def __init__(self, names: list[str], words: list[str]):
        rng = random.Random(41)
        names, words = sorted(names), sorted(words) or [""]
        letters = Counter(folded("".join(names)))
        kinds, weights = zip(*sorted(letters.items()), strict=True)
        self.pads = ["".join(rng.choices(kinds, weights, k=90 + 3 * i)) + " " for i in range(PADS)]
        # thresholds of names are measured on the half of them that a dictionary has not seen
        self._train(rng, names[::2], words)
        z = self._squeeze("")
        unseen: dict[str, list[float]] = {}
        for n in names[1::2]:
            if len(n) >= MIN_RUN and character_set(n).startswith("part"):
                unseen.setdefault(character_set(n), []).append(self.bits(n, squeeze=z))
        self._train(rng, names, words)
        self.thresholds = self._measured(rng, unseen)

    def _train(self, rng: random.Random, names: list[str], words: list[str]) -> None:
        samples = [folded(" ".join([*rng.choices(names, k=6), *rng.choices(words, k=6),
                                    *(rng.choices(PLACES, k=2) if i % 8 == 0 else [])])).encode() for i in range(SAMPLES)]
        body = zstandard.train_dictionary(DICTIONARY, samples, level=19).as_bytes()
        # the text before a candidate goes behind the tables and the content
        at = body.index(_OFFSETS) + len(_OFFSETS)
        self.tables, self.content = body[:at], body[at:]

    def __reduce__(self):
        return _restored, (self.tables, self.content, self.pads, self.thresholds)

    def _squeeze(self, before: str):
        data = zstandard.ZstdCompressionDict(self.tables + self.content + folded(before).encode("utf-8", "replace"),
                                             dict_type=zstandard.DICT_TYPE_FULLDICT)
        return zstandard.ZstdCompressor(level=19, dict_data=data, write_checksum=False, write_content_size=False,
                                        write_dict_id=False)

    def bits(self, candidate: str, before: str = "", squeeze=None) -> float:
        """Marginal bits a character of the candidate behind the text ``before``."""
        z = squeeze or self._squeeze(before)
        said = (folded(candidate) + " ").encode()
        added = [len(z.compress(p.encode() + said)) - len(z.compress(p.encode()))
                 for p in (self.pads if len(candidate) <= 256 else self.pads[:1])]
        return 8 * sum(added) / len(added) / len(candidate)

    def _measured(self, rng: random.Random, unseen: dict[str, list[float]]) -> dict[str, float]:
        z = self._squeeze("")
        out = {}
        for kind, alphabets in ALPHABETS.items():
            least, most = [], []
            for letters, size in itertools.product(alphabets, LENGTHS):
                keys = ["".join(rng.choices(letters, k=size)) for _ in range(KEYS)]
                costs = sorted(self.bits(k, squeeze=z) for k in keys if character_set(k) == kind)
                least.append(costs[int(MISSED * len(costs))])
                most.append(costs[int(MOST_MISSED * len(costs))])
            out[kind] = min(least)
            if kind in unseen:
                out[kind] = max(out[kind], min(*most, _share(unseen[kind], KNOWN)))
        out["numbers"] *= 0.75  # no name is a number, so only repetition must stay under it
        out["parts"] = max(out["cases"], _share(unseen.get("parts", [0.0]), KNOWN))  # no alphabet has such keys
        return out

    def new(self, candidate: str, before: str = "") -> bool:
        return self.bits(candidate, before) >= self.thresholds[character_set(candidate)]


def _share(costs: list[float], share: float) -> float:
    """The cost that so large a share does not exceed."""
    return sorted(costs)[int(share * (len(costs) - 1))]


def _restored(tables: bytes, content: bytes, pads: list[str], thresholds: dict[str, float]) -> Novelty:
    made = Novelty.__new__(Novelty)
    made.tables, made.content, made.pads, made.thresholds = tables, content, pads, thresholds
    return made


@functools.cache
def library_names(modules: tuple[str, ...] = tuple(MODULES)) -> list[str]:
    """Names in modules of Python's library and in their classes."""
    out: set[str] = set()
    for name in modules:
        module = importlib.import_module(name)
        for place in (module, *(v for v in vars(module).values() if isinstance(v, type))):
            out.update(n for n in dir(place) if not n.startswith("__"))
    return sorted(out)


@functools.cache
def plain() -> Novelty:
    """The model without a corpus."""
    return Novelty(library_names(), [])


def fit(docs: DataFrame) -> Novelty:
    """The model of a corpus: its commonest words, of all of its texts, beside the library's names.

    Words are counted by Spark and classed by their counts (16 classes to a doubling); as many
    classes, from the commonest, are taken whole as hold ``WORDS`` words together."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z_]{{{MIN_WORD},}}"), F.lit(0))).alias("word")
    stage = Staging(docs.sparkSession, "secrets")
    counts = stage.keep(docs.select(words).groupBy("word").agg(F.floor(16 * F.log2(F.count(F.lit(1)))).alias("class")),
                        "words")
    least, held = None, 0
    for kind, n in counts.groupBy("class").count().orderBy(F.desc("class")).collect():  # 1024 classes at most
        held += n
        if held > WORDS:
            break
        least = kind
    top = counts.where(F.col("class") >= least).collect() if least is not None else []
    stage.drop("words")
    return Novelty(library_names(), [r["word"] for r in top])


def _base(text: str, may: tuple[bool, bool, bool]) -> list[tuple[int, int, int]]:
    found = []
    if may[0]:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if may[1]:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if may[2]:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _novel(text: str, base: list[tuple[int, int, int]], model: Novelty) -> list[tuple[int, int, int]]:
    at = [m.start() for m in _NEAR.finditer(text)]
    told: dict[str, bool] = {}

    def new(part: str) -> bool:
        if part not in told:
            first = text.find(part)
            told[part] = model.new(part, text[max(0, first - BEFORE):first])
        return told[part]

    def free_of_base(lo: int, hi: int) -> bool:
        return not any(s < hi and lo < e for s, _, e in base)

    secret: list[str] = []
    for m in RUN.finditer(text) if at else ():
        body = m.group().rstrip("=")
        lo = m.start() + body.rfind("=") + 1
        hi = m.end()
        k = np.searchsorted(at, [lo, hi])
        near = (k[0] > 0 and lo - at[k[0] - 1] <= CONTEXT) or (k[1] < len(at) and at[k[1]] - hi <= CONTEXT)
        if not near or hi - lo < MIN_RUN or not free_of_base(lo, hi):
            continue
        part = text[lo:hi]
        end = re.search(r"[^/._-]*$", part).group()
        for some in (part, end) if len(end) >= MIN_RUN else (part,):
            if new(some):
                secret.append(some)
                break
    found: set[tuple[int, int, int]] = set()
    for part in dict.fromkeys(secret):
        lo = text.find(part)
        while lo >= 0:
            if free_of_base(lo, lo + len(part)):
                found.add((lo, 3, lo + len(part)))
            lo = text.find(part, lo + len(part))
    return sorted(found)


def find(text: str | None, model: Novelty | None = None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every span of the text, in order; none in a null text."""
    if not text:
        return []
    base = _base(text, (True, True, True))
    return sorted(base + _novel(text, base, model or plain()))


def _spans(column: pa.Array, model: Novelty) -> list[list[tuple[int, int, int]]]:
    """``find`` of each text of an Arrow column; texts without a trace of any pattern aren't searched."""
    out: list[list] = [[] for _ in range(len(column))]
    for at, data, bounds in runs(column):
        # places where MIN_HEX bytes of hex digits in a row begin
        hexes = np.concatenate([[0], np.cumsum(_HEXES[data])])
        full = np.flatnonzero(hexes[MIN_HEX:] - hexes[:-MIN_HEX] == MIN_HEX) if len(hexes) > MIN_HEX else ()
        with_hex = set(np.searchsorted(bounds, full, "right") - 1)
        raw = data.tobytes()
        low = raw.lower()
        for i in range(len(bounds) - 1):
            lo, hi = bounds[i], bounds[i + 1]
            may = (any(low.find(w, lo, hi) >= 0 for w in _WORDS), raw.find(b"AKIA", lo, hi) >= 0, i in with_hex)
            near = may[0] or any(low.find(w.encode(), lo, hi) >= 0 for w in SENSITIVE)
            if any(may) or near:
                text = raw[lo:hi].decode("utf-8", "surrogatepass")
                base = _base(text, may)
                out[at + i] = sorted(base + (_novel(text, base, model) if near else []))
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, keep: list[str] | None = None, model: Novelty | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) of every row with n_assign,
    n_access, n_hex, n_novel, base_spans and spans ("kind:start:end", joined
    by commas, by start and then kind).  Null and empty texts have none.  The
    ``model`` is that of ``docs`` by default."""
    model = model or fit(docs)
    keep = keep if keep is not None else ["doc_id"]
    names = [*keep, "n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"]

    def run(batches):
        free()
        for b in batches:
            found = _spans(b.column(0), model)
            counts = [pa.array([sum(k == kind for _, k, _ in x) for x in found], pa.int64()) for kind in range(4)]
            base = [_said([s for s in x if s[1] < 3]) for x in found]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(1 + i) for i in range(len(keep))), *counts, pa.array(base, pa.string()),
                 pa.array([_said(x) for x in found], pa.string())], names)

    return docs.select(F.col("text").alias(unused("_s_text", keep)), *keep).mapInArrow(run, extended(
        docs.select(*keep).schema,
        "n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string"))


def redact(docs: DataFrame, mark: str = "[secret]", model: Novelty | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with each span of the text replaced by
    ``mark``; overlapping spans are replaced as one.  The ``model`` is that of ``docs`` by default."""
    model = model or fit(docs)
    at = docs.columns.index("text")

    def run(batches):
        free()
        for b in batches:
            texts = b.column(at)
            found = _spans(texts, model)
            if any(found):
                new = texts.to_pylist()
                for i, spans in enumerate(found):
                    if spans:
                        parts, to = [], 0
                        for s, _, e in spans:
                            if s >= to:
                                parts += [new[i][to:s], mark]
                            to = max(to, e)
                        new[i] = "".join([*parts, new[i][to:]])
                texts = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(
                [texts if k == at else b.column(k) for k in range(b.num_columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
