"""Byte-level BPE through sentencepiece, and cached encoding with tokenizers.

A rank file's vocabulary is written as a sentencepiece BPE model: one piece per
token, each byte ``b`` as the character ``chr(0x100 + b)``, scored by the
negative rank, with identity normalisation.  sentencepiece merges the adjacent
pair with the highest score, the leftmost of equals, which is the pair of the
lowest rank.  Texts are cut by the pre-tokenizer's pattern and each piece is
encoded alone; decoding maps ids to pieces and characters back to bytes.
"""

from __future__ import annotations

import base64
import codecs
import itertools
import json
import os
import struct
import uuid
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.tables import extended, together
from circula.llm.workers import held

SHIFT = 0x100  # a byte's character; none of these is white space or changes under identity normalisation
CACHE = 400_000  # pieces of text whose ids a Python worker remembers, and twice as many words
TOGETHER = 200_000  # characters of texts whose new words are learned at once
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2  # of sentencepiece's model format


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value)


_CHARACTERS = "".join(chr(SHIFT + b) for b in range(256))


def to_characters(piece: bytes) -> str:
    return codecs.charmap_decode(piece, "strict", _CHARACTERS)[0]


def to_bytes(characters: str) -> bytes:
    return bytes(ord(c) - SHIFT for c in characters)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialized model; piece ids equal the ranks, the unknown piece is
    last.  Ranks must be 0, 1, ... and single bytes among the tokens."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be consecutive from 0")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte must be a token")
    out = [_field(1, _field(1, to_characters(t).encode()) + _field(2, float(-i)) + _field(3, _NORMAL))
           for i, t in enumerate(order)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN)))
    out.append(_field(2, _field(3, _BPE) + _field(4, len(order) + 1) + _field(40, len(order))))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Coder:
    """Encodes and decodes with a serialized model; remembers pieces of text."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        # the inverse mapping of every id but the unknown one, which is last
        self.table = [to_bytes(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size() - 1)]
        self.decimal = [b"%d," % i for i in range(len(self.table))]
        # a piece of text that is itself a token is that token, even if no merges lead to it
        whole = self.sp.encode([to_characters(t) for t in self.table], num_threads=1)
        self.fixed = {t.decode(): (i,) for i, (t, ids) in enumerate(zip(self.table, whole, strict=True))
                      if ids != [i] and _is_text(t)}
        self.known: dict[str, tuple[int, ...]] = dict(self.fixed)  # by match of the pattern
        self.words: dict[str, tuple[int, ...]] = {}  # by word with a space before it
        self.said: dict[str, tuple[bytes, bytes]] = {}  # the same words' ids in decimals, and decoded

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if not plain(text):
            return self._pieces(text)
        words = text.split(" ")  # all but the first have a space before them
        rest = words[1:]
        self._meet(set(rest), self.words, tuple)
        return list(itertools.chain(self._pieces(words[0]), *map(self.words.__getitem__, rest)))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: the number of its ids, and the digests of the ids as comma-joined decimals and of
        the ids decoded.  Both are put together from those of the words that were met before."""
        cut = [t.split(" ") if plain(t) else None for t in (t or "" for t in texts)]
        rest = [w[1:] if w else () for w in cut]
        self._meet(set().union(*rest), self.said, self._said)
        get, out = self.said.__getitem__, []
        for text, words, others in zip(texts, cut, rest, strict=True):
            first = self._said(self._pieces(text if words is None else words[0]))
            decimals, decoded = zip(first, *map(get, others), strict=True)
            ids = b"".join(decimals)
            out.append((ids.count(b","), sha256(ids[:-1]).hexdigest(), sha256(b"".join(decoded)).hexdigest()))
        return out

    def _said(self, ids) -> tuple[bytes, bytes]:
        return b"".join([self.decimal[i] for i in ids]), self.decode(ids)

    def _meet(self, met: set[str], known: dict, form) -> None:
        """Adds to ``known`` what ``form`` makes of the ids of every word met, with a space before it.  The
        words are cut as one text, in which each piece that begins with a space begins a word."""
        new = list(met.difference(known))
        if not new:
            return
        if len(known) + len(new) > 2 * CACHE:
            known.clear()
            new = list(met)
        pieces = self.split(" " + " ".join(new))
        self._learn(pieces)
        ids = list(map(self.known.__getitem__, pieces))
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        for w, lo, hi in zip(new, starts, [*starts[1:], len(pieces)], strict=True):
            known[w] = form(ids[lo] if hi - lo == 1 else tuple(itertools.chain.from_iterable(ids[lo:hi])))

    def _learn(self, pieces: list[str]) -> None:
        new = list(set(pieces).difference(self.known))
        if not new:
            return
        if len(self.known) + len(new) > CACHE:
            self.known = dict(self.fixed)
            new = list(set(pieces).difference(self.known))
        # a byte that no text has stands between the pieces
        said = to_characters(b"\xff".join([p.encode() for p in new])).split(_CHARACTERS[0xFF])
        self.known.update(zip(new, map(tuple, self.sp.encode(said, num_threads=1)), strict=True))

    def _pieces(self, text: str | None):
        return list(itertools.chain.from_iterable(map(self._piece, self.split(text or ""))))

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            self._learn([piece])
            ids = self.known[piece]
        return ids

    def decode(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


#: White space other than the space and the line end, and those two next to one another.
_ODD = regex.compile("[\\x09\\x0b-\\x0d\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]").search
_SEVERAL = ("  ", "\n\n", " \n", "\n ")


def plain(text: str) -> bool:
    """Whether all white space of the text is single spaces and line ends
    between other characters.  A byte-level pattern then always cuts before a
    space, so each word with the space before it can be encoded alone."""
    return not (text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _SEVERAL)
                or (any(x in text for x in "\t\x0b\x0c\r") if text.isascii() else _ODD(text)))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``token_ids`` (array of int) to every row; empty for null and empty texts."""
    model = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks_path)))  # ~1 MB
    mark, at = uuid.uuid4().hex, len(docs.columns)

    def run(batches):
        coder = held(mark, lambda: Coder(model.value, pattern))
        for b in batches:
            ids = pa.array([coder.encode(t) for t in b.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], ids], [*b.schema.names[:at], "token_ids"])

    return docs.select(*docs.columns, F.col("text").alias("_b_text")).mapInArrow(
        run, extended(docs.schema, "token_ids array<int>"))


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to rows with ``token_ids``; null ids give null."""
    model = tokens.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks_path)))
    mark, at = uuid.uuid4().hex, len(tokens.columns)

    def run(batches):
        coder = held(mark, lambda: Coder(model.value, pattern))
        for b in batches:
            out = [None if x is None else coder.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.binary())],
                                             [*b.schema.names[:at], "decoded"])

    return tokens.select(*tokens.columns, F.col("token_ids").alias("_b_ids")).mapInArrow(
        run, extended(tokens.schema, "decoded binary"))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: texts are
    encoded, and the ids decoded, where the text is; no ids leave the task."""
    model = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks_path)))
    mark = uuid.uuid4().hex

    def run(batches):
        coder = held(mark, lambda: Coder(model.value, pattern))
        for b in batches:
            out = []
            for texts in together(b.column(1), TOGETHER):
                out += coder.digests(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, extended(rows.select("doc_id").schema,
                                         "n_tokens long, ids_sha256 string, decoded_sha256 string"))


#: The character that stands for a byte in the tokenizers files: itself if it is
#: printable and no space, else the next one from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_STANDS = dict(zip((b for b in range(256) if b not in _PLAIN), itertools.count(256)))


_STANDING = "".join(chr(_STANDS.get(b, b)) for b in range(256))


def _standing(piece: str) -> str:
    return codecs.charmap_decode(piece.encode(), "strict", _STANDING)[0]


def added_tokens(path: str) -> dict[str, int]:
    """The ids of the strings that a tokenizers file's library takes out of a text before anything else."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t[k] for t in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must match as they stand")
    return {t["content"]: t["id"] for t in found}


class Tokens:
    """Ids of whole texts by a tokenizers file.  Texts are cut into words that
    the tokenizer never joins, a new word into the pieces that its pre-tokenizer
    makes, and a new piece is encoded by the file's BPE model.  Words and
    pieces are remembered.  With ``added``, the file's added tokens in a text
    are their ids, as the library has it by default, else ordinary text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # added tokens are cut out before
        self.added = added_tokens(path) if added else {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.merge = self.model.model.tokenize
        self.packed = [struct.pack("<I", i) for i in range(self.model.get_vocab_size())]
        self.words: dict = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, words: list) -> None:
        raise NotImplementedError

    def joined(self, words: list) -> bytes:
        self.meet(set(words))
        return b"".join(map(self.words.__getitem__, words))

    def meet(self, met: set) -> None:
        """Learns the words met that are new; nearly every text has some."""
        known = self.words
        new = met.difference(known)
        if new:
            if len(known) + len(new) > 2 * CACHE:
                known.clear()
                new = met
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            self.learn(list(new))

    def piece(self, piece: str) -> bytes:
        """Ids of one piece that the pre-tokenizer cuts no further."""
        ids = self.pieces.get(piece)
        if ids is None:
            packed = self.packed
            ids = self.pieces[piece] = b"".join([packed[t.id] for t in self.merge(_standing(piece))])
        return ids


class ByteTokens:
    """Ids of whole texts by a tokenizers file of a byte-level BPE without
    normalisation.  Its vocabulary and merges are handed to tiktoken's BPE core, which
    gives the same ids: both merge the pair of the lowest rank first, and here a
    token's id is the rank of the merge that makes it.  With ``added``, the
    file's added tokens in a text are their ids, else ordinary text."""

    def __init__(self, path: str, pattern: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = {chr(c): bytes([b]) for b, c in _STANDS.items()} | {chr(b): bytes([b]) for b in _PLAIN}
        ranks = {b"".join(map(plain.__getitem__, token)): i for token, i in model["vocab"].items()}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or len(set(made)) != len(made):
            raise ValueError("the ids of the merged tokens must be in the order of the merges")
        self.added = added_tokens(path) if added else {}
        ranks = {t: i for t, i in ranks.items() if i not in self.added.values()}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.coder.encode_to_numpy(text or "", allowed_special=self.coder.special_tokens_set,
                                          disallowed_special=()).astype("<u4", copy=False).tobytes()


class WordTokens(Tokens):
    """Of a tokenizer that lower-cases, drops white space and marks word ends:
    words are runs of bytes other than ASCII white space.  A word of Latin
    letters, digits and marks, whose normal form is itself, is cut by the
    tokenizer's pattern here; any other goes through the whole tokenizer."""

    _LATIN = regex.compile("[\x21-\x7e\u00a1-\u012f\u0131-\u024f]+").fullmatch
    _PIECES = regex.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not any(t in text for t in self.added):
            return self.joined(text.encode().split())
        return b"".join([self.packed[self.added[part]] if part in self.added else self.joined(part.encode().split())
                         for part in self.cut(text)])

    def all_ids(self, texts: list[bytes | None]) -> list[bytes]:
        """``ids`` of each text, given in UTF-8; the new words of all are learned at once."""
        texts, added = [t or b"" for t in texts], [a.encode() for a in self.added]
        words = [None if any(a in t for a in added) else t.split() for t in texts]
        self.meet(set().union(*(w for w in words if w)))
        get = self.words.__getitem__
        out = [None if w is None else b"".join(map(get, w)) for w in words]
        return [self.ids(t.decode()) if x is None else x for t, x in zip(texts, out, strict=True)]

    def learn(self, words: list[bytes]) -> None:
        known, piece, cut = self.words, self.piece, []
        for w, text in zip(words, b" ".join(words).decode().split(" "), strict=True):
            if not (text.isprintable() if text.isascii() else self._LATIN(text)):
                known[w] = b"".join([self.packed[i] for i in self.model.encode(text, add_special_tokens=False).ids])
                continue
            low = text.lower()
            if low.isalpha():  # one run of letters
                known[w] = piece(low)
            else:
                cut.append((w, low))
        # the others are cut as one text, in which a space stands between them
        parts = iter(self._PIECES(" ".join([low for _, low in cut])))
        for w, _ in cut:
            known[w] = b"".join(map(piece, iter(parts.__next__, " ")))
