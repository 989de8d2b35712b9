from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from circula.llm import bpe, packing, records
from circula.llm.tables import Staging
from tests.llm.helpers import ODD, documents, prose

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def texts():
    rng = random.Random(1)
    marks = ["a", "B", " ", "  ", "\n", "é", "9", "'s", "　", "!", "\x1d", "́", "界", "\x85", "\r", "'LL", "İ", "ß", "\x00"]
    return ([t or "" for t in ODD[:-1]] + ["x " * 3000, "tail  ", " lead", "a\n\nb", "a \nb", "<|endoftext|> </s>", "😀" * 20]
            + ["".join(rng.choice(marks) for _ in range(50)) for _ in range(300)] + [prose(rng, 200) for _ in range(20)])


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_sentencepiece_equals_tiktoken(reference):
    coder = bpe.Coder(bpe.sentencepiece_model(bpe.read_ranks(RANKS)), P.PATTERN)
    for t in texts():
        ids = coder.encode(t)
        assert ids == reference.encode_ordinary(t), t
        assert coder.decode(ids) == t.encode()


def test_sentencepiece_of_other_texts(reference):
    coder = bpe.Coder(bpe.sentencepiece_model(bpe.read_ranks(RANKS)), P.PATTERN)
    rng = random.Random(2)
    for _ in range(300):  # any tokens side by side
        raw = b"".join(coder.table[rng.randrange(len(coder.table))] for _ in range(8))
        t = raw.decode("utf-8", "ignore")
        assert coder.encode(t) == reference.encode_ordinary(t)


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        bpe.sentencepiece_model({b"a": 0})


def test_encode_decode_frames(spark, reference):
    docs = documents(spark, ODD, extra=True)
    tokens = bpe.encode(docs, RANKS, P.PATTERN)
    back = {r["doc_id"]: r for r in bpe.decode(tokens, RANKS, P.PATTERN).collect()}
    said = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = reference.encode_ordinary(t or "")
        assert back[i]["token_ids"] == ids and bytes(back[i]["decoded"]) == (t or "").encode()
        assert said[i]["n_tokens"] == len(ids)
        assert said[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert said[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_the_whole_tokenizer(name):
    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    own = bpe.ByteTokens(P.path(name), P.PATTERN) if "byte" in name else bpe.WordTokens(P.path(name))
    for t in texts():
        assert np.frombuffer(own.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_have_the_ids_of_the_library(spark, tmp_path, name):
    whole = Tokenizer.from_file(P.path(name))
    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "\n", "a", "B9", "é", "\u0301"]
    said = ["a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choice(parts) for _ in range(12)) for _ in range(300)), *texts()]
    want = [whole.encode(t, add_special_tokens=False).ids for t in said]
    docs = documents(spark, said)
    if "byte" in name:
        rows = packing.token_pieces(docs, P.path(name), P.PATTERN, 1 << 20, 2, with_ids=True)
        got = {r["doc_id"]: r["ids"] for r in rows.collect()}
    else:
        dest = f"file://{tmp_path}/out"
        names = records.write(docs, dest, P.path(name), 2, 49_408)
        got = {d: ids.tolist() for n in names
               for d, ids in records.read_file(open(f"{tmp_path}/out/{n}.rec", "rb").read())}
    for i, t in enumerate(said):
        assert got[i] == [*want[i], 2], t


@pytest.fixture
def written(spark, tmp_path):
    rng = random.Random(4)
    said = [*ODD, *(prose(rng, rng.randrange(1, 60)) for _ in range(60))]
    rows = [(i * 3 % 101 if i != 5 else None, t) for i, t in enumerate(said)] + [(7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dest = f"file://{tmp_path}/out"
    names = records.write(docs, dest, P.path("word_bpe_49k.json"), 2, 49_408)
    return rows, dest, names


def test_records_round_trip(spark, written, monkeypatch):
    rows, dest, names = written
    got = sorted((tuple(r) for r in records.placed(records.read(spark, dest)).collect()), key=lambda r: r[1])
    own = bpe.WordTokens(P.path("word_bpe_49k.json"))
    want = sorted((i if i is not None else -1, own.ids(t) + b"\x02\0\0\0") for i, t in rows)
    assert [r[0] if r[0] is not None else -1 for r in got] == [i for i, _ in want]
    start = 0
    import zlib
    by_id = {}
    for i, ids in want:
        by_id.setdefault(i, []).append((len(ids) // 4, zlib.crc32(ids)))
    for r in got:
        assert r[1] == start
        start += r[2]
        by_id[r[0] if r[0] is not None else -1].remove((r[2], r[3]))
    assert not any(by_id.values())


def test_index_reads_any_order_and_checksums_hold(written):
    _, dest, names = written
    path = f"{dest}/{names[0]}.rec"
    local = path.removeprefix("file://")
    data = open(local, "rb").read()
    all_rows = list(records.read_file(data))
    order = list(range(len(all_rows)))[::-1]
    for (doc, ids), i in zip(records.read_at(path, order), order, strict=True):
        assert doc == all_rows[i][0] and (ids == all_rows[i][1]).all()
    for at in (records.HEADER.size, records.HEADER.size + 9, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(records.read_file(bytes(broken)))
    index = bytearray(open(local.replace(".rec", ".idx"), "rb").read())
    index[0] ^= 1
    with pytest.raises(ValueError):
        records.read_index(bytes(index))


def test_no_rows_make_no_records(spark, tmp_path):
    dest = f"file://{tmp_path}/none"
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert records.write(docs, dest, P.path("word_bpe_49k.json"), 2, 49_408) == []
    assert records.placed(records.read(spark, dest)).count() == 0


def test_wide_ids():
    ids = np.array([1, 70_000], "<u4").tobytes()
    assert records.read_payload(records.payload_of(None, ids, 4), 4)[1].tolist() == [1, 70_000]
    assert isinstance(Staging, type)


def test_words_met_together_equal_texts_alone(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE", 40)  # what is remembered is dropped again and again
    said = [*texts(), None]
    coder = bpe.Coder(bpe.sentencepiece_model(bpe.read_ranks(RANKS)), P.PATTERN)
    got = [r for lo in range(0, len(said), 50) for r in coder.digests(said[lo:lo + 50])]
    for t, r in zip(said, got, strict=True):
        ids = reference.encode_ordinary(t or "")
        assert r == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()), t
    said += ["a <|endoftext|> b", "b c"]
    own, whole = bpe.WordTokens(P.path("word_bpe_49k.json"), added=True), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = own.all_ids([t and t.encode() for t in said])
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [whole.encode(t or "", add_special_tokens=False).ids for t in said]
