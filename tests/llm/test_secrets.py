from __future__ import annotations

import random
import re
import string

from circula.llm import secrets as S
from tests.llm.helpers import ODD, documents, prose

NEW = "q7Zt9XbL2mWc8RvK4pYd"


def base(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text or ""):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m.group()) >= 24]
    return sorted(out)


def texts():
    rng = random.Random(3)
    parts = ["password = 'hunter22x'", "Api_Key:abc", "APIKEY=" + "ab12" * 5, "token token: " + "f" * 30,
             "AKIA" + "A1B2" * 4, "AKIAshort", "AKIAAKIA" + "Z" * 30, "deadbeef" * 3, "deadbeef" * 2, "é", "\n", "ſecret=abcdefgh",
             "secret   =   \"x.y-z/1+=_\"", "toKen=abcdefgh", "passwd", ": ="]
    return [*ODD, *(" ".join(rng.choice([*parts, prose(rng, 3)]) for _ in range(12)) for _ in range(200))]


def test_base_spans_equal_brute_force(spark):
    all_texts = texts()
    got = {r["doc_id"]: r for r in S.scan(documents(spark, all_texts, extra=True)).collect()}
    for i, t in enumerate(all_texts):
        want = base(t)
        assert got[i]["base_spans"] == ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in want), t
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(x[1] == k for x in want) for k in range(3)]
        assert set(got[i]["base_spans"].split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_new_strings_in_sensitive_context():
    text = f"the bearer credential is {NEW} and the rest of the text"
    assert [text[s:e] for s, k, e in S.find(text) if k == 3] == [NEW]
    again = "bearer " + NEW + " as said before: " + NEW + " " + "far away " * 90 + NEW
    assert [again[s:e] for s, k, e in S.find(again) if k == 3] == [NEW] * 3  # wherever the text says it again
    assert [k for _, k, _ in S.find(f"password={NEW} and {NEW}")] == [0, 3]
    assert not S.find(f"in the garden {NEW} grows") and not S.find("the private configuration/path/to/config2.json")
    assert S.find(None) == [] and S.find("") == []


def test_new_strings_of_any_alphabet():
    rng = random.Random(8)
    for letters in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase + "234567",
                    string.digits + string.ascii_lowercase, string.digits):
        for n in (16, 20, 40):
            for _ in range(40):
                new = "".join(rng.choice(letters) for _ in range(n))
                text = f"the bearer credential is {new} and the rest of the text"
                assert [text[s:e] for s, _, e in S.find(text)] == [new]


def test_identifiers_in_sensitive_context_are_known():
    for name in ("database_connection_string", "private_key_file_location", "================", "node_modules/packages/"):
        assert not S.find(f"the session key of {name} is read"), name
    name = "get_connection_parameters"
    assert not S.find(f"the key is {name} now, and {name} later")


def measured(model, texts):
    return sum(model.new(t) for t in texts) / len(texts)


def test_rates_on_names_and_keys():
    """Names of modules that the dictionary has not seen, and random keys of every alphabet."""
    seen = S.library_names(tuple(S.MODULES[::2]))
    model = S.Novelty(seen, [])
    others = [n for n in S.library_names(tuple(S.MODULES[1::2])) if n not in set(seen) and len(n) >= S.MIN_RUN]
    assert len(others) > 500 and measured(model, others) < 0.12
    assert measured(S.plain(), [n for n in S.library_names() if len(n) >= S.MIN_RUN]) < 0.05
    rng = random.Random(17)
    for alphabets in S.ALPHABETS.values():
        for letters in alphabets:
            for n in (16, 24, 40):
                keys = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(100)]
                assert measured(S.plain(), keys) > 0.9, (letters, n)


def test_names_before_a_key_and_words_behind_it():
    rng = random.Random(4)
    for _ in range(40):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(20))
        for said, want in ((f"session_cookie_value={key}", key), (f"{key} is the private key", key),
                           (f"the token src/lib/config/{key} x", key), (f"a{' b' * 70} {key} {' c' * 70} token", None)):
            found = [said[s:e] for s, k, e in S.find(said) if k == 3]
            assert all(want is not None and f.endswith(want) for f in found) and bool(found) == (want is not None)


def test_a_model_of_a_corpus_goes_to_tasks(spark):
    import pickle

    docs = documents(spark, [prose(random.Random(1), 300), None, ""])
    model = S.fit(docs)
    again = pickle.loads(pickle.dumps(model))
    assert again.thresholds == model.thresholds and again.bits(NEW) == model.bits(NEW)
    text = f"the bearer credential is {NEW}, {NEW}"
    got = S.scan(documents(spark, [text]), model=model).first()
    assert got["spans"] == f"novel:25:{25 + len(NEW)},novel:{27 + len(NEW)}:{27 + 2 * len(NEW)}"
    assert S.scan(documents(spark, [])).count() == 0


def test_redaction(spark):
    text = "x password=abcdef1234567890abcdef1234 y AKIA" + "Q1" * 9 + " z"
    docs = documents(spark, [text, None, "", "clean"], extra=True)
    got = {r["doc_id"]: r["text"] for r in S.redact(docs).collect()}
    assert got == {0: "x [secret] y [secret] z", 1: None, 2: "", 3: "clean"}
    assert S.redact(docs).schema == docs.schema and S.redact(docs.limit(0)).count() == 0
