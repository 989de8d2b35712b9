"""Chat formatting: schema fingerprints select mappings to canonical turns.

A record's *fingerprint* is a hash of its sorted nested field paths
(``messages[].role``, ``data.prompt``), of those paths only whose ends some mapping names, so that
other fields do no harm.  Each ``Mapping`` says in a few fields how a layout
becomes turns of (role, text), and which paths it needs; a fingerprint selects the most
specific mapping (the one with most paths) whose paths it contains, at the top or inside an
object, the outermost first.  Fields of ``OPTIONAL`` may be there or not, and a null text is empty.  Records are
JSON texts of any mixture of layouts (``canonical``); the rows of a table of turns become such records (``turn_records``).

Template: ``[INST]user[/INST]``, ``<s>assistant</s>``,
``<<SYS>>system<</SYS>>``, and ``[ROLE]name[TEXT]text[/ROLE]`` for any other
role.  Within a text (or name) ``\\``, ``<`` and ``[`` get a ``\\`` before
them, so no control string can be in it, and taking those away gives the text
back.  The loss mask is the body of every assistant turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circula.llm.tables import extended
from circula.llm.workers import free

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
_RISKY = re.compile(r"[\\<\[]")
_BODY = re.compile(r"(?:[^\\<\[]++|\\.)*+", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


OPTIONAL = frozenset({"system", "input"})


@dataclass(frozen=True)
class Mapping:
    """A layout: turns from a list field (``items`` with ``role`` and
    ``text`` in each), or from ``fields``: (role, names joined by an empty line).
    A ``system`` field beside the items is the first turn."""

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict = field(default_factory=lambda: _ROLES, hash=False)

    def paths(self) -> frozenset[str]:
        """The paths that a record must have."""
        if self.fields:
            return frozenset(p for _, names in self.fields for p in names) - OPTIONAL
        head = f"{self.items}[]." if self.items else ""
        return frozenset((head + self.role, head + self.text))


def _asked(*user: str, answer: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return ("system", ("system",)), ("user", user), ("assistant", (answer,))


MAPPINGS = (
    Mapping("turn rows", "", "role", "text", roles={}),
    Mapping("messages", "messages", "role", "content"),
    Mapping("from and value", "conversations", "from", "value"),
    Mapping("turn list", "turns", "role", "text"),
    Mapping("prompt and completion", fields=_asked("prompt", answer="completion")),
    Mapping("prompt and response", fields=_asked("prompt", answer="response")),
    Mapping("question and answer", fields=_asked("question", answer="answer")),
    Mapping("instruction and output", fields=_asked("instruction", "input", answer="output")),
    Mapping("instruction and response", fields=_asked("instruction", "input", answer="response")),
)
_NAMED = frozenset().union(*(m.paths() for m in MAPPINGS)) | OPTIONAL


def _named(path: str) -> bool:
    """Whether the path, or its end behind some objects, is or is within one that a mapping names."""
    parts = path.split(".")
    ends = [".".join(parts[k:]) for k in range(len(parts)) if "[]" not in "".join(parts[:k])]
    return any(e == n or e.startswith((n + "[]", n + ".")) for e in ends for n in _NAMED)


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of those paths that some mapping names."""
    return hashlib.sha256("\n".join(sorted(p for p in set(paths) if _named(p))).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m.paths()): m for m in MAPPINGS}


def field_paths(value, head: str = "") -> Iterator[str]:
    """Paths of the leaves of a decoded JSON value; a null field is a leaf."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from field_paths(v, f"{head}.{k}" if head else k)
    elif isinstance(value, list):
        for v in value:
            yield from field_paths(v, head + "[]")
    else:
        yield head


def selected(paths: Iterable[str]) -> tuple[Mapping, tuple[str, ...]] | None:
    """The most specific mapping whose paths are among these, and the keys of the object that they are in."""
    paths = set(paths)
    places = {()}
    for p in paths:
        keys = p.split("[]")[0].split(".")[:-1]
        places.update(tuple(keys[:k]) for k in range(1, len(keys) + 1))

    def has(wanted: str) -> bool:
        return any(p == wanted or p.startswith((wanted + "[]", wanted + ".")) for p in paths)

    fits = [(-len(m.paths()), len(at), k, at) for at in places for k, m in enumerate(MAPPINGS)
            if all(has(".".join([*at, p])) for p in m.paths())]
    if not fits:
        return None
    _, _, k, at = min(fits)
    return MAPPINGS[k], at


#: Mappings of the fingerprints that a worker has met (layouts are few; the memory is emptied beyond SEEN).
_CHOSEN: dict[str, tuple[Mapping, tuple[str, ...]] | None] = {}
SEEN = 10_000


def mapping_of(paths: Iterable[str]) -> tuple[str, tuple[Mapping, tuple[str, ...]] | None]:
    """Fingerprint of the paths, and what it selects."""
    paths = set(paths)
    mark = fingerprint(paths)
    if mark not in _CHOSEN:
        if len(_CHOSEN) >= SEEN:
            _CHOSEN.clear()
        _CHOSEN[mark] = selected(p for p in paths if _named(p))
    return mark, _CHOSEN[mark]


def _text(value) -> str:
    """A text field: null is empty, a list is its parts (of objects their ``text``), joined by an empty line."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "\n\n".join(t for t in (_text(v.get("text") if isinstance(v, dict) else v) for v in value) if t)
    if isinstance(value, (dict, bool)):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


def mapped(record) -> tuple[str | None, list[tuple[str, str]] | None]:
    """Fingerprint and canonical turns of a decoded record; no turns if no mapping fits.  A list is that of its messages."""
    if isinstance(record, list):
        record = {"messages": record}
    if not isinstance(record, dict):
        return None, None
    mark, found = mapping_of(field_paths(record))
    if found is None:
        return mark, None
    m, keys = found
    for key in keys:
        record = record[key]
    if m.fields:
        said = [(role, names, "\n\n".join(t for t in (_text(record.get(n)) for n in names) if t)) for role, names in m.fields]
        return mark, [(role, text) for role, names, text in said if text or not set(names) <= OPTIONAL]
    turns = []
    if m.items and _text(record.get("system")):
        turns.append(("system", _text(record["system"])))
    for x in record[m.items] if m.items else [record]:
        if isinstance(x, dict):
            role = _text(x.get(m.role))
            turns.append((m.roles.get(role, role), _text(x.get(m.text))))
    return mark, turns


def turns_of(record) -> list[tuple[str, str]] | None:
    """Canonical turns of a decoded record; None if no mapping fits."""
    return mapped(record)[1]


def escaped(text: str) -> str:
    return _RISKY.sub(r"\\\g<0>", text)


def unescaped(body: str) -> str:
    return _ESCAPED.sub(r"\1", body) if "\\" in body else body


def formatted_turn(role: str, text: str) -> str:
    if role in MARKS:
        return MARKS[role][0] + escaped(text) + MARKS[role][1]
    return OTHER[0] + escaped(role) + OTHER[1] + escaped(text) + OTHER[2]


def parse(output: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """(role, text, bounds of its body) of each turn of formatted output."""
    at = 0
    while at < len(output):
        role = next((r for r, (head, _) in MARKS.items() if output.startswith(head, at)), None)
        if role is not None:
            at, tail = at + len(MARKS[role][0]), MARKS[role][1]
        elif output.startswith(OTHER[0], at):
            end = _BODY.match(output, at + len(OTHER[0])).end()
            role = unescaped(output[at + len(OTHER[0]):end])
            if not output.startswith(OTHER[1], end):
                raise ValueError(f"no {OTHER[1]} at {end}")
            at, tail = end + len(OTHER[1]), OTHER[2]
        else:
            raise ValueError(f"no turn begins at {at}")
        end = _BODY.match(output, at).end()
        if not output.startswith(tail, end):
            raise ValueError(f"no {tail} at {end}")
        yield role, unescaped(output[at:end]), (at, end)
        at = end + len(tail)


def loss_mask(output: str) -> list[tuple[int, int]]:
    return [where for role, _, where in parse(output) if role == "assistant"]


def canonical(records: DataFrame, keep: list[str], column: str = "record") -> DataFrame:
    """One row per turn (``keep`` columns, fingerprint, turn, role, text) of the
    JSON records in ``column``.  A null record, one that is no JSON object or list or
    has a fingerprint without a mapping gives one row with null turn, role and text."""
    names = [*keep, "fingerprint", "turn", "role", "text"]

    def run(batches):
        free()
        for b in batches:
            row, mark, turn, role, text = [], [], [], [], []
            for i, said in enumerate(b.column(0).to_pylist()):
                try:
                    record = json.loads(said or "")
                except ValueError:
                    record = None
                print_, turns = mapped(record)
                for k, (r, t) in enumerate(turns or [(None, None)]):
                    row.append(i)
                    mark.append(print_)
                    turn.append(k if r is not None else None)
                    role.append(r)
                    text.append(t)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(1 + k).take(pa.array(row, pa.int64())) for k in range(len(keep))),
                 pa.array(mark, pa.string()), pa.array(turn, pa.int64()), pa.array(role, pa.string()),
                 pa.array(text, pa.string())], names)

    return records.select(F.col(column).alias("_c_record"), *keep).mapInArrow(
        run, extended(records.select(*keep).schema, "fingerprint string, turn long, role string, text string"))


def turn_rows(table: DataFrame, conversation: str, turn: str) -> DataFrame:
    """conv_id, turn, role and text of a table with one row per turn, each row mapped as a
    record of its own; other columns do no harm.  Null roles and texts are empty."""
    records = turn_records(table, conversation, turn)
    rows = canonical(records, ["conv_id", "at"])
    return rows.select("conv_id", F.col("at").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))


def turn_records(table: DataFrame, conversation: str, turn: str) -> DataFrame:
    """conv_id, at and ``record`` (a JSON object of the columns that name a turn) of a table with one row per turn."""
    rows = [m for m in MAPPINGS if not m.items and not m.fields and m.paths() <= set(table.columns)]
    if not rows:
        raise ValueError(f"no mapping of rows by turn has its columns among {table.columns}")
    record = F.to_json(F.struct(*sorted(rows[0].paths())), {"ignoreNullFields": "false"})
    return table.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("at"), record.alias("record"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted``, the turn's part of the output; a conversation's
    output is its parts by turn (equal turns by role and text)."""
    def esc(c):
        return F.regexp_replace(c, r"([\\<\[])", r"\\$1")

    out = F.concat(F.lit(OTHER[0]), esc(F.col("role")), F.lit(OTHER[1]), esc(F.col("text")), F.lit(OTHER[2]))
    for role, (head, tail) in MARKS.items():
        out = F.when(F.col("role") == role, F.concat(F.lit(head), esc(F.col("text")), F.lit(tail))).otherwise(out)
    return turns.withColumn("formatted", out)


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars of each conversation, parsed from its formatted parts.  A
    conversation streams through one task in turn order, as its digests are
    sequential, and is never held whole."""
    ordered = (parts.select("conv_id", "turn", "role", "text", "formatted").repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        free()
        rows: list[tuple] = []
        held, n, chars, loss, turns, masked = None, 0, 0, 0, None, None

        def flush():
            arrays = [pa.array([r[k] for r in rows], pa.string() if k in (2, 4) else pa.int64()) for k in range(6)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for conv, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if turns is None or conv != held:
                    if turns is not None:
                        rows.append((held, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                    held, n, chars, loss = conv, 0, 0, 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                chars += len(part)
                for role, text, _ in parse(part):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        loss += len(text)
                        masked.update(text.encode())
            if len(rows) > 10_000:
                yield flush()
        if turns is not None:
            rows.append((held, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
        yield flush()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and ``formatted`` of each conversation, as one text."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "formatted")))
    return format_turns(turns).groupBy("conv_id").agg(
        F.concat_ws("", F.transform(order, lambda x: x["formatted"])).alias("formatted"))


def oracle(extra: str) -> str:
    """DuckDB SQL for ``read_back`` over the table conversations and ``extra`` rows."""
    heads = "".join(f" WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    risky = "length(regexp_replace({0}, '[^\\\\<\\[]', '', 'g'))"
    other = f"{sum(map(len, OTHER))} + length(r) + {risky.format('r')}"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
 UNION ALL {extra})
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
 CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(t) + {risky.format('t')} + CASE r{heads} ELSE {other} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
