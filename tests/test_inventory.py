
from __future__ import annotations

import __spark_entry__ as entry_mod
from circula.plans.catalog import ORACLE, QUERIES

SECTIONS = {"S": 2, "Q": 13, "R": 5, "T": 2, "P": 6, "A": 12, "L": 11, "U": 7, "C": 7, "F": 5, "W": 2}
IDS = [f"{p}{i}" for p, n in SECTIONS.items() for i in range(1, n + 1)]


def test_every_operator_id_is_registered():
    keys = set(entry_mod.queries())
    missing = [i for i in IDS if not any(k.startswith(i.lower() + "_") for k in keys)]
    assert missing == []


def test_every_registered_query_belongs_to_an_operator_id():
    ids = {i.lower() for i in IDS}
    assert all(k.split("_", 1)[0] in ids for k in QUERIES)


def test_entry_holds_the_catalog():
    assert QUERIES.items() <= entry_mod.queries().items() and ORACLE.items() <= entry_mod.oracle_sql().items()
