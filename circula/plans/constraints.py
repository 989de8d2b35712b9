"""Every declared constraint of all 14 tables, on stand-in tables with faults.

The stand-in of a table is the table itself with faults put where a hash of
the row's key says so (the same hash in DuckDB).  The checks of
``operators.quality`` run on it as on any table; the SQL is made from the same
description of the schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circula.functions.common import key_text
from circula.operators import quality
from circula.schema import CURRENT_DATE, TABLES

WRONG = "Wrong"              # no member of any enum
TOO_LARGE = "9999999.99"     # too large for every declared decimal
FAR = 1_000_000_000          # added to an integer key, so that no parent has it


def _sql_key(pk) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST(t.{c} AS VARCHAR), 'NULL')" for c in pk) + ")"


def _fault(tname: str, mark: str) -> Column:
    """About one row in eight, by the hash of its key and of ``mark``."""
    return F.substring(F.md5(F.concat(key_text(*TABLES[tname].primary_key), F.lit(f":{mark}"))), 1, 1).isin("0", "1")


def _sql_fault(tname: str, mark: str) -> str:
    return f"substr(md5({_sql_key(TABLES[tname].primary_key)} || ':{mark}'), 1, 1) IN ('0', '1')"


def _with(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])


def _counted(frames: list[DataFrame], named: list[tuple[str, str]]) -> DataFrame:
    """Number of violations of each named constraint, 0 for those without any."""
    found = reduce(DataFrame.unionByName, frames).groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("_n"))
    every = found.sparkSession.createDataFrame(named, "table_name string, rule string")
    return every.join(found, ["table_name", "rule"], "left").select(
        "table_name", "rule", F.coalesce("_n", F.lit(0)).alias("Violations"))


def _sql(rows: list[tuple[str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, '{rule}' AS rule, count(*) AS Violations FROM {source} t "
                               f"WHERE {cond}" for t, rule, source, cond in rows)


def _per_row(kind: str):
    """(table, column, rule name, faulty value, SQL of a broken clean value) of a kind of row rule."""
    for tname, spec in TABLES.items():
        if kind == "not_null":
            for c in spec.not_null:
                yield tname, c, f"NOT NULL({c})", lambda col: F.lit(None), f"t.{c} IS NULL"
        elif kind == "length":
            for c, n in spec.lengths.items():
                yield tname, c, f"LENGTH({c}<={n})", lambda col, n=n: F.repeat(F.lit("x"), F.lit(n + 1)), \
                    f"length(t.{c}) > {n}"
        elif kind == "enum":
            for c, allowed in spec.enums.items():
                members = ", ".join(f"'{a}'" for a in allowed)
                yield tname, c, f"ENUM({c})", lambda col: F.lit(WRONG), f"t.{c} NOT IN ({members})"
        elif kind == "decimal":
            for c, (p, s) in spec.decimals.items():
                yield tname, c, f"DECIMAL({c},{p},{s})", lambda col: F.lit(TOO_LARGE).cast("decimal(12,2)"), \
                    f"abs(t.{c}) >= {10 ** (p - s)}"


def check_rows(t, kind: str) -> DataFrame:
    """Q4 (not_null), Q5 (length), Q6 (enum) or Q7 (decimal) over all tables."""
    check = {"not_null": quality.check_not_null, "length": quality.check_length, "enum": quality.check_enum,
             "decimal": quality.check_decimal}[kind]
    by_table: dict[str, dict[str, Column]] = {}
    named = []
    for tname, c, rule, wrong, _ in _per_row(kind):
        col = F.col(c).cast("decimal(12,2)") if kind == "decimal" else F.col(c)
        by_table.setdefault(tname, {})[c] = F.when(_fault(tname, c), wrong(col)).otherwise(col)
        named.append((tname, rule))
    # a faulty key column would move the faults of the others; no such column is declared
    return _counted([check(_with(t[n], values), n) for n, values in by_table.items()], named)


def sql_rows(kind: str) -> str:
    return _sql([(n, rule, n, f"coalesce({_sql_fault(n, c)} OR {broken}, false)")
                 for n, c, rule, _, broken in _per_row(kind)])


def check_primary_keys(t) -> DataFrame:
    """Q2 over all tables: some rows come again, some again without a key part."""
    frames = []
    for n, spec in TABLES.items():
        df = t[n].select(*spec.primary_key)
        first = spec.primary_key[0]
        again = df.filter(_fault(n, "again"))
        lost = df.filter(_fault(n, "lost")).withColumn(first, F.lit(None).cast(dict(df.dtypes)[first]))
        frames.append(quality.check_primary_key(df.unionByName(again).unionByName(lost), n))
    return _counted(frames, [(n, "PRIMARY KEY") for n in TABLES])


def sql_primary_keys() -> str:
    parts = [f"SELECT '{n}' AS table_name, 'PRIMARY KEY' AS rule, count(*) FILTER (WHERE {_sql_fault(n, 'again')}) "
             f"+ count(*) FILTER (WHERE {_sql_fault(n, 'lost')}) AS Violations FROM {n} t" for n in TABLES]
    return "\nUNION ALL ".join(parts)


def _foreign_keys():
    for n, spec in TABLES.items():
        for fk in spec.foreign_keys:
            yield n, fk, f"FOREIGN KEY({','.join(fk.columns)}->{fk.parent})"


def check_foreign_keys(t) -> DataFrame:
    """Q9 over all tables: some keys are moved to where no parent is."""
    frames, named = [], []
    for n, fk, rule in _foreign_keys():
        c = fk.columns[0]
        text = dict(t[n].dtypes)[c] == "string"
        moved = F.concat(F.lit("no-"), F.col(c)) if text else (F.col(c) + F.lit(FAR)).cast("int")
        child = _with(t[n], {c: F.when(_fault(n, f"fk {c}"), moved).otherwise(F.col(c))})
        frames.append(quality.check_foreign_key(child, t[fk.parent], n, fk))
        named.append((n, rule))
    return _counted(frames, named)


def sql_foreign_keys() -> str:
    rows = []
    for n, fk, rule in _foreign_keys():
        c, p = fk.columns[0], fk.parent_columns[0]
        rows.append((n, rule, n, f"t.{c} IS NOT NULL AND ({_sql_fault(n, f'fk {c}')} OR NOT EXISTS "
                                 f"(SELECT 1 FROM {fk.parent} p WHERE p.{p} = t.{c}))"))
    return _sql(rows)


def default_values(t, as_of) -> DataFrame:
    """Q1 over all tables: every column with a default is left out and filled in;
    per column the value and how many rows have it."""
    frames = []
    for n, spec in TABLES.items():
        if spec.defaults:
            full = quality.apply_defaults(t[n].drop(*spec.defaults), n, as_of)
            frames += [full.groupBy(F.lit(n).alias("table_name"), F.lit(c).alias("column_name"),
                                    F.col(c).cast("string").alias("Value")).agg(F.count(F.lit(1)).alias("Rows"))
                       for c in spec.defaults]
    return reduce(DataFrame.unionByName, frames)


def sql_defaults(as_of: str) -> str:
    parts = []
    for n, spec in TABLES.items():
        for c, value in spec.defaults.items():
            said = as_of if value == CURRENT_DATE else value
            parts.append(f"SELECT '{n}' AS table_name, '{c}' AS column_name, '{said}' AS Value, count(*) AS Rows "
                         f"FROM {n} t HAVING count(*) > 0")
    return "\nUNION ALL ".join(parts)
