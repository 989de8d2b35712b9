"""The declared constraint system as Spark jobs (Q1-Q10).

Each check returns violation rows ``(table_name, rule, row_key, detail)``;
``row_key`` is the row's primary key as text (composite parts joined by
``|``).  ``split_valid`` evaluates every rule as a flag on the row itself and
splits good from quarantined rows without a generated row tag, so a retried
task produces the same split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circula.functions.common import as_date, fitted, key_text
from circula.operators.ranking import spread_join
from circula.schema import CURRENT_DATE, YEAR_MAX, YEAR_MIN, YEAR_ZERO, table

VIOLATION_COLS = ("table_name", "rule", "row_key", "detail")
CORRUPT = "_corrupt_record"  # set by the CSV loader for rows that did not parse


def _violations(df: DataFrame, tname: str, rule: Column | str, detail: Column) -> DataFrame:
    pk = table(tname).primary_key
    rule_col = F.lit(rule) if isinstance(rule, str) else rule
    return df.select(F.lit(tname).alias("table_name"), rule_col.alias("rule"),
                     key_text(*pk).alias("row_key"), detail.cast("string").alias("detail"))


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "table_name string, rule string, row_key string, detail string")


def _union(frames: list[DataFrame], df: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else _empty(df)


# --------------------------------------------------------------------- Q1
def apply_defaults(df: DataFrame, tname: str, as_of) -> DataFrame:
    """Q1: add every absent column with its declared default (null if none).

    A column that is present but null stays null (SQL default rule).  The
    result has the table's columns in declared order (plus the loader's
    ``_corrupt_record`` when present); present columns keep
    their incoming type, because a raw value may not fit the declared type
    yet (an ANSI cast would fail the job) - Q7 reports it, and
    :func:`conform` casts only rows that passed.
    """
    spec = table(tname)
    present = set(df.columns)
    out = []
    for name, dtype in spec.columns:
        if name in present:
            out.append(F.col(name))
            continue
        default = spec.defaults.get(name)
        if default == CURRENT_DATE:
            value = as_date(as_of)
        elif default is None:
            value = F.lit(None)
        else:
            value = F.lit(default)
        out.append(value.cast(dtype).alias(name))
    if CORRUPT in present:  # the CSV loader's raw text of unparsable rows rides along
        out.append(F.col(CORRUPT))
    return df.select(*out)


def conform(df: DataFrame, tname: str) -> DataFrame:
    """Cast a table's columns to their declared types (for rows that passed
    every check, so each value fits; one that does not would be null, as no
    value may end the job; see :func:`~circula.functions.common.fitted`)."""
    spec = table(tname)
    return df.select(*[fitted(df, c, t).alias(c) for c, t in spec.columns if c in df.columns])


# --------------------------------------------------------------------- Q2
def check_primary_key(df: DataFrame, tname: str) -> DataFrame:
    """Q2: null key parts (one row each) and repeated keys (one row per key)."""
    pk = list(table(tname).primary_key)
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
    nulls = _violations(df.filter(any_null), tname, "PRIMARY KEY", F.lit("null key"))
    repeated = (df.filter(~any_null).groupBy(*pk).agg(F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") > 1))
    reps = _violations(repeated, tname, "PRIMARY KEY",
                       F.concat(F.lit("repeated "), F.col("_n").cast("string"), F.lit(" times")))
    return nulls.unionByName(reps)


# --------------------------------------------------------------------- Q3
def _repeated_values(df: DataFrame, column: str) -> DataFrame:
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))


def check_unique(df: DataFrame, tname: str) -> DataFrame:
    """Q3: every row holding a repeated non-null value of a UNIQUE column."""
    frames = []
    for column in table(tname).unique:
        if column not in df.columns:
            continue
        reps = _repeated_values(df, column)
        hit = spread_join(df.filter(F.col(column).isNotNull()), reps, [column], "inner")
        frames.append(_violations(hit, tname, f"UNIQUE({column})",
                                  F.concat(F.col(column), F.lit(" x"), F.col("_n").cast("string"))))
    return _union(frames, df)


# --------------------------------------------------------------------- Q4-Q8
def row_rules(df: DataFrame, tname: str, checks: tuple[str, ...]) -> list[tuple[str, Column, Column]]:
    """(rule name, broken?, detail) for every per-row rule of the table."""
    spec = table(tname)
    cols = set(df.columns)
    rules: list[tuple[str, Column, Column]] = []
    if "not_null" in checks:
        for c in spec.not_null:
            if c in cols:
                rules.append((f"NOT NULL({c})", F.col(c).isNull(), F.lit(c)))
    if "length" in checks:
        for c, n in spec.lengths.items():
            if c in cols:
                ln = F.char_length(F.col(c).cast("string"))
                rules.append((f"LENGTH({c}<={n})", F.coalesce(ln > n, F.lit(False)),
                              F.concat(F.lit(f"{c}: "), ln.cast("string"), F.lit(f" > {n}"))))
    if "enum" in checks:
        for c, allowed in spec.enums.items():
            if c in cols:
                rules.append((f"ENUM({c})", F.coalesce(~F.col(c).isin(*allowed), F.lit(False)),
                              F.concat(F.lit(f"{c}="), F.col(c))))
    if "type" in checks:
        for c, declared in spec.columns:
            kind = declared.simpleString()
            # a decimal that is a number but too large is Q7's, not a wrong type
            wanted = "decimal(38,10)" if c in spec.decimals else kind
            if c in cols and wanted != "string" and dict(df.dtypes)[c] != kind:
                bad = F.col(c).isNotNull() & fitted(df, c, wanted).isNull()
                rules.append((f"TYPE({c} {kind})", bad, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))))
    if "decimal" in checks:
        for c, (p, s) in spec.decimals.items():
            if c in cols:
                # the value as it would be stored, that is rounded to the scale
                limit = F.lit(10 ** (p - s))
                stored = F.round(F.col(c).try_cast("decimal(38,10)"), s)
                rules.append((f"DECIMAL({c},{p},{s})", F.coalesce(F.abs(stored) >= limit, F.lit(False)),
                              F.concat(F.lit(f"{c}="), F.col(c).cast("string"))))
    if "year" in checks:
        for c in spec.years:
            if c in cols:
                y = fitted(df, c, "int")
                bad = ~(y.between(YEAR_MIN, YEAR_MAX) | (y == YEAR_ZERO))
                rules.append((f"YEAR({c})", F.coalesce(bad, F.lit(False)),
                              F.concat(F.lit(f"{c}="), y.cast("string"))))
    return rules


def _check_rows(df: DataFrame, tname: str, kind: str) -> DataFrame:
    """One pass over the rows: broken rules collected per row, then exploded."""
    rules = row_rules(df, tname, (kind,))
    if not rules:
        return _empty(df)
    hits = F.filter(F.array(*[F.when(bad, F.struct(F.lit(name).alias("r"), detail.alias("d")))
                              for name, bad, detail in rules]),
                    lambda x: x.isNotNull())
    pk = list(table(tname).primary_key)
    exploded = (df.select(*pk, F.explode(hits).alias("_v")))
    return _violations(exploded, tname, F.col("_v.r"), F.col("_v.d"))


def check_not_null(df: DataFrame, tname: str) -> DataFrame:
    """Q4: a null in a declared NOT NULL column."""
    return _check_rows(df, tname, "not_null")


def check_length(df: DataFrame, tname: str) -> DataFrame:
    """Q5: text longer than its VARCHAR(n)."""
    return _check_rows(df, tname, "length")


def check_enum(df: DataFrame, tname: str) -> DataFrame:
    """Q6: a value outside the ENUM list (exact, case-sensitive; null passes)."""
    return _check_rows(df, tname, "enum")


def check_decimal(df: DataFrame, tname: str) -> DataFrame:
    """Q7: an amount that does not fit its DECIMAL(p,s)."""
    return _check_rows(df, tname, "decimal")


def check_year(df: DataFrame, tname: str = "book") -> DataFrame:
    """Q8: a YEAR outside 1901..2155 that is not 0."""
    return _check_rows(df, tname, "year")


# --------------------------------------------------------------------- Q9
def check_foreign_key(child: DataFrame, parent: DataFrame, tname: str, fk=None) -> DataFrame:
    """Q9: non-null child keys with no parent row (left anti join).

    ``fk`` picks one declared foreign key of ``tname``; by default all of the
    table's foreign keys whose parent is given as ``parent`` (a DataFrame or
    a dict of parent tables).
    """
    spec = table(tname)
    fks = [fk] if fk is not None else list(spec.foreign_keys)
    frames = []
    for f in fks:
        p = parent[f.parent] if isinstance(parent, dict) else parent
        # an anti join needs no distinct parents; a set number of partitions keeps AQE from merging
        # them up to its size in compressed bytes, which for bare keys is ten million rows to sort
        # (the session's own number would be dropped where the parents are dealt out by the key already)
        keys = p.select(*[F.col(pc).alias(cc) for cc, pc in zip(f.columns, f.parent_columns)])
        keys = keys.repartition(2 * int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), *f.columns)
        nonnull = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in f.columns])
        orphans = child.filter(nonnull).join(keys, list(f.columns), "left_anti")
        detail = F.concat(F.lit(f"{'|'.join(f.columns)}="), key_text(*f.columns))
        frames.append(_violations(orphans, tname, f"FOREIGN KEY({','.join(f.columns)}->{f.parent})", detail))
    return _union(frames, child)


# --------------------------------------------------------------------- Q10
def flag_rules(t: dict, df: DataFrame, tname: str) -> DataFrame:
    """Every rule of Q2-Q9 as a flag on the row, and whether each value fits its
    declared type; adds ``BrokenRules`` (array).  Keys are compared as
    their declared types, so no value can fail the comparison."""
    spec = table(tname)
    pk = list(spec.primary_key)
    # the per-row rules are read off the raw values
    names = [(name, bad) for name, bad, _ in
             row_rules(df, tname, ("type", "not_null", "length", "enum", "decimal", "year"))]
    types = dict(spec.columns)
    keys = list(dict.fromkeys([*pk, *[c for c in spec.unique if c in df.columns],
                               *[c for f in spec.foreign_keys for c in f.columns if c in df.columns]]))
    typed = {c: f"_key_{c}" for c in keys}
    flagged = df.select(*df.columns, F.array(*[F.when(b, F.lit(n)) for n, b in names]).cast("array<string>").alias("_rules"),
                        *[fitted(df, c, types[c]).alias(typed[c]) for c in keys])
    marks: list[tuple[str, Column]] = []
    if CORRUPT in df.columns:
        marks.append(("PARSE", F.col(CORRUPT).isNotNull()))

    # Q2: null key parts, and every row of a repeated key
    parts = [typed[c] for c in pk]
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in parts])
    marks.append(("PRIMARY KEY(null)", any_null))
    flagged = _marked(flagged, flagged.filter(~any_null), parts, "_pk_rep")
    marks.append(("PRIMARY KEY(repeated)", F.coalesce(F.col("_pk_rep"), F.lit(False))))

    # Q3: repeated non-null unique values
    for column in spec.unique:
        if column in df.columns:
            flag = f"_uq_{column}"
            flagged = _marked(flagged, flagged.filter(F.col(typed[column]).isNotNull()), [typed[column]], flag)
            marks.append((f"UNIQUE({column})", F.coalesce(F.col(flag), F.lit(False))))

    # Q9: left join to the distinct parent keys
    orphans: list[tuple[str, Column]] = []
    for i, f in enumerate(spec.foreign_keys):
        if f.parent not in t or not all(c in df.columns for c in f.columns):
            continue
        flag, own = f"_fk{i}", [typed[c] for c in f.columns]
        parents = (t[f.parent].select(*[F.col(pc).cast(types[cc]).alias(typed[cc])
                                        for cc, pc in zip(f.columns, f.parent_columns)])
                   .distinct().withColumn(flag, F.lit(True)))
        flagged = spread_join(flagged, parents, own, "left")
        nonnull = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in own])
        orphans.append((f"FOREIGN KEY({','.join(f.columns)}->{f.parent})", nonnull & F.col(flag).isNull()))

    lists = [F.array(*[F.when(b, F.lit(n)) for n, b in part]) for part in (marks, orphans) if part]
    broken = F.concat(lists[0], F.col("_rules"), *lists[1:])
    return flagged.select(*df.columns, F.filter(broken, lambda x: x.isNotNull()).alias("BrokenRules"))


def _marked(rows: DataFrame, among: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag`` true where their key is in ``among`` more than once."""
    reps = (among.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
            .select(*keys, F.lit(True).alias(flag)))
    return spread_join(rows, reps, keys, "left")


def split_valid(t: dict, tname: str, df: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Q10: (good rows, quarantined rows with the list of broken rules)."""
    df = df if df is not None else t[tname]
    flagged = flag_rules(t, df, tname)
    good = flagged.filter(F.size("BrokenRules") == 0).drop("BrokenRules")
    bad = flagged.filter(F.size("BrokenRules") > 0).withColumn(
        "BrokenRules", F.array_join("BrokenRules", ","))
    return good, bad
