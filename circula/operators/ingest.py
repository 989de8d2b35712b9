"""Ingest operators: id assignment (Q11), upsert (Q12), sign-up batches (Q13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circula.functions.common import as_date, fitted
from circula.operators.quality import apply_defaults, conform, flag_rules, row_rules
from circula.operators.ranking import sequence_numbers, spread_join
from circula.schema import table
from circula.session import ensure_checkpoint_dir


def assign_ids(df: DataFrame, id_col: str, order_cols: Sequence, start,
               num_partitions: int | None = None) -> DataFrame:
    """Q11: continue an AUTO_INCREMENT: ``start + rank - 1`` in the given order.

    Gap-free and stable under retry, with no single global sort partition
    (range partitions + per-partition offsets, see ``sequence_numbers``).
    ``start`` is the first id to hand out (an int, or a one-value Column such
    as the current maximum + 1 read with a scalar subquery).
    """
    ranked = sequence_numbers(df, order_cols=order_cols, out_col="_rank",
                              num_partitions=num_partitions)
    first = start if isinstance(start, Column) else F.lit(int(start))
    return ranked.withColumn(id_col, (first + F.col("_rank") - 1).cast("int")).drop("_rank")


def next_id(current: DataFrame, id_col: str) -> int:
    """First free AUTO_INCREMENT value of a table (max + 1, or 1 when empty)."""
    m = current.agg(F.max(id_col)).first()[0]
    return 1 if m is None else int(m) + 1


#: The per-row rules (Q4-Q8) that a batch of changes may be held to, beside its keys and types.
CHANGE_RULES = ("not_null", "length", "enum", "decimal", "year")


def _judged_changes(current: DataFrame | None, changes: DataFrame, key: Sequence[str], tname: str | None,
                    rules: Sequence[str]) -> DataFrame:
    """The changes with ``_faults``, the list of what is wrong with each: a null key part, values that do
    not fit the current table's types, and the broken ones of ``rules``."""
    faults = [F.when(F.col(c).isNull(), F.lit(f"NULL KEY({c})")) for c in key]
    have = dict(current.dtypes) if current is not None else {}
    for c in changes.columns:
        if c in have and have[c] != dict(changes.dtypes)[c]:
            lost = F.col(c).isNotNull() & fitted(changes, c, have[c]).isNull()
            faults.append(F.when(lost, F.lit(f"TYPE({c} {have[c]})")))
    if tname is not None:
        faults += [F.when(bad, F.lit(name)) for name, bad, _ in row_rules(changes, tname, tuple(rules))]
    elif rules:
        raise ValueError("rules are those of a declared table: give its name")
    return changes.withColumn("_faults", F.filter(F.array(*faults).cast("array<string>"), lambda x: x.isNotNull()))


def upsert(current: DataFrame, changes: DataFrame, key: Sequence[str], order_cols: Sequence[str],
           tname: str | None = None, as_of=None, rules: Sequence[str] = ()) -> DataFrame:
    """Q12: apply a batch of changes; the last change per key wins, new keys
    are inserted.

    The winner per key is taken with an aggregate (``max_by`` on a struct of
    the order columns followed by the whole change row), which Spark combines
    map-side, so a key changed a million times costs one row per task.  Ties
    on the order columns go to the greatest change row.  Columns absent from
    the change rows keep the current value for an edit and take the declared
    default (Q1) for an insert.  A change with a null key part or with a value that does not fit its column
    (see :func:`~circula.functions.common.fitted`), and one that breaks a rule of ``rules`` (of
    ``CHANGE_RULES``, for the declared table ``tname``), is left out alone, and the
    last of the others wins; :func:`rejected_changes` has those left out.
    """
    key = list(key)
    have = dict(current.dtypes)
    judged = _judged_changes(current, changes, key, tname, rules).filter(F.size("_faults") == 0)
    change_cols = [c for c in changes.columns]
    changes = judged.select(*[(fitted(judged, c, have[c]) if c in have else F.col(c)).alias(c) for c in change_cols])
    payload = [c for c in change_cols if c not in key]
    ordering = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in change_cols])
    latest = (changes.groupBy(*key)
              .agg(F.max_by(F.struct(*[F.col(c) for c in payload]), ordering).alias("_w"))
              .select(*key, *[F.col(f"_w.{c}").alias(c) for c in payload]))
    out_cols = current.columns
    keep_cols = [c for c in out_cols if c not in change_cols]
    cur = current.select(*key, *[F.col(c).alias(f"_cur_{c}") for c in keep_cols],
                         F.lit(True).alias("_exists"))
    merged = latest.join(cur, key, "left")
    proj = []
    for c in out_cols:
        if c in change_cols:
            proj.append(F.col(c))
        else:
            default = _default_expr(tname, c, as_of, current)
            proj.append(F.when(F.col("_exists"), F.col(f"_cur_{c}")).otherwise(default).alias(c))
    changed = merged.select(*proj)
    untouched = current.join(latest.select(*key), key, "left_anti")
    return untouched.unionByName(changed)


def rejected_changes(changes: DataFrame, key: Sequence[str], current: DataFrame | None = None,
                     tname: str | None = None, rules: Sequence[str] = ()) -> DataFrame:
    """Q12: the changes that :func:`upsert` into ``current`` leaves out (with the same
    ``tname`` and ``rules``), with their comma-joined ``Reason``; without a
    ``current`` table, those with a null key part."""
    judged = _judged_changes(current, changes, list(key), tname, rules).filter(F.size("_faults") > 0)
    return judged.select(*changes.columns, F.array_join("_faults", ",").alias("Reason"))


def _default_expr(tname: str | None, column: str, as_of, current: DataFrame) -> Column:
    dtype = dict(current.dtypes)[column]
    if tname is None:
        return F.lit(None).cast(dtype)
    default = table(tname).defaults.get(column)
    if default is None:
        return F.lit(None).cast(dtype)
    if default == "CURRENT_DATE":
        return as_date(as_of).cast(dtype)
    return F.lit(default).cast(dtype)


# Sign-up outcome labels (first failing rule wins, in this order).
SIGNUP_MISSING = "missing field"
SIGNUP_TERMS = "terms not accepted"
SIGNUP_EMAIL = "invalid email"
SIGNUP_TAKEN = "email already registered"
SIGNUP_REPEAT = "email repeated in batch"
EMAIL_PATTERN = r"^[^@]+@[^@]+$"


def normalize_signups(df: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Q13: decide a batch of sign-up forms.

    Returns one row per submission with the User columns it would create and
    ``Reason`` (null when accepted).  Rules, first failing wins: all five text
    fields non-empty after trim; terms accepted; e-mail has exactly one '@'
    with text on both sides; e-mail (trimmed, lower-case) not already held by
    a user; e-mail not repeated earlier in the batch (lowest SubmissionID
    kept, then the least row).  A submission delivered again counts once.  Passwords are never carried.
    """
    first, last = F.trim("firstName"), F.trim("lastName")
    email = F.lower(F.trim("email"))
    cleaned = df.select(
        "SubmissionID",
        F.concat_ws(" ", first, last).alias("Name"), email.alias("Email"),
        F.trim("phone").alias("Phone"), F.trim("address").alias("Street"),
        F.coalesce(F.col("terms"), F.lit(False)).alias("_terms"),
        F.array(first, last, email, F.trim("phone"), F.trim("address")).alias("_fields"))
    missing = F.exists("_fields", lambda x: x.isNull() | (x == ""))
    base_reason = (F.when(missing, F.lit(SIGNUP_MISSING))
                   .when(~F.col("_terms"), F.lit(SIGNUP_TERMS))
                   .when(~F.col("Email").rlike(EMAIL_PATTERN), F.lit(SIGNUP_EMAIL)))
    # one submission delivered again is one submission
    cleaned = cleaned.withColumn("Reason", base_reason).drop("_fields", "_terms").distinct()

    held = (users.filter(F.col("Email").isNotNull())
            .select(F.lower(F.trim("Email")).alias("Email")).distinct()
            .withColumn("_taken", F.lit(True)))
    cleaned = spread_join(cleaned, held, ["Email"], "left").withColumn(
        "Reason", F.coalesce(F.col("Reason"),
                             F.when(F.col("_taken"), F.lit(SIGNUP_TAKEN)))).drop("_taken")

    # First submission per e-mail among those still standing: an aggregate
    # (combined map-side), joined back on (Email, SubmissionID) - one match
    # per row at most, and hashing on both columns spreads a hot e-mail.
    firsts = (cleaned.filter(F.col("Reason").isNull()).groupBy("Email")
              .agg(F.min(F.struct("SubmissionID", "Name", "Phone", "Street")).alias("_w"))
              .select("Email", F.col("_w.SubmissionID").alias("SubmissionID"), "_w"))
    decided = spread_join(cleaned, firsts, ["Email", "SubmissionID"], "left").withColumn(
        "Reason", F.coalesce(F.col("Reason"), F.when(
            ~F.struct("SubmissionID", "Name", "Phone", "Street").eqNullSafe(F.col("_w")), F.lit(SIGNUP_REPEAT))))
    return decided.select(
        "SubmissionID", "Name", "Email", "Phone", "Street",
        F.when(F.col("Reason").isNull(), F.lit("Active")).alias("AccountStatus"),
        F.when(F.col("Reason").isNull(), as_date(as_of)).alias("MembershipDate"),
        "Reason")


def signups_to_users(decided: DataFrame, users: DataFrame, as_of,
                     num_partitions: int | None = None) -> DataFrame:
    """Accepted sign-ups as User rows with fresh UserIDs (Q11), in
    SubmissionID order (ties broken by the row's own values)."""
    accepted = decided.filter(F.col("Reason").isNull()).drop("Reason")
    with_ids = assign_ids(accepted, "UserID", ["SubmissionID", "Email", "Name", "Phone", "Street"],
                          next_id(users, "UserID"),
                          num_partitions=num_partitions)
    return apply_defaults(with_ids.drop("SubmissionID"), "library_user", as_of)


def ingest_table(t: dict, tname: str, raw: DataFrame, good_path: str, bad_path: str, as_of) -> None:
    """Ingest one table: defaults (Q1) -> every check as a flag on the row
    (Q10) -> good rows cast to the declared types and written, quarantined
    rows written with their broken rules.

    The flagged rows are checkpointed once (into spark.checkpoint.dir), so
    both writes read the same checked rows and the joins behind the checks
    run once.  ``t`` holds the parent tables for the foreign-key checks.
    """
    ensure_checkpoint_dir(raw.sparkSession)
    flagged = flag_rules(t, apply_defaults(raw, tname, as_of), tname).checkpoint(eager=True)
    good = conform(flagged.filter(F.size("BrokenRules") == 0).drop("BrokenRules"), tname)
    bad = flagged.filter(F.size("BrokenRules") > 0).withColumn("BrokenRules", F.array_join("BrokenRules", ","))
    good.write.mode("overwrite").parquet(good_path)
    bad.write.mode("overwrite").parquet(bad_path)


def ingest_files(t: dict, tname: str, path: str, fmt: str, good_path: str, bad_path: str, as_of) -> None:
    """The ingest flow from files: S1 load (raw parquet as stored, or CSV
    with unparsable rows kept aside) -> :func:`ingest_table`.  Rows that did
    not parse are quarantined under the rule ``PARSE``."""
    from circula.sources.tables import load_table
    some = next(iter(t.values())) if isinstance(t, dict) and t else t["loan"]
    raw = load_table(some.sparkSession, tname, path, fmt=fmt, strict=False)
    ingest_table(t, tname, raw, good_path, bad_path, as_of)
