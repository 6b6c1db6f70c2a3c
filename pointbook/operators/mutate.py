"""Table mutations as pure functions: old snapshot + change set -> new snapshot.

Spark's Parquet tables have no MERGE / UPDATE / DELETE, and a snapshot is
never rewritten in place, so every mutation is a join producing the next
version (written with ``sources.tables.write_snapshot``).

Request batches replace the reference's one-row HTTP calls. Within a batch
the reference would apply requests one after another, so a batch is first
reduced to the net effect of that sequence (``seq`` = arrival order):

* upserts overwrite every mutable column -> the last request per key wins;
* columns the reference never updates on conflict (``created_at``, a note's
  ``student_id``) keep the stored value, or the first inserting request's;
* deletes and range resets attribute each removed row to the first request
  that covers it.

Merge plans
-----------
* Change set proven small (rows and bytes): the changes are broadcast and the
  base table is scanned twice (its rows, left-joined with the changes, and its
  key column, for the changes that are new), never shuffled.
* Otherwise: one full outer join on the key (sort-merge or shuffled hash,
  chosen by AQE), which handles change sets as large as the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import empty_to_null, gen_id
from ..schemas import ID_PREFIX_PENALTY
from ..sources.roster import normalize_roster, roster_required_fields
from .guards import DEFAULT_BROADCAST_ROWS, few_per_key, materialize_if_bounded, restrict_to_keys, row_count_at_most, small_enough
from .validate import (first_reason, split_valid, validate_notes, validate_penalties, validate_resets,
                       validate_rules, validate_students, validate_thresholds)


# -- net effect of a batch ----------------------------------------------------

def dedupe_last(changes: DataFrame, key: str, cols: list[str], seq: str = "seq") -> DataFrame:
    """One row per key carrying the values of its last request (by ``seq``).

    ``max_by`` over a struct keeps NULL fields (a later NULL overwrites) and
    aggregates partially, so a key repeated in a third of the batch is
    reduced inside each task before the shuffle.
    """
    payload = F.struct(*[F.col(c) for c in cols])
    return (changes.groupBy(key).agg(F.max_by(payload, F.col(seq)).alias("_last"))
            .select(key, *[F.col(f"_last.{c}").alias(c) for c in cols]))


# -- merge ----------------------------------------------------------------------

def merge_upsert(base: DataFrame, changes: DataFrame, key: str, update_cols: list[str], as_of: str,
                 keep_cols: tuple[str, ...] = (), created_col: str | None = "created_at",
                 updated_col: str | None = "updated_at", max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                 with_op: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Apply net changes (one row per ``key``) to ``base``.

    ``update_cols`` are overwritten on conflict (NULL overwrites too - this
    is not a coalesce); ``keep_cols`` keep the stored value on conflict and
    take the change's value on insert; ``created_col`` is kept or set to
    ``as_of``; ``updated_col`` becomes ``as_of`` on every touched row.
    With ``with_op`` an ``op`` column tells ``inserted`` / ``updated`` /
    NULL (untouched) - the edit-or-add flag (D8). ``source`` is the raw
    request batch the changes were reduced from: when it alone exceeds the
    bound the (costly) proof on the reduced changes is skipped and the full
    outer merge is used.
    """
    ccols = [c for c in list(update_cols) + list(keep_cols)]
    c = changes.select(F.col(key).alias("_ck"), *[F.col(x).alias(f"_c_{x}") for x in ccols])
    if source is not None and not row_count_at_most(source, max_broadcast_rows):
        small = False
    else:
        c, small = materialize_if_bounded(c, max_broadcast_rows)

    def merged(exists: Column, present: Column, b) -> list[Column]:
        out = []
        for name in base.columns:
            if name == key:
                v = F.coalesce(b(name), F.col("_ck"))
            elif name in update_cols:
                v = F.when(present, F.col(f"_c_{name}")).otherwise(b(name))
            elif name in keep_cols:
                v = F.when(exists, b(name)).otherwise(F.col(f"_c_{name}"))
            elif name == created_col:
                v = F.when(exists, b(name)).otherwise(F.lit(as_of))
            elif name == updated_col:
                v = F.when(present, F.lit(as_of)).otherwise(b(name))
            else:
                v = b(name)
            out.append(v.alias(name))
        if with_op:
            out.append(F.when(present & exists, F.lit("updated")).when(present, F.lit("inserted")).alias("op"))
        return out

    if small:
        # two scans of the base: its rows, and its keys
        present = F.col("_ck").isNotNull()
        stored = base.join(F.broadcast(c), base[key] == F.col("_ck"), "left").select(*merged(F.lit(True), present, lambda n: base[n]))
        known = base.select(F.col(key).alias("_bk")).join(F.broadcast(c.select("_ck")), F.col("_bk") == F.col("_ck"), "left_semi")
        # keys that are known are a subset of the changes' keys
        inserted = c.join(F.broadcast(known), F.col("_ck") == F.col("_bk"), "left_anti")
        out = stored.unionByName(inserted.select(
            *merged(F.lit(False), F.lit(True), lambda n: F.lit(None).cast(base.schema[n].dataType))))
    else:
        j = base.join(c, base[key] == F.col("_ck"), "full_outer")
        out = j.select(*merged(base[key].isNotNull(), F.col("_ck").isNotNull(), lambda n: base[n]))
    return out


def update_existing(base: DataFrame, changes: DataFrame, key: str, update_cols: list[str], as_of: str,
                    updated_col: str | None = "updated_at", source: DataFrame | None = None,
                    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """C3 pattern: overwrite ``update_cols`` of existing keys only; unknown keys
    are a silent no-op, nothing is inserted. A change set proven small
    (``source``: the raw batch) is broadcast: one scan of the base."""
    c = changes.select(F.col(key).alias("_ck"), *[F.col(x).alias(f"_c_{x}") for x in update_cols])
    if source is None or row_count_at_most(source, max_broadcast_rows):
        c, small = materialize_if_bounded(c, max_broadcast_rows)
        if small:
            c = F.broadcast(c)
    j = base.join(c, base[key] == F.col("_ck"), "left")
    present = F.col("_ck").isNotNull()
    out = []
    for name in base.columns:
        if name in update_cols:
            v = F.when(present, F.col(f"_c_{name}")).otherwise(base[name])
        elif name == updated_col:
            v = F.when(present, F.lit(as_of)).otherwise(base[name])
        else:
            v = base[name]
        out.append(v.alias(name))
    return j.select(*out)


def delete_by_keys(base: DataFrame, keys: DataFrame, key: str = "id", keys_col: str = "id",
                   max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Delete rows whose ``key`` is in ``keys`` (absent keys are fine). A raw
    batch of keys proven small is broadcast: the base is only scanned. A
    larger one is made distinct and joined by key."""
    k = keys.select(F.col(keys_col).alias(key))
    small = small_enough(k, max_broadcast_rows)
    k = k.distinct()
    return base.join(F.broadcast(k) if small else k, key, "left_anti").select(*base.columns)


# -- students (C1-C4) ---------------------------------------------------------

STUDENT_FIELDS = ["name", "grade", "student_phone", "parent_phone"]


def upsert_students(students: DataFrame, requests: DataFrame, as_of: str, with_op: bool = False,
                    **kw) -> tuple[DataFrame, DataFrame]:
    """Validated upserts; insert, or overwrite name, grade and both phones
    (``''`` stays ``''``, NULL overwrites); ``created_at`` kept.
    Returns ``(new_students, rejected_requests)``."""
    ok, bad = split_valid(validate_students(requests))
    net = dedupe_last(ok, "id", STUDENT_FIELDS)
    return merge_upsert(students, net, "id", STUDENT_FIELDS, as_of, with_op=with_op, source=requests, **kw), bad


def import_students(students: DataFrame, roster: DataFrame, as_of: str, **kw) -> tuple[DataFrame, DataFrame]:
    """Roster import - normalise (A2), keep rows with id and name (B6),
    empty optional values become NULL (unlike C1), last duplicate id wins.
    Returns ``(new_students, imported)`` where ``imported`` is the one-row
    count of rows after B6 *including* duplicates (E3)."""
    rows = roster_required_fields(normalize_roster(roster))
    rows = rows.select("seq", "id", "name", *[empty_to_null(c).alias(c) for c in STUDENT_FIELDS[1:]])
    net = dedupe_last(rows, "id", STUDENT_FIELDS)
    imported = rows.agg(F.count(F.lit(1)).alias("imported"))
    return merge_upsert(students, net, "id", STUDENT_FIELDS, as_of, source=roster, **kw), imported


def update_students(students: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """Overwrite existing students only (unknown ids: no-op)."""
    ok, _ = split_valid(validate_students(requests))
    return update_existing(students, dedupe_last(ok, "id", STUDENT_FIELDS), "id", STUDENT_FIELDS, as_of, source=requests)


def delete_students(students: DataFrame, penalties: DataFrame, notes: DataFrame,
                    keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C4 + D7: delete students and cascade to their ledger rows and notes."""
    k = keys.select("id")
    return (delete_by_keys(students, k),
            delete_by_keys(penalties, k, key="student_id"),
            delete_by_keys(notes, k, key="student_id"))


# -- rules / thresholds (C5-C8) ---------------------------------------------------

RULE_FIELDS = ["title", "points", "is_active", "sort_order"]
THRESHOLD_FIELDS = ["min_points", "label", "message_template", "sort_order"]


def upsert_rules(rules: DataFrame, requests: DataFrame, as_of: str, batch: str, **kw) -> tuple[DataFrame, DataFrame]:
    """Coerced, validated rule upserts; all four fields overwritten on
    conflict. Past ledger rows are not touched (their title and points are
    frozen copies)."""
    ok, bad = split_valid(validate_rules(requests, batch))
    return merge_upsert(rules, dedupe_last(ok, "id", RULE_FIELDS), "id", RULE_FIELDS, as_of, source=requests,
                        **kw), bad


def upsert_thresholds(thresholds: DataFrame, requests: DataFrame, as_of: str, batch: str,
                      **kw) -> tuple[DataFrame, DataFrame]:
    """Coerced, validated threshold upserts (template NULL -> ``''``)."""
    ok, bad = split_valid(validate_thresholds(requests, batch))
    net = dedupe_last(ok, "id", THRESHOLD_FIELDS)
    return merge_upsert(thresholds, net, "id", THRESHOLD_FIELDS, as_of, source=requests, **kw), bad


# -- ledger (C9-C11) ----------------------------------------------------------------

def rule_snapshot(requests: DataFrame, rules: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Each request with its rule's *current* ``rule_title`` and ``points``
    (NULL, with ``_rid`` NULL, when the rule does not exist).

    Rules are a configuration table: broadcast after a bounded row count, so
    the requests are not shuffled by ``rule_id``; a rules table beyond the
    bound is joined by sort-merge."""
    r = rules.select(F.col("id").alias("_rid"), F.col("title").alias("rule_title"), F.col("points").alias("points"))
    if row_count_at_most(rules, max_broadcast_rows):
        r = F.broadcast(r)
    return requests.join(r, F.col("rule_id") == F.col("_rid"), "left")


def assign_penalties(requests: DataFrame, rules: DataFrame, students: DataFrame, as_of: str, batch: str) -> DataFrame:
    """C9 (J3 -> D2 -> D3): every request with ``reject_reason`` (NULL =
    accepted) and, for accepted ones, the ledger row to append.

    The rule's *current* title and points are copied onto the row (frozen
    thereafter); inactive rules are accepted; the student must exist.
    Reject order: schema -> rule_not_found -> student_not_found.
    ``batch`` names the batch and is part of every id: ``seq`` is unique in it only.
    Both lookups are equi-joins; the rules (a configuration table) are
    broadcast after a bounded count (``rule_snapshot``). A batch naming few students (a micro-batch) first
    narrows the roster to them through a broadcast semi-join, so the roster
    is scanned, not shuffled; a large batch keeps the sort-merge join with
    skew splitting for a hot student.
    """
    v = validate_penalties(requests)
    (students,) = restrict_to_keys([(students, "id")], requests, "student_id")
    j = rule_snapshot(v, rules)
    s = students.select(F.col("id").alias("_sid"), F.lit(True).alias("_sx"))
    j = j.join(s, F.col("student_id") == F.col("_sid"), "left")
    reason = first_reason(
        (F.size("issues") > 0, "schema"),
        (F.col("_rid").isNull(), "rule_not_found"),
        (F.col("_sx").isNull(), "student_not_found"),
    )
    return j.select(
        "seq",
        gen_id(ID_PREFIX_PENALTY, F.lit(batch), "seq", "student_id", "rule_id", "occurred_on").alias("id"),
        "student_id", "rule_id", "rule_title", "points", "occurred_on", "memo",
        F.lit(as_of).alias("created_at"),
        reason.alias("reject_reason"),
        F.array_join("issues", ",").alias("issues"),
    )


def accepted_penalties(decided: DataFrame) -> DataFrame:
    """Ledger rows to append from ``assign_penalties``."""
    return (decided.where(F.col("reject_reason").isNull())
            .select("id", "student_id", "rule_id", "rule_title", "points", "occurred_on", "memo", "created_at"))


def rejected_penalties(decided: DataFrame) -> DataFrame:
    """Quarantine of ``assign_penalties``."""
    return (decided.where(F.col("reject_reason").isNotNull())
            .select("seq", "student_id", "rule_id", "occurred_on", "reject_reason", "issues"))


def _ranges(requests: DataFrame) -> DataFrame:
    """The valid reset requests as (_rseq, _rsid, _lo, _hi)."""
    v = validate_resets(requests).where(F.size("issues") == 0)
    return v.select(F.col("seq").alias("_rseq"), F.col("student_id").alias("_rsid"), F.col("from").alias("_lo"), F.col("to").alias("_hi"))


def covered_days(penalties: DataFrame, requests: DataFrame) -> DataFrame:
    """C11: the (student, day)s with ledger rows that some valid request covers,
    with their ``points`` and ``rows`` and the first covering request ``_rseq``.
    A small batch only aggregates the students it names."""
    from .ranges import by_day, first_covering

    (named,) = restrict_to_keys([(penalties, "student_id")], requests, "student_id")
    return first_covering(by_day(named), _ranges(requests))


def reset_counts(requests: DataFrame, covered: DataFrame) -> DataFrame:
    """One row per request (``seq``, ``student_id``, ``reject_reason``,
    ``deleted``): an invalid request deletes nothing and carries
    ``reject_reason = 'schema'``. A row covered by several requests counts
    for the first (by ``seq``), as sequential deletes would."""
    hits = covered.groupBy("_rseq").agg(F.sum("rows").alias("_n"))
    return (validate_resets(requests).join(hits, F.col("seq") == F.col("_rseq"), "left")
            .select("seq", "student_id",
                    F.when(F.size("issues") > 0, F.lit("schema")).alias("reject_reason"),
                    F.coalesce("_n", F.lit(0)).cast("bigint").alias("deleted")))


def reset_penalties(penalties: DataFrame, requests: DataFrame, **few_kw) -> tuple[DataFrame, DataFrame]:
    """C11: delete each valid request's student rows with ``occurred_on`` in the
    inclusive text range (``from > to`` deletes nothing).

    Returns ``(remaining_penalties, deleted_counts)`` (see ``reset_counts``).
    A small batch with few requests a student (``guards.few_per_key``,
    ``few_kw`` passed on) is broadcast with its ranges: the ledger is only
    scanned, and a row meets few ranges. Otherwise rows go by an equi
    anti-join on (student, day) with the covered days: no row meets more than
    one day, and a hot student is spread by day.
    """
    covered = covered_days(penalties, requests)
    if few_per_key(requests, "student_id", **few_kw):
        remaining = penalties.join(F.broadcast(_ranges(requests)), (F.col("student_id") == F.col("_rsid"))
                                   & F.col("occurred_on").between(F.col("_lo"), F.col("_hi")), "left_anti")
    else:
        remaining = penalties.join(covered.select("student_id", "occurred_on"), ["student_id", "occurred_on"], "left_anti")
    return remaining.select(*penalties.columns), reset_counts(requests, covered)


# -- notes (C12) ----------------------------------------------------------------------

def upsert_notes(notes: DataFrame, requests: DataFrame, students: DataFrame, as_of: str, batch: str,
                 **kw) -> tuple[DataFrame, DataFrame]:
    """Insert, or overwrite ``noted_on`` and ``content`` - a note's
    ``student_id`` never changes on conflict.

    Sequentially, a new id is inserted by its first request whose student
    exists (earlier ones fail the foreign key and are rejected); later
    requests for it are updates whose ``student_id`` is ignored.
    Returns ``(new_notes, rejected_requests)``.
    """
    ok, bad = split_valid(validate_notes(requests, batch))
    # one bounded check on the batch decides every lookup: a small batch looks
    # up only the notes and students it names and merges by broadcast
    limit = kw.pop("max_broadcast_rows", DEFAULT_BROADCAST_ROWS)
    small = row_count_at_most(requests, limit)
    note_ids, students = notes.select("id"), students.select("id")
    if small:
        note_ids = note_ids.join(F.broadcast(ok.select(F.col("id").alias("_k")).distinct()),
                                 F.col("id") == F.col("_k"), "left_semi")
        students = students.join(F.broadcast(ok.select(F.col("student_id").alias("_k")).distinct()),
                                 F.col("id") == F.col("_k"), "left_semi")
    known = students.select(F.col("id").alias("_sid"), F.lit(True).alias("_sx"))
    r = (ok.join(note_ids.select(F.col("id").alias("_nid"), F.lit(True).alias("_nx")), F.col("id") == F.col("_nid"), "left")
         .join(known, F.col("student_id") == F.col("_sid"), "left"))
    # first request that can insert a new id
    first_ok = (r.where(F.col("_nx").isNull() & F.col("_sx").isNotNull())
                .groupBy(F.col("id").alias("_fid")).agg(F.min("seq").alias("_fseq")))
    r = r.join(first_ok, F.col("id") == F.col("_fid"), "left")
    accepted = r.where(F.col("_nx").isNotNull() | (F.col("seq") >= F.col("_fseq")))
    fk_rejected = (r.where(F.col("_nx").isNull() & (F.col("_fseq").isNull() | (F.col("seq") < F.col("_fseq"))))
                   .select(*ok.columns).withColumn("issues", F.array(F.lit("student_id:not_found"))))
    payload = F.struct("noted_on", "content")
    net = (accepted.groupBy("id").agg(
        F.max_by(payload, F.col("seq")).alias("_last"),
        F.min_by(F.col("student_id"), F.col("seq")).alias("student_id"))
        .select("id", "student_id", "_last.noted_on", "_last.content"))
    new = merge_upsert(notes, net, "id", ["noted_on", "content"], as_of, keep_cols=("student_id",),
                       max_broadcast_rows=limit if small else 0, **kw)
    return new, bad.unionByName(fk_rejected)


def edit_or_add(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Per changed key, whether it exists (``updated``) or not (``inserted``)."""
    k = changes.select(key).distinct()
    (base,) = restrict_to_keys([(base.select(key), key)], changes, key)  # small batch: its keys only
    b = base.select(F.col(key).alias("_bk"), F.lit(True).alias("_bx"))
    return (k.join(b, F.col(key) == F.col("_bk"), "left")
            .select(key, F.when(F.col("_bx").isNotNull(), F.lit("updated")).otherwise(F.lit("inserted")).alias("op")))


def is_empty(df: DataFrame) -> bool:
    """Whether ``df`` has no row (at most one is read)."""
    return df.isEmpty()


def seed_if_empty(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """A4: ``df`` plus ``defaults`` only when ``df`` has no row."""
    return df.unionByName(defaults.select(*df.columns)) if is_empty(df) else df
