"""References to records that are missing, late or withdrawn.

Changes arrive as signed deltas of two kinds.  A row that refers to a key counts
+1 on its day; a delivery of a target record counts +1 at the moment it is
loaded and -1 at the moment it is withdrawn.  Taking rows or deliveries back
gives the same deltas with the other sign.  The state holds the sums of one
(target, key, moment), rows of zero sums vanish, and sums are associative: a new
batch merges into a stored state without reading old rows, partial aggregation
runs before every shuffle, and a key that a third of all rows refer to costs one
row a day and map task.

A key with positive references and no positive existence is an orphan.  A record
withdrawn and loaded again exists again.  For rows that must be judged at their
own time, the running sum of a key's existence gives the stretches of time in
which it exists; keys that can be broken at all are joined back to their rows,
and a row in no stretch is broken.

Defined results: null, blank, ``nan``, ``none`` and ``null`` ids are no
reference; a row without load time is only ever ``missing``; a target without
load time was there from the start; equal deliveries of one batch count once, and
so do repeated equal rows of a report; empty tables give an empty state.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.ids import reference_id
from siltstone.operators.skew import salted, salted_join

STATE = ("target", "key", "at", "refs", "existence")
EVER = "timestamp_ntz'0001-01-01 00:00:00'"


@dataclass(frozen=True)
class Reference:
    """A column of ``rows`` that names keys of the table called ``target``."""

    table: str
    column: str
    row_key: str
    target: str
    rows: DataFrame
    time: str = "loaded_at"


@dataclass(frozen=True)
class Target:
    name: str
    key: str
    rows: DataFrame
    loaded: str = "loaded_at"
    deleted: str = "deleted_at"


def _rows(ref: Reference) -> DataFrame:
    r = ref.rows
    return r.select(
        F.lit(ref.table).alias("table_name"), F.lit(ref.column).alias("column_name"), F.lit(ref.target).alias("target"),
        reference_id(r[ref.row_key]).alias("row_key"), reference_id(r[ref.column]).alias("key"), r[ref.time].alias("at"),
    ).filter("key is not null")


def reference_rows(refs: list[Reference]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_rows(r) for r in refs])


def reference_deltas(refs: list[Reference], sign: int = 1) -> DataFrame:
    """Deltas of referring rows by day; ``sign=-1`` takes a batch of rows back."""
    day = F.date_trunc("day", F.col("at").cast("timestamp_ntz")).cast("timestamp_ntz")
    return reference_rows(refs).select("target", "key", day.alias("at"), F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("existence"))


def existence_deltas(targets: list[Target], sign: int = 1) -> DataFrame:
    """Deltas of target deliveries: +1 when loaded, -1 when withdrawn; ``sign=-1`` takes a batch of deliveries back."""
    out = []
    for t in targets:
        one = t.rows.select(t.rows[t.key].cast("string").alias("key"), t.rows[t.loaded].cast("timestamp_ntz").alias("l"), t.rows[t.deleted].cast("timestamp_ntz").alias("d"))
        one = one.filter("key is not null").distinct()
        moments = F.array(F.struct(F.coalesce("l", F.expr(EVER)).alias("at"), F.lit(sign).cast("long").alias("n")), F.struct(F.col("d").alias("at"), F.lit(-sign).cast("long").alias("n")))
        one = one.select("key", F.explode(moments).alias("e")).filter("e.at is not null")
        out.append(one.select(F.lit(t.name).alias("target"), "key", F.col("e.at").alias("at"), F.lit(0).cast("long").alias("refs"), F.col("e.n").alias("existence")))
    return reduce(DataFrame.unionByName, out)


def merge_state(*parts: DataFrame) -> DataFrame:
    """Merge stored states and new deltas into one state."""
    both = reduce(DataFrame.unionByName, [p.select(*STATE) for p in parts])
    return both.groupBy("target", "key", "at").agg(F.sum("refs").alias("refs"), F.sum("existence").alias("existence")).filter("refs != 0 or existence != 0")


def current(state: DataFrame) -> DataFrame:
    """One row a key: sums of references and existence, first load, span of the days of references, first withdrawal."""
    return state.groupBy("target", "key").agg(
        F.sum("refs").alias("refs"), F.sum("existence").alias("existence"),
        F.min(F.when(F.col("existence") > 0, F.col("at"))).alias("first_seen"), F.min(F.when(F.col("existence") < 0, F.col("at"))).alias("first_gone"),
        F.min(F.when(F.col("refs") > 0, F.col("at"))).alias("first_ref"), F.max(F.when(F.col("refs") > 0, F.col("at"))).alias("last_ref"),
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys that are referred to now and do not exist now."""
    return current(state).filter("refs > 0 and existence <= 0").select("target", "key", "refs", F.when(F.col("first_seen").isNull(), "missing").otherwise("deleted").alias("kind"))


def existing(events: DataFrame) -> DataFrame:
    """``target, key, since, until``: the stretches in which the running sum of existence is positive; the last may be open."""
    w = Window.partitionBy("target", "key").orderBy("at")
    run = events.filter("existence != 0").select("target", "key", "at", F.sum("existence").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    flips = run.withColumn("was", F.coalesce(F.lag("n").over(w), F.lit(0))).filter("(n > 0) != (was > 0)")
    return flips.select("target", "key", F.col("at").alias("since"), F.lead("at").over(w).alias("until"), "n").filter("n > 0").drop("n")


def broken_references(refs: list[Reference], targets: list[Target], state: DataFrame | None = None) -> DataFrame:
    """One row for each referring row whose target did not exist at the row's own time.

    Columns ``table_name, column_name, row_key, load_month, kind`` with kind
    ``missing``, ``late`` (the target came after the row) or ``deleted`` (the
    target was withdrawn by then), the first that applies.  ``state`` is the
    stored state of the same references and targets, if there is one.
    """
    events = merge_state(existence_deltas(targets)) if state is None else state.filter("existence != 0")
    state = merge_state(reference_deltas(refs), events) if state is None else state
    possible = "refs > 0 and (first_seen is null or first_seen > first_ref or first_gone < last_ref + interval 1 day)"
    suspects = current(state).filter(possible).select("target", "key", "first_seen")
    found = salted_join(reference_rows(refs), suspects, ["target", "key"], ["row_key", "at"]).withColumn("at", F.col("at").cast("timestamp_ntz"))
    # What was never there needs no stretches; the others are judged by the time of the row.
    never = found.filter("first_seen is null")
    was = found.filter("first_seen is not null and at is not null")
    spans = existing(events.join(suspects.select("target", "key"), ["target", "key"], "left_semi"))
    left, right, on = salted(was, spans, ["target", "key"], ["row_key", "at"])
    right = right.select(*[F.col(c).alias(f"_{c}") for c in on], "since", "until")
    inside = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    gone = left.join(right, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in on], inside), "left_anti").select(*was.columns)
    kind = F.when(F.col("first_seen").isNull(), "missing").when(F.col("first_seen") > F.col("at"), "late").otherwise("deleted")
    return never.unionByName(gone).select("table_name", "column_name", "row_key", F.date_format("at", "yyyy-MM").alias("load_month"), kind.alias("kind")).distinct()


def orphan_report(broken: DataFrame) -> DataFrame:
    """Counts of broken references by table, column, month and kind."""
    return broken.groupBy("table_name", "column_name", "load_month", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
