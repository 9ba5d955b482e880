"""Splits that keep related records on one side.

Records are tied directly or through a shared key (a hub node), ties chain, and
a component is never divided.  A ``State`` is the stored component table with
the sides that its components hold; ``extended`` merges a batch of records and
ties into it (``components``), ``save`` and ``load`` keep it in a named folder.
A component keeps the side it has; a new one fills the side that lacks most; a
component that holds several sides, because its records were given on several or
because the batch merged components of different sides, is quarantined and
reported instead of being moved.

New components of at least ``1 / LARGE`` of all records number at most
``LARGE``; these are dealt out one by one, largest first.  All others go by a
second hash of their root, which has nothing to do with the root being the
smallest of its component, with the remaining deficits as probabilities, so the
sides are met up to about ``1 / sqrt(LARGE)`` and no list of components leaves
the cluster.

Defined results: null ids make no record and no tie; repeated rows and ties
count once; empty tables give an empty split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.ids import reference_id
from siltstone.llm.components import extend
from siltstone.operators.skew import salted_join
from siltstone.storage import cut

LARGE = 1000
SIDES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def node(kind: str, label) -> F.Column:
    return F.unhex(F.md5(F.concat(F.lit(kind + ":"), label)))


def legal_records(queries: DataFrame, docs: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records ``node, kind, record_id`` and ties ``a, b`` of judged questions and acts.

    A relevant judgement ties its query and document; equal ``question_norm``
    ties queries, equal trimmed lower-case ``legal_number`` ties documents, both
    through one hub node a value.  Hub nodes have no record.
    """
    judged, rest = legal_batches(queries, docs, qrels)
    return judged[0].union(rest[0]).distinct(), judged[1].union(rest[1]).distinct()


def legal_batches(queries: DataFrame, docs: DataFrame, qrels: DataFrame) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """The records and ties of questions and acts, and those that judgements add."""
    j = qrels.filter("relevance = 1").select(reference_id(qrels["query_id"]).alias("q"), reference_id(qrels["document_id"]).alias("d")).dropna()
    q = queries.select(F.col("query_id").cast("string").alias("q"), F.col("question_norm").alias("h")).filter("q is not null")
    number = F.lower(F.regexp_replace("legal_number", r"^[\s ]+|[\s ]+$", ""))
    d = docs.select(F.col("doc_id").cast("string").alias("d"), F.when(number != "", number).alias("h")).filter("d is not null")
    own = q.dropna().select(node("q", F.col("q")).alias("a"), node("n", F.col("h")).alias("b")).union(d.dropna().select(node("d", F.col("d")), node("a", F.col("h"))))
    judged = j.select(node("q", F.col("q")).alias("a"), node("d", F.col("d")).alias("b"))
    first = q.select(F.lit("query").alias("kind"), F.col("q").alias("record_id")).union(d.select(F.lit("document"), "d"))
    later = j.select(F.lit("query").alias("kind"), F.col("q").alias("record_id")).union(j.select(F.lit("document"), "d"))
    return (_named(first), own.distinct()), (_named(later), judged.distinct())


def _named(records: DataFrame) -> DataFrame:
    return records.distinct().select(F.when(F.col("kind") == "query", node("q", F.col("record_id"))).otherwise(node("d", F.col("record_id"))).alias("node"), "kind", "record_id")


def stored_sides(split: DataFrame) -> DataFrame:
    """``node, kind, record_id, side`` of a stored division; null elements do not count."""
    parts = [("train_qids", "query", "train"), ("val_qids", "query", "validation"), ("train_doc_ids", "document", "train"), ("val_doc_ids", "document", "validation")]
    out = None
    for column, kind, side in parts:
        one = split.select(F.lit(kind).alias("kind"), F.explode(column).alias("record_id"), F.lit(side).alias("side")).select("kind", reference_id(F.col("record_id")).alias("record_id"), "side")
        out = one if out is None else out.union(one)
    out = out.dropna().distinct()
    return _named(out.select("kind", "record_id")).join(out, ["kind", "record_id"]).select("node", "kind", "record_id", "side")


@dataclass(frozen=True)
class State:
    """``table(node, root)``, ``records(node, kind, record_id)``, ``held(root, n_records, held)`` and ``sides(root, n_records, side, quarantined)``."""

    table: DataFrame
    records: DataFrame
    held: DataFrame
    sides: DataFrame


def save(state: State, path: str) -> None:
    for name in State.__dataclass_fields__:
        getattr(state, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> State:
    return State(*[spark.read.parquet(f"{path}/{name}") for name in State.__dataclass_fields__])


def extended(state: State | None, records: DataFrame, ties: DataFrame, sides: DataFrame | None, proportions: dict[str, float] = SIDES, keep_assigned: bool = True) -> tuple[State, DataFrame]:
    """The state with a batch merged into it, and the batch's ``merges(old_root, root)``.

    ``records(node, kind, record_id)`` and given ``sides(node, kind, record_id,
    side)`` may repeat known ones.  With ``keep_assigned`` a component holds the
    side that an earlier batch gave it as well as those of its records.
    """
    new = records.select("node", "kind", "record_id")
    if sides is not None:
        new = new.union(sides.select("node", "kind", "record_id"))
    new = new.distinct()
    fresh = cut(new if state is None else new.join(state.records, "node", "left_anti"), "records")
    table, merges = extend(None if state is None else state.table, fresh.select("node"), ties)
    flag = {s: f"_{i}" for i, s in enumerate(proportions)}
    rooted = fresh.select("node").join(table, "node")
    parts = rooted.select("root", F.lit(1).alias("n_records"), *[F.lit(False).alias(f) for f in flag.values()])
    if sides is not None:
        given = sides.select("node", "side").distinct().join(table, "node")
        parts = parts.union(given.select("root", F.lit(0), *[F.col("side") == s for s in flag]))
    if state is not None:
        up = merges.select(F.col("old_root").alias("root"), F.col("root").alias("above"))
        old = state.held.join(up, "root", "left").join(state.sides.select("root", F.col("side").alias("assigned")), "root", "left")
        has = [F.array_contains("held", s) | (F.equal_null("assigned", F.lit(s)) if keep_assigned else F.lit(False)) for s in flag]
        parts = parts.union(old.select(F.coalesce("above", "root"), "n_records", *[F.coalesce(h, F.lit(False)) for h in has]))
    by = parts.groupBy("root").agg(F.sum("n_records").alias("n_records"), *[F.max(f).alias(f) for f in flag.values()])
    names = F.array_compact(F.array(*[F.when(F.col(f), F.lit(s)) for s, f in sorted(flag.items())]))
    held = cut(by.select("root", "n_records", F.when(F.size(names) > 0, names).alias("held")).filter("n_records > 0"), "held")
    every = fresh if state is None else cut(state.records.union(fresh), "records")
    return State(table, every, held, cut(assign(held, proportions), "sides")), merges


def assign(components: DataFrame, proportions: dict[str, float] = SIDES, large: int = LARGE) -> DataFrame:
    """``root, side, quarantined`` for ``root, n_records, held``.

    ``held`` with one side is kept, with several is a conflict (side null), and
    without any is filled by deficit.
    """
    n = F.size("held")
    totals = components.agg(
        F.sum("n_records").alias("all"), *[F.sum(F.when((n == 1) & (F.col("held")[0] == s), F.col("n_records"))).alias(s) for s in proportions]
    ).first()
    total = totals["all"] or 0
    lack = {s: p * total - (totals[s] or 0) for s, p in proportions.items()}
    new = F.col("held").isNull()
    big = components.filter(new & (F.col("n_records") * large >= total)).select("root", "n_records").orderBy(F.desc("n_records"), "root").collect()  # at most `large` rows
    dealt = []
    for r in big:
        side = max(lack, key=lambda s: (lack[s], s))
        lack[side] -= r["n_records"]
        dealt.append((r["root"], side))
    rest = sum(max(0.0, x) for x in lack.values()) or 1.0
    u = F.conv(F.substring(F.md5(F.concat(F.lit("fill:"), F.hex("root"))), 1, 12), 16, 10).cast("double") / float(16**12)
    pick, edge = None, 0.0
    for s in proportions:
        edge += max(0.0, lack[s]) / rest
        pick = F.when(u < edge, s) if pick is None else pick.when(u < edge, s)
    by_hash = pick.otherwise(max(proportions, key=lambda s: proportions[s]))
    hand = components.sparkSession.createDataFrame(dealt, "root binary, dealt string")
    out = components.join(F.broadcast(hand), "root", "left")  # at most `large` rows
    side = F.when(n > 1, None).when(n == 1, F.col("held")[0]).otherwise(F.coalesce("dealt", by_hash))
    return out.select("root", "n_records", side.alias("side"), (F.coalesce(n, F.lit(0)) > 1).alias("quarantined"))


def split(state: State) -> DataFrame:
    """``kind, record_id, component, side, quarantined`` of every record of a state."""
    rooted = state.records.join(state.table, "node")
    given = state.sides.select("root", "side", "quarantined")
    return salted_join(rooted, given, ["root"], ["node"], seen=state.table.select("root")).select("kind", "record_id", F.lower(F.hex("root")).alias("component"), "side", "quarantined")


def components(state: State) -> DataFrame:
    """``kind, record_id, group_name`` with the smallest ``kind:record_id`` of the component."""
    rooted = state.records.join(state.table, "node").select("kind", "record_id", "node", "root")
    name = rooted.groupBy("root").agg(F.min(F.concat_ws(":", "kind", "record_id")).alias("group_name"))
    return salted_join(rooted, name, ["root"], ["node"], seen=state.table.select("root")).select("kind", "record_id", "group_name")


def conflicts(state: State, queries: DataFrame) -> DataFrame:
    """``group_id, query_id`` of the known queries in components whose records are given on several sides."""
    bad = state.held.filter(F.size("held") > 1).select("root")
    nodes = salted_join(state.table, bad, ["root"], ["node"])
    known = queries.select(node("q", F.col("query_id").cast("string")).alias("node"), F.col("query_id").cast("string").alias("query_id")).dropna().distinct()
    rows = cut(nodes.join(known, "node").select("root", "query_id"), "conflicts")
    name = rows.groupBy("root").agg(F.min("query_id").alias("group_id"))
    return salted_join(rows, name, ["root"], ["query_id"]).select("group_id", "query_id")


def split_checks(state: State, given: DataFrame, proportions: dict[str, float] = SIDES) -> DataFrame:
    """One row: records, components on several sides, given records moved or left in no quarantine, and sides out of bounds.

    A side is out of bounds if the records of new components on it miss the
    share that its lack asks for by more than a twentieth of all records.
    """
    out = cut(split(state), "split")
    c = out.groupBy("component").agg(F.count_distinct("side").alias("n")).agg(F.count_if(F.col("n") > 1).alias("divided"))
    g = given.select("kind", "record_id", F.col("side").alias("given")).distinct()
    j = out.join(g, ["kind", "record_id"])
    kept = j.agg(F.count_if(~F.col("quarantined") & (F.col("side") != F.col("given"))).alias("moved"), F.count_if(F.col("quarantined") & F.col("side").isNotNull()).alias("quarantined_with_side"))
    n = F.coalesce("n_records", F.lit(0))
    both = state.held.select("root", "n_records", F.size("held").alias("k")).join(state.sides.select("root", "side"), "root")
    t = both.agg(
        F.sum(n).alias("n_records"), *[F.coalesce(F.sum(F.when((F.col("k") == 1) & (F.col("side") == s), n)), F.lit(0)).alias(f"old_{s}") for s in proportions],
        *[F.coalesce(F.sum(F.when(F.col("k").isNull() & (F.col("side") == s), n)), F.lit(0)).alias(f"new_{s}") for s in proportions],
    )
    lack = {s: F.greatest(F.lit(0.0), p * F.col("n_records") - F.col(f"old_{s}")) for s, p in proportions.items()}
    fresh, all_lack = sum(F.col(f"new_{s}") for s in proportions), sum(lack.values())
    off = [F.coalesce(F.abs(F.col(f"new_{s}") - fresh * F.try_divide(lack[s], all_lack)) > 0.05 * F.col("n_records"), F.lit(False)).cast("long") for s in proportions]
    return t.select(F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"), sum(off).alias("sides_out_of_bounds")).crossJoin(c).crossJoin(kept)  # single rows
