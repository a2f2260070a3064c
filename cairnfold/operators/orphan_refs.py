"""References to records that do not exist (problem 1).

References are pre-aggregated per key and period in the mappers. The counts of the few heavy keys are held
against a broadcast of their targets, all others meet the referenced table in a shuffled join, and both are
united. What failed goes back to the rows in the same two ways, to name them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfold.operators.skew import HEAVY_SHARE, heavy_keys, key_hash, split_join
from cairnfold.session import cut


@dataclass(frozen=True)
class Reference:
    """A table whose rows refer to containers: the name that its results carry, its scope, reference,
    time and the text that identifies a row."""

    rows: DataFrame
    scope: str
    ref: str
    at: str
    row_key: Column


def _union(references: Mapping[str, Reference]) -> DataFrame:
    out = None
    for name, r in references.items():
        part = r.rows.where(F.col(r.ref).isNotNull()).select(
            F.lit(name).alias("tbl"),
            F.col(r.scope).cast("string").alias("_scope"),
            F.col(r.ref).cast("bigint").alias("_ref"),
            F.col(r.at).alias("_at"),
            r.row_key.alias("ref_key"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no references were given")
    return out.withColumn("_key", key_hash("_scope", "_ref")).withColumn("period", F.date_format("_at", "yyyy-MM"))


def referenced_state(
    targets: DataFrame, deleted: DataFrame, scope: str = "namespace", ref: str = "dcid", at: str = "sealed_at"
) -> DataFrame:
    """One row for each (scope, ref) that is registered or queued for deletion: when it was first
    registered and whether it is deleted."""
    there = targets.select(
        F.col(scope).cast("string").alias("_scope"), F.col(ref).cast("bigint").alias("_ref"),
        F.lit(1).alias("_there"), F.lit(0).alias("_deleted"), F.col(at).alias("_since"),
    )
    gone = deleted.select(
        F.col(scope).cast("string").alias("_scope"), F.col(ref).cast("bigint").alias("_ref"),
        F.lit(0).alias("_there"), F.lit(1).alias("_deleted"), F.lit(None).cast("timestamp").alias("_since"),
    )
    return (
        there.unionByName(gone)
        .where("_scope is not null and _ref is not null")
        .groupBy("_scope", "_ref")
        .agg(F.max("_there").alias("_there"), F.max("_deleted").alias("_deleted"), F.min("_since").alias("_since"))
        .withColumn("_key", key_hash("_scope", "_ref"))
    )


#: Bytes of suspect keys that are broadcast to the rows; beyond, rows are shuffled.
BROADCAST_BYTES = 16 << 20


def _verdict() -> Column:
    return (
        F.when(F.coalesce("_there", F.lit(0)) == 0, "missing")
        .when(F.col("_deleted") == 1, "deleted")
        .when(F.col("_since") > F.col("_at"), "later")
    )


def _judged(
    references: Mapping[str, Reference], targets: DataFrame, deleted: DataFrame, heavy_share: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The references; their counts per key and period; and those counts of which some reference fails, with the
    state of its target."""
    refs = _union(references)
    ref = ["_scope", "_ref"]
    counts = cut(refs.groupBy("tbl", "_key", *ref, "period").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_at")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    heavy = heavy_keys(counts, "_key", "_n", total, heavy_share)
    state = referenced_state(targets, deleted)
    # the earliest reference of a period fails if any does
    failed = split_join(counts, state, ref, "_key", heavy, "left").where(_verdict().isNotNull())
    return refs, counts, cut(failed.drop("_at"))


def orphan_references(
    references: Mapping[str, Reference],
    targets: DataFrame,
    deleted: DataFrame,
    heavy_share: float = HEAVY_SHARE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows ``tbl, ref_key, dcid, period, reason``, one for each distinct reference that does not resolve.

    ``reason`` is missing (not registered), deleted (queued for deletion, at whatever time), or later
    (registered after the reference was made); the first that holds. A null reference is none. A null
    scope resolves to nothing. A null time is never before a registration; its period is null.
    A repeated row counts once; with an empty target table every reference is missing.
    """
    refs, _, failed = _judged(references, targets, deleted, heavy_share)
    return _rows(refs, failed, heavy_share, broadcast_bytes)


def _rows(refs: DataFrame, failed: DataFrame, heavy_share: float, broadcast_bytes: int) -> DataFrame:
    """The references themselves: the keys and periods that failed are broadcast if their bytes allow it,
    else only those of heavy keys, while the rows of all others are shuffled."""
    on = ["tbl", "_scope", "_ref", "_month"]
    # a null scope or period must meet its own kind again
    again = {"_scope": F.coalesce("_scope", F.lit("")), "_month": F.coalesce("period", F.lit(""))}
    refs, known = refs.withColumns(again), failed.withColumns(again).drop("_n", "period")
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("tbl", "_scope", "period")), F.lit(96))
    if (failed.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes:
        joined = refs.join(F.broadcast(known), ["_key", *on])
    else:
        total = failed.agg(F.sum("_n")).first()[0]
        joined = split_join(refs, known, on, "_key", heavy_keys(failed, "_key", "_n", total, heavy_share))
    return (
        joined.withColumn("reason", _verdict())
        .where("reason is not null")
        .select("tbl", "ref_key", F.col("_ref").alias("dcid"), "period", "reason")
        .distinct()
    )


def orphan_report(
    references: Mapping[str, Reference],
    targets: DataFrame,
    deleted: DataFrame,
    heavy_share: float = HEAVY_SHARE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Counts ``tbl, period, refs, missing, deleted, later, orphans``: ``refs`` are references as
    delivered, repeated rows included, the others distinct references. Periods without a reference have
    no row; a null time makes a null period."""
    refs, counts, failed = _judged(references, targets, deleted, heavy_share)
    whole = counts.groupBy("tbl", "period").agg(F.sum("_n").alias("refs"))
    n = lambda what: F.count(F.when(F.col("reason") == what, 1)).alias(what)
    found = (
        _rows(refs, failed, heavy_share, broadcast_bytes)
        .groupBy("tbl", "period")
        .agg(n("missing"), n("deleted"), n("later"), F.count(F.lit(1)).alias("orphans"))
    )
    zero = [F.coalesce(found[c], F.lit(0)).alias(c) for c in ("missing", "deleted", "later", "orphans")]
    same = (whole["tbl"] == found["tbl"]) & whole["period"].eqNullSafe(found["period"])
    return whole.join(found, same, "left").select(whole["tbl"], whole["period"], "refs", *zero)
