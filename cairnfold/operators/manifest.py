"""Manifests: the ordered chunks of an object."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def records(entries: DataFrame) -> DataFrame:
    """Entries without repeated rows."""
    return entries.distinct()


def scan(entries: DataFrame, manifest_id: str) -> DataFrame:
    """One manifest in order."""
    return entries.where(F.col("manifest_id") == manifest_id).orderBy("ordinal")


def with_offsets(entries: DataFrame) -> DataFrame:
    """``chunk_offset`` where it is null: the sum of the lengths before it; a null length counts as 0."""
    w = Window.partitionBy("manifest_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("chunk_offset", F.coalesce("chunk_offset", F.sum(F.coalesce("len", F.lit(0))).over(w), F.lit(0).cast("bigint")))


def containers_of(entries: DataFrame) -> DataFrame:
    """Distinct ``namespace, manifest_id, dcid``; reads these columns only."""
    return entries.where("dcid is not null").select("namespace", "manifest_id", "dcid").distinct()


def drop(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Entries of other manifests."""
    return entries.join(manifests.select("manifest_id").distinct(), "manifest_id", "left_anti")


def check(entries: DataFrame) -> DataFrame:
    """Manifests whose ordinals do not run from 0 without gaps, or whose offsets are not sums of lengths:
    ``manifest_id, entries, gaps, wrong_offsets``."""
    w = Window.partitionBy("manifest_id").orderBy("ordinal")
    before = F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = entries.select("manifest_id", "ordinal", "chunk_offset", "len").distinct()
    own = own.withColumn("_gap", F.row_number().over(w) - 1 != F.col("ordinal")).withColumn("_off", F.coalesce(F.col("chunk_offset") != before, F.lit(False)))
    n = lambda c: F.count(F.when(F.col(c), 1))
    out = own.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("entries"), n("_gap").alias("gaps"), n("_off").alias("wrong_offsets"))
    return out.where("gaps > 0 or wrong_offsets > 0")
