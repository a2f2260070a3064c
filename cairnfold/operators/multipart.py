"""Multipart uploads: parts, their check, and the object they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfold.functions.hashing import multipart_etag

MOST_PARTS = 10_000


def latest_parts(parts: DataFrame, by: str = "seq") -> DataFrame:
    """The last upload of each part."""
    cols = [c for c in parts.columns if c not in ("upload_id", "part_no")]
    last = F.max(F.struct(F.col(by).alias("_by"), *cols)).alias("_l")
    return parts.groupBy("upload_id", "part_no").agg(last).select("upload_id", "part_no", *[F.col(f"_l.{c}").alias(c) for c in cols])


def check_parts(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """The client's list ``upload_id, position, part_no, etag`` with ``error``: invalid_part (not stored, or another
    ETag), too_many_parts (of an upload), or null; and the part's ``size``."""
    own = stored.select("upload_id", "part_no", F.col("etag").alias("_etag"), "size")
    n = asked.groupBy("upload_id").agg(F.count(F.lit(1)).alias("_parts"))
    met = asked.join(own, ["upload_id", "part_no"], "left").join(n, "upload_id")
    quoted = F.regexp_replace("etag", '^"|"$', "")
    error = F.when(F.col("_parts") > MOST_PARTS, "too_many_parts").when(F.col("_etag").isNull() | ~F.col("_etag").eqNullSafe(quoted), "invalid_part")
    return met.select("upload_id", "position", "part_no", "size", error.alias("error"))


def upload_etag(parts: DataFrame) -> DataFrame:
    """``upload_id, etag, size, parts`` of parts ``upload_id, part_no, etag, size`` in their order."""
    return parts.groupBy("upload_id").agg(multipart_etag("part_no", "etag").alias("etag"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"))


def join_manifests(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries ``upload_id, part_no, ordinal, fp, len`` of the parts ``upload_id, position, part_no`` as one manifest in
    the client's order: ``upload_id, ordinal, chunk_offset, fp, len``.

    Numbers and offsets are summed from part to part and within a part, so that long parts do not meet in
    one window.
    """
    sums = entries.groupBy("upload_id", "part_no").agg(F.count(F.lit(1)).alias("_n"), F.sum("len").alias("_len"))
    before = Window.partitionBy("upload_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("upload_id", "position").orderBy("_i")
    starts = parts.select("upload_id", "position", "part_no").join(sums, ["upload_id", "part_no"])
    starts = starts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_b", F.coalesce(F.sum("_len").over(before), F.lit(0)))
    own = entries.select("upload_id", "part_no", F.col("ordinal").alias("_i"), "fp", "len")
    met = own.join(starts.drop("_n", "_len"), ["upload_id", "part_no"])
    head = F.coalesce(F.sum("len").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return met.select(
        "upload_id", (F.col("_o") + F.row_number().over(inside) - 1).cast("bigint").alias("ordinal"), (F.col("_b") + head).cast("bigint").alias("chunk_offset"), "fp", "len"
    )
