"""Which chunks are new: within an object, within an intake, and against an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfold.operators.skew import HEAVY_SHARE, heavy_keys, key_hash, split_join
from cairnfold.session import cut


def first_uses(chunks: DataFrame, scope: str = "namespace", obj: str = "obj_seq") -> DataFrame:
    """``scope, fp, first_obj, first_ordinal, uses``: where each fingerprint stands first, objects taken in their
    order. An aggregation that combines in the mappers, whatever the skew, in place of a window."""
    at = F.min(F.struct(F.col(obj).alias("o"), F.col("ordinal").alias("i")))
    own = chunks.where("fp is not null").groupBy(scope, "fp").agg(at.alias("_at"), F.count(F.lit(1)).alias("uses"))
    return own.select(scope, "fp", F.col("_at.o").alias("first_obj"), F.col("_at.i").alias("first_ordinal"), "uses")


def live_index(index: DataFrame, deleted: DataFrame, scope: str = "namespace") -> DataFrame:
    """Index rows whose container is not queued for deletion."""
    return index.join(deleted.select(scope, "dcid").distinct(), [scope, "dcid"], "left_anti")


def classify(chunks: DataFrame, index: DataFrame | None = None, scope: str = "namespace", obj: str = "obj_seq", heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Adds ``status`` to chunks, ``indexed`` (in the index), ``repeated`` (earlier in the same object),
    ``shared`` (in an earlier object) or ``new``, and ``dcid``, the index's container.

    Equals committing the objects one by one in the order of ``obj``. A null fingerprint is ``new``. The chunks'
    rows, which should not carry their bytes, are written once, so that objects are read and hashed once.
    """
    chunks = cut(chunks.drop("dcid"))
    known = first_uses(chunks, scope, obj).withColumn("_key", key_hash(scope, "fp"))
    if index is None:
        known = known.withColumn("dcid", F.lit(None).cast("bigint"))
    else:
        least = index.where("fp is not null and dcid is not null").groupBy(scope, "fp").agg(F.min("dcid").alias("dcid"))
        known = known.join(least, [scope, "fp"], "left")
    known = cut(known)
    total = known.agg(F.sum("uses")).first()[0] or 0
    heavy = heavy_keys(known, "_key", "uses", total, heavy_share)
    own = chunks.withColumn("_key", key_hash(scope, "fp"))
    met = split_join(own, known, [scope, "fp"], "_key", heavy, "left")
    first = (F.col("first_obj") == F.col(obj)) & (F.col("first_ordinal") == F.col("ordinal"))
    status = (
        F.when(F.col("dcid").isNotNull(), "indexed")
        .when(first | F.col("fp").isNull() | F.col("first_obj").isNull(), "new")
        .when(F.col("first_obj") == F.col(obj), "repeated")
        .otherwise("shared")
    )
    return met.withColumn("status", status).drop("_key", "first_obj", "first_ordinal", "uses")


def dedup_report(chunks: DataFrame, by: Sequence[str], scope: Sequence[str] = ("namespace",)) -> DataFrame:
    """``by, chunks, unique_chunks, total_bytes, unique_bytes, dedup_rate``: unique within ``scope``, and each unique
    chunk counted where it stands first. ``by`` columns must be functions of the object."""
    # the objects are read and hashed once for both sums
    chunks = cut(chunks.select(*dict.fromkeys([*by, *scope, "fp", "len", "obj_seq", "ordinal"])))
    at = F.min(F.struct("obj_seq", "ordinal", *[F.col(b).alias(f"_{b}") for b in by]))
    once = chunks.groupBy(*scope, "fp").agg(at.alias("_at"), F.max("len").alias("_len"))
    unique = once.select(*[F.col(f"_at._{b}").alias(b) for b in by], "_len").groupBy(*by).agg(F.count(F.lit(1)).alias("unique_chunks"), F.sum("_len").alias("unique_bytes"))
    whole = chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("total_bytes"))
    same = [whole[b].eqNullSafe(unique[b]) for b in by]
    zero = lambda c: F.coalesce(unique[c], F.lit(0)).alias(c)
    out = whole.join(unique, same, "left").select(*[whole[b] for b in by], "chunks", zero("unique_chunks"), "total_bytes", zero("unique_bytes"))
    rate = F.when(F.col("total_bytes") > 0, (F.col("total_bytes") - F.col("unique_bytes")) / F.col("total_bytes")).otherwise(0.0)
    return out.withColumn("dedup_rate", rate)


def object_stats(objects: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every object, also one without chunks: ``keys, size, chunks, written_bytes, dedup_rate``. ``chunks`` have a
    ``status`` from ``classify``; a rate over 0 bytes is 0."""
    sums = chunks.groupBy(*keys).agg(
        F.sum("len").alias("_size"), F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("status") == "new", F.col("len")).otherwise(0)).alias("_new")
    )
    out = objects.select(*keys).join(sums, list(keys), "left")
    size, new = F.coalesce("_size", F.lit(0)), F.coalesce("_new", F.lit(0))
    rate = F.when(size > 0, (size - new) / size).otherwise(0.0)
    return out.select(*keys, size.alias("size"), F.coalesce("_n", F.lit(0)).alias("chunks"), new.alias("written_bytes"), rate.alias("dedup_rate"))


def upsert_index(index: DataFrame, new: DataFrame, scope: str = "namespace") -> DataFrame:
    """``scope, fp, dcid`` after new rows ``scope, fp, dcid, seq`` were written in the order of ``seq``: the last one
    wins, also over the index. Combines in the mappers."""
    old = index.select(scope, "fp", "dcid", F.lit(None).cast("bigint").alias("seq"))
    both = old.unionByName(new.select(scope, "fp", "dcid", F.col("seq").cast("bigint").alias("seq")))
    last = F.max(F.struct(F.coalesce("seq", F.lit(-(2**62))).alias("s"), F.col("dcid").alias("d")))
    return both.groupBy(scope, "fp").agg(last.alias("_l")).select(scope, "fp", F.col("_l.d").alias("dcid"))


def without_equal_etag(incoming: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that are not there yet with the same bucket, name and ETag; the others need no write."""
    there = objects.where("etag is not null").select("bucket", "name", "etag").distinct()
    return incoming.join(there, ["bucket", "name", "etag"], "left_anti")


def compress_rate(written: Column | str, stored: Column | str) -> Column:
    """Share of the unique bytes that compression saved; 0 where there are none."""
    w, n = (F.col(c) if isinstance(c, str) else c for c in (written, stored))
    return F.when(w > 0, (w - n) / w).otherwise(0.0)
