"""Which objects refer to which containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def references(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """``namespace, dcid, bucket, object``: one row for a container and each object with a chunk in it."""
    own = entries.where("dcid is not null").select("manifest_id", "dcid").distinct()
    named = objects.where("manifest_id is not null").select("namespace", "manifest_id", "bucket", F.col("name").alias("object")).distinct()
    return own.join(named, "manifest_id").select("namespace", "dcid", "bucket", "object").distinct()


def add(refs: DataFrame, new: DataFrame) -> DataFrame:
    """Union as a set."""
    return refs.unionByName(new.select(*refs.columns)).distinct()


def remove(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References without those of ``objects`` (``bucket, object``)."""
    return refs.join(objects.select("bucket", "object").distinct(), ["bucket", "object"], "left_anti")


def dereferenced(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """``namespace, dcid`` that lose their last reference with ``objects``: one pass of counts for each container."""
    gone = objects.select("bucket", "object").distinct().withColumn("_gone", F.lit(1))
    marked = refs.join(gone, ["bucket", "object"], "left")
    left = F.count(F.when(F.col("_gone").isNull(), 1))
    return marked.groupBy("namespace", "dcid").agg(left.alias("_left")).where("_left = 0").select("namespace", "dcid")


def counts(refs: DataFrame) -> DataFrame:
    """``namespace, dcid, objects, buckets``."""
    own = refs.groupBy("namespace", "dcid", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("namespace", "dcid").agg(F.sum("n").alias("objects"), F.count(F.lit(1)).alias("buckets"))
