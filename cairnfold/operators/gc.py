"""The deletion queue and the sweep of containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["namespace", "dcid"]


def enqueue(queue: DataFrame, dereferenced: DataFrame) -> DataFrame:
    return queue.select(*KEY).unionByName(dereferenced.select(*KEY)).distinct()


def dequeue(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.select(*KEY).distinct().join(done.select(*KEY).distinct(), KEY, "left_anti")


def sample(queue: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most ``k`` queued containers, picked at random but the same for a seed; they stay in the queue."""
    own = queue.where("namespace is not null and dcid is not null").select(*KEY).distinct()
    return own.orderBy(F.xxhash64(*KEY, F.lit(seed)), *KEY).limit(k)


def victims(queue: DataFrame, refs: DataFrame) -> DataFrame:
    """Queued containers that nothing refers to any more, checked anew at the sweep."""
    own = queue.where("namespace is not null and dcid is not null").select(*KEY).distinct()
    return own.join(refs.select(*KEY).distinct(), KEY, "left_anti")


def remove_fingerprints(index: DataFrame, swept: DataFrame) -> DataFrame:
    """Index rows that do not point into a swept container: a fingerprint goes only where its container is the
    one expected."""
    return index.join(swept.select(*KEY).distinct(), KEY, "left_anti")


def sweep_report(queue: DataFrame, refs: DataFrame, containers: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each queued container: ``namespace, dcid, action, fingerprints``. ``kept`` is referred to again,
    ``missing`` is no longer registered and is just taken off the queue, ``swept`` is deleted; ``fingerprints`` is
    what goes from the index with it."""
    own = queue.where("namespace is not null and dcid is not null").select(*KEY).distinct()
    live = refs.select(*KEY).distinct().withColumn("_live", F.lit(1))
    there = containers.select(*KEY).distinct().withColumn("_there", F.lit(1))
    fps = index.where("fp is not null").select(*KEY, F.lower("fp").alias("fp")).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    out = own.join(live, KEY, "left").join(there, KEY, "left").join(fps, KEY, "left")
    action = F.when(F.col("_live") == 1, "kept").when(F.col("_there").isNull(), "missing").otherwise("swept")
    gone = F.when(F.col("_live") == 1, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint")
    return out.select(*KEY, action.alias("action"), gone.alias("fingerprints"))


def outcome(queue: DataFrame, refs: DataFrame, failing: DataFrame) -> DataFrame:
    """One row for each queued container: ``namespace, dcid, outcome``. ``kept`` is referred to again and leaves the
    queue, ``swept`` is deleted, and ``queued`` could not be (``failing``) and is tried again by the next sweep."""
    own = queue.where("namespace is not null and dcid is not null").select(*KEY).distinct()
    live = refs.select(*KEY).distinct().withColumn("_live", F.lit(1))
    fails = failing.select(*KEY).distinct().withColumn("_fails", F.lit(1))
    what = F.when(F.col("_live") == 1, "kept").when(F.col("_fails") == 1, "queued").otherwise("swept")
    return own.join(live, KEY, "left").join(fails, KEY, "left").select(*KEY, what.alias("outcome"))
