"""Mixing sources to target weights (problem 7): systematic sampling.

Within a source every document has the same expected number of copies. Summed up along the documents, ordered
by size, and moved by one random offset, it crosses an integer once for each copy to give out. So a document
gets the whole part of its expectation or one more, never above the cap, and the sizes chosen
follow the sizes there are. The sum is a rank times the expectation; ranks come from counts of buckets of
bounded number, so that no source has to pass through one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfold.session import cut

#: Documents that one bucket ranks at most, about.
GROUP = 1 << 18
#: Size classes for each doubling of the size.
CLASSES = 4
#: ``mix_targets`` may name so many sources; they pass through the driver.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Share:
    """What one source is to give."""

    source: str
    target: float
    cap: int
    available: int
    documents: int
    expected: float  # copies of each document


def normal(source: Column) -> Column:
    """Sources compare without regard to case and outer blanks."""
    return F.lower(F.trim(source))


def offset(source: str, seed: int) -> float:
    """The source's random offset in [0, 1), the same in every run with a seed."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{source}".encode()).digest()[:6], "big") / 2**48


def shares(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[Share]:
    """Shares of the sources with a positive target. ``total``: tokens to reach; by default the most at which
    every source that has documents can still give its share of the sum of such shares."""
    rows = (
        targets.select(normal(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("t"), F.col("max_repeats").cast("long").alias("r"))
        .where("source is not null and t > 0 and not isnan(t)").groupBy("source").agg(F.max("t").alias("t"), F.min("r").alias("r"))
        .orderBy("source").limit(MOST_SOURCES + 1).collect()
    )
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    asked = sizes.sparkSession.createDataFrame([(r["source"],) for r in rows], "source string")
    sums = sizes.join(F.broadcast(asked), "source").groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    there = {r["source"]: (r["n"], r["docs"]) for r in sums.collect()}
    whole = [(r["source"], r["t"], max(0, r["r"] if r["r"] is not None else 1), *there.get(r["source"], (0, 0))) for r in rows]
    usable = [x for x in whole if x[2] * x[3] > 0]
    reach = sum(x[1] for x in usable)
    if total is None:
        total = int(min((x[2] * x[3] / (x[1] / reach) for x in usable), default=0))
        part = {x[0]: x[1] / reach for x in usable}
    else:
        part = {x[0]: x[1] for x in usable}
    return [
        Share(s, t, r, n, docs, min(float(r), part[s] * total / n) if s in part else 0.0) for s, t, r, n, docs in whole
    ]


def mix(
    sizes: DataFrame, targets: DataFrame, item: str = "doc_id", total: int | None = None, seed: int = 0, group: int = GROUP
) -> tuple[DataFrame, list[Share]]:
    """The chosen documents, ``<item>, source, n_tokens, repeats``, and the shares.

    ``sizes``: ``<item>, source, n_tokens``; repeated rows of a document are one. Documents without tokens, or
    with a null source or one without a target, are not chosen. A null ``max_repeats`` is 1, one below 1 leaves its
    source out. Without usable sources the result is empty.
    """
    own = sizes.select(item, normal(F.col("source")).alias("source"), "n_tokens").where("n_tokens > 0 and source is not null")
    own = cut(own.distinct())
    plan = shares(own, targets, total)
    use = {s.source: s for s in plan if s.expected > 0}
    groups = max(1, -(-max((s.documents for s in use.values()), default=0) // group))
    rates = sizes.sparkSession.createDataFrame([(s.source, float(s.expected), offset(s.source, seed)) for s in use.values()], "source string, _each double, _offset double")
    wanted = own.join(F.broadcast(rates), "source")
    dealt = wanted.withColumn("_class", F.floor(F.log2("n_tokens") * CLASSES).cast("int")).withColumn(
        "_g", F.pmod(F.xxhash64(item), F.lit(groups)).cast("int")
    )
    bucket = ["source", "_class", "_g"]
    before = Window.partitionBy("source").orderBy("_class", "_g").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    ranked = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*bucket).orderBy("n_tokens", item))).join(start.drop("_c"), bucket)
    each, u = F.col("_each"), F.col("_offset")
    rank = F.col("_before") + F.col("_nth")
    # a cap that is a whole number of copies needs no rounding, which might cross one integer too many
    copies = F.when(each == F.floor(each), F.floor(each)).otherwise(F.floor(each * rank + u) - F.floor(each * (rank - 1) + u))
    chosen = ranked.withColumn("repeats", copies.cast("int")).where("repeats > 0").select(item, "source", "n_tokens", "repeats")
    return chosen, plan


def share_report(chosen: DataFrame, plan: list[Share], sizes: DataFrame | None = None) -> DataFrame:
    """For each source with a target: ``source, target_share, max_repeats, available_tokens, available_documents,
    expected_copies, documents, most_repeats, tokens, reached_share``; the last of all tokens chosen (0 if there
    are none). With ``sizes`` also each source that has documents but no target, which is null for it, as is the
    source for documents without one."""
    spark = chosen.sparkSession
    schema = "source string, target_share double, max_repeats bigint, available_tokens bigint, available_documents bigint, expected_copies double"
    asked = spark.createDataFrame([(s.source, s.target, s.cap, s.available, s.documents, s.expected) for s in plan], schema)
    if sizes is not None:
        own = sizes.select(*[c for c in sizes.columns if c != "source"], normal(F.col("source")).alias("source")).distinct()
        there = own.groupBy("source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("available_tokens"), F.count(F.lit(1)).alias("available_documents"))
        more = there.join(F.broadcast(asked.select("source")), "source", "left_anti")
        none = [F.lit(None).cast(k).alias(c) for c, k in (("target_share", "double"), ("max_repeats", "bigint"))]
        asked = asked.unionByName(more.select("source", *none, "available_tokens", "available_documents", F.lit(0.0).alias("expected_copies")))
    sums = chosen.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens")
    )
    out = asked.join(F.broadcast(sums), "source", "left").fillna(0, ["documents", "most_repeats", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy())
    return out.withColumn("reached_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
