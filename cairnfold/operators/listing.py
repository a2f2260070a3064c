"""Listings: buckets, namespaces, objects by prefix, pages and common prefixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfold.functions.naming import namespace_of


def namespaces(buckets: DataFrame) -> DataFrame:
    return buckets.select(namespace_of("name").alias("namespace")).where("namespace is not null").distinct()


def with_prefix(objects: DataFrame, bucket: str, prefix: str = "") -> DataFrame:
    """Both conditions reach the scan."""
    own = objects.where(F.col("bucket") == bucket)
    return own.where(F.col("name").startswith(prefix)) if prefix else own


def entries(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str = "", after: str = "") -> DataFrame:
    """Distinct ``entry, is_prefix``: names with the prefix after a marker; those with the delimiter beyond the
    prefix stand as the part up to it, once."""
    own = with_prefix(objects, bucket, prefix)
    own = own.where(F.col("name") > after) if after else own
    rest = F.substring("name", len(prefix) + 1, 1 << 30)
    at = F.instr(rest, delimiter) if delimiter else F.lit(0)
    entry = F.when(at > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), at + len(delimiter) - 1))).otherwise(F.col("name"))
    out = own.select(entry.alias("entry"), (at > 0).alias("is_prefix")).distinct()
    return out.where(~F.col("is_prefix") | (F.col("entry") > after) | ~F.lit(after).startswith(F.col("entry"))) if after and delimiter else out


@dataclass(frozen=True)
class Page:
    """One page: names of objects, common prefixes, whether there is more, and the marker for the next."""

    names: list[str]
    prefixes: list[str]
    truncated: bool
    next_token: str | None


def page(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str = "", token: str = "", start_after: str = "", max_keys: int = 1000) -> Page:
    """A page in the order of names, of at most ``max_keys`` objects and prefixes; ``token`` is the last entry of the
    page before, and no entry is lost or repeated between pages. The sort keeps ``max_keys + 1`` rows."""
    after = token or start_after
    rows = entries(objects, bucket, prefix, delimiter, after).orderBy("entry").limit(max_keys + 1).collect()
    own = rows[:max_keys]
    more = len(rows) > max_keys
    last = own[-1]["entry"] if own else None
    return Page([r["entry"] for r in own if not r["is_prefix"]], [r["entry"] for r in own if r["is_prefix"]], more, last if more else None)


def head(objects: DataFrame, bucket: str, name: str) -> DataFrame:
    return objects.where((F.col("bucket") == bucket) & (F.col("name") == name))


def bucket_counts(buckets: DataFrame, objects: DataFrame) -> DataFrame:
    """``name, objects, removable``: a bucket can be removed when it is empty."""
    n = objects.select("bucket", "name").distinct().groupBy(F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    out = buckets.select("name").distinct().join(n, F.col("name") == F.col("_b"), "left")
    return out.select("name", F.coalesce("_n", F.lit(0)).alias("objects"), (F.coalesce("_n", F.lit(0)) == 0).alias("removable"))
