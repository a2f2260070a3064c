"""Joins and keys that stay balanced when one key holds a large part of the rows.

A *heavy* key is one with at least ``share`` of all rows, so there are at most ``1 / share`` of them:
the number collected and broadcast has that bound whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with this share of the rows is heavy; hence at most 500 keys are.
HEAVY_SHARE = 0.002


def key_hash(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def heavy_keys(counts: DataFrame, key: str, n: str, total: int, share: float = HEAVY_SHARE) -> list[int]:
    """Hashes of the heavy keys; ``counts`` may hold several partial counts of a key.

    ``key`` is a bigint hash. An action over pre-aggregated rows; returns at most ``1 / share`` values.
    """
    if total <= 0:
        return []
    least = max(2, int(total * share))
    rows = (
        counts.groupBy(key)
        .agg(F.sum(n).alias("_n"))
        .where(F.col("_n") >= least)
        .orderBy(F.col("_n").desc(), key)
        .limit(int(1 / share) + 1)
        .collect()
    )
    return [r[0] for r in rows if r[0] is not None]


def split_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    key: str,
    heavy: Sequence[int],
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` (skewed in ``on``) with ``lookup`` (few rows a key).

    Both sides carry the bigint hash ``key`` of the columns ``on``. Rows with a heavy key meet a
    broadcast of the lookup's rows with those keys, where they stand, without a shuffle; all others are
    shuffled. ``lookup`` must hold one row for a key (or as few as a constant), so what is broadcast
    stays below ``1 / share`` times that constant. ``how``: inner, left, left_semi or left_anti.
    A null in ``on`` matches nothing.
    """
    names = [key, *on]
    if not heavy:
        return rows.join(lookup, names, how)
    is_heavy = F.coalesce(F.col(key).isin([int(h) for h in heavy]), F.lit(False))
    a = rows.where(is_heavy).join(F.broadcast(lookup.where(is_heavy)), names, how)
    b = rows.where(~is_heavy).join(lookup.where(~is_heavy), names, how)
    return a.unionByName(b)


def salted_join(a: DataFrame, b: DataFrame, on: Sequence[str], key: str, heavy: Sequence[int], salts: int = 16) -> DataFrame:
    """Inner join of two sides that may both have many rows of a heavy key.

    Rows of ``a`` with a heavy key are dealt to ``salts`` parts by a hash of the whole row, those of ``b``
    are repeated for each part, so that a key's pairs are made by that many tasks. All other rows are joined as they
    are. ``key`` is the bigint hash of ``on``, and may be the only column of it.
    """
    names = list(dict.fromkeys([key, *on]))
    if not heavy:
        return a.join(b, names)
    is_heavy = F.coalesce(F.col(key).isin([int(h) for h in heavy]), F.lit(False))
    dealt = a.where(is_heavy).withColumn("_salt", F.pmod(F.xxhash64(*a.columns), F.lit(salts)).cast("int"))
    repeated = b.where(is_heavy).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.where(~is_heavy).join(b.where(~is_heavy), names).unionByName(dealt.join(repeated, [*names, "_salt"]).drop("_salt"))
