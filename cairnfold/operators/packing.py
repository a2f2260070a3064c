"""Packing new chunks into bounded containers, in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfold.operators.arrow_groups import column, whole_groups
from cairnfold.session import shuffle_width

HEADER = 8
CAPACITY = 16 << 20


def fold(raw: Sequence[int], stored: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container number (from 0 in a session) and offset of each chunk. A container begins after its header; a
    new one is opened where the offset plus the chunk's raw length reaches the capacity, and the offset goes
    on by the stored length. So a chunk of nearly the capacity leaves an empty container before it."""
    number, offset = 0, HEADER
    numbers, offsets = [], []
    for r, s in zip(raw, stored, strict=True):
        if offset + r >= capacity:
            number, offset = number + 1, HEADER
        numbers.append(number)
        offsets.append(offset)
        offset += s
    return numbers, offsets


def pack_containers(chunks: DataFrame, session: Sequence[str], order: Sequence[str], capacity: int = CAPACITY, raw: str = "len", stored: str | None = None, rows: int = 1 << 18) -> DataFrame:
    """Adds ``container_no`` (in the session) and ``block_offset`` to new chunks. A session (an object, or a part)
    has containers of its own, so sessions are folded in parallel; chunks go by ``order``."""
    names = chunks.columns
    stored = stored or raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, list(session), rows):
            new = np.zeros(len(t), bool)
            for c in session:
                code = column(t, c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            heads = [0, *np.flatnonzero(new).tolist(), len(t)]
            r, s = column(t, raw).to_pylist(), column(t, stored).to_pylist()
            number, offset = [], []
            for a, b in zip(heads, heads[1:], strict=False):
                n, o = fold(r[a:b], s[a:b], capacity)
                number += n
                offset += o
            out = t.append_column("container_no", pa.array(number, pa.int64())).append_column("block_offset", pa.array(offset, pa.int64()))
            yield from out.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    dealt = chunks.select(*names).repartition(shuffle_width(chunks.sparkSession), *session).sortWithinPartitions(*session, *order)
    return dealt.mapInArrow(run, f"{schema}, container_no bigint, block_offset bigint")


def number_containers(packed: DataFrame, scope: Sequence[str], session: Sequence[str], base: int = 0, sessions_in_block: int = 1 << 20) -> DataFrame:
    """Adds ``dcid``: containers numbered without gaps through the sessions of each scope in their order, from
    ``base + 1``; a number that an empty container would have had stays unused.

    ``session`` ends with its numeric order. Sessions are counted, summed within blocks of their order and
    from block to block, so that no task sees all sessions of a scope.
    """
    own = list(dict.fromkeys([*scope, *session]))
    order = session[-1]
    used = packed.groupBy(*own).agg((F.max("container_no") + 1).alias("_n"))
    block = F.floor(F.col(order) / sessions_in_block)
    used = used.withColumn("_block", block)
    before = Window.partitionBy(*scope).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = used.groupBy(*scope, "_block").agg(F.sum("_n").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*scope, "_block").orderBy(*[c for c in session if c not in scope][-1:], *[c for c in session if c not in scope][:-1]).rowsBetween(Window.unboundedPreceding, -1)
    at = used.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(blocks, [*scope, "_block"])
    at = at.select(*own, (F.col("_base") + F.col("_in")).alias("_first"))
    return packed.join(at, own).withColumn("dcid", F.lit(base) + F.col("_first") + F.col("container_no") + 1).drop("_first")


def utilisation(packed: DataFrame, by: Sequence[str], capacity: int = CAPACITY, stored: str = "len") -> DataFrame:
    """For each container that holds a block: ``by, container_no, blocks, stored_len, fill`` (header included)."""
    out = packed.groupBy(*by, "container_no").agg(F.count(F.lit(1)).alias("blocks"), F.sum(stored).alias("stored_len"))
    return out.withColumn("fill", (F.col("stored_len") + HEADER) / F.lit(capacity))
