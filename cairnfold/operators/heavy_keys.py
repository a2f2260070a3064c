"""Per-key results without imbalance (problem 5): dense accumulator arrays.

Rows are added up where they are read. Each input split encodes its keys in a dictionary and adds up rows,
bytes and groups in dense numpy arrays indexed by the code. Arrays go out in blocks of the key space; a
block's arrays are scattered into one common dictionary and summed, one after the other. A key that holds
half of the table arrives at its block as one array cell for each split.

What must be distinct, repeated rows and the groups of a key, is so within a split as long as the group lies in
one split only. A first pass over the groups alone finds those that do not; only their rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfold.operators.arrow_groups import column
from cairnfold.session import cut, shuffle_width

#: Rows that a split accumulates before its arrays go out: what bounds a worker's memory.
SPLIT_ROWS = 1 << 18
#: Rows, and so at most as many keys, for which one block is made.
BLOCK_ROWS = 1 << 20
#: Bytes of hashes of scattered groups that are broadcast to the rows; beyond, all rows are shuffled.
BROADCAST_BYTES = 64 << 20
_SUMS = ("deliveries", "records", "bytes", "groups")
_ARRAYS = "part int, block int, keys array<binary>, " + ", ".join(f"{s} array<bigint>" for s in _SUMS)


def _lists(arrays: list[pa.Array], cuts: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), a) for a in arrays]


def _blocks(keys: pa.Array, sums: np.ndarray, part: int, n_blocks: int) -> pa.RecordBatch:
    """Dense arrays ``sums[what, code]`` cut into blocks by a byte hash of the key."""
    block = _block_of(keys, n_blocks)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    own = _lists([keys.take(pa.array(order)), *[pa.array(s[order], pa.int64()) for s in sums]], np.r_[cuts, len(order)])
    names = ["part", "block", "keys", *_SUMS]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), part), pa.int32()), pa.array(block[order[cuts]], pa.int32()), *own], names=names)


def _block_of(keys: pa.Array, n_blocks: int) -> np.ndarray:
    """Block of each key from its last eight bytes, mixed; the same in every task."""
    padded = pc.binary_join_element_wise(pa.scalar(b"\0" * 8), keys.cast(pa.binary()), pa.scalar(b"")).cast(pa.large_binary())
    ends = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset + 1 : padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2] or b"", np.uint8)
    tail = data[ends[:, None] + np.arange(-8, 0)] if len(ends) else np.zeros((0, 8), np.uint8)
    x = np.ascontiguousarray(tail).view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(n_blocks)).astype(np.int64)


def _accumulate(n_blocks: int, n_parts: int, split_rows: int):
    """Mapper over rows sorted by ``_h, _deal``: arrays of each split, and under part -1 the hashes of the groups
    that it held to be whole."""

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        t = t.group_by(t.column_names, use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        group = column(t, "_group").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        deliveries = column(t, "count_all").to_numpy()
        size = column(t, "_bytes").fill_null(0).to_numpy(zero_copy_only=False)
        counted = column(t, "_kind").to_numpy() < 2
        for part in range(n_parts):
            enc = column(t, f"_k{part}").dictionary_encode()
            code = enc.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            ok, k = code >= 0, len(enc.dictionary)
            code, w = code[ok], size[ok].astype(np.int64)
            sums = np.zeros((4, k), np.int64)
            np.add.at(sums[0], code, deliveries[ok])
            sums[1] = np.bincount(code, minlength=k)
            np.add.at(sums[2], code, w)
            g, whole = group[ok], counted[ok] & (group[ok] >= 0)
            pairs = np.unique(code[whole] * (g.max(initial=0) + 1) + g[whole])
            sums[3] = np.bincount(pairs // (g.max(initial=0) + 1), minlength=k)
            yield _blocks(enc.dictionary.cast(pa.binary()), sums, part, n_blocks)
        here = np.unique(column(t, "_h").to_numpy()[column(t, "_kind").to_numpy() == 0])
        yield _blocks(pa.array([x.tobytes() for x in here], pa.binary()), np.zeros((4, len(here)), np.int64), -1, n_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        n, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            # the cut falls where hash or deal change, so that no group and no repeated row is counted twice
            h, deal = batch["_h"].to_numpy(), batch["_deal"].to_numpy()
            if n + len(batch) >= split_rows and kept:
                new = np.r_[(h[0], deal[0]) != last, (h[1:] != h[:-1]) | (deal[1:] != deal[:-1])]
                at = np.flatnonzero(new)
                if len(at):
                    yield from flush([*kept, batch.slice(0, int(at[0]))])
                    kept, n, batch = [], 0, batch.slice(int(at[0]))
            last = (h[-1], deal[-1])
            kept.append(batch)
            n += len(batch)
        if n:
            yield from flush(kept)

    return run


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of one block, added one batch after the other to those of one common dictionary."""
    part = key[0].as_py()
    keys, total = pa.array([], pa.binary()), np.zeros((4, 0), np.int64)
    for batch in batches:
        more = batch["keys"].flatten().cast(pa.binary())
        enc = pa.chunked_array([keys, more]).combine_chunks().dictionary_encode()
        code, old = enc.indices.to_numpy(), len(keys)
        sums = np.zeros((4, len(enc.dictionary)), np.int64)
        sums[:, :old] = total  # the dictionary goes on from the one before
        for i, what in enumerate(_SUMS):
            np.add.at(sums[i], code[old:], batch[what].flatten().to_numpy(zero_copy_only=False))
        keys, total = enc.dictionary, sums
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part), pa.int32()), keys, *[pa.array(s) for s in total]], names=["part", "key", *_SUMS])


def scattered_groups(df: DataFrame, group: str, split_rows: int) -> tuple[DataFrame, int, int]:
    """Hashes ``_h`` of the groups that lie in several input splits (``_kind`` 1) or, in all, have more than
    ``split_rows`` rows (2), how many these are, and the number of all rows."""
    own = df.groupBy(F.xxhash64(group).alias("_h"), F.spark_partition_id().alias("_split")).agg(F.count(F.lit(1)).alias("_n"))
    each = own.groupBy("_h").agg(F.count(F.lit(1)).alias("_splits"), F.sum("_n").alias("_n"))
    kind = F.when(F.col("_n") > split_rows, 2).when(F.col("_splits") > 1, 1).otherwise(0)
    each = cut(each.select("_h", kind.cast("int").alias("_kind"), "_n"))
    some, rows = each.agg(F.count(F.when(F.col("_kind") > 0, 1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    return each.where("_kind > 0").select("_h", "_kind"), some, rows


def key_loads(
    df: DataFrame,
    keys: Sequence[str],
    group: str,
    row_key: Sequence[str],
    size: str,
    split_rows: int = SPLIT_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Loads of every value of each of the columns ``keys``.

    Returns ``key_col, key_val, deliveries, records, bytes, groups``: rows as delivered; rows without
    repetition, where rows equal in ``row_key``, the keys, ``size`` and ``group`` are one; the sum of
    ``size`` over these; and the number of distinct values of ``group`` with the key. A null key has no
    row, a null size adds 0, a null group counts as no group. Keys are compared as text.

    Groups are told apart by a 64-bit hash only to decide which way their rows go; either way is exact. A
    group within one input split is added up there. The rows of the others are shuffled by group, or, of a
    group with more than ``split_rows`` rows and of null groups, by row, their pairs of key and group being made
    distinct by a shuffle. Should a second reading be split otherwise (as where executors were lost),
    a group held to be whole comes from two splits, which is seen, and all groups are shuffled.
    """
    cols = list(dict.fromkeys([group, *row_key, *keys, size]))
    own = df.select(*cols)
    scattered, some, rows = scattered_groups(own, group, split_rows)
    own = own.withColumn("_h", F.xxhash64(group))
    n_blocks = max(4 * shuffle_width(df.sparkSession), rows // BLOCK_ROWS)
    if some * 8 <= broadcast_bytes:
        marked = own.join(F.broadcast(scattered), "_h", "left")
        arrays = cut(_arrays(marked, cols, keys, group, size, n_blocks, split_rows))
        twice = arrays.where("part = -1").select(F.explode("keys").alias("k")).groupBy("k").count().where("count > 1")
        whole = twice.isEmpty()
    else:
        marked, whole = own.join(scattered, "_h", "left"), False
    if not whole:
        big = scattered.where("_kind = 2").withColumn("_kind", F.lit(2))
        marked = own.join(big, "_h", "left").withColumn("_kind", F.coalesce("_kind", F.lit(1)))
        arrays = _arrays(marked, cols, keys, group, size, n_blocks, split_rows)
    schema = "part int, key binary, " + ", ".join(f"{s} bigint" for s in _SUMS)
    loads = arrays.where("part >= 0").groupBy("part", "block").applyInArrow(_merge, schema)
    if not scattered.where("_kind = 2").isEmpty():
        pairs = None
        for i, k in enumerate(keys):
            p = marked.where(F.col("_kind") == 2).where(F.col(group).isNotNull() & F.col(k).isNotNull())
            p = p.select(F.lit(i).alias("part"), _encode(F.col(k).cast("string")).alias("key"), group).distinct()
            pairs = p if pairs is None else pairs.unionByName(p)
        zero = F.lit(0).cast("bigint")
        more = pairs.groupBy("part", "key").agg(F.count(F.lit(1)).alias("groups"))
        more = more.select("part", "key", *[zero.alias(s) for s in _SUMS[:3]], "groups")
        loads = loads.unionByName(more).groupBy("part", "key").agg(*[F.sum(s).alias(s) for s in _SUMS])
    name = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("part") + 1)
    return loads.select(name.alias("key_col"), _decode(F.col("key")).alias("key_val"), *_SUMS)


def _arrays(marked: DataFrame, cols: list[str], keys: Sequence[str], group: str, size: str, n_blocks: int, split_rows: int) -> DataFrame:
    """Arrays of the rows with ``_kind``: null or 0 where they stand, 1 and 2 after a shuffle."""
    width = shuffle_width(marked.sparkSession)
    kind = F.when(F.col(group).isNull(), 2).otherwise(F.coalesce("_kind", F.lit(0)))
    marked = marked.withColumn("_kind", kind.cast("int"))
    marked = marked.withColumn("_deal", F.when(F.col("_kind") == 2, F.xxhash64(*[F.col(c) for c in cols])).otherwise(F.lit(0)))
    rest = [c for c in cols if c not in keys and c != group and c != size]
    parts = [_encode(F.col(k).cast("string")).alias(f"_k{i}") for i, k in enumerate(keys)]
    more = [F.col(c).alias(f"_r{i}") for i, c in enumerate(rest)]
    own = marked.select("_h", "_deal", "_kind", F.col(group).cast("string").alias("_group"), F.col(size).cast("bigint").alias("_bytes"), *parts, *more)
    here = own.where("_kind = 0")
    dealt = own.where("_kind > 0").repartition(width, "_h", "_deal")
    run = _accumulate(n_blocks, len(keys), split_rows)
    each = [x.sortWithinPartitions("_h", "_deal").mapInArrow(run, _ARRAYS) for x in (here, dealt)]
    return each[0].unionByName(each[1])


def _encode(key):
    """A 64-digit hex text as its 32 bytes, any other text as 33 marks and its own bytes."""
    raw = F.when(F.length(key) == 64, F.try_to_binary(key, F.lit("hex")))
    same = F.lower(F.hex(raw)) == key
    return F.when(same, raw).otherwise(F.encode(F.concat(F.lit("~" * 33), key), "UTF-8"))


def _decode(key):
    return F.when(F.length(key) == 32, F.lower(F.hex(key))).otherwise(F.decode(F.substring(key, 34, 1 << 30), "UTF-8"))


def overloading(loads: DataFrame, total: int, share: float) -> DataFrame:
    """Keys with at least ``share`` of all ``total`` delivered rows."""
    return loads.where(F.col("deliveries") >= F.lit(share) * F.lit(total)).select("key_col", "key_val")
