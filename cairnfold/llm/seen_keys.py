"""Has this key been seen before? (problem 2): Golomb-coded sets.

Keys are dealt to shards by hash. A shard's hashes are reduced to a range of ``keys * 2**bits``, sorted, and
the gaps between them stored with a Golomb code in blocks of ``BLOCK`` values: about ``bits + 1.6`` bits a
key. A question decodes only the block that could hold its value. A key that was there is always
found; one that was not is taken for one with probability ``keys / range``.

Coded sets are stored, and added to batch by batch (``SeenKeys``); answering needs nothing else of history.
Answers of "yes" can then be verified with the keys themselves: the hashes of those keys, coded in the same way,
pick the rows of history where these stand, and only rows picked are shuffled. Rows that repeat a key within one
batch are decided by their order, exactly; ``audit`` counts them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnfold.operators.arrow_groups import binaries, column, ranges
from cairnfold.operators.skew import HEAVY_SHARE, heavy_keys, split_join
from cairnfold.session import checkpoint_dir, cut

#: One wrong yes in 2**BITS new keys.
BITS = 10
#: Values in a block.
BLOCK = 128
#: Keys that a shard is made for, which bounds a worker's memory.
SHARD_KEYS = 1 << 20
#: Bytes of coded hashes that go to the mappers of history, to pick the rows that a yes is verified with.
FILTER_BYTES = 32 << 20


def reduce_hash(h: np.ndarray, scope: int) -> np.ndarray:
    """64-bit hashes evenly onto ``0 .. scope - 1``; ``scope`` at most 2**32."""
    return (((h.view(np.uint64) >> np.uint64(32)) * np.uint64(scope)) >> np.uint64(32)).astype(np.int64)


@dataclass
class CodedSet:
    """Blocks of a Golomb-coded set; block ``i`` holds ``count[i]`` values from ``first[i]`` on and its code
    is ``data[start[i] : start[i + 1]]``: ``unary[i]`` bytes of quotients, then the remainders."""

    scope: int
    shift: int
    first: np.ndarray
    count: np.ndarray
    unary: np.ndarray
    start: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return int(self.count.sum())

    @property
    def rate(self) -> float:
        """Theoretical probability of a wrong yes."""
        return len(self) / self.scope if self.scope else 0.0

    @staticmethod
    def of(values: np.ndarray, scope: int, block: int = BLOCK) -> CodedSet:
        """``values``: sorted and distinct, in ``0 .. scope - 1``."""
        n = len(values)
        # the best power of two for geometric gaps of this mean
        shift = max(0, int(np.floor(np.log2(max(1.0, scope / max(n, 1) * np.log(2))))))
        head = np.arange(0, n, block)
        count = np.diff(np.r_[head, n]).astype(np.int64)
        owner = np.repeat(np.arange(len(head)), count)
        gap = np.diff(values, prepend=0)
        inner = np.ones(n, bool)
        inner[head] = False
        gap, own = gap[inner], owner[inner]
        q, rem = gap >> shift, gap & ((1 << shift) - 1)
        bits = np.cumsum(q + 1)
        per = np.bincount(own, weights=q + 1, minlength=len(head)).astype(np.int64)
        unary = (per + 7) // 8
        rest = ((count - 1) * shift + 7) // 8
        start = np.r_[0, np.cumsum(unary + rest)].astype(np.int64)
        stream = np.zeros(int(start[-1]) * 8, np.uint8)
        stream[start[own] * 8 + bits - (np.cumsum(per) - per)[own] - 1] = 1
        if shift:
            nth = np.arange(len(own)) - (np.cumsum(count - 1) - (count - 1))[own]
            at = (start[own] + unary[own]) * 8 + nth * shift
            for j in range(shift):
                stream[at + j] = (rem >> (shift - 1 - j)) & 1
        return CodedSet(scope, shift, values[head], count, unary, start, np.packbits(stream))

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the blocks and the position in ``blocks`` of each."""
        count = self.count[blocks]
        owner = np.repeat(np.arange(len(blocks)), count)
        gap = np.zeros(len(owner), np.int64)
        head = np.cumsum(count) - count
        gap[head] = self.first[blocks]
        inner = np.ones(len(owner), bool)
        inner[head] = False
        unary = self.unary[blocks]
        ones = np.flatnonzero(np.unpackbits(self.data[ranges(self.start[blocks], unary)]))
        own = owner[inner]
        base = ((np.cumsum(unary) - unary) * 8)[own]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        before = np.where(new, base - 1, np.r_[-1, ones[:-1]] if len(ones) else ones)
        value = (ones - before - 1) << self.shift
        if self.shift:
            rest = self.start[blocks + 1] - self.start[blocks] - unary
            stream = np.unpackbits(self.data[ranges(self.start[blocks] + unary, rest)])
            inside = count - 1
            nth = np.arange(len(own)) - (np.cumsum(inside) - inside)[own]
            at = ((np.cumsum(rest) - rest) * 8)[own] + nth * self.shift
            for j in range(self.shift):
                value |= stream[at + j].astype(np.int64) << (self.shift - 1 - j)
        gap[inner] = value
        total = np.cumsum(gap)
        return total - (total - gap)[np.repeat(head, count)], owner

    def values(self) -> np.ndarray:
        return self.decode(np.arange(len(self.first)))[0] if len(self.first) else np.zeros(0, np.int64)

    def has(self, values: np.ndarray) -> np.ndarray:
        """Whether each value is in the set; decodes only the blocks that are asked for."""
        if not len(self.first) or not len(values):
            return np.zeros(len(values), bool)
        at = np.searchsorted(self.first, values, "right") - 1
        blocks, place = np.unique(np.maximum(at, 0), return_inverse=True)
        held, owner = self.decode(blocks)
        key = np.sort(held + owner * self.scope)
        asked = values + place * self.scope
        i = np.searchsorted(key, asked)
        return (at >= 0) & (i < len(key)) & (key[np.minimum(i, len(key) - 1)] == asked)


_BLOCKS = "shard int, scope bigint, shift int, first bigint, count int, unary int, code binary"


def _rows(s: CodedSet, shard: int) -> pa.Table:
    k = len(s.first)
    return pa.table(
        [
            pa.array(np.full(k, shard, np.int32)), pa.array(np.full(k, s.scope)),
            pa.array(np.full(k, s.shift, np.int32)), pa.array(s.first), pa.array(s.count.astype(np.int32)),
            pa.array(s.unary.astype(np.int32)), binaries(s.data, np.diff(s.start)),
        ],
        names=["shard", "scope", "shift", "first", "count", "unary", "code"],
    )


def _build(scope: int):
    def run(table: pa.Table) -> pa.Table:
        values = np.unique(reduce_hash(column(table, "h").to_numpy(), scope))
        return _rows(CodedSet.of(values, scope), table["shard"][0].as_py())

    return run


def _read(table: pa.Table) -> CodedSet:
    if not len(table):
        return CodedSet.of(np.zeros(0, np.int64), 1)
    order = np.argsort(column(table, "first").to_numpy())
    table = table.take(pa.array(order)).combine_chunks()
    code = column(table, "code").to_pylist()
    return CodedSet(
        table["scope"][0].as_py(), table["shift"][0].as_py(), column(table, "first").to_numpy(),
        column(table, "count").to_numpy().astype(np.int64), column(table, "unary").to_numpy().astype(np.int64),
        np.r_[0, np.cumsum([len(c) for c in code])].astype(np.int64), np.frombuffer(b"".join(code), np.uint8),
    )


def _levels(table: pa.Table) -> list[CodedSet]:
    """The coded sets of a shard, one for each generation."""
    generation = column(table, "generation").to_numpy()
    return [_read(table.filter(pa.array(generation == g))) for g in np.unique(generation)]


def _union(table: pa.Table) -> pa.Table:
    """Sets of one range merge exactly: the values of all generations of a shard, coded anew."""
    values = np.unique(np.concatenate([x.values() for x in _levels(table)]))
    return _rows(CodedSet.of(values, table["scope"][0].as_py()), table["shard"][0].as_py())


def coded_set(hashes: DataFrame, shards: int, scope: int) -> DataFrame:
    """The stored form of a set of keys: rows of ``shard, scope, shift, first, count, unary, code``, one for each
    block. ``hashes``: bigint ``h`` in any number of repetitions, which the mappers reduce."""
    own = hashes.where("h is not null").distinct().withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return own.groupBy("shard").applyInArrow(_build(scope), _BLOCKS)


class SeenKeys:
    """The keys seen so far as coded sets in a folder: a generation of blocks for each ``append``, merged with the one
    before as soon as that is not twice as large, so that there are few. History is never read again.

    ``keys`` is how many the range is made for: with so many, one new key in ``2**bits`` is taken for an old one, with
    fewer or more so many less or more. A range cannot be changed afterwards, as the hashes are gone; a store
    opened again takes it from the folder. A generation counts from when its folder is complete.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: int = SHARD_KEYS, bits: int = BITS, shard_keys: int = SHARD_KEYS):
        self.spark, self.folder = spark, folder
        if self._exists("range"):
            self.shards, self.scope = spark.read.parquet(os.path.join(folder, "range")).first()
            return
        self.shards = max(1, -(-keys // shard_keys))
        self.scope = max(1, -(-keys // self.shards)) << bits
        if self.scope > 1 << 32:
            raise ValueError("a shard's range must not exceed 2**32")
        spark.createDataFrame([(self.shards, self.scope)], "shards int, scope bigint").coalesce(1).write.parquet(os.path.join(folder, "range"))

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._fs(os.path.join(name, "_SUCCESS"))
        return fs.exists(path)

    def generations(self) -> list[tuple[int, int]]:
        """First and last ``append`` of each generation in use: of overlapping ones the widest."""
        fs, path = self._fs("sets")
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        spans = sorted((int(a), -int(b)) for a, b in (x.split("-") for x in names) if self._exists(f"sets/{a}-{b}"))
        out: list[tuple[int, int]] = []
        for a, b in spans:
            if not out or a > out[-1][1]:
                out.append((a, -b))
        return out

    def _at(self, span: tuple[int, int]) -> DataFrame:
        path = os.path.join(self.folder, "sets", f"{span[0]}-{span[1]}")
        return self.spark.read.schema(_BLOCKS).parquet(path).withColumn("generation", F.lit(span[0]))

    def blocks(self) -> DataFrame:
        """Blocks of all generations, with ``generation``."""
        own = [self._at(g) for g in self.generations()]
        if not own:
            return self.spark.createDataFrame([], _BLOCKS + ", generation int")
        return reduce(DataFrame.unionByName, own)

    def shard(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.shards)).cast("int")

    def append(self, hashes: DataFrame) -> None:
        """Adds keys by their bigint hashes ``h``."""
        spans = self.generations()
        nth = spans[-1][1] + 1 if spans else 0
        span = (nth, nth)
        coded_set(hashes, self.shards, self.scope).write.mode("overwrite").parquet(os.path.join(self.folder, "sets", f"{nth}-{nth}"))
        size = lambda g: self._at(g).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        while spans and size(spans[-1]) <= 2 * size(span):
            both = self._at(spans[-1]).unionByName(self._at(span))
            span = (spans.pop()[0], nth)
            both.groupBy("shard").applyInArrow(_union, _BLOCKS).write.mode("overwrite").parquet(os.path.join(self.folder, "sets", f"{span[0]}-{span[1]}"))


def _ask(scope: int, names: list[str]):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        h, batch = column(asked, "h").to_numpy(), column(asked, "_batch").to_numpy()
        own = reduce_hash(h, scope)
        yes, theory = np.zeros(len(h), bool), np.zeros(len(h))
        for stored in _levels(blocks) if len(blocks) else []:
            yes |= stored.has(own)
            theory = 1 - (1 - theory) * (1 - stored.rate)
        levels: list[CodedSet] = []
        order = np.argsort(batch, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(batch[order])) + 1).tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            mine = order[a:b]
            for level in levels:
                yes[mine] |= level.has(own[mine])
                theory[mine] = 1 - (1 - theory[mine]) * (1 - level.rate)
            fresh = np.unique(own[mine[~yes[mine]]])
            if len(fresh):
                # as in a log-structured tree few sets are kept
                while levels and len(levels[-1]) <= 2 * len(fresh):
                    fresh = np.union1d(fresh, levels.pop().values())
                levels.append(CodedSet.of(fresh, scope))
        return asked.select(names).append_column("maybe", pa.array(yes)).append_column("theory", pa.array(theory))

    return run


def _among(sets: list[CodedSet]):
    """Mapper: the rows whose hash ``h`` may be in one of the shards' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch["h"].to_numpy()
            keep, shard = np.zeros(len(h), bool), h % len(sets)
            for i, s in enumerate(sets):
                mine = np.flatnonzero(shard == i)
                keep[mine] = s.has(reduce_hash(h[mine], s.scope))
            yield batch.filter(pa.array(keep))

    return run


def _asked_again(old: DataFrame, maybe: DataFrame, hashed: Column, filter_bytes: int) -> DataFrame:
    """The rows of history that may have a key which was answered with yes, found where they stand: the hashes of those
    keys go to the mappers as coded sets of 17 bits a key, as long as these take no more than ``filter_bytes``."""
    n = maybe.count()
    if n * 17 // 8 > filter_bytes:
        return old
    shards = max(1, -(-n // SHARD_KEYS))
    scope = max(1, -(-n // shards)) << 12
    blocks = coded_set(maybe.select(hashed.alias("h")), shards, scope).collect()
    sets = [CodedSet.of(np.zeros(0, np.int64), scope)] * shards
    for i in {b["shard"] for b in blocks}:
        sets[i] = _read(pa.Table.from_pylist([b.asDict() for b in blocks if b["shard"] == i], _arrow_schema()))
    own = old.withColumn("h", hashed)
    return own.mapInArrow(_among(sets), own.schema).drop("h")


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _BLOCKS.split(", "))])


def seen_pairs(
    history: DataFrame, intake: DataFrame, keys: list[str], order: str, batch: str, bits: int = BITS, shard_keys: int = SHARD_KEYS,
    store: SeenKeys | None = None, filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Distinct keys of each batch: the keys' columns, ``_batch, _first`` (least ``order``), ``_n`` rows, ``maybe`` (the
    coded sets' answer), ``theory`` (its probability if the key is new) and ``seen`` (verified).

    The batch is asked of the stored coded sets and of coded sets of the earlier batches, to which its new keys
    are added afterwards. ``seen`` holds a yes against the keys themselves; a no needs no such check. Without a
    ``store`` one is made of ``history``; into one that is given the new keys are appended.
    """
    spark = history.sparkSession
    known = " and ".join(f"{k} is not null" for k in keys)
    hashed = F.xxhash64(*keys)
    old = history.where(known).select(*keys)
    pairs = (
        intake.where(known)
        .withColumn("_batch", F.coalesce(F.col(batch).cast("int"), F.lit(2**31 - 1)))
        .groupBy(*keys, "_batch")
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    own = store
    if own is None:
        # counts of whole tables come from the footers of their files; history and intake together make up to 2 in 2**bits
        folder = os.path.join(checkpoint_dir(spark), "cairnfold", uuid.uuid4().hex)
        own = SeenKeys(spark, folder, max(1, history.count(), intake.count()), bits, shard_keys)
        own.append(old.select(hashed.alias("h")))
    asked = pairs.withColumn("h", hashed).withColumn("shard", own.shard(F.col("h")))
    names = [*keys, "_batch", "_first", "_n"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*names).schema)
    answered = cut(
        own.blocks().groupBy("shard")
        .cogroup(asked.groupBy("shard"))
        .applyInArrow(_ask(own.scope, names), f"{schema}, maybe boolean, theory double")
    )
    if store is not None:
        store.append(answered.where("not maybe").select(hashed.alias("h")))
    there = _asked_again(old, answered.where("maybe"), hashed, filter_bytes).distinct().withColumn("_old", F.lit(True))
    earliest = F.min("_batch").over(Window.partitionBy(*keys))
    seen = F.col("maybe") & (F.coalesce("_old", F.lit(False)) | (earliest < F.col("_batch")))
    return answered.join(there, keys, "left").select(*names, "maybe", "theory", seen.alias("seen"))


def _intake(df: DataFrame, keys: dict[str, str]) -> tuple[DataFrame, list[str]]:
    cols = {f"_k_{a}": (F.lower(F.col(b)) if a == "fp" else F.col(b)).cast("string") for a, b in keys.items()}
    return df.withColumns(cols), list(cols)


def _packed(df: DataFrame, name: str) -> DataFrame:
    """A 64-digit hex key as its bytes; others as marks and their text, which is longer."""
    raw = F.when(F.length(name) == 64, F.try_to_binary(name, F.lit("hex")))
    return df.withColumn(name, F.coalesce(raw, F.encode(F.concat(F.lit("~" * 33), F.col(name)), "UTF-8")))


def _prepared(history: DataFrame, intake: DataFrame, scope: str, fp: str, order: str, batch: str):
    h, keys = _intake(history.select(scope, fp), {"scope": scope, "fp": fp})
    c, _ = _intake(intake.select(scope, fp, F.col(order).alias("_order"), F.col(batch).alias("_given")), {"scope": scope, "fp": fp})
    return _packed(h.select(*keys), "_k_fp"), _packed(c.select(*keys, "_order", "_given"), "_k_fp"), keys


def seen_before(
    history: DataFrame,
    intake: DataFrame,
    scope: str = "namespace",
    fp: str = "fp",
    order: str = "chunk_id",
    batch: str = "batch_no",
    bits: int = BITS,
    shard_keys: int = SHARD_KEYS,
    heavy_share: float = HEAVY_SHARE,
    store: SeenKeys | None = None,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Distinct ``order`` of the rows of ``intake`` whose key (scope, fp) stands in ``history`` or in a row of
    ``intake`` with a smaller ``order``.

    ``batch`` rises with ``order``; a null batch comes last. ``fp`` compares without regard to case; a row
    with a null scope or fp is never seen, nor does it make others so. Repeated rows of one ``order`` do
    not make each other seen. An empty history leaves repetition within the intake. With a ``store`` the coded sets
    are taken from there and the intake's new keys appended; ``history``, all keys it was made from, then only
    verifies.
    """
    old, new, keys = _prepared(history, intake, scope, fp, order, batch)
    pairs = cut(seen_pairs(old, new, keys, "_order", "_given", bits, shard_keys, store, filter_bytes).withColumn("_key", F.xxhash64(*keys, "_batch")))
    total = pairs.agg(F.sum("_n")).first()[0] or 0
    heavy = heavy_keys(pairs, "_key", "_n", total, heavy_share)
    rows = new.withColumn("_batch", F.coalesce(F.col("_given").cast("int"), F.lit(2**31 - 1))).withColumn("_key", F.xxhash64(*keys, "_batch"))
    # a pair that was not seen and has one row decides itself
    use = pairs.where(F.col("seen") | (F.col("_n") > 1)).select("_key", *keys, "_batch", "_first", "seen")
    met = split_join(rows, use, [*keys, "_batch"], "_key", heavy)
    return met.where(F.col("seen") | (F.col("_order") > F.col("_first"))).select(F.col("_order").alias(order)).distinct()


def audit(
    history: DataFrame,
    intake: DataFrame,
    scope: str = "namespace",
    fp: str = "fp",
    order: str = "chunk_id",
    batch: str = "batch_no",
    bits: int = BITS,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """For each batch: ``batch, questions`` (distinct keys), ``known`` (of these, seen before), ``repeats`` (rows beyond
    the first of a key within the batch, repeated rows included, which no set is asked for), ``yes, wrong_yes, wrong_no`` (0 by construction, counted),
    ``expected_wrong`` (the theory's sum over keys that were new), ``wrong_rate`` and ``theory_rate`` a new key."""
    old, new, keys = _prepared(history, intake, scope, fp, order, batch)
    pairs = cut(seen_pairs(old, new, keys, "_order", "_given", bits, shard_keys))
    # every key is held against history and the earlier batches here, also where the answer was no
    since = (
        old.where(" and ".join(f"{k} is not null" for k in keys))
        .withColumn("_since", F.lit(-(2**31)))
        .unionByName(pairs.select(*keys, F.col("_batch").alias("_since")))
        .groupBy(*keys)
        .agg(F.min("_since").alias("_since"))
    )
    truth = pairs.join(since, keys).withColumn("old", F.col("_since") < F.col("_batch"))
    n = lambda c: F.count(F.when(c, 1))
    new_key = ~F.col("old")
    return (
        truth.groupBy(F.col("_batch").alias("batch"))
        .agg(
            F.count(F.lit(1)).alias("questions"),
            n(F.col("old")).alias("known"),
            F.sum(F.col("_n") - 1).alias("repeats"),
            n(F.col("maybe")).alias("yes"),
            n(F.col("maybe") & new_key).alias("wrong_yes"),
            n(~F.col("maybe") & F.col("old")).alias("wrong_no"),
            F.coalesce(F.sum(F.when(new_key, F.col("theory"))), F.lit(0.0)).alias("expected_wrong"),
            n(new_key).alias("_new"),
        )
        .withColumn("wrong_rate", F.when(F.col("_new") > 0, F.col("wrong_yes") / F.col("_new")))
        .withColumn("theory_rate", F.when(F.col("_new") > 0, F.col("expected_wrong") / F.col("_new")))
        .drop("_new")
    )
