"""Deduplicating new batches against all history (problem 4): bit-difference fingerprints.

A record is a set of elements. Its fingerprint is a string of bits in which each element flips one, so
that two fingerprints differ in no more bits than the sets differ in elements. A similarity of ``least``
allows sets of sizes m and n to differ in ``(1 - least) / (1 + least) * (m + n)`` elements. The wide
fingerprint (one bit for each 64-bit hash, kept as the list of set bits) is rotated and cut into one block
more than that number, so that some block is equal in both; it is looked up exactly in block tables, one
for each rotation and size class. A folded fingerprint of 128 bits then verifies the Hamming distance, and
the sets themselves the similarity.

Elements of very many records are left out of the wide fingerprint (which cannot add a difference), as
blocks of nothing else would be shared by all. As the blocks without a difference may be empty in both,
records are also looked up by the elements of a prefix under one global order, of which similar sets
always share one; frequent elements stand last in it. The few pairs left are compared by the elements themselves.
New records are appended to the tables (``BatchIndex``); nothing about history is made anew.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfold.operators.arrow_groups import column
from cairnfold.operators.skew import HEAVY_SHARE, heavy_keys, key_hash, salted_join, split_join
from cairnfold.session import checkpoint_dir, cut, shuffle_width

LEAST = 0.7
ROTATIONS = 3
#: At most so many frequent elements are left out of the block tables.
FREQUENT = 1 << 20
#: Batches of one delivery.
BATCHES = 16
_STEP = 1.15


@dataclass(frozen=True)
class Ladder:
    """Size classes and the number of blocks of each."""

    least: float

    def upper(self, n_max: int) -> np.ndarray:
        out = [1]
        while out[-1] < n_max:
            out.append(max(out[-1] + 1, int(out[-1] * _STEP)))
        return np.array(out)

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.floor((1 - self.least) / (1 + self.least) * (a + b) + 1e-9).astype(np.int64)

    def blocks(self, upper: np.ndarray) -> np.ndarray:
        return self.differences(upper, np.floor(upper / self.least + 1e-9)) + 1


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x + np.uint64((salt * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _fold(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each set."""
    at = (_mix(codes, 5) >> np.uint64(57)).astype(np.int64)
    parity = np.zeros((n, 128), np.uint8)
    np.bitwise_xor.at(parity, (owner, at), 1)
    words = np.packbits(parity, axis=1, bitorder="little").view("<i8")
    return words[:, 0].copy(), words[:, 1].copy()


def _keys(codes, owner, scope, k, n_blocks, rotation):
    """(owner, key) of every block with an element: key of scope, size class, rotation, block and bits."""
    x = _mix(codes)
    place = _rotate(x, rotation * (64 // ROTATIONS)) >> np.uint64(32)
    block = ((place * n_blocks[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((block, owner))
    o, b = owner[order], block[order]
    head = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (b[1:] != b[:-1])])
    bits = np.add.reduceat(_mix(codes[order], 1), head)
    o, b = o[head], b[head]
    tag = _mix(scope[o] + _mix(k[o].astype(np.uint64) * np.uint64(1 << 20) + np.uint64(rotation), 2) + _mix(b.astype(np.uint64), 3))
    return o, (tag ^ _mix(bits, 4)).view(np.int64)


def _signatures(least: float, frequent: np.ndarray, probe: bool):
    ladder = Ladder(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n_sets = len(batch)
            if not n_sets:
                continue
            lists = column(t, "codes")
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            codes = lists.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(n_sets), size)
            scope = column(t, "scope_hash").to_numpy().view(np.uint64)
            fold = _fold(codes, owner, n_sets)
            upper = ladder.upper(int(size.max() / least) + 2)
            blocks = ladder.blocks(upper)
            lower = np.r_[1, upper[:-1] + 1]
            own = np.searchsorted(upper, size)
            hot = np.isin(codes ^ _mix(scope[owner], 9), frequent)
            cold, cold_owner = codes[~hot], owner[~hot]
            parts = []
            small, large = np.ceil(least * size - 1e-9), np.floor(size / least + 1e-9)
            for step in range(-len(upper), len(upper)) if probe else (0,):
                k = own + step
                ok = (k >= 0) & (k < len(upper))
                kk = np.clip(k, 0, len(upper) - 1)
                ok &= (lower[kk] <= large) & (upper[kk] >= small)
                if not ok.any():
                    continue
                use = ok[cold_owner]
                for r in range(ROTATIONS):
                    if use.any():
                        parts.append(_keys(cold[use], cold_owner[use], scope, kk, blocks[kk], r))
            # the prefix under one order, frequent elements last: exact, whatever blocks are empty
            rank = (_mix(codes, 7) >> np.uint64(1)) | (hot.astype(np.uint64) << np.uint64(63))
            order = np.lexsort((rank, owner))
            place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
            prefix = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
            at = order[place < prefix[owner]]
            parts.append((owner[at], _mix(codes[at] + _mix(scope[owner[at]], 11), 12).view(np.int64)))
            o, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            take = pa.array(o)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key), column(t, "cid").take(take), pa.array(size[o].astype(np.int32)),
                    pa.array(fold[0][o]), pa.array(fold[1][o]), column(t, "batch").take(take),
                ],
                names=["key", "cid", "n", "f1", "f2", "batch"],
            )

    return run


_SIGNATURE = "key bigint, cid bigint, n int, f1 bigint, f2 bigint, batch int"


def members(elements: DataFrame) -> DataFrame:
    """Sets from rows ``scope, obj, batch, element``. Null elements, objects or scopes are left out. An object that
    comes with several batches belongs to the first. An element is any text, or binary."""
    own = elements.where("scope is not null and obj is not null and element is not null")
    own = own.withColumn("element", F.col("element").cast("string"))
    return identified(own.groupBy("scope", "obj").agg(F.min("batch").cast("int").alias("batch"), F.collect_set("element").alias("elements")))


def identified(sets: DataFrame) -> DataFrame:
    """``scope, obj, batch, elements``, sorted, with ``codes``, the elements' 64-bit hashes that fingerprints are made of, and
    the class of equal sets: ``cid2``, SHA-256 of scope and elements, and ``cid``, its hash. Empty sets are left out."""
    sets = sets.where(F.size("elements") > 0).withColumn("elements", F.array_sort("elements"))
    whole = F.array_join(F.transform("elements", lambda e: F.concat(F.octet_length(e).cast("string"), F.lit(":"), e)), "")
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("scope").cast("string"), "scope", whole).cast("binary"), 256))
    sets = sets.withColumn("codes", F.array_sort(F.array_distinct(F.transform("elements", lambda e: F.xxhash64(e)))))
    sets = sets.withColumn("cid2", digest)
    return sets.select("scope", "obj", "batch", "elements", "codes", F.xxhash64("cid2").alias("cid"), "cid2")


def classes(sets: DataFrame) -> DataFrame:
    """One row for each class of equal sets, with its first and its last batch."""
    own = F.first(F.struct("scope", "elements", "codes")).alias("own")  # the same in all
    each = sets.groupBy("cid", "cid2").agg(F.min("batch").alias("first"), F.max("batch").alias("last"), own)
    return each.select("cid", "cid2", "first", "last", "own.*")


def frequent_elements(sets: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """Hashes (with scope) of the elements of so many sets that there can be no more than ``most`` such; they steer
    the work and do not change the result. Counted exactly, with the mappers' help."""
    total = sets.agg(F.sum(F.size("codes"))).first()[0] or 0
    least = max(32, total / most)
    each = sets.select(F.xxhash64("scope").alias("s"), F.explode("codes").alias("code"))
    rows = each.groupBy("s", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("s", "code").collect()
    pairs = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2).view(np.uint64)
    return pairs[:, 1] ^ _mix(pairs[:, 0], 9)


def signatures(table: DataFrame, frequent: np.ndarray, batch: str, probe: bool, least: float = LEAST) -> DataFrame:
    """Rows of the block tables for classes: as stored (own size class), or as looked up (all size classes
    that a similar set may have)."""
    own = table.select(F.xxhash64("scope").alias("scope_hash"), "codes", "cid", F.col(batch).alias("batch"))
    return own.mapInArrow(_signatures(least, frequent, probe), _SIGNATURE)


def candidate_pairs(stored: DataFrame, looked_up: DataFrame, least: float = LEAST, heavy: Sequence[int] = ()) -> DataFrame:
    """Pairs of classes with an equal block whose folded fingerprints are near enough: ``a, b``. ``heavy``: keys of so many
    stored rows that their pairs are made by several tasks."""
    s = stored.select("key", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("batch").alias("ba"))
    p = looked_up.select("key", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("batch").alias("bb"))
    total = F.col("na") + F.col("nb")
    distance = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    near = distance <= F.floor(F.lit((1 - least) / (1 + least)) * total + 1e-9)
    sizes = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    return salted_join(s, p, ["key"], "key", heavy).where((F.col("ba") < F.col("bb")) & sizes & near).select("a", "b").distinct()


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of classes of one scope whose sets, compared by their elements themselves, have the similarity:
    ``a, a2, b, b2, similarity``."""
    a = left.select(F.col("cid").alias("a"), F.col("cid2").alias("a2"), F.col("scope").alias("sa"), F.col("elements").alias("ea"))
    b = right.select(F.col("cid").alias("b"), F.col("cid2").alias("b2"), F.col("scope").alias("sb"), F.col("elements").alias("eb"))
    both = pairs.join(a, "a").join(b, "b").where("sa = sb")
    common = F.size(F.array_intersect("ea", "eb"))
    total = F.size("ea") + F.size("eb") - common
    out = both.withColumn("common", common).withColumn("total", total).where(F.col("common") >= F.lit(least) * F.col("total") - 1e-9)
    return out.select("a", "a2", "b", "b2", (F.col("common") / F.col("total")).alias("similarity"))


_CLASS = "cid bigint, cid2 binary, scope string, elements array<string>"
_MEMBER = "cid bigint, cid2 binary, obj bigint, batch int"


class BatchIndex:
    """Block tables, sets and members of everything accepted, in a folder; each delivery, of one batch or some, is
    looked up and appended, and nothing about history is made anew.

    The block table is bucketed by block key, sets and members by class, so that a delivery's rows are shuffled to
    where history lies and history is not. ``append`` writes the rows of new classes only. The frequent elements are
    those of the first delivery appended (history), kept in the folder, so that stored and looked-up keys agree;
    elements that become frequent later make full buckets, whose pairs several tasks share, and a new index from time
    to time. Batches must be numbered in the order in which they come.
    """

    def __init__(self, spark: SparkSession, folder: str, least: float = LEAST, buckets: int | None = None):
        self.spark, self.folder, self.least = spark, folder, least
        if not self._exists("buckets"):
            spark.createDataFrame([(buckets or shuffle_width(spark), least)], "n int, least double").coalesce(1).write.parquet(self._path("buckets"))
        self.buckets, self.least = spark.read.parquet(self._path("buckets")).first()

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self._path(name), "_SUCCESS"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _name(self, name: str) -> str:
        return f"cairnfold_{name}_{hashlib.md5(self.folder.encode()).hexdigest()}"

    def table(self, name: str) -> DataFrame:
        """A stored table: ``blocks``, ``sets`` or ``members``."""
        schema, key = {"blocks": (_SIGNATURE, "key"), "sets": (_CLASS, "cid"), "members": (_MEMBER, "cid")}[name]
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        if not self.spark.catalog.tableExists(self._name(name)):
            self.spark.sql(f"CREATE TABLE {self._name(name)} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self._path(name)}'")
        return self.spark.table(self._name(name))

    def _write(self, df: DataFrame, name: str, key: str) -> None:
        self.table(name)  # known to this session
        writer = df.repartition(self.buckets, key).write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, key).mode("append")
        writer.option("path", self._path(name)).saveAsTable(self._name(name))

    def _frequent(self, sets: DataFrame | None = None) -> np.ndarray:
        if self._exists("frequent"):
            return np.array([r[0] for r in self.spark.read.parquet(self._path("frequent")).collect()], np.int64).view(np.uint64)
        if sets is None:
            return np.zeros(0, np.uint64)
        found = frequent_elements(sets)
        self.spark.createDataFrame([(int(x),) for x in found.view(np.int64)], "code bigint").coalesce(1).write.parquet(self._path("frequent"))
        return found

    def append(self, elements: DataFrame) -> None:
        self.append_sets(cut(members(elements)))

    def append_sets(self, sets: DataFrame) -> DataFrame:
        """Writes members, and sets and blocks of classes that are new; returns the delivery's classes."""
        table = cut(classes(sets))
        frequent = self._frequent(table)
        new = table
        if self._exists("sets"):
            new = cut(table.join(self.table("sets").select("cid", "cid2"), ["cid", "cid2"], "left_anti"))
        self._write(signatures(new, frequent, "first", False, self.least), "blocks", "key")
        self._write(new.select("cid", "cid2", "scope", "elements"), "sets", "cid")
        self._write(sets.select("cid", "cid2", "obj", "batch"), "members", "cid")
        return table

    def links(self, table: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
        """``a, a2, b, b2, similarity``: stored classes ``a`` that begin in an earlier batch than the last of ``b`` in ``table``."""
        stored = self.table("blocks")
        counts = stored.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        total = stored.count()
        heavy = heavy_keys(counts.where(F.col("n") >= max(2, int(total * heavy_share))), "key", "n", total, heavy_share)
        looked = signatures(table, self._frequent(), "last", True, self.least)
        pairs = cut(candidate_pairs(stored, looked, self.least, heavy))
        return verified(pairs, self.table("sets"), table, self.least)

    def check(self, elements: DataFrame) -> DataFrame:
        """``obj_a, obj_b, similarity`` of a batch's objects with those stored; writes nothing."""
        sets = cut(members(elements))
        return expand(self.links(cut(classes(sets))), self.table("members"), sets.select("cid", "cid2", "obj", "batch"))

    def accept(self, sets: DataFrame) -> DataFrame:
        """Appends a delivery of sets as ``members`` gives them and returns the links of its classes with everything in an
        earlier batch, those of the delivery included."""
        table = self.append_sets(sets)
        return cut(self.links(table))


def deliver(sets: DataFrame, least: float = LEAST, at_once: int = BATCHES, folder: str | None = None) -> tuple[DataFrame, BatchIndex]:
    """All links of sets with ``batch`` 0 (history, which is appended only) and later ones, accepted in their order, up
    to ``at_once`` batches a delivery; and the index."""
    spark = sets.sparkSession
    index = BatchIndex(spark, folder or os.path.join(checkpoint_dir(spark), "cairnfold", uuid.uuid4().hex), least)
    batches = [r[0] for r in sets.where("batch > 0").select("batch").distinct().orderBy("batch").collect()]
    index.append_sets(sets.where("batch <= 0"))
    links = spark.createDataFrame([], "a bigint, a2 binary, b bigint, b2 binary, similarity double")
    for i in range(0, len(batches), at_once):
        own = batches[i : i + at_once]
        links = links.unionByName(index.accept(sets.where(F.col("batch").between(own[0], own[-1]))))
    return links.distinct(), index


def near_duplicates(elements: DataFrame, least: float = LEAST, at_once: int = BATCHES) -> DataFrame:
    """Pairs ``obj_a, obj_b, similarity``: ``obj_b`` of batch 1 or later is a near-duplicate of ``obj_a`` of a
    smaller batch (0: history) in the same scope: their sets of elements have at least ``least`` of their
    union in common. Sets without a known element are like nothing. Equal sets are one class until here, so
    that a group of copies is compared once; the expansion to pairs of objects is what is asked for.
    """
    return near_duplicate_sets(cut(members(elements)), least, at_once)


def near_duplicate_sets(sets: DataFrame, least: float = LEAST, at_once: int = BATCHES) -> DataFrame:
    """The same from sets as ``identified`` gives them."""
    links, index = deliver(sets, least, at_once)
    own = index.table("members")
    return expand(links, own, own.where("batch > 0"))


def expand(links: DataFrame, earlier: DataFrame, later: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Pairs of objects from links of classes and the members of these. A class with a large part of all members is
    dealt to several tasks on either side."""
    a = earlier.select(F.col("cid").alias("a"), F.col("cid2").alias("a2"), F.col("obj").alias("obj_a"), F.col("batch").alias("batch_a"))
    b = later.select(F.col("cid").alias("b"), F.col("cid2").alias("b2"), F.col("obj").alias("obj_b"), F.col("batch").alias("batch_b"))
    each = earlier.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(each, "cid", "n", earlier.count(), heavy_share)
    out = salted_join(a, links, ["a2"], "a", heavy)
    out = salted_join(out, b, ["b2"], "b", heavy).where((F.col("batch_a") < F.col("batch_b")) & (F.col("obj_a") != F.col("obj_b")))
    return out.select("obj_a", "obj_b", "similarity")


def upload_links(elements: DataFrame, least: float = LEAST) -> DataFrame:
    """One row for each object of batch 1 or later: ``obj, batch, class_id`` (the least object of its class of
    equal sets), ``copies`` (earlier objects with an equal set) and ``links`` (earlier objects that are
    near-duplicates, copies included). Counted from classes, without making the pairs."""
    return set_links(cut(members(elements)), least)


def set_links(sets: DataFrame, least: float = LEAST, at_once: int = BATCHES) -> DataFrame:
    """The same from sets as ``identified`` gives them."""
    links = deliver(sets, least, at_once)[0]
    sets = sets.select("cid", "cid2", "obj", "batch")
    own = sets.groupBy("cid", "cid2", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("obj").alias("least_obj"))
    ids = own.groupBy("cid", "cid2").agg(F.min("least_obj").alias("class_id"))
    uploads = own.where(F.col("batch") > 0).select(F.col("cid").alias("b"), F.col("cid2").alias("b2"), F.col("batch").alias("to"))
    earlier = own.select(F.col("cid").alias("a"), F.col("cid2").alias("a2"), F.col("batch").alias("from"), "n")
    met = links.join(uploads, ["b", "b2"]).join(earlier, ["a", "a2"]).where(F.col("from") < F.col("to"))
    same = (F.col("a") == F.col("b")) & (F.col("a2") == F.col("b2"))
    counts = met.groupBy(F.col("b").alias("cid"), F.col("b2").alias("cid2"), F.col("to").alias("batch")).agg(
        F.sum("n").alias("links"), F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("copies")
    )
    # a class may hold a large part of all objects
    own, ids, counts = cut(own), cut(ids), cut(counts)
    heavy = heavy_keys(own, "cid", "n", own.agg(F.sum("n")).first()[0] or 0)
    out = split_join(sets.where(F.col("batch") > 0), ids, ["cid2"], "cid", heavy)
    out = split_join(out, counts, ["cid2", "batch"], "cid", heavy, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("obj", "batch", "class_id", zero("copies"), zero("links"))


def chunk_verdicts(chunks: DataFrame, history: DataFrame, index: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """For each chunk ``chunk_id, deduped, dcid``: whether its key (namespace, fp) stands in ``history`` or in a
    chunk with a smaller ``chunk_id``, and the least ``dcid`` that the key has in ``index`` (null: none).

    A null namespace or fp is never a duplicate. Repeated rows of a chunk give one row."""
    key = lambda df: df.where("namespace is not null and fp is not null").withColumn("fp", F.lower("fp")).withColumn("key", key_hash("namespace", "fp"))
    none = F.lit(None).cast("bigint")
    own = chunks.select("chunk_id", "namespace", F.lower("fp").alias("fp")).withColumn("key", key_hash("namespace", "fp"))
    first = key(chunks).select("key", "namespace", "fp", F.col("chunk_id").cast("bigint").alias("first"), F.lit(0).alias("old"), none.alias("at"), F.lit(1).alias("n"))
    old = key(history).select("key", "namespace", "fp", none.alias("first"), F.lit(1).alias("old"), none.alias("at"), F.lit(0).alias("n"))
    at = key(index).select("key", "namespace", "fp", none.alias("first"), F.lit(0).alias("old"), F.col("dcid").alias("at"), F.lit(0).alias("n"))
    known = (
        first.unionByName(old).unionByName(at).groupBy("key", "namespace", "fp")
        .agg(F.min("first").alias("first"), F.max("old").alias("old"), F.min("at").alias("at"), F.sum("n").alias("n"))
        .where("n > 0")
    )
    known = cut(known)
    total = known.agg(F.sum("n")).first()[0] or 0
    heavy = heavy_keys(known, "key", "n", total, heavy_share)
    met = split_join(own, known.drop("n"), ["namespace", "fp"], "key", heavy, "left")
    seen = F.coalesce((F.col("old") == 1) | (F.col("first") < F.col("chunk_id")), F.lit(False))
    return met.select("chunk_id", seen.alias("deduped"), F.col("at").alias("dcid")).distinct()


def similar_blocks(n: int, least: float = LEAST) -> int:
    """Number of blocks of the size class of sets of ``n`` elements."""
    ladder = Ladder(least)
    upper = ladder.upper(max(1, math.ceil(n)))
    return int(ladder.blocks(upper)[np.searchsorted(upper, n)])
