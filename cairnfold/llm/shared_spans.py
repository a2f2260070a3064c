"""Long exact spans shared between records (problem 3): super-k-mer partitioning.

A record is a sequence of elements, here (fingerprint, length). A span counts from ``min_bytes`` on. A
window is a shortest run of elements that reaches ``min_bytes`` from its first element on, or back from
its last; an element lies in a shared span of at least that size if and only if it lies in a window that
another record has too. Consecutive windows with the same minimiser, the least element hash within,
travel as one packed string (a super-k-mer) to the bucket of that minimiser. There the windows are cut
out again, named exactly by sorting, and those that two records hold are marked.

The frequent elements come last in the order that picks minimisers, so that no bucket fills up with
windows around a frequent element, and windows of nothing but frequent elements are told apart by four
elements in a row. A bucket that is too full all the same is split by the content of its windows, which are then told
apart one by one. Equal strings are made one by the mappers. What comes back to the records are the
marked ranges of each distinct string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfold.operators.arrow_groups import binaries, column, ranges, whole_groups
from cairnfold.operators.skew import HEAVY_SHARE, heavy_keys, split_join
from cairnfold.session import cut, shuffle_width

MIN_BYTES = 1 << 20
#: Elements of a record that lie in one piece; a longer record is cut into pieces that overlap.
PIECE = 1 << 16
#: Rows that a worker handles at once.
ROWS = 1 << 18
#: Bytes of distinct strings with shared ranges that are broadcast; beyond, only the heavy strings are.
BROADCAST_BYTES = 16 << 20
#: Distinct strings, counted once for each worker that found them, that a bucket may have; fuller ones are split by window.
BUCKET_ROWS = 1 << 17

_ELEMENT = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", "<u8"), ("d", "<u8"), ("len", "<u4")])  # fingerprint and length
_TOP = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(size: np.ndarray, run: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last element of every window, sorted. ``run`` numbers the runs, ascending."""
    n = len(size)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    after = np.cumsum(size, dtype=np.int64)
    before = after - size
    first, last = np.searchsorted(run, run, "left"), np.searchsorted(run, run, "right") - 1
    at = np.arange(n)
    end = np.searchsorted(after, before + least, "left")
    ok = end <= last
    begin = np.searchsorted(before, after - least, "right") - 1
    ok2 = begin >= first
    key = np.unique(np.r_[at[ok] * n + end[ok], begin[ok2] * n + at[ok2]])
    return key // n, key % n


def _range_min(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Least value of each ``values[s : e + 1]``, by a table of powers of two."""
    out = np.empty(len(s), values.dtype)
    length = e - s + 1
    level = np.frexp(length)[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[: len(table) - half], table[half:])
        m = level == k
        if m.any():
            out[m] = np.minimum(table[s[m]], table[e[m] - (1 << k) + 1])
    return out


def _elements(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Packed elements, their sizes, runs and places, and the records' names, without repeated rows."""
    name, piece, ordinal = column(table, "record"), column(table, "piece").to_numpy(), column(table, "ordinal").to_numpy()
    code, size = column(table, "code"), column(table, "size")
    rec = name.dictionary_encode().indices.to_numpy().astype(np.int64)
    new = np.ones(len(rec), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (piece[1:] != piece[:-1]) | (ordinal[1:] != ordinal[:-1])
    keep = np.flatnonzero(new)
    rec, piece, ordinal = rec[keep], piece[keep], ordinal[keep]
    size = size.fill_null(-1).to_numpy(zero_copy_only=False)[keep]
    code = code.take(pa.array(keep))
    known = ~code.is_null().to_numpy(zero_copy_only=False) & (size >= 0)
    step = np.ones(len(rec), bool)
    step[1:] = (rec[1:] != rec[:-1]) | (piece[1:] != piece[:-1]) | (ordinal[1:] != ordinal[:-1] + 1) | ~known[:-1]
    run = np.cumsum(step)[known]
    at = keep[known]
    data = b"".join(code.filter(pa.array(known)).to_pylist())
    raw = np.frombuffer(data, np.dtype([(x, "<u8") for x in "abcd"]))
    el = np.empty(len(raw), _ELEMENT)
    size = size[known].astype(np.int64)
    long = size >= 0xFFFFFFFF
    for x in "abc":
        el[x] = raw[x]
    el["d"] = np.where(long, raw["d"] ^ _mix(size.astype(np.uint64)), raw["d"])
    el["len"] = np.where(long, 0xFFFFFFFF, size)
    return el, np.minimum(size, 0xFFFFFFFF), run, ordinal[known], name.take(pa.array(at))


def _super_kmers(el: np.ndarray, size: np.ndarray, run: np.ndarray, least: int, frequent: np.ndarray):
    """First and last element and minimiser of each super-k-mer."""
    s, e = windows(size, run, least)
    if not len(s):
        return s, e, np.zeros(0, np.uint64)
    code = el["a"] ^ _mix(el["len"].astype(np.uint64))
    rank = _mix(code) & ~_TOP
    rank |= np.where(np.isin(el["a"], frequent), _TOP, np.uint64(0))
    least_rank = _range_min(rank, s, e)
    only = ((least_rank & _TOP) != 0) & (e - s >= 3)
    if only.any():
        four = _mix(_mix(_mix(_mix(code[:-3]) + code[1:-2]) + code[2:-1]) + code[3:]) | _TOP
        least_rank[only] = _range_min(four, s[only], e[only] - 3)
    new = np.ones(len(s), bool)
    new[1:] = (least_rank[1:] != least_rank[:-1]) | (run[s[1:]] != run[s[:-1]])
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(s)] - 1
    return s[head], e[tail], least_rank[head]


def _packed(el: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    data, width = el.tobytes(), _ELEMENT.itemsize
    strings = [data[a * width : (b + 1) * width] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    return strings, [xxhash.xxh3_128_digest(x) for x in strings]


def _ranked(names: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each name among the distinct ones in order, and these."""
    own = names.dictionary_encode()
    order = pc.sort_indices(own.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[own.indices.to_numpy()], own.dictionary.take(pa.array(order))


def _least_and_most(at: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.full(k, np.iinfo(np.int64).max), np.full(k, np.iinfo(np.int64).min)
    np.minimum.at(lo, at, low)
    np.maximum.at(hi, at, high)
    return lo, hi


def _strings(least: int, frequent: np.ndarray, rows: int):
    """Mapper: each distinct string of a worker's rows, with the least and greatest record that has it; and, as rows without
    ``packed``, where each string stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["record", "piece"], rows):
            el, size, runs, ordinal, name = _elements(t)
            s, e, minimiser = _super_kmers(el, size, runs, least, frequent)
            if not len(s):
                continue
            owner, names = _ranked(name.take(pa.array(s)))
            strings, digest = _packed(el, s, e)
            code = pa.array(strings, pa.binary()).dictionary_encode()
            at, k = code.indices.to_numpy(), len(code.dictionary)
            lo, hi = _least_and_most(at, k, owner, owner)
            bucket = np.empty(k, np.int64)
            bucket[at] = minimiser.view(np.int64)
            n = np.bincount(at, minlength=k).astype(np.int64)
            none = pa.nulls(k)
            yield _row_batch([pa.array(bucket), code.dictionary, names.take(pa.array(lo)), names.take(pa.array(hi)), pa.array(n), none, none, none])
            none = pa.nulls(len(s))
            yield _row_batch([none, none, none, none, none, pa.array(digest, pa.binary()), name.take(pa.array(s)), pa.array(ordinal[s], pa.int64())])

    return run


_MAPPED = pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("lo", pa.string()), ("hi", pa.string()), ("n", pa.int64()), ("string", pa.binary()), ("record", pa.string()), ("start", pa.int64())])


def _row_batch(arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip(arrays, _MAPPED.types, strict=True)], schema=_MAPPED)


def _names(el: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number for each window, the same if and only if the elements are: by sorting pairs of numbers
    of halves, as in the doubling of prefixes."""
    own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_ELEMENT.itemsize), len(el), [None, pa.py_buffer(el)])
    rank = own.dictionary_encode().indices.to_numpy().astype(np.int64)
    level = np.frexp(e - s + 1)[1] - 1
    left, right = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            _, rank = np.unique(rank[: len(rank) - half] * (len(el) + 1) + rank[half:], return_inverse=True)
        m = level == k
        left[m], right[m] = rank[s[m]], rank[e[m] - (1 << k) + 1]
    key = np.stack([e - s, left, right])
    order = np.lexsort(key)
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[:, order], axis=1) != 0).any(axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _count(least: int, rows: int):
    """Buckets: marks the windows that two records hold; ranges of each string as pairs of offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket"], rows):
            found = _shared_ranges(t, least)
            if found is not None:
                yield found

    return run


def _cut_out(t: pa.Table, least: int):
    """Distinct strings, their least and greatest record as ranks, their rows, and all their windows."""
    code = column(t, "packed").dictionary_encode()
    at, k = code.indices.to_numpy(), len(code.dictionary)
    rank, names = _ranked(pa.concat_arrays([column(t, "lo"), column(t, "hi")]))
    lo, hi = _least_and_most(at, k, rank[: len(t)], rank[len(t) :])
    n = np.zeros(k, np.int64)
    np.add.at(n, at, column(t, "n").to_numpy())
    strings = code.dictionary.to_pylist()
    lengths = np.array([len(x) for x in strings], np.int64) // _ELEMENT.itemsize
    el = np.frombuffer(b"".join(strings), _ELEMENT)
    owner = np.repeat(np.arange(k), lengths)
    s, e = windows(el["len"].astype(np.int64), owner, least)
    return strings, lengths, lo, hi, names, n, el, owner, s, e


def _shared_ranges(t: pa.Table, least: int) -> pa.RecordBatch | None:
    strings, lengths, lo, hi, _, n, el, owner, s, e = _cut_out(t, least)
    if not len(s):
        return None
    name = _names(el, s, e)
    low, high = _least_and_most(name, int(name.max()) + 1, lo[owner[s]], hi[owner[s]])
    shared = (low < high)[name]
    s, e = s[shared], e[shared]
    if not len(s):
        return None
    # join the windows of a string that touch; they come sorted
    base = (np.cumsum(lengths) - lengths)[owner[s]]
    new = np.ones(len(s), bool)
    new[1:] = (owner[s[1:]] != owner[s[:-1]]) | (s[1:] > np.maximum.accumulate(e)[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(s)] - 1
    own = owner[s[head]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([xxhash.xxh3_128_digest(strings[i]) for i in own], pa.binary()),
            pa.array(s[head] - base[head]), pa.array(e[tail] - base[head]), pa.array(n[own]),
        ],
        names=["string", "a", "b", "n"],
    )


def _one_by_one(least: int, rows: int):
    """Every window of the strings on its own: its content's SHA-256, the records and where it stands in the string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), rows):
                t = pa.Table.from_batches([batch.slice(i, rows)]).combine_chunks()
                strings, lengths, lo, hi, names, n, el, owner, s, e = _cut_out(t, least)
                data, width = el.tobytes(), _ELEMENT.itemsize
                own = owner[s]
                base = (np.cumsum(lengths) - lengths)[own]
                digests = [xxhash.xxh3_128_digest(x) for x in strings]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hashlib.sha256(data[a * width : (b + 1) * width]).digest() for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.binary()),
                        names.take(pa.array(lo[own])), names.take(pa.array(hi[own])),
                        pa.array([digests[i] for i in own.tolist()], pa.binary()), pa.array(s - base), pa.array(e - base), pa.array(n[own]),
                    ],
                    names=["window", "lo", "hi", "string", "a", "b", "n"],
                )

    return run


def _split_by_window(strings: DataFrame, least: int, heavy_share: float) -> DataFrame:
    """The same as ``_count`` for strings of buckets that are too full: windows meet by the digest of their content."""
    schema = "window binary, lo string, hi string, string binary, a bigint, b bigint, n bigint"
    each = cut(strings.mapInArrow(_one_by_one(least, 1024), schema).withColumn("key", F.xxhash64("window")))
    met = each.groupBy("key", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("m"))
    shared = cut(met.where("lo < hi").select("key", "window", "m"))
    total = each.count()
    heavy = heavy_keys(shared, "key", "m", total, heavy_share)
    return split_join(each, shared.drop("m"), ["window"], "key", heavy).select("string", "a", "b", "n")


def _pieces(rows: DataFrame, least: int, piece: int) -> DataFrame:
    """Adds the number of the piece; of a record in several pieces each piece also gets the rows of the
    following ones, as far as a span of ``least`` from its last element can reach."""
    own = rows.withColumn("piece", F.floor(F.col("ordinal") / piece))
    longest = rows.agg(F.max("ordinal")).first()[0]
    if longest is None or longest < piece:
        return own
    sizes = own.groupBy("record", "piece").agg(F.sum(F.greatest("size", F.lit(0))).alias("bytes"))
    # a piece that is missing ends every run, so pieces in a row are looked at only
    row = Window.partitionBy("record").orderBy("piece")
    sizes = sizes.withColumn("island", F.col("piece") - F.row_number().over(row))
    row = Window.partitionBy("record", "island").orderBy("piece")
    before = F.coalesce(F.sum("bytes").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    sizes = sizes.withColumn("before", before).withColumn("previous", F.lag("piece").over(row))
    # the piece ``from`` needs this one if what lies between has less than ``least`` bytes
    reach = Window.partitionBy("record", "island").orderBy("before").rangeBetween(-(least - 1), Window.currentRow)
    wanted = sizes.withColumn("first", F.min("previous").over(reach)).where(F.col("first") < F.col("piece"))
    wanted = wanted.select("record", "piece", F.explode(F.sequence("first", F.col("piece") - 1)).alias("from"))
    copies = own.join(wanted, ["record", "piece"]).withColumn("piece", F.col("from")).drop("from")
    return own.unionByName(copies)


def frequent_elements(rows: DataFrame, share: float) -> list[bytes]:
    """Fingerprints that may hold ``share`` of the rows, at most ``2 / share``, from one mergeable
    frequent-items sketch. They steer the balance only; no result depends on them."""
    k = int(2 / share)
    top = rows.where(F.col("code").isNotNull()).agg(F.call_function("approx_top_k", F.hex("code"), F.lit(k), F.lit(max(4 * k, 1024))).alias("top"))
    least = rows.count() * share
    return [bytes.fromhex(x["item"]) for x in top.first()["top"] or [] if x["count"] >= least]


def shared_spans(
    entries: DataFrame,
    min_bytes: int = MIN_BYTES,
    record: str = "manifest_id",
    ordinal: str = "ordinal",
    fp: str = "fp",
    size: str = "len",
    piece: int = PIECE,
    rows: int = ROWS,
    heavy_share: float = HEAVY_SHARE,
    broadcast_bytes: int = BROADCAST_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Distinct ``record, ordinal`` of every element in a span of at least ``min_bytes`` that also stands in
    another record.

    A null or negative length, a null fingerprint and a gap in ``ordinal`` end a run; rows with a null
    record or ordinal belong to none. Of rows with the same record and ordinal one counts. Fingerprints
    compare without regard to case. A span that only repeats within its own record is not shared. Records
    may be of any length. Elements are told apart by the whole fingerprint (by SHA-256 of one that is not 64
    hex digits) and the length, records by their names. Needs ``1 <= min_bytes < 2**32 - 1``. An empty table gives no rows.
    """
    if not 1 <= min_bytes < 0xFFFFFFFF:
        raise ValueError("min_bytes must lie between 1 and 2**32 - 2")
    spark = entries.sparkSession
    low = F.lower(F.col(fp).cast("string"))
    raw = F.when(F.length(low) == 64, F.try_to_binary(low, F.lit("hex")))
    code = F.coalesce(raw, F.unhex(F.sha2(low, 256)))
    own = entries.where(F.col(record).isNotNull() & F.col(ordinal).isNotNull()).select(
        F.col(record).cast("string").alias("record"), F.col(ordinal).cast("bigint").alias("ordinal"),
        code.alias("code"), F.col(size).cast("bigint").alias("size"),
    )
    frequent = np.array([int.from_bytes(x[:8], "little") for x in frequent_elements(own, heavy_share)], np.uint64)
    width = shuffle_width(spark)
    dealt = _pieces(own, min_bytes, piece).repartition(width, "record", "piece").sortWithinPartitions("record", "piece", "ordinal")
    mapped = "bucket bigint, packed binary, lo string, hi string, n bigint, string binary, record string, start bigint"
    mapped = cut(dealt.mapInArrow(_strings(min_bytes, frequent, rows), mapped))
    strings = mapped.where("packed is not null").select("bucket", "packed", "lo", "hi", "n")
    # at most one bucket in ``bucket_rows`` strings is too full for one worker
    full = cut(strings.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket"))
    ranges_of = "string binary, a bigint, b bigint, n bigint"
    usual = strings.join(F.broadcast(full), "bucket", "left_anti").repartition(width, "bucket").sortWithinPartitions("bucket")
    found = usual.mapInArrow(_count(min_bytes, bucket_rows), ranges_of)
    if not full.isEmpty():
        hot = strings.join(F.broadcast(full), "bucket", "left_semi")
        found = found.unionByName(_split_by_window(hot, min_bytes, heavy_share))
    marked = cut(
        found.groupBy("string")
        .agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.max("n").alias("n"))
        .withColumn("key", F.xxhash64("string"))
    )
    places = mapped.where("record is not null").select("string", "record", "start").withColumn("key", F.xxhash64("string"))
    known = marked.drop("n")
    total, wide = marked.agg(F.sum("n"), F.sum(F.size("spans") * 16 + 40)).first()
    if (wide or 0) <= broadcast_bytes:
        met = places.join(F.broadcast(known), ["key", "string"])
    else:
        top = marked.where(F.col("n") >= max(2, int(total * heavy_share))).select("key").collect()
        met = split_join(places, known, ["string"], "key", [r[0] for r in top])
    return (
        met.select("record", "start", F.explode("spans").alias("span"))
        .select("record", F.explode(F.sequence(F.col("start") + F.col("span.a"), F.col("start") + F.col("span.b"))).alias("ordinal"))
        .distinct()
    )


def sharing_report(entries: DataFrame, min_bytes: int = MIN_BYTES, record: str = "manifest_id", ordinal: str = "ordinal", size: str = "len", **more) -> DataFrame:
    """For each record ``record, bytes, shared_bytes, shared_part``: its bytes, those in shared spans, and
    their quotient (null for a record of 0 bytes). Null lengths add nothing; repeated rows count once."""
    found = shared_spans(entries, min_bytes, record=record, ordinal=ordinal, size=size, **more).withColumn("hit", F.lit(1))
    own = entries.where(F.col(record).isNotNull() & F.col(ordinal).isNotNull())
    own = own.groupBy(F.col(record).cast("string").alias("record"), F.col(ordinal).cast("bigint").alias("ordinal"))
    own = own.agg(F.max(F.col(size).cast("bigint")).alias("size"))
    joined = own.join(found, ["record", "ordinal"], "left")
    sums = joined.groupBy("record").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("size"))), F.lit(0)).alias("shared_bytes"),
    )
    part = F.when(F.col("bytes") > 0, F.col("shared_bytes") / F.col("bytes"))
    return sums.withColumn("shared_part", part)
