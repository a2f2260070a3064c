"""Operators on small cases, against slow versions."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfold.operators import archive, chunking, dedup, gc, listing, manifest, multipart, packing, reader, refs
from cairnfold.operators.chunking import ContentChunker, byte_gear


def slow_lengths(c: ContentChunker, data: bytes) -> list[int]:
    gear = [int(x) for x in byte_gear(c.seed)]
    hard, easy = ((1 << b) - 1 for b in c.bits)
    out, at = [], 0
    while at < len(data):
        rest = data[at:]
        n = len(rest)
        if n <= c.minimum:
            out.append(n)
            break
        h, end = 0, min(n, c.maximum)
        for i in range(c.minimum, min(n, c.maximum)):
            h = ((h << 1) + gear[rest[i]]) % 2**64
            if h & (hard if i < min(n, c.average) else easy) == 0:
                end = i + 1
                break
        out.append(end)
        at += end
    return out


@given(st.binary(max_size=4000), st.sampled_from([(256, 64, 1024), (300, 100, 1200), (1024, 256, 2048), (128, 64, 129)]), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_content_chunks_equal_the_slow_way(data, sizes, norm):
    c = ContentChunker(*sizes, norm=norm)
    got = c.lengths(data)
    assert got == slow_lengths(c, data)
    assert sum(got) == len(data)
    assert all(c.minimum < n <= c.maximum for n in got[:-1])


def test_blocks_of_the_buffer_do_not_matter(monkeypatch):
    r = random.Random(9)
    data = bytes(r.randrange(256) for _ in range(30_000))
    c = ContentChunker(256, 64, 1024)
    want = slow_lengths(c, data)
    for block in (32, 100, 4096):
        monkeypatch.setattr(chunking, "_BLOCK", block)
        assert c.lengths(data) == want


@pytest.mark.parametrize("data", [bytes(b for b in range(100) for _ in range(100)) + b"a" * 1024, b"\x01" * 5000 + b"\xff" * 5000 + bytes(i % 256 for i in range(10_000)), b"A" * 2**17])
def test_chunks_of_regular_data(data):
    c = ContentChunker(4096, 1024, 8192)
    got = c.lengths(data)
    assert got == slow_lengths(c, data) and len(got) > 1 and max(got) <= 8192


def test_chunks_move_with_the_content():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(200_000))
    c = ContentChunker(4096, 1024, 8192)

    def pieces(b):
        at, out = 0, set()
        for n in c.lengths(b):
            out.add(b[at : at + n])
            at += n
        return out

    a, b = pieces(data), pieces(data[:5000] + b"abc" + data[5000:])
    assert len(a & b) >= len(a) - 3


@pytest.mark.parametrize("bad", [{"average": 0}, {"average": 4096, "minimum": 10}, {"average": 4096, "maximum": 2**31}, {"average": 4096, "minimum": 8192, "maximum": 4096}, {"average": 10_000, "minimum": 100, "maximum": 8192}, {"average": 4096, "norm": 4}])
def test_chunker_options(bad):
    with pytest.raises(ValueError):
        ContentChunker(**bad)


@pytest.mark.parametrize(("data", "lens"), [(b"", []), (b"hello", [5]), (b"0123456789", [10]), (b"x" * 20, [10, 10]), (b"x" * 23, [10, 10, 3]), (None, [])])
def test_fixed_chunks(spark, data, lens):
    df = spark.createDataFrame([(1, data)], "id int, body binary")
    got = chunking.fixed_chunks(df, "body", ["id"], 10, payload=True).orderBy("ordinal").collect()
    assert [x.len for x in got] == lens
    assert b"".join(bytes(x.payload) for x in got) == (data or b"")
    assert [x.fp for x in got] == [hashlib.sha256(bytes(x.payload)).hexdigest() for x in got]
    assert [x.chunk_offset for x in got] == [10 * i for i in range(len(lens))]


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "namespace string, obj_seq long, ordinal int, fp string, len long")


def test_classify_equals_one_by_one(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), o, i, "hot" if r.random() < 0.4 else r.choice([*"pqrstuv", None]), 5) for o in range(30) for i in range(12)]
    index = [("a", "p", 7), ("a", "p", 9), ("b", "q", 8), ("b", "r", None)]
    df = spark.createDataFrame(index, "namespace string, fp string, dcid long")
    for share in (0.002, 0.9):
        got = {(x.namespace, x.obj_seq, x.ordinal): (x.status, x.dcid) for x in dedup.classify(_chunks(spark, rows), df, heavy_share=share).collect()}
        known, seen, want = {("a", "p"): 7, ("b", "q"): 8}, {}, {}
        for ns, o, i, f, _ in sorted(rows, key=lambda x: x[1:3]):
            if f is not None and (ns, f) in known:
                want[ns, o, i] = ("indexed", known[ns, f])
            elif f is None or (ns, f) not in seen:
                want[ns, o, i] = ("new", None)
                seen[ns, f] = o
            else:
                want[ns, o, i] = ("repeated" if seen[ns, f] == o else "shared", None)
        assert got == want


def test_packing_fold(spark):
    r = random.Random(3)
    rows = [("a", o, i, f"{o}-{i}", r.choice([1, 10, 50, 91, 92, 93, 200])) for o in range(40) for i in range(r.randrange(1, 20))]
    got = packing.pack_containers(_chunks(spark, rows), ["namespace", "obj_seq"], ["ordinal"], capacity=100, rows=50)
    numbered = packing.number_containers(got, ["namespace"], ["namespace", "obj_seq"], base=10, sessions_in_block=7).collect()
    want, last = {}, 10
    for o in range(40):
        own = [x for x in rows if x[1] == o]
        no, off = 0, 8
        for _, _, i, _, n in own:
            if off + n >= 100:
                no, off = no + 1, 8
            want[o, i] = (no, off, last + no + 1)
            off += n
        last += no + 1
    assert {(x.obj_seq, x.ordinal): (x.container_no, x.block_offset, x.dcid) for x in numbered} == want


def test_manifest(spark):
    rows = [("a", "m1", 0, 0, "f1", 1024, 1), ("a", "m1", 1, None, "f2", 2048, 2), ("a", "m1", 2, 3072, "f3", 4096, 1), ("a", "m2", 1, 5, "f3", 1, None)]
    df = spark.createDataFrame(rows, "namespace string, manifest_id string, ordinal int, chunk_offset long, fp string, len long, dcid long")
    assert [x.fp for x in manifest.scan(df, "m1").collect()] == ["f1", "f2", "f3"]
    assert [x.chunk_offset for x in manifest.with_offsets(manifest.scan(df, "m1")).orderBy("ordinal").collect()] == [0, 1024, 3072]
    assert {(x.manifest_id, x.dcid) for x in manifest.containers_of(df).collect()} == {("m1", 1), ("m1", 2)}
    assert {x.manifest_id for x in manifest.check(df).collect()} == {"m2"}
    assert manifest.drop(df, df.where("manifest_id = 'm1'")).count() == 1


def test_references_and_collection(spark):
    own = spark.createDataFrame([("a", 100, "a.b", "x"), ("a", 100, "a.b", "y"), ("a", 200, "a.b", "x"), ("a", 300, "a.c", "x")], "namespace string, dcid long, bucket string, object string")
    gone = spark.createDataFrame([("a.b", "x"), ("a.b", "nothing")], "bucket string, object string")
    assert [(x.namespace, x.dcid) for x in refs.dereferenced(own, gone).collect()] == [("a", 200)]
    assert refs.remove(own, gone).count() == 2
    assert refs.add(own, own).count() == 4
    queue = spark.createDataFrame([("a", 100), ("a", 200), ("a", 400), ("a", 200)], "namespace string, dcid long")
    index = spark.createDataFrame([("a", "f", 200), ("a", "g", 300), ("b", "f", 200)], "namespace string, fp string, dcid long")
    assert {x.dcid for x in gc.victims(queue, refs.remove(own, gone)).collect()} == {200, 400}
    assert {(x.namespace, x.fp) for x in gc.remove_fingerprints(index, queue).collect()} == {("a", "g"), ("b", "f")}
    there = spark.createDataFrame([("a", 200)], "namespace string, dcid long")
    got = {x.dcid: (x.action, x.fingerprints) for x in gc.sweep_report(queue, refs.remove(own, gone), there, index).collect()}
    assert got == {100: ("kept", 0), 200: ("swept", 1), 400: ("missing", 0)}


@pytest.mark.parametrize("broadcast_bytes", [0, 10_000])
def test_missing_blocks(spark, broadcast_bytes):
    entries = spark.createDataFrame([("a", 1, "f", "m1"), ("a", 1, "f", "m2"), ("a", 1, "g", "m1"), ("a", None, "f", "m3"), (None, 1, "f", "m4")], "namespace string, dcid long, fp string, manifest_id string")
    blocks = spark.createDataFrame([("a", 1, "f"), ("a", 2, "g"), (None, 1, "f")], "namespace string, dcid long, fp string")
    got = reader.missing_blocks(entries, blocks, broadcast_bytes)
    assert got.columns == entries.columns
    assert sorted(x.manifest_id for x in got.collect()) == ["m1", "m3", "m4"]


def test_ranges(spark):
    rows = [("m", i, i * 10, 10) for i in range(5)]
    df = spark.createDataFrame(rows, "manifest_id string, ordinal int, chunk_offset long, len long")
    data = bytes(range(50))
    for start, length in [(0, -1), (0, 0), (7, 5), (9, 1), (10, 10), (45, 100), (50, 1), (3, 41)]:
        plan = reader.range_plan(df, start, length).orderBy("ordinal").collect()
        got = b"".join(data[x.chunk_offset + x.skip : x.chunk_offset + x.skip + x.take] for x in plan)
        assert got == (data[start:] if length == -1 else data[start : start + length])
    e = spark.createDataFrame([(-1, 5, 50), (0, -2, 50), (51, 1, 50), (50, 1, 50)], "s long, n long, size long")
    assert [x[0] for x in e.select(reader.range_error(F.col("s"), F.col("n"), F.col("size"))).collect()] == ["invalid_range"] * 3 + [None]


def test_pages_lose_nothing(spark):
    names = ["a", "b/1", "b/2", "b/x/3", "c", "d/1", "e", "f/", "f/1"]
    df = spark.createDataFrame([("k", n) for n in names] + [("other", "zz")], "bucket string, name string")
    for delimiter, want in (("", sorted(names)), ("/", ["a", "b/", "c", "d/", "e", "f/"])):
        for k in (1, 2, 4, 100):
            got, token = [], ""
            for _ in range(20):
                p = listing.page(df, "k", delimiter=delimiter, token=token, max_keys=k)
                got += sorted(p.names + p.prefixes)
                if not p.truncated:
                    break
                token = p.next_token
            assert got == want, (delimiter, k)
    assert listing.page(df, "k", prefix="b/", delimiter="/").prefixes == ["b/x/"]
    assert listing.page(df, "k", prefix="b/", start_after="b/1").names == ["b/2", "b/x/3"]


def test_multipart(spark):
    stored = spark.createDataFrame([("u", 1, "e1", 10, 1), ("u", 1, "e1b", 12, 2), ("u", 2, "e2", 20, 1)], "upload_id string, part_no int, etag string, size long, seq long")
    own = multipart.latest_parts(stored)
    assert {(x.part_no, x.etag) for x in own.collect()} == {(1, "e1b"), (2, "e2")}
    asked = spark.createDataFrame([("u", 0, 2, '"e2"'), ("u", 1, 1, "e1"), ("u", 2, 3, "e3")], "upload_id string, position int, part_no int, etag string")
    assert {x.part_no: x.error for x in multipart.check_parts(asked, own).collect()} == {2: None, 1: "invalid_part", 3: "invalid_part"}


def test_archive_selection(spark):
    rows = [("b", "src/", 0, 493, 53), ("b", "src/a.txt", 5, 420, 48), ("b", "src/sub/", 0, 493, 53), ("b", "src/sub/b", 7, 420, 48), ("b", "src/subway", 3, 420, 48)]
    df = archive.lay_out(spark.createDataFrame(rows, "backup_id string, name string, size long, mode long, typeflag int"))
    assert {x.name: x.offset for x in df.collect()} == {"src/": 0, "src/a.txt": 0, "src/sub/": 5, "src/sub/b": 5, "src/subway": 12}
    assert {x.name for x in archive.select(df, ["src/sub/"]).collect()} == {"src/", "src/sub/", "src/sub/b"}
    assert {x.name for x in archive.select(df, ["src/a.txt", "nothing"]).collect()} == {"src/", "src/a.txt"}
    assert archive.select(df, None).count() == 5
    assert {(x.first_byte, x.last_byte) for x in archive.byte_ranges(df).collect()} == {(0, 4), (5, 11), (12, 14)}
