"""Commits by several writers, compaction, sweeps that fail in part, parts of large reads and uploads."""

import threading

import pytest
from pyspark.sql import functions as F

from cairnfold.api import Engine, Settings
from cairnfold.operators import chunking, reader
from cairnfold.operators.skew import salted_join
from cairnfold.sources.container_file import ContainerSource
from cairnfold.sources.store import ConflictError, Store

BUCKETS = "name STRING, namespace STRING, uuid STRING, created TIMESTAMP, location STRING"


def _row(spark, name):
    return spark.createDataFrame([(name, "n", "u", None, None)], BUCKETS)


def test_of_two_writers_one_fails_and_nothing_is_lost(spark, tmp_path):
    root = str(tmp_path / "store")
    first, second = Store(spark, root), Store(spark, root)
    seen = second.state()
    first.commit(append={"buckets": _row(spark, "a")})
    second.state = lambda: seen  # it read before the other one published
    with pytest.raises(ConflictError):
        second.commit(append={"buckets": _row(spark, "b")})
    del second.state
    second.commit(append={"buckets": _row(spark, "b")})
    assert {r["name"] for r in first.read("buckets").collect()} == {"a", "b"}


def test_writers_at_once(spark, tmp_path):
    root, done, failed = str(tmp_path / "store"), [], []

    def write(name):
        store = Store(spark, root)
        for _ in range(10):
            try:
                store.commit(append={"buckets": _row(spark, name)})
                done.append(name)
                return
            except ConflictError:
                failed.append(name)

    threads = [threading.Thread(target=write, args=(x,)) for x in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == list("abc")
    store = Store(spark, root)
    assert sorted(r["name"] for r in store.read("buckets").collect()) == list("abc")
    assert store.state()["commit"] == 3


def test_compact_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for i in range(9):
        store.commit(append={"buckets": _row(spark, f"b{i}")})
    assert store.compact("buckets") == 9 and store.compact("buckets") == 0
    assert len(store.state()["tables"]["buckets"]) == 1
    assert store.vacuum() == 9
    assert store.read("buckets").count() == 9


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"), Settings(capacity=4096, chunker=chunking.ContentChunker(256, 64, 1024)))
    e.make_bucket("team.docs")
    return e


def _put(engine, rows):
    return engine.put(engine.spark.createDataFrame([("team.docs", n, bytearray(b)) for n, b in rows], "bucket string, name string, body binary"))


def test_a_batch_that_fails_stays_queued(spark, engine, monkeypatch):
    _put(engine, [(f"o{i}", bytes([i]) * 3000) for i in range(3)])
    engine.delete(engine.table("objects").select("bucket", "name"))
    queued = engine.table("deleted_containers").count()
    assert queued > 0
    monkeypatch.setattr(engine, "_sweep", lambda mine: 1 / 0)
    assert engine.gc() == {"swept": 0, "fingerprints": 0, "queued": queued}
    assert engine.table("deleted_containers").count() == queued
    monkeypatch.undo()
    done = engine.gc()
    assert done["swept"] == queued and done["queued"] == 0
    assert engine.table("blocks").isEmpty() and engine.table("fp_index").isEmpty() and engine.table("deleted_containers").isEmpty()


def test_parts_uploads_and_ranges(spark, engine):
    body = bytes(range(256)) * 60
    _put(engine, [("big", body), ("empty", b"")])
    parts = list(engine.stream("team.docs", "big", 10, 9000, part_bytes=2048))
    assert len(parts) > 2 and b"".join(parts) == body[10:9010]
    assert list(engine.stream("team.docs", "empty")) == [] and engine.get("team.docs", "empty") == b""
    asked = spark.createDataFrame([("team.docs", "big", 0, 5), ("team.docs", "big", 700, 9), ("team.docs", "none", 0, 1)], "bucket string, name string, start bigint, length bigint")
    assert {(r["start"], bytes(r["body"])) for r in engine.read(asked).collect()} == {(0, body[:5]), (700, body[700:709])}
    upload = engine.start_upload("team.docs", "made/it")
    engine.put_parts(upload, spark.createDataFrame([(1, bytearray(b"head"))], "part_no int, body binary"))
    engine.copy_part(upload, 2, "team.docs", "big", 100, 50)
    assert [u["upload_id"] for u in engine.list_uploads("team.docs", "made/").collect()] == [upload]
    listed = engine.list_parts(upload).collect()
    assert [(r["part_no"], r["size"]) for r in listed] == [(1, 4), (2, 50)]
    assert [r["part_no"] for r in engine.list_parts(upload, after=1).collect()] == [2]
    engine.complete_upload(upload, [(r["part_no"], r["etag"]) for r in listed])
    assert engine.get("team.docs", "made/it") == b"head" + body[100:150]


def test_a_read_opens_only_the_folders_of_its_containers(spark, engine):
    _put(engine, [("a", b"x" * 2000)])
    engine.make_bucket("other.docs")
    engine.put(spark.createDataFrame([("other.docs", "b", bytearray(b"y" * 2000))], "bucket string, name string, body binary"))
    asked = spark.createDataFrame([("team.docs", "a")], "bucket string, name string")
    files = [f for f in engine._pieces(asked)[1].inputFiles() if "/blocks/" in f]
    assert files and all("namespace=team" in f for f in files)


def test_containers_go_out_as_files(spark, engine, tmp_path):
    _put(engine, [(f"o{i}", bytes([i]) * 3000) for i in range(3)])
    root = "file://" + str(tmp_path / "out")
    written = engine.export_containers(root).collect()
    assert len(written) == engine.table("blocks").select("dcid").distinct().count()
    spark.dataSource.register(ContainerSource)
    got = {(r["dcid"], r["fp"], bytes(r["payload"])) for r in spark.read.format("container").load(root).collect()}
    assert got == {(r["dcid"], r["fp"], bytes(r["payload"])) for r in engine.table("blocks").collect()}


def test_assemble_in_order(spark):
    rows = [(k, i, bytes([k, i % 256, 0, 255])) for k in (1, 2) for i in range(300)]
    df = spark.createDataFrame([(k, i, bytearray(b)) for k, i, b in rows[::-1]], "k int, ordinal int, data binary")
    got = {r["k"]: bytes(r["body"]) for r in reader.assemble(df, ["k"]).collect()}
    assert got == {k: b"".join(b for x, _, b in rows if x == k) for k in (1, 2)}


def test_salted_join_makes_every_pair_once(spark):
    a = spark.createDataFrame([(1 if i < 60 else i, i) for i in range(100)], "key bigint, x int")
    b = spark.createDataFrame([(1 if i < 40 else i, i) for i in range(80)], "key bigint, y int")
    want = sorted(map(tuple, a.join(b, "key").collect()))
    assert sorted(map(tuple, salted_join(a, b, ["key"], "key", [1], salts=4).collect())) == want
    assert sorted(map(tuple, salted_join(a, b, [], "key", []).collect())) == want


def test_chunk_rates(spark):
    from cairnfold.operators.dedup import compress_rate

    df = spark.createDataFrame([(100, 25), (0, 0), (10, 12)], "w bigint, s bigint")
    assert [r[0] for r in df.select(compress_rate("w", "s")).collect()] == [0.75, 0.0, -0.2]
    assert df.where(F.lit(False)).select(compress_rate("w", "s")).count() == 0
