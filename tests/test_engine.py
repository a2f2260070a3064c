"""The engine from end to end, the container files and the streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairnfold import cli
from cairnfold.api import Engine, Settings, StoreError
from cairnfold.operators.chunking import METHOD_KEY, ContentChunker
from cairnfold.sources import container_file, files
from cairnfold.streaming import ingest

R = random.Random(0)
A, B = b"A" * 5000, bytes(R.randrange(256) for _ in range(5000))
PUT = "bucket string, name string, body binary, user_defined map<string,string>"


def engine(spark, path, codec="snappy"):
    return Engine(spark, str(path), Settings(codec, 4096, ContentChunker(256, 64, 1024)))


def test_life_of_objects(spark, tmp_path):
    e = engine(spark, tmp_path / "s")
    assert e.make_bucket("team.docs") and not e.make_bucket("team.docs") and e.make_bucket("team.copy")
    with pytest.raises(StoreError, match="invalid_bucket_name"):
        e.make_bucket("nodots")
    rows = [("team.docs", "a/1", A + B, {METHOD_KEY: "FixedCDC"}), ("team.docs", "a/2", A + B, None), ("team.docs", "empty", b"", None), ("team.docs", "dir/", b"", None)]
    stats = {x.name: x for x in e.put(spark.createDataFrame(rows, PUT)).collect()}
    assert stats["a/1"].dedup_rate > 0.4 and stats["empty"].manifest_id is None and stats["dir/"].is_dir
    assert e.get("team.docs", "a/1") == A + B == e.get("team.docs", "a/2") and e.get("team.docs", "empty") == b""
    assert e.get("team.docs", "a/2", 4990, 30) == (A + B)[4990:5020]
    # what is stored already is not stored again
    before = e.table("blocks").count()
    assert e.put(spark.createDataFrame(rows, PUT)).count() == 0
    again = e.put(spark.createDataFrame([("team.docs", "again", A + B, None)], PUT)).first()
    assert again.written_bytes == 0 and again.dedup_rate == 1.0 and e.table("blocks").count() == before
    # an object is replaced, a copy keeps the content
    e.copy("team.docs", "a/1", "team.copy", "x")
    e.put(spark.createDataFrame([("team.docs", "a/1", b"new", None)], PUT))
    assert e.get("team.docs", "a/1") == b"new" and e.get("team.copy", "x") == A + B
    gone = e.delete(spark.createDataFrame([("team.docs", "a/2"), ("team.docs", "again"), ("team.docs", "never")], "bucket string, name string"))
    assert {x.name: x.status for x in gone.collect()} == {"a/2": "deleted", "again": "deleted", "never": "absent"}
    e.gc()
    assert e.get("team.copy", "x") == A + B
    with pytest.raises(StoreError, match="bucket_not_empty"):
        e.remove_bucket("team.copy")
    e.delete(e.table("objects").select("bucket", "name"))
    assert e.gc()["swept"] > 0
    for t in ("blocks", "fp_index", "refs", "objects", "manifest_entries", "deleted_containers"):
        assert e.table(t).count() == 0, t
    e.remove_bucket("team.copy")
    assert [x.name for x in e.list_buckets().collect()] == ["team.docs"]


def test_requests_that_are_wrong(spark, tmp_path):
    e = engine(spark, tmp_path / "s", "zlib")
    e.make_bucket("team.docs")
    put = lambda *rows: e.put(spark.createDataFrame(list(rows), PUT))
    put(("team.docs", "x", B, None))
    for code, f in {
        "no_such_bucket": lambda: put(("team.none", "x", B, None)),
        "folder_with_content": lambda: put(("team.docs", "d/", B, None)),
        "repeated_name": lambda: put(("team.docs", "y", B, None), ("team.docs", "y", A, None)),
        "no_such_object": lambda: e.get("team.docs", "none"),
        "invalid_range": lambda: e.get("team.docs", "x", 0, -2),
        "precondition_failed": lambda: e.get("team.docs", "x", if_match="0"),
        "no_such_upload": lambda: e.abort_upload("none"),
        "other_namespace": lambda: e.copy("team.docs", "x", "else.docs", "x"),
        "no_such_backup": lambda: e.restore("team.docs", "none", str(tmp_path)),
        "immutable_setting": lambda: engine(spark, tmp_path / "s", "none"),
    }.items():
        with pytest.raises(StoreError, match=code):
            f()
    assert e.get("team.docs", "x") == B


def test_uploads_in_parts(spark, tmp_path):
    e = engine(spark, tmp_path / "s", "none")
    e.make_bucket("team.docs")
    u = e.start_upload("team.docs", "big", {METHOD_KEY: "FixedCDC"})
    e.put_parts(u, spark.createDataFrame([(1, B), (2, B)], "part_no int, body binary"))
    parts = {x.part_no: x.etag for x in e.put_parts(u, spark.createDataFrame([(1, A), (3, b"end")], "part_no int, body binary")).collect()}
    etag2 = {x.part_no: x.etag for x in e.table("mp_parts").collect()}[2]
    with pytest.raises(StoreError, match="invalid_part"):
        e.complete_upload(u, [(1, "0" * 32)])
    done = e.complete_upload(u, [(2, etag2), (1, parts[1]), (3, parts[3])]).first()
    assert done["size"] == 10_003 and done.etag.endswith("-3")
    assert e.get("team.docs", "big") == B + A + b"end"
    assert e.table("mp_uploads").count() == 0 and e.table("mp_parts").count() == 0


def test_backup_and_restore(spark, tmp_path):
    e = engine(spark, tmp_path / "s")
    e.make_bucket("team.docs")
    src = tmp_path / "tree"
    (src / "sub" / "deep").mkdir(parents=True)
    (src / "f.txt").write_bytes(b"hello")
    (src / "sub" / "g").write_bytes(B)
    (src / "sub" / "deep" / "h").write_bytes(b"")
    e.backup("team.docs", str(src), "tree-1")
    assert e.archive_list("team.docs", "tree-1").count() == 6
    e.restore("team.docs", "tree-1", str(tmp_path / "all"))
    assert (tmp_path / "all" / "tree" / "sub" / "g").read_bytes() == B and (tmp_path / "all" / "tree" / "f.txt").read_bytes() == b"hello"
    e.restore("team.docs", "tree-1", str(tmp_path / "part"), ["tree/sub/deep"])
    assert not (tmp_path / "part" / "tree" / "f.txt").exists() and (tmp_path / "part" / "tree" / "sub" / "deep" / "h").exists()
    e.delete_backup("team.docs", "tree-1")
    assert e.table("archives").count() == 0 and e.table("objects").count() == 0


def test_container_files(spark, tmp_path):
    fps = ["%064x" % i for i in range(5)]
    blocks = [(f, bytes([i]) * (i * 10), 0) for i, f in enumerate(fps)]
    path = str(tmp_path / "0" / "DC7")
    container_file.write_container(path, blocks)
    assert [(f, n) for f, _, n, _, _ in container_file.read_footer(path)] == [(f, len(d)) for f, d, _ in blocks]
    assert container_file.write_container(str(tmp_path / "0" / "DC8"), []) == 0 and not os.path.exists(tmp_path / "0" / "DC8")
    spark.dataSource.register(container_file.ContainerSource)
    got = spark.read.format("container").load(str(tmp_path)).orderBy("offset", "fp").collect()
    assert [(x.dcid, x.fp, bytes(x.payload)) for x in got] == [(7, f, d) for f, d, _ in blocks]
    for data, what in ((b"short", "too small"), (b"x" * 40, "not a container"), (bytes.fromhex("46434458") + b"\x02\0\0\0" + b"\0" * 20, "version")):
        (tmp_path / "bad").write_bytes(data)
        with pytest.raises(container_file.ContainerError, match=what):
            container_file.read_footer(str(tmp_path / "bad"))
    m = str(tmp_path / "manifest")
    entries = [(fps[0], 1024, 1), (fps[1], 2048, 2), (fps[2], 4096, 1)]
    assert container_file.write_manifest(m, entries) == [1, 2]
    assert container_file.read_manifest(m) == entries and container_file.read_manifest_containers(m) == [1, 2]


def test_streamed_ingest_equals_a_batch(spark, tmp_path):
    rows = [("team.docs", f"o{i}", (A + B)[i * 100 : i * 100 + 3000], None) for i in range(12)]
    df = spark.createDataFrame(rows, PUT)
    for i in range(3):
        df.where(F.col("name").isin([f"o{k}" for k in range(i * 4, i * 4 + 4)])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, batch = engine(spark, tmp_path / "a"), engine(spark, tmp_path / "b")
    for e in (stream, batch):
        e.make_bucket("team.docs")
    for _ in range(2):  # what comes twice is stored once
        src = spark.readStream.schema(PUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, src, str(tmp_path / f"cp{_}")).awaitTermination()
    batch.put(df)
    assert stream.table("objects").count() == 12
    total = lambda e: e.table("blocks").agg(F.countDistinct("fp")).first()[0]
    assert total(stream) == total(batch) == stream.table("blocks").count()
    assert all(stream.get("team.docs", n) == b for _, n, b, _ in rows)


def test_stream_of_unique_chunks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, A[:1000]), ("a", 2, A[:1000] + B[:500])], "namespace string, obj_seq long, body binary")
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("namespace string, obj_seq long, body binary").parquet(str(tmp_path / "in"))
    q = ingest.unique_chunks(src, 100).writeStream.format("memory").queryName("uniq").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("uniq").count() == 6


def test_tags(spark, tmp_path):
    e = engine(spark, tmp_path / "s")
    e.make_bucket("team.docs")
    e.put(spark.createDataFrame([("team.docs", "x", B, {METHOD_KEY: "FixedCDC"}), ("team.docs", "y", A, None)], PUT))
    assert e.tags("team.docs", "x") == {}
    e.set_tags("team.docs", "x", {"a": "1", "b": "2"})
    e.set_tags("team.docs", "x", {"a": "3"})
    assert e.tags("team.docs", "x") == {"a": "3"} and e.tags("team.docs", "y") == {}
    assert e.head("team.docs", "x").first().user_defined[METHOD_KEY] == "FixedCDC"
    e.set_tags("team.docs", "x", {})
    assert e.tags("team.docs", "x") == {} and e.get("team.docs", "x") == B


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a").write_bytes(B)
    (tmp_path / "in" / "sub" / "b").write_bytes(A)
    c = ContentChunker(256, 64, 1024)
    for fixed in (True, False):
        got = files.chunk_files(spark, str(tmp_path / "in"), c, fixed).groupBy("path").agg(F.sum("len").alias("n")).collect()
        assert sorted(x.n for x in got) == [5000, 5000]
    assert files.file_hashes(str(tmp_path / "in" / "a"))[0] == __import__("base64").b64encode(__import__("hashlib").md5(B).digest()).decode()
    assert files.pack_tar(str(tmp_path / "in"), str(tmp_path / "t.tar")) == 4
    done, skipped = files.unpack_tar(str(tmp_path / "t.tar"), str(tmp_path / "out"))
    assert len(done) == 4 and not skipped and (tmp_path / "out" / "in" / "a").read_bytes() == B
    import io
    import tarfile

    with tarfile.open(tmp_path / "bad.tar", "w") as tar:
        info = tarfile.TarInfo("../evil")
        info.size = 1
        tar.addfile(info, io.BytesIO(b"x"))
    with pytest.raises(ValueError, match="leave"):
        files.unpack_tar(str(tmp_path / "bad.tar"), str(tmp_path / "out"))
    assert not (tmp_path / "evil").exists()


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "f").write_bytes(B)
    run = lambda *a: cli.run(cli.parser().parse_args(["--store", str(tmp_path / "s"), *a]), spark)
    run("mb", "team.docs")
    run("upload", "team.docs", str(tmp_path / "tree" / "f"), "--object-name", "x/f", "--part-size", "2000")
    run("download", "team.docs", "x/f", str(tmp_path / "back"))
    assert (tmp_path / "back").read_bytes() == B
    capsys.readouterr()
    run("ls", "team.docs", "--delimiter", "/")
    assert capsys.readouterr().out == "x/\n"
    run("backup", "team.docs", str(tmp_path / "tree"))
    name = capsys.readouterr().out.strip()
    run("restore", "team.docs", name, str(tmp_path / "again"))
    assert (tmp_path / "again" / "tree" / "f").read_bytes() == B
    run("del-backup", "team.docs", name)
    run("delete", "team.docs", "x/f")
    run("gc")
    run("rb", "team.docs")
    assert cli.size_of("64M") == 64 << 20
