"""The engine: buckets, objects, uploads, archives and collection over one store."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfold.functions import codecs, naming
from cairnfold.operators import archive, chunking, dedup, gc, listing, multipart, packing, reader, refs
from cairnfold.session import cut
from cairnfold.sources import container_file
from cairnfold.sources.store import Store


class StoreError(ValueError):
    """What a request got wrong; ``code`` names it."""

    def __init__(self, code: str, what: str = ""):
        super().__init__(f"{code}: {what}" if what else code)
        self.code = code


@dataclass(frozen=True)
class Settings:
    """``compression`` and ``capacity`` cannot change once a store has them."""

    compression: str = "snappy"
    capacity: int = packing.CAPACITY
    chunker: chunking.ContentChunker = field(default_factory=lambda: chunking.ContentChunker(
        average=_size("CAIRNFOLD_CHUNK_AVG", 128 << 10), minimum=_size("CAIRNFOLD_CHUNK_MIN", 64 << 10), maximum=_size("CAIRNFOLD_CHUNK_MAX", 256 << 10)))


def _size(name: str, default: int) -> int:
    try:
        return int(os.environ[name])
    except (KeyError, ValueError):
        return default


def dense_numbers(df: DataFrame, keys: Sequence[str], name: str, base: int = 0, group: int = 1 << 20) -> DataFrame:
    """Numbers from ``base + 1`` without gaps, found again by any executor: counted by groups of a hash."""
    groups = max(1, -(-df.count() // group))
    own = df.withColumn("_g", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    before = Window.partitionBy().orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    start = own.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    nth = F.row_number().over(Window.partitionBy("_g").orderBy(*keys))
    return own.withColumn("_n", nth).join(start, "_g").withColumn(name, (F.lit(base) + F.col("_b") + F.col("_n")).cast("bigint")).drop("_g", "_n", "_b")


class Engine:
    """All methods read the last commit; those that change something make one commit."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.store = spark, Store(spark, root)
        self.settings = settings or Settings()
        codecs.codec(self.settings.compression)
        known = self.store.read("settings").collect()
        if not known:
            row = [("cairnfold", uuid.uuid4().hex, self.settings.capacity, self.settings.compression, naming.SHARD, 1)]
            self.store.commit(replace={"settings": self.spark.createDataFrame(row, "name string, uuid string, block_size bigint, compression string, shards int, meta_version int")})
        elif (known[0]["block_size"], known[0]["compression"]) != (self.settings.capacity, self.settings.compression):
            raise StoreError("immutable_setting", "capacity and compression belong to the store")

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _of(self, name: str, namespaces: Iterable[str]) -> tuple[DataFrame, list[str]]:
        """What a table laid out by namespace has of some, and the folders of that."""
        folders = self.store.folders_of(name, [(n,) for n in set(namespaces)])
        return self.store.read(name, folders), folders

    def _objects(self, bucket: str) -> DataFrame:
        return self._of("objects", [bucket.split(".")[0]])[0]

    def register_views(self) -> None:
        """The store's tables as temporary views for SQL."""
        for name in ("buckets", "objects", "manifest_entries", "fp_index", "blocks", "refs", "deleted_containers"):
            self.table(name).createOrReplaceTempView(name)

    # buckets

    def make_bucket(self, name: str, location: str | None = None) -> bool:
        """False where it was there already."""
        row = self.spark.createDataFrame([(name, location)], "name string, location string")
        error = row.select(naming.bucket_error("name")).first()[0]
        if error:
            raise StoreError("invalid_bucket_name", error)
        if not self.table("buckets").where(F.col("name") == name).isEmpty():
            return False
        new = row.select("name", naming.namespace_of("name").alias("namespace"), F.lit(uuid.uuid4().hex).alias("uuid"), F.current_timestamp().alias("created"), "location")
        self.store.commit(append={"buckets": new})
        return True

    def remove_bucket(self, name: str) -> None:
        own = self.table("buckets")
        if own.where(F.col("name") == name).isEmpty():
            raise StoreError("no_such_bucket", name)
        if not listing.with_prefix(self._objects(name), name).isEmpty():
            raise StoreError("bucket_not_empty", name)
        self.store.commit(replace={"buckets": cut(own.where(F.col("name") != name))})

    def list_buckets(self) -> DataFrame:
        return self.table("buckets").orderBy("name")

    # objects

    def put(self, objects: DataFrame) -> DataFrame:
        """Stores ``bucket, name, body`` (and ``user_defined``); returns the new rows of ``objects``.

        Later rows of one name in a call are not told apart: a name may come once. What is there with the same
        ETag is left alone; another object of the name is replaced. All buckets must exist.
        """
        if "user_defined" not in objects.columns:
            objects = objects.withColumn("user_defined", F.lit(None).cast("map<string,string>"))
        own = objects.select("bucket", "name", F.coalesce("body", F.lit(b"")).alias("body"), "user_defined")
        own = cut(own.withColumn("etag", F.md5("body")).withColumn("size", F.length("body").cast("bigint")))
        self._check_put(own)
        fresh = dedup.without_equal_etag(own, self.table("objects"))
        base = self.table("objects").agg(F.max("obj_seq")).first()[0] or 0
        numbered = cut(dense_numbers(fresh, ["bucket", "name"], "obj_seq", base).withColumn("namespace", naming.namespace_of("bucket")))
        keys = ["namespace", "obj_seq"]
        chunks = chunking.chunk_by_method(numbered, "body", keys, "user_defined", self.settings.chunker, payload=True).drop("method")
        return self._commit_chunks(numbered, chunks)

    def _check_put(self, own: DataFrame) -> None:
        missing = own.select(F.col("bucket").alias("b")).distinct().join(self.table("buckets"), F.col("b") == F.col("name"), "left_anti").limit(1).collect()
        if missing:
            raise StoreError("no_such_bucket", str(missing[0][0]))
        if not own.where(F.col("name").endswith("/") & (F.col("size") > 0)).isEmpty():
            raise StoreError("folder_with_content")
        if not own.groupBy("bucket", "name").count().where("count > 1").isEmpty():
            raise StoreError("repeated_name")

    def _commit_chunks(self, numbered: DataFrame, chunks: DataFrame) -> DataFrame:
        """Commits objects ``namespace, obj_seq, bucket, name, size, etag, user_defined`` with their chunks."""
        s = self.settings
        keys = ["namespace", "obj_seq"]
        live = dedup.live_index(self.table("fp_index"), self.table("deleted_containers"))
        marked = cut(dedup.classify(chunks.select(*keys, "ordinal", "chunk_offset", "len", "fp"), live))
        new = marked.where("status = 'new'").select(*keys, "ordinal")
        number = codecs.codec(s.compression).number
        stored = chunks.join(new, [*keys, "ordinal"], "left_semi").withColumn("stored", codecs.encode("payload", number))
        stored = cut(stored.select(*keys, "ordinal", "fp", "len", "stored", F.length("stored").cast("bigint").alias("stored_len"), F.crc32("stored").alias("crc")))
        base = self.table("blocks").agg(F.max("dcid")).first()[0] or 0
        old = self.table("deleted_containers").agg(F.max("dcid")).first()[0] or 0
        known = self.table("manifest_entries").agg(F.max("dcid")).first()[0] or 0
        packed = packing.pack_containers(stored.drop("stored"), keys, ["ordinal"], s.capacity, stored="stored_len")
        packed = cut(packing.number_containers(packed, ["namespace"], keys, max(base, old, known)))
        blocks = packed.join(stored.select(*keys, "ordinal", "stored"), [*keys, "ordinal"]).select(
            "namespace", naming.shard_of("dcid").alias("shard"), "dcid", "fp", F.col("block_offset").alias("offset"), "stored_len", "crc", F.lit(number).cast("tinyint").alias("codec"), F.col("stored").alias("payload")
        )
        fresh = packed.select("namespace", "fp", F.col("dcid").alias("_dcid"))
        entries = marked.join(fresh, ["namespace", "fp"], "left").select(
            "namespace", naming.manifest_name("obj_seq").alias("manifest_id"), F.col("ordinal").cast("int").alias("ordinal"), "chunk_offset", "fp", "len", F.coalesce("dcid", "_dcid").alias("dcid")
        )
        entries = cut(entries)
        stats = dedup.object_stats(numbered, marked, ["obj_seq"]).drop("size")
        sizes = packed.groupBy("obj_seq").agg(F.sum("stored_len").alias("_stored"))
        whole = numbered.drop("body").join(stats, "obj_seq").join(sizes, "obj_seq", "left")
        rows = cut(whole.select(
            "bucket", "name", "namespace", "obj_seq", "size", "etag", F.current_timestamp().alias("mod_time"), F.col("name").endswith("/").alias("is_dir"),
            F.when(F.col("chunks") > 0, naming.manifest_name("obj_seq")).alias("manifest_id"), "written_bytes", F.coalesce("_stored", F.lit(0)).alias("stored_bytes"), "dedup_rate", "user_defined",
        ))
        added = cut(refs.references(rows, entries))
        new = {"blocks": blocks, "fp_index": packed.select("namespace", "fp", "dcid"), "manifest_entries": entries}
        there = self.table("objects").join(rows.select("bucket", "name"), ["bucket", "name"], "left_semi")
        if there.isEmpty():
            queue = gc.dequeue(self.table("deleted_containers"), added)
            self.store.commit(append=new | {"objects": rows, "refs": added}, replace={"deleted_containers": cut(queue)})
        else:  # some objects are replaced: what `_without` leaves, and the new rows
            changes, folders = self._without(rows.select("bucket", F.col("name").alias("object")))
            entries = new.pop("manifest_entries")
            changes["objects"] = changes["objects"].unionByName(rows)
            changes["refs"] = refs.add(changes["refs"], added)
            changes["manifest_entries"] = changes["manifest_entries"].unionByName(entries)
            changes["deleted_containers"] = gc.dequeue(changes["deleted_containers"], added)
            self.store.commit(append=new, replace={k: cut(v) for k, v in changes.items()}, instead=folders)
        return self.table("objects").join(rows.select("obj_seq"), "obj_seq", "left_semi")

    def _without(self, named: DataFrame) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
        """The tables after the objects ``bucket, object`` are gone, with what they alone referred to queued; of objects,
        references and entries only the folders of the namespaces concerned, which come along."""
        spaces = [r[0] for r in named.select(naming.namespace_of("bucket").alias("n")).distinct().collect()]
        (objects, a), (own, b), (entries, c) = (self._of(t, spaces) for t in ("objects", "refs", "manifest_entries"))
        keys = named.select("bucket", F.col("object").alias("name")).distinct()
        gone = objects.join(keys, ["bucket", "name"], "left_semi")
        left = objects.join(keys, ["bucket", "name"], "left_anti")
        # a copied object keeps the manifest
        unused = gone.where("manifest_id is not null").select("manifest_id").distinct().join(left.select("manifest_id"), "manifest_id", "left_anti")
        return {
            "objects": left,
            "refs": refs.remove(own, named),
            "manifest_entries": entries.join(unused, "manifest_id", "left_anti"),
            "deleted_containers": gc.enqueue(self.table("deleted_containers"), refs.dereferenced(own, named)),
        }, {"objects": a, "refs": b, "manifest_entries": c}

    def delete(self, objects: DataFrame) -> DataFrame:
        """Deletes ``bucket, name``; returns them with ``status`` deleted or absent. Deleting what is not there is fine."""
        asked = cut(objects.select("bucket", "name").distinct())
        there = self.table("objects").select("bucket", "name").distinct().withColumn("_t", F.lit(1))
        out = cut(asked.join(there, ["bucket", "name"], "left").select("bucket", "name", F.when(F.col("_t") == 1, "deleted").otherwise("absent").alias("status")))
        changes, folders = self._without(asked.withColumnRenamed("name", "object"))
        self.store.commit(replace={k: cut(v) for k, v in changes.items()}, instead=folders)
        return out

    def copy(self, bucket: str, name: str, to_bucket: str, to_name: str) -> None:
        """A new name for a manifest: no byte is written. Both buckets must share a namespace."""
        row = self._one(bucket, name)
        if to_bucket.split(".")[0] != bucket.split(".")[0]:
            raise StoreError("other_namespace", to_bucket)
        if self.table("buckets").where(F.col("name") == to_bucket).isEmpty():
            raise StoreError("no_such_bucket", to_bucket)
        base = self.table("objects").agg(F.max("obj_seq")).first()[0] or 0
        rows = listing.head(self.table("objects"), bucket, name).withColumn("bucket", F.lit(to_bucket)).withColumn("name", F.lit(to_name))
        rows = cut(rows.withColumn("obj_seq", F.lit(base + 1).cast("bigint")).withColumn("written_bytes", F.lit(0).cast("bigint")).withColumn("stored_bytes", F.lit(0).cast("bigint")))
        changes, folders = self._without(rows.select("bucket", F.col("name").alias("object")))
        entries = self.table("manifest_entries").where(F.col("manifest_id") == row["manifest_id"])
        self.store.commit(replace={
            "objects": cut(changes["objects"].unionByName(rows)), "refs": cut(refs.add(changes["refs"], refs.references(rows, entries))),
            "deleted_containers": cut(changes["deleted_containers"]),
        }, instead={k: folders[k] for k in ("objects", "refs")})

    def head(self, bucket: str, name: str) -> DataFrame:
        return listing.head(self._objects(bucket), bucket, name)

    def tags(self, bucket: str, name: str) -> dict[str, str]:
        """The object's tags, which its user metadata holds under ``tag:``."""
        return {k[4:]: v for k, v in (self._one(bucket, name)["user_defined"] or {}).items() if k.startswith("tag:")}

    def set_tags(self, bucket: str, name: str, tags: dict[str, str]) -> None:
        """Replaces all tags; none at all deletes them."""
        self._one(bucket, name)
        new = F.create_map(*[F.lit(x) for k, v in tags.items() for x in ("tag:" + k, v)]) if tags else F.lit(None).cast("map<string,string>")
        none = F.create_map().cast("map<string,string>")
        own = F.map_filter(F.coalesce("user_defined", none), lambda k, _: ~k.startswith("tag:"))
        here = (F.col("bucket") == bucket) & (F.col("name") == name)
        objects, folders = self._of("objects", [bucket.split(".")[0]])
        rows = objects.withColumn("user_defined", F.when(here, F.map_concat(own, F.coalesce(new, none))).otherwise(F.col("user_defined")))
        self.store.commit(replace={"objects": cut(rows)}, instead={"objects": folders})

    def _one(self, bucket: str, name: str):
        row = self.head(bucket, name).first()
        if row is None:
            raise StoreError("no_such_object", f"{bucket}/{name}")
        return row

    def list(self, bucket: str, **how) -> listing.Page:
        return listing.page(self._objects(bucket), bucket, **how)

    def _pieces(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The requests with all columns, and the pieces of each with ``data`` and their place ``at`` in what is read. Only the
        folders of the containers that the manifests name are opened."""
        for c, v in (("start", 0), ("length", -1)):
            if c not in asked.columns:
                asked = asked.withColumn(c, F.lit(v).cast("bigint"))
        asked = asked.select("bucket", "name", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length")).distinct()
        spaces = [r[0] for r in asked.select(naming.namespace_of("bucket").alias("n")).distinct().collect()]
        own = cut(asked.join(self._of("objects", spaces)[0].select("bucket", "name", "manifest_id"), ["bucket", "name"]))
        entries = own.where("manifest_id is not null").join(self._of("manifest_entries", spaces)[0], "manifest_id")
        plan = cut(reader.range_plan(entries, F.col("start"), F.col("length")))
        shards = [tuple(r) for r in plan.select("namespace", naming.shard_of("dcid").alias("shard")).distinct().collect()]
        found = reader.locate(plan, self.store.read("blocks", self.store.folders_of("blocks", shards)))
        raw = codecs.decode("payload", F.col("codec"))
        found = found.withColumn("raw", raw).withColumn("at", F.col("chunk_offset") + F.col("skip") - F.col("start"))
        return own, found.withColumn("data", F.substring(F.col("raw"), (F.col("skip") + 1).cast("int"), F.col("take").cast("int")))

    def read(self, asked: DataFrame) -> DataFrame:
        """Bodies of ``bucket, name`` (and ``start, length``): ``bucket, name, start, length, body``. Objects without content
        have an empty body, those that are not there no row; a repeated request is one."""
        keys = ["bucket", "name", "start", "length"]
        own, pieces = self._pieces(asked)
        out = own.select(*keys).join(reader.assemble(pieces, keys), keys, "left")
        return out.select(*keys, F.coalesce("body", F.lit(b"")).alias("body"))

    def read_parts(self, asked: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
        """The same for objects of any size: ``bucket, name, start, length, part, body``, parts of about ``part_bytes`` in
        order; of an empty object there is none."""
        return reader.parts(self._pieces(asked)[1], ["bucket", "name", "start", "length"], "at", part_bytes)

    def stream(self, bucket: str, name: str, start: int = 0, length: int = -1, if_match: str | None = None, part_bytes: int = 64 << 20) -> Iterator[bytes]:
        """One object's bytes in parts, so that the driver never holds more than a few of them."""
        row = self._one(bucket, name)
        if start < 0 or length < -1 or start > row["size"]:
            raise StoreError("invalid_range", f"{start}+{length}")
        if if_match is not None and if_match.strip('"') != row["etag"]:
            raise StoreError("precondition_failed", if_match)
        asked = self.spark.createDataFrame([(bucket, name, start, length)], "bucket string, name string, start bigint, length bigint")
        return (bytes(r["body"]) for r in cut(self.read_parts(asked, part_bytes)).orderBy("part").toLocalIterator())

    def get(self, bucket: str, name: str, start: int = 0, length: int = -1, if_match: str | None = None) -> bytes:
        """One object's bytes, on the driver."""
        return b"".join(self.stream(bucket, name, start, length, if_match))

    # collection

    def gc(self, at_once: int = 10_000) -> dict[str, int]:
        """One pass over the queue. Containers that are referred to again leave it; the others lose their index rows and
        blocks, about ``at_once`` in a commit, of which only the folders concerned are rewritten. A batch that fails
        stays queued for the next pass while the others go."""
        queue, own = self.table("deleted_containers"), self.table("refs")
        victims = gc.victims(queue, own).withColumn("shard", naming.shard_of("dcid"))
        n = victims.count()
        batches = max(1, -(-n // at_once))
        victims = cut(victims.withColumn("_batch", F.pmod(F.xxhash64("namespace", "shard"), F.lit(batches))))
        done = {"swept": 0, "fingerprints": 0, "queued": 0}
        for batch in [r[0] for r in victims.select("_batch").distinct().collect()]:
            mine = victims.where(F.col("_batch") == batch)
            try:
                gone = self._sweep(mine)
            except Exception:  # noqa: BLE001  whatever it was, the next pass tries again
                done["queued"] += mine.count()
            else:
                done["swept"] += mine.count()
                done["fingerprints"] += gone
        kept = cut(gc.dequeue(queue, victims))
        if not kept.isEmpty():
            self.store.commit(replace={"deleted_containers": cut(gc.dequeue(self.table("deleted_containers"), kept))})
        return done

    def _sweep(self, mine: DataFrame) -> int:
        """Deletes containers in one commit; returns how many index rows went with them."""
        spaces = [r[0] for r in mine.select("namespace").distinct().collect()]
        index, a = self._of("fp_index", spaces)
        left = cut(gc.remove_fingerprints(index, mine))
        b = self.store.folders_of("blocks", [tuple(r) for r in mine.select("namespace", "shard").distinct().collect()])
        kept = cut(self.store.read("blocks", b).join(mine.select("namespace", "dcid"), ["namespace", "dcid"], "left_anti"))
        rest = cut(gc.dequeue(self.table("deleted_containers"), mine))
        gone = index.count() - left.count()
        self.store.commit(replace={"fp_index": left, "blocks": kept, "deleted_containers": rest}, instead={"fp_index": a, "blocks": b})
        return gone

    def export_containers(self, root: str) -> DataFrame:
        """Writes all containers as files under ``root``, which may be on any file system, and returns what was written."""
        return cut(container_file.export_containers(self.table("blocks"), root))

    # multipart

    def start_upload(self, bucket: str, name: str, user_defined: dict[str, str] | None = None) -> str:
        if self.table("buckets").where(F.col("name") == bucket).isEmpty():
            raise StoreError("no_such_bucket", bucket)
        upload = uuid.uuid4().hex
        schema = "upload_id string, bucket string, name string, user_defined map<string,string>"
        row = self.spark.createDataFrame([(upload, bucket, name, user_defined)], schema).withColumn("initiated", F.current_timestamp())
        self.store.commit(append={"mp_uploads": row})
        return upload

    def _upload(self, upload: str):
        row = self.table("mp_uploads").where(F.col("upload_id") == upload).first()
        if row is None:
            raise StoreError("no_such_upload", upload)
        return row

    def put_parts(self, upload: str, parts: DataFrame) -> DataFrame:
        """Stores ``part_no, body``; of one number the last call wins. Returns ``part_no, etag, size``."""
        self._upload(upload)
        seq = self.store.state()["commit"]
        own = cut(parts.select(
            F.lit(upload).alias("upload_id"), F.col("part_no").cast("int").alias("part_no"), "body", F.md5("body").alias("etag"),
            F.length("body").cast("bigint").alias("size"), F.current_timestamp().alias("last_modified"), F.lit(seq).cast("bigint").alias("seq"),
        ))
        self.store.commit(append={"mp_parts": own})
        return own.select("part_no", "etag", "size")

    def list_uploads(self, bucket: str, prefix: str = "") -> DataFrame:
        """Uploads under way: ``upload_id, name, initiated``, by name and start."""
        own = self.table("mp_uploads").where((F.col("bucket") == bucket) & F.col("name").startswith(prefix))
        return own.select("upload_id", "name", "initiated").orderBy("name", "initiated")

    def list_parts(self, upload: str, after: int = 0, limit: int = 1000) -> DataFrame:
        """A page of an upload's parts beyond number ``after``: ``part_no, etag, size, last_modified``."""
        self._upload(upload)
        own = self.table("mp_parts").where((F.col("upload_id") == upload) & (F.col("part_no") > after))
        return multipart.latest_parts(own).select("part_no", "etag", "size", "last_modified").orderBy("part_no").limit(limit)

    def copy_part(self, upload: str, part_no: int, bucket: str, name: str, start: int = 0, length: int = -1) -> DataFrame:
        """A part that is a range of an object; read and written by Spark."""
        self._one(bucket, name)
        asked = self.spark.createDataFrame([(bucket, name, start, length)], "bucket string, name string, start bigint, length bigint")
        return self.put_parts(upload, self.read(asked).select(F.lit(part_no).alias("part_no"), "body"))

    def complete_upload(self, upload: str, parts: list[tuple[int, str]]) -> DataFrame:
        """Makes the object of ``(part number, ETag)`` in the order given."""
        up = self._upload(upload)
        if len(parts) > multipart.MOST_PARTS:
            raise StoreError("too_many_parts", str(len(parts)))
        asked = self.spark.createDataFrame([(upload, i, n, e) for i, (n, e) in enumerate(parts)], "upload_id string, position int, part_no int, etag string")
        stored = cut(multipart.latest_parts(self.table("mp_parts").where(F.col("upload_id") == upload)))
        bad = multipart.check_parts(asked, stored).where("error is not null").orderBy("position").first()
        if bad:
            raise StoreError(bad["error"], str(bad["part_no"]))
        used = asked.select("upload_id", "position", "part_no").join(stored, ["upload_id", "part_no"])
        total = multipart.upload_etag(used.withColumn("part_no", F.col("position"))).first()
        base = self.table("objects").agg(F.max("obj_seq")).first()[0] or 0
        schema = "bucket string, name string, size bigint, etag string, user_defined map<string,string>, obj_seq bigint, body binary"
        meta = up["user_defined"]
        numbered = self.spark.createDataFrame([(up["bucket"], up["name"], total["size"], total["etag"], meta, base + 1, None)], schema).withColumn("namespace", naming.namespace_of("bucket"))
        keyed = used.withColumn("user_defined", F.create_map(*[F.lit(x) for kv in meta.items() for x in kv]) if meta else F.lit(None).cast("map<string,string>"))
        pieces = chunking.chunk_by_method(keyed, "body", ["upload_id", "position", "part_no"], "user_defined", self.settings.chunker, payload=True)
        pieces = cut(pieces)
        starts = pieces.groupBy("position").agg(F.count(F.lit(1)).alias("_n"), F.sum("len").alias("_l"))
        w = Window.partitionBy().orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select("position", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"), F.coalesce(F.sum("_l").over(w), F.lit(0)).alias("_b"))
        own = pieces.join(F.broadcast(starts), "position").withColumn("ordinal", (F.col("_o") + F.col("ordinal")).cast("int")).withColumn("chunk_offset", F.col("_b") + F.col("chunk_offset"))
        own = own.withColumn("obj_seq", F.lit(base + 1).cast("bigint")).withColumn("namespace", F.lit(up["bucket"].split(".")[0]))
        out = self._commit_chunks(numbered, own.select("namespace", "obj_seq", "ordinal", "chunk_offset", "len", "fp", "payload"))
        self.abort_upload(upload)
        return out

    def abort_upload(self, upload: str) -> None:
        self._upload(upload)
        self.store.commit(replace={t: cut(self.table(t).where(F.col("upload_id") != upload)) for t in ("mp_uploads", "mp_parts")})

    # archives

    def backup(self, bucket: str, folder: str, backup_id: str) -> DataFrame:
        """Stores a folder of the driver's disk as ``<id>.DATA`` and its layout; returns the layout.

        Names start with the folder's own name. The files are read by Spark, the data object is joined from
        their bytes.
        """
        base = os.path.dirname(os.path.abspath(folder))
        rows = []
        for at, _, files in os.walk(folder):
            rows.append((os.path.relpath(at, base) + "/", 0, os.stat(at).st_mode & 0o777, os.stat(at).st_mtime, archive.FOLDER, None))
            for f in files:
                p = os.path.join(at, f)
                rows.append((os.path.relpath(p, base), os.path.getsize(p), os.stat(p).st_mode & 0o777, os.stat(p).st_mtime, archive.FILE, p))
        found = self.spark.createDataFrame(rows, "name string, size bigint, mode bigint, at double, typeflag int, path string")
        own = found.select(F.lit(backup_id).alias("backup_id"), F.lit(bucket).alias("bucket"), "name", "size", "mode", F.timestamp_seconds("at").alias("mod_time"), "typeflag", "path")
        laid = cut(archive.lay_out(own))
        files = [r[5] for r in rows if r[5]]
        whole = self.spark.createDataFrame([], "path string, content binary") if not files else self.spark.read.format("binaryFile").load([f"file://{f}" for f in map(os.path.abspath, files)]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        joined = laid.withColumn("path", F.regexp_replace(F.col("path"), "^", "")).join(whole.withColumnRenamed("path", "_p"), F.col("_p") == F.col("path"))
        body = reader.assemble(joined, ["backup_id"], ordinal="offset", data="content")
        data = body.select(F.lit(bucket).alias("bucket"), F.lit(backup_id + ".DATA").alias("name"), "body")
        if data.isEmpty():
            data = self.spark.createDataFrame([(bucket, backup_id + ".DATA", bytearray())], "bucket string, name string, body binary")
        self.put(data)
        self.store.commit(append={"archives": laid})
        return laid.drop("path")

    def archive_list(self, bucket: str, backup_id: str) -> DataFrame:
        own = self.table("archives").where((F.col("backup_id") == backup_id) & (F.col("bucket") == bucket))
        return archive.listing(own).orderBy("name")

    def restore(self, bucket: str, backup_id: str, target: str, paths: list[str] | None = None) -> list[str]:
        """Writes files back under ``target`` on the driver; a name that would leave it is an error. Returns the names."""
        own = self.table("archives").where((F.col("backup_id") == backup_id) & (F.col("bucket") == bucket))
        if own.isEmpty():
            raise StoreError("no_such_backup", backup_id)
        root = os.path.realpath(target)
        own = cut(archive.select(own, paths))
        done, at = [], {}
        for r in own.orderBy("name").toLocalIterator():
            p = os.path.realpath(os.path.join(root, r["name"]))
            if not (p + "/").startswith(root + "/"):
                raise StoreError("outside_target", r["name"])
            os.makedirs(p if r["typeflag"] == archive.FOLDER else os.path.dirname(p), exist_ok=True)
            if r["typeflag"] != archive.FOLDER:
                open(p, "wb").close()
                os.chmod(p, r["mode"])
                at[r["offset"], r["size"]] = p
            done.append(r["name"])
        # all files are read by one job and come one after the other
        files = own.where((F.col("typeflag") != archive.FOLDER) & (F.col("size") > 0))
        asked = files.select(F.lit(bucket).alias("bucket"), F.lit(backup_id + ".DATA").alias("name"), F.col("offset").alias("start"), F.col("size").alias("length"))
        for r in cut(self.read_parts(asked)).orderBy("start", "part").toLocalIterator():
            os.chmod(p := at[r["start"], r["length"]], 0o600)
            with open(p, "ab") as f:
                f.write(r["body"])
        for r in files.toLocalIterator():
            os.chmod(at[r["offset"], r["size"]], r["mode"])
        return done

    def delete_backup(self, bucket: str, backup_id: str) -> None:
        schema = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("name", T.StringType())])
        self.delete(self.spark.createDataFrame([(bucket, backup_id + ".DATA")], schema))
        own = self.table("archives")
        self.store.commit(replace={"archives": cut(own.where(~((F.col("backup_id") == backup_id) & (F.col("bucket") == bucket))))})
