"""The fixed schemas of the tables of a store, as Spark DDL."""

SCHEMAS: dict[str, str] = {
    "buckets": "name STRING, namespace STRING, uuid STRING, created TIMESTAMP, location STRING",
    "objects": "bucket STRING, name STRING, namespace STRING, obj_seq BIGINT, size BIGINT, etag STRING, mod_time TIMESTAMP, is_dir BOOLEAN, manifest_id STRING, written_bytes BIGINT, stored_bytes BIGINT, dedup_rate DOUBLE, user_defined MAP<STRING,STRING>",
    "manifest_entries": "namespace STRING, manifest_id STRING, ordinal INT, chunk_offset BIGINT, fp STRING, len BIGINT, dcid BIGINT",
    "fp_index": "namespace STRING, fp STRING, dcid BIGINT",
    "blocks": "namespace STRING, shard BIGINT, dcid BIGINT, fp STRING, offset BIGINT, stored_len BIGINT, crc BIGINT, codec TINYINT, payload BINARY",
    "refs": "namespace STRING, dcid BIGINT, bucket STRING, object STRING",
    "deleted_containers": "namespace STRING, dcid BIGINT",
    "mp_uploads": "upload_id STRING, bucket STRING, name STRING, initiated TIMESTAMP, user_defined MAP<STRING,STRING>",
    "mp_parts": "upload_id STRING, part_no INT, body BINARY, etag STRING, size BIGINT, last_modified TIMESTAMP, seq BIGINT",
    "archives": "backup_id STRING, bucket STRING, name STRING, size BIGINT, mode BIGINT, mod_time TIMESTAMP, typeflag INT, offset BIGINT",
    "settings": "name STRING, uuid STRING, block_size BIGINT, compression STRING, shards INT, meta_version INT",
}

#: Tables that are laid out by namespace and container shard.
PARTITIONS: dict[str, list[str]] = {
    "blocks": ["namespace", "shard"], "manifest_entries": ["namespace"], "fp_index": ["namespace"], "objects": ["namespace"], "refs": ["namespace"],
}
