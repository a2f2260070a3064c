"""Container and manifest files: readers and writers, and a data source for Spark.

A container file is the magic number and version (two little-endian 32-bit numbers), the blocks' bytes, a
footer of records and the footer's position in the last eight bytes. The footer here is one fixed record for
each block: fingerprint (32 bytes), offset and length (64 bits), CRC (32 bits) and codec (one byte). A path is a
local one or an address (``scheme://``) of any file system that Arrow knows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
MAGIC, VERSION, HEADER = 0x58444346, 1, 8
_RECORD = struct.Struct("<32sQQIB")
_ENTRY = struct.Struct("<32sQQ")


class ContainerError(ValueError):
    pass


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), os.path.abspath(path))


def _writing(path: str) -> pa.NativeFile:
    system, own = _at(path)
    system.create_dir(own.rpartition("/")[0], recursive=True)
    return system.open_output_stream(own)


def _reading(path: str) -> pa.NativeFile:
    system, own = _at(path)
    return system.open_input_file(own)


def write_container(path: str, blocks: list[tuple[str, bytes, int]]) -> int:
    """Writes ``(fingerprint, stored bytes, codec)``; without blocks no file. Returns the file's size."""
    if not blocks:
        return 0
    records, offset = [], HEADER
    with _writing(path) as f:
        f.write(struct.pack("<II", MAGIC, VERSION))
        for fp, data, codec in blocks:
            f.write(data)
            records.append(_RECORD.pack(bytes.fromhex(fp), offset, len(data), zlib.crc32(data), codec))
            offset += len(data)
        f.write(b"".join(records))
        f.write(struct.pack("<Q", offset))
        return f.tell()


def read_footer(path: str) -> list[tuple[str, int, int, int, int]]:
    """``fp, offset, stored_len, crc, codec`` of each block."""
    with _reading(path) as f:
        size = f.size()
        if size < 16:
            raise ContainerError("too small")
        magic, version = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ContainerError("not a container")
        if version != VERSION:
            raise ContainerError(f"version {version}")
        f.seek(size - 8)
        (at,) = struct.unpack("<Q", f.read(8))
        if not HEADER <= at <= size - 8 or (size - 8 - at) % _RECORD.size:
            raise ContainerError("broken footer")
        f.seek(at)
        footer = f.read(size - 8 - at)
    return [(fp.hex(), off, n, crc, codec) for fp, off, n, crc, codec in _RECORD.iter_unpack(footer)]


def write_manifest(path: str, entries: list[tuple[str, int, int]]) -> list[int]:
    """Writes ``(fingerprint, length, dcid)`` and the section of distinct container ids; returns these, sorted."""
    unique = sorted({d for _, _, d in entries})
    with _writing(path) as f:
        f.write(struct.pack("<Q", _ENTRY.size * len(entries)))
        for fp, n, dcid in entries:
            f.write(_ENTRY.pack(bytes.fromhex(fp), n, dcid))
        f.write(struct.pack(f"<{len(unique)}Q", *unique))
    return unique


def read_manifest(path: str) -> list[tuple[str, int, int]]:
    with _reading(path) as f:
        (n,) = struct.unpack("<Q", f.read(8))
        return [(fp.hex(), size, dcid) for fp, size, dcid in _ENTRY.iter_unpack(f.read(n))]


def read_manifest_containers(path: str) -> list[int]:
    """The distinct container ids, without reading the entries."""
    with _reading(path) as f:
        (n,) = struct.unpack("<Q", f.read(8))
        f.seek(8 + n)
        data = f.read()
    return list(struct.unpack(f"<{len(data) // 8}Q", data))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        system, root = _at(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        found = [x.path for x in found if x.is_file and x.base_name.startswith("DC") and x.base_name[2:].isdigit()]
        scheme = self.root.partition("://")[0] + "://" if "://" in self.root and not self.root.startswith("file:") else ""
        return [_File(scheme + p) for p in sorted(found)] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.path
        if not path:
            return
        with _reading(path) as f:
            for fp, offset, n, crc, codec in read_footer(path):
                f.seek(offset)
                data = f.read(n)
                if zlib.crc32(data) != crc:
                    raise ContainerError(f"{path}: checksum at {offset}")
                yield int(os.path.basename(path)[2:]), fp, offset, n, crc, codec, data


class ContainerSource(DataSource):
    """``spark.dataSource.register(ContainerSource)``, then ``spark.read.format("container").load(folder)``: one partition
    for each container file under the folder."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return "dcid bigint, fp string, offset bigint, stored_len bigint, crc bigint, codec int, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def _export(root: str):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namespace, shard, dcid = (k.as_py() for k in key)
        rows = sorted((r["offset"], r["fp"], r["payload"], r["codec"]) for b in batches for r in b.select(["offset", "fp", "payload", "codec"]).to_pylist())
        path = f"{root.rstrip('/')}/{namespace}/{shard}/DC{dcid}"
        size = write_container(path, [(fp, data, codec) for _, fp, data, codec in rows])
        yield pa.RecordBatch.from_arrays([pa.array([namespace]), pa.array([dcid], pa.int64()), pa.array([path]), pa.array([size], pa.int64())], names=["namespace", "dcid", "path", "size"])

    return run


def export_containers(blocks: DataFrame, root: str) -> DataFrame:
    """Writes a file for each container of ``blocks`` (as the store has them), by the executors, under
    ``root/<namespace>/<shard>``; returns ``namespace, dcid, path, size`` when it is run. A container, which has a bounded
    size, is written by one task."""
    return blocks.groupBy("namespace", "shard", "dcid").applyInArrow(_export(root), "namespace string, dcid bigint, path string, size bigint")
