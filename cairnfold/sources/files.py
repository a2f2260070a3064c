"""Local files and folders: chunk scans, uploads with checksums, downloads and tar archives."""

from __future__ import annotations

import base64
import hashlib
import os
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfold.operators import chunking


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, size, mod_time, body`` of the files under a path, one row each; read by the executors."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return own.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), F.col("content").alias("body"))


def chunk_files(spark: SparkSession, path: str, chunker: chunking.ContentChunker, fixed: bool = False) -> DataFrame:
    """Chunks of files with their fingerprints: ``path, ordinal, chunk_offset, len, fp``."""
    own = read_files(spark, path)
    return chunking.fixed_chunks(own, "body", ["path"], chunker.average) if fixed else chunking.content_chunks(own, "body", ["path"], chunker)


def file_hashes(path: str, block: int = 1 << 20) -> tuple[str, str]:
    """MD5 in base64 and SHA-256 in hex of a file, read in blocks."""
    md5, sha = hashlib.md5(), hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(block):
            md5.update(data)
            sha.update(data)
    return base64.b64encode(md5.digest()).decode(), sha.hexdigest()


def pack_tar(folder: str, path: str) -> int:
    """A plain tar of a folder, names relative to its parent; returns the number of entries."""
    base, n = os.path.dirname(os.path.abspath(folder)), 0
    with tarfile.open(path, "w") as tar:
        for at, folders, files in os.walk(folder):
            folders.sort()
            for p in [at, *(os.path.join(at, f) for f in sorted(files))]:
                tar.add(p, os.path.relpath(p, base), recursive=False)
                n += 1
    return n


def unpack_tar(path: str, target: str) -> tuple[list[str], list[str]]:
    """Extracts folders and regular files; returns the names written and those skipped (links, devices). A name that
    would leave the target is an error before anything is written."""
    root = os.path.realpath(target)
    done, skipped = [], []
    with tarfile.open(path) as tar:
        members = tar.getmembers()
        for m in members:
            if not (os.path.realpath(os.path.join(root, m.name)) + "/").startswith(root + "/"):
                raise ValueError(f"{m.name} would leave the target")
        for m in members:
            p = os.path.join(root, m.name)
            if m.isdir():
                os.makedirs(p, exist_ok=True)
            elif m.isreg():
                os.makedirs(os.path.dirname(p), exist_ok=True)
                with open(p, "wb") as f, tar.extractfile(m) as src:  # type: ignore[union-attr]
                    while data := src.read(1 << 20):
                        f.write(data)
                os.chmod(p, m.mode)
            else:
                skipped.append(m.name)
                continue
            done.append(m.name)
    return done, skipped
