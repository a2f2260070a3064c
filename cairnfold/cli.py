"""Commands over a store: ``python -m cairnfold --store FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import os
import sys
import time
from datetime import datetime

from pyspark.sql import SparkSession

from cairnfold.api import Engine, Settings, StoreError
from cairnfold.operators.chunking import METHOD_KEY
from cairnfold.sources.files import file_hashes


def size_of(text: str) -> int:
    """Bytes of "64M", "1G" or "123"."""
    s = text.strip().lower()
    unit = {"g": 1 << 30, "m": 1 << 20}.get(s[-1:], 1)
    digits = s[:-1] if unit > 1 else s
    if not digits.isdigit():
        raise argparse.ArgumentTypeError(f"{text!r} is no size")
    return int(digits) * unit


def backup_name(folder: str, at: datetime) -> str:
    return f"{os.path.basename(os.path.abspath(folder))}-{at:%Y%m%d%H%M%S}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairnfold")
    p.add_argument("--store", required=True)
    p.add_argument("--compression", default="snappy", choices=["none", "snappy", "zlib"])
    c = p.add_subparsers(dest="command", required=True)
    for name in ("mb", "rb"):
        c.add_parser(name).add_argument("bucket")
    up = c.add_parser("upload")
    up.add_argument("bucket")
    up.add_argument("file")
    up.add_argument("--object-name")
    up.add_argument("--chunk-method", default="FastCDC")
    up.add_argument("--part-size", type=size_of, default=1 << 30)
    up.add_argument("--disable-multipart", action="store_true")
    down = c.add_parser("download")
    for a in ("bucket", "object", "file"):
        down.add_argument(a)
    for name in ("delete", "head"):
        d = c.add_parser(name)
        d.add_argument("bucket")
        d.add_argument("object")
    ls = c.add_parser("ls")
    ls.add_argument("bucket", nargs="?")
    ls.add_argument("--prefix", default="")
    ls.add_argument("--delimiter", default="")
    c.add_parser("gc")
    b = c.add_parser("backup")
    b.add_argument("bucket")
    b.add_argument("folder")
    r = c.add_parser("restore")
    for a in ("bucket", "backup_id", "target"):
        r.add_argument(a)
    r.add_argument("paths", nargs="*")
    for name in ("list-backup", "del-backup"):
        x = c.add_parser(name)
        x.add_argument("bucket")
        x.add_argument("backup_id")
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    e = Engine(spark, args.store, Settings(compression=args.compression))
    start = time.perf_counter()
    rate = lambda n: print(f"{n} bytes, {n / 2**20 / max(1e-9, time.perf_counter() - start):.2f} MiB/s")
    match args.command:
        case "mb":
            print("made" if e.make_bucket(args.bucket) else "there already")
        case "rb":
            e.remove_bucket(args.bucket)
        case "upload":
            e.make_bucket(args.bucket)
            name, size = args.object_name or os.path.basename(args.file), os.path.getsize(args.file)
            meta = {METHOD_KEY: args.chunk_method}
            if size > args.part_size and not args.disable_multipart:
                upload, parts = e.start_upload(args.bucket, name, meta), []
                with open(args.file, "rb") as f:
                    while data := f.read(args.part_size):
                        row = spark.createDataFrame([(len(parts) + 1, bytearray(data))], "part_no int, body binary")
                        parts.append((len(parts) + 1, e.put_parts(upload, row).first().etag))
                e.complete_upload(upload, parts)
            else:
                with open(args.file, "rb") as f:
                    row = (args.bucket, name, bytearray(f.read()), meta)
                e.put(spark.createDataFrame([row], "bucket string, name string, body binary, user_defined map<string,string>"))
            rate(size)
            print("md5 {} sha256 {}".format(*file_hashes(args.file)))
        case "download":
            with open(args.file, "wb") as f:
                for data in e.stream(args.bucket, args.object):
                    f.write(data)
                rate(f.tell())
        case "delete":
            print(e.delete(spark.createDataFrame([(args.bucket, args.object)], "bucket string, name string")).first().status)
        case "head":
            for r in e.head(args.bucket, args.object).collect():
                print(r.asDict())
        case "ls" if args.bucket is None:
            for r in e.list_buckets().collect():
                print(r["name"])
        case "ls":
            token = ""
            while True:
                page = e.list(args.bucket, prefix=args.prefix, delimiter=args.delimiter, token=token)
                print(*sorted(page.names + page.prefixes), sep="\n")
                if not page.truncated:
                    break
                token = page.next_token or ""
        case "gc":
            print(e.gc())
        case "backup":
            e.make_bucket(args.bucket)
            name = backup_name(args.folder, datetime.now())
            e.backup(args.bucket, args.folder, name)
            print(name)
        case "restore":
            print(*e.restore(args.bucket, args.backup_id, args.target, args.paths or None), sep="\n")
        case "list-backup":
            for r in e.archive_list(args.bucket, args.backup_id).collect():
                print(r["mode"], r["size"], r["modified"], r["name"])
        case "del-backup":
            e.delete_backup(args.bucket, args.backup_id)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cairnfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(args, spark)
    except StoreError as e:
        print(e, file=sys.stderr)
        return 1
    return 0
