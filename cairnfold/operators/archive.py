"""Archives of directories: one data object and a table of what lies where in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfold.operators.reader import running_offsets

#: Type flags of tar.
FILE, FOLDER = ord("0"), ord("5")


def lay_out(files: DataFrame, by: str = "backup_id") -> DataFrame:
    """Adds ``offset``, the sum of the sizes of the regular files before it in the order of names; a folder carries
    the current offset and adds nothing."""
    own = files.withColumn("_s", F.when(F.col("typeflag") == FILE, F.coalesce("size", F.lit(0))).otherwise(0))
    return running_offsets(own, [by], ["name"], "_s", "offset").drop("_s")


def select(files: DataFrame, paths: list[str] | None) -> DataFrame:
    """What a restore of ``paths`` needs: a path itself, all under it, and the folders above it. Trailing slashes do
    not matter; no paths means all."""
    if not paths:
        return files
    name = F.regexp_replace("name", "/+$", "")
    keep = F.lit(False)
    for p in paths:
        p = p.rstrip("/")
        keep = keep | (name == p) | F.col("name").startswith(p + "/") | ((F.col("typeflag") == FOLDER) & F.lit(p).startswith(F.concat(name, F.lit("/"))))
    return files.where(keep)


def byte_ranges(files: DataFrame) -> DataFrame:
    """``first_byte, last_byte`` in the data object of each regular file with content."""
    own = files.where((F.col("typeflag") == FILE) & (F.col("size") > 0))
    return own.withColumn("first_byte", F.col("offset")).withColumn("last_byte", F.col("offset") + F.col("size") - 1)


def listing(files: DataFrame) -> DataFrame:
    """``mode, size, modified, name`` as a list shows them."""
    text = F.lit("")
    mode = F.col("mode")
    for bit, c in zip(range(8, -1, -1), "rwxrwxrwx", strict=True):
        text = F.concat(text, F.when(F.shiftright(mode, bit).bitwiseAND(1) == 1, c).otherwise("-"))
    kind = F.when(F.col("typeflag") == FOLDER, "d").otherwise("-")
    return files.select(F.concat(kind, text).alias("mode"), "size", F.date_format("mod_time", "yyyy-MM-dd HH:mm:ss").alias("modified"), "name")
