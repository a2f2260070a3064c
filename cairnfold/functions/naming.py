"""Names of namespaces, buckets, keys and containers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_NAMESPACE = "globalns"
BACKEND_PREFIX = "dedup."
CONTAINER_PREFIX = "DC"
SHARD = 1024
#: Words that neither half of a bucket name may be, in any case.
RESERVED = ["datacontainer", "fpcache", "buckets", "ref", "deleteddcid", "datamanifestid", "datacontainerid", "globalns", "dedup"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _halves(name: Column) -> tuple[Column, Column, Column]:
    dot = F.instr(name, ".")
    return dot, F.substring_index(name, ".", 1), name.substr(dot + 1, F.length(name))


def namespace_of(name: Column | str) -> Column:
    """The part before the first dot; the default namespace without a dot; null if a half is empty."""
    name = _col(name)
    dot, left, right = _halves(name)
    return F.when(dot == 0, F.lit(DEFAULT_NAMESPACE)).when((left != "") & (right != ""), left)


def full_bucket(name: Column | str) -> Column:
    """The bucket's full name; without a dot it gets the default namespace; null if a half is empty."""
    name = _col(name)
    dot, left, right = _halves(name)
    return F.when(dot == 0, F.concat(F.lit(DEFAULT_NAMESPACE + "."), name)).when((left != "") & (right != ""), name)


def backend_bucket(namespace: Column | str) -> Column:
    return F.concat(F.lit(BACKEND_PREFIX), _col(namespace))


def index_key(namespace: Column | str) -> Column:
    return F.concat(_col(namespace), F.lit(".FPCache"))


def refs_key(namespace: Column | str) -> Column:
    return F.concat(_col(namespace), F.lit(".Ref"))


def deleted_key(namespace: Column | str) -> Column:
    return F.concat(_col(namespace), F.lit(".deletedDCID"))


def bucket_error(name: Column | str) -> Column:
    """Why a name is no bucket name, or null: no_namespace, reserved_namespace, reserved_bucket,
    short_namespace, short_bucket, not_lowercase, not_s3 (the strict rule of S3: 3 to 63 characters, letters,
    digits, dots and hyphens, a letter or digit at both ends, no two dots or dot and hyphen in a row, no IP
    address). The first that holds; a null name has none."""
    name = _col(name)
    dot, left, right = _halves(name)
    s3 = name.rlike(r"^[a-z0-9][a-z0-9.\-]{1,61}[a-z0-9]$") & ~name.rlike(r"\.\.|\.-|-\.") & ~name.rlike(r"^(\d+\.){3}\d+$")
    return (
        F.when(name.isNull(), F.lit(None).cast("string"))
        .when(dot == 0, "no_namespace")
        .when(F.lower(left).isin(RESERVED), "reserved_namespace")
        .when(F.lower(right).isin(RESERVED), "reserved_bucket")
        .when(F.length(left) < 3, "short_namespace")
        .when(F.length(right) < 3, "short_bucket")
        .when(F.lower(name) != name, "not_lowercase")
        .when(~s3, "not_s3")
    )


def shard_of(dcid: Column | str) -> Column:
    return F.floor(_col(dcid) / SHARD).cast("bigint")


def container_name(dcid: Column | str) -> Column:
    return F.concat(F.lit(CONTAINER_PREFIX), _col(dcid).cast("string"))


def container_path(root: str, dcid: Column | str) -> Column:
    """``root/<dcid div 1024>/DC<dcid>``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), shard_of(dcid).cast("string"), F.lit("/"), container_name(dcid))


def container_id(name: Column | str) -> Column:
    """The id in a container's name; null where the name is none."""
    name = _col(name)
    return F.when(name.startswith(CONTAINER_PREFIX), _try_long(name.substr(F.lit(3), F.length(name))))


def _try_long(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{1,18}$"), text.cast("bigint"))


def manifest_name(number: Column | str) -> Column:
    return F.concat(F.lit("Manifest"), _col(number).cast("string"))
