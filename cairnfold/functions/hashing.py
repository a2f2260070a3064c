"""Fingerprints, ETags and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fingerprint(data: Column | str) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(_col(data), 256)


def object_etag(data: Column | str) -> Column:
    """MD5 of the whole content in hex."""
    return F.md5(_col(data))


def multipart_etag(part: Column | str, etag: Column | str) -> Column:
    """Aggregate: MD5 of the binary MD5s of the parts in their order, a hyphen and their number."""
    parts = F.array_sort(F.collect_list(F.struct(_col(part).alias("p"), _col(etag).alias("e"))))
    joined = F.array_join(F.transform(parts, lambda x: x["e"]), "")
    return F.concat(F.md5(F.unhex(joined)), F.lit("-"), F.size(parts).cast("string"))


def checksum(data: Column | str) -> Column:
    """CRC-32 (IEEE) as a bigint."""
    return F.crc32(_col(data))


def content_md5(data: Column | str) -> Column:
    """MD5 in base64, as the Content-MD5 header has it."""
    return F.base64(F.unhex(F.md5(_col(data))))
