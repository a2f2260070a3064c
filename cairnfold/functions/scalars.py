"""Sizes, durations, versions and other texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ["K", "M", "G", "T", "P", "E"]
#: Media types by extension; anything else is application/octet-stream.
MEDIA_TYPES = {
    ".css": "text/css", ".csv": "text/csv", ".gif": "image/gif", ".gz": "application/gzip", ".htm": "text/html", ".html": "text/html",
    ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".js": "text/javascript", ".json": "application/json", ".pdf": "application/pdf",
    ".png": "image/png", ".svg": "image/svg+xml", ".tar": "application/x-tar", ".txt": "text/plain", ".wasm": "application/wasm",
    ".webp": "image/webp", ".xml": "text/xml", ".zip": "application/zip",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_size(text: Column | str) -> Column:
    """Bytes of "64M", "1g" or "123" (binary units, blanks around); null where it is no size."""
    s = F.lower(F.trim(_col(text)))
    number = F.regexp_extract(s, r"^(\d{1,18})[gm]?$", 1)
    unit = F.when(s.endswith("g"), 1 << 30).when(s.endswith("m"), 1 << 20).otherwise(1)
    return F.when(number != "", number.cast("bigint") * unit)


def format_bytes(n: Column | str) -> Column:
    """"1.50 KiB (1536 Bytes)"; below 1024 "n Bytes". Shifts by units, then divides, as binary prefixes do; halves
    are rounded to even as printf does on binary fractions."""
    n = _col(n).cast("bigint")
    out = F.concat(n.cast("string"), F.lit(" Bytes"))
    for i, unit in enumerate(_UNITS):
        m = F.shiftright(n, 10 * i)
        # a fraction with a denominator of 1024 is exact as a decimal; to even on a tie
        text = F.format_string("%.2f", F.bround(m.cast("decimal(30,12)") / F.lit(1024).cast("decimal(5,0)"), 2).cast("double"))
        whole = F.concat(text, F.lit(f" {unit}iB ("), n.cast("string"), F.lit(" Bytes)"))
        more = m >= 1024 if i else n >= 1024
        out = F.when(more, whole).otherwise(out)
    return out


def duration_micros(text: Column | str) -> Column:
    """Microseconds of "1.5" (seconds), "1m30s", "1d2h"; 0 for an empty text and for what is no duration."""
    s = _col(text)
    seconds = F.regexp_extract(s, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$", 1)
    shape = s.rlike(r"^(?:\d+(?:\.\d*)?d)?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:h|ms|us|µs|ns|m|s))*$") & (s != "")
    part = lambda unit, micros: F.coalesce(
        F.aggregate(
            F.regexp_extract_all(s, F.lit(rf"(\d+(?:\.\d*)?|\.\d+){unit}(?![a-z])"), F.lit(1)),
            F.lit(0.0),
            lambda acc, x: acc + x.cast("double") * micros,
        ),
        F.lit(0.0),
    )
    total = part("d", 86_400e6) + part("h", 3_600e6) + part("m", 60e6) + part("s", 1e6) + part("ms", 1e3) + part("us", 1.0) + part("µs", 1.0) + part("ns", 1e-3)
    return F.when(seconds != "", F.floor(seconds.cast("double") * 1e6)).when(shape, F.floor(total)).when(s.isNotNull(), 0).cast("bigint")


def media_type(key: Column | str) -> Column:
    """Media type by the extension of the last component of a key."""
    ext = F.lower(F.regexp_extract(_col(key), r"(\.[^./]*)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in MEDIA_TYPES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def without_password(uri: Column | str) -> Column:
    """The URI with the password before its last @ as stars."""
    u = _col(uri)
    return F.regexp_replace(u, r"^((?:(?:(?!://).)*://)?+)([^:]*):(?:.*)(@[^@]*)$", "$1$2:****$3")


def split_words(text: Column | str, separator: str = ",") -> Column:
    return F.split(_col(text), F.lit(rf"\Q{separator}\E"))


def version(text: Column | str) -> Column:
    """``struct<major, minor, patch, pre>`` of a version; build information is left out; null where it is none."""
    s = F.regexp_replace(_col(text), r"(?s)^(.+?)\+.*$", "$1")
    pre = F.regexp_extract(s, r"(?s)^.+?-(.*)$", 1)
    core = F.regexp_extract(s, r"^(\d{1,18}(?:\.\d{1,18}){0,2})(?:-(?s:.*))?$", 1)
    p = F.split(core, r"\.")
    at = lambda i: F.coalesce(F.try_element_at(p, F.lit(i + 1)).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(core != "", F.struct(at(0).alias("major"), at(1).alias("minor"), at(2).alias("patch"), pre.alias("pre")))


def compare_versions(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1; a release is later than its pre-releases; null where one is no version."""
    a, b = version(a), version(b)
    out = F.lit(0)
    pre = F.when(a["pre"] == b["pre"], 0).when(a["pre"] == "", 1).when(b["pre"] == "", -1).when(a["pre"] < b["pre"], -1).otherwise(1)
    out = pre
    for f in ("patch", "minor", "major"):
        out = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(out)
    return F.when(a.isNotNull() & b.isNotNull(), out)


def method_name(full: Column | str) -> Column:
    """The last component of a function's full name, without package, receiver and markers of anonymous functions."""
    s = F.regexp_replace(_col(full), r"^[^/]*/(?=.)", "")
    t = F.regexp_replace(s, r"\.+$", "")
    for _ in range(8):  # markers may be nested
        t = F.regexp_replace(t, r"^(.*)\.(?:func\d[^.]*|\d)\.*$", "$1")
    last = F.regexp_extract(t, r"([^.]*)$", 1)
    return F.when(t == "", s).otherwise(last)


def _turned(digits: Column) -> Column:
    """Sixteen hex digits with their bytes in the other order; ``reverse`` would take bytes for UTF-8."""
    return F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])


def u64_to_bytes(n: Column | str) -> Column:
    """Eight bytes, least first."""
    return F.unhex(_turned(F.lpad(F.hex(_col(n).cast("bigint")), 16, "0")))


def bytes_to_u64(data: Column | str) -> Column:
    """The number of eight bytes, least first; signed above 2**63. Null unless there are eight."""
    return F.when(F.length(_col(data)) == 8, F.conv(_turned(F.hex(_col(data))), 16, -10).cast("bigint"))


def inside(path: Column | str, root: str) -> Column:
    """Whether a relative path, with . and .. resolved, stays within ``root``. Absolute paths count from it."""
    parts = F.filter(F.split(_col(path), "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, x: F.struct(
            (acc["d"] + F.when(x == "..", -1).otherwise(1)).alias("d"),
            F.least(acc["low"], acc["d"] + F.when(x == "..", -1).otherwise(1)).alias("low"),
        ),
    )
    return (depth["low"] >= 0) & (depth["d"] > 0)
