"""Block codecs: none, snappy and zlib, by name or number, as Arrow functions."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    name: str
    number: int
    encode: Callable[[bytes], bytes]
    decode: Callable[[bytes], bytes]


def _snappy_size(data: bytes) -> int:
    """Length of the content, which a raw snappy block begins with as a variable-length number."""
    n = shift = 0
    for i, b in enumerate(data):
        n |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return n
        if i == 4:
            break
    raise ValueError("no snappy block")


def _snappy_decode(data: bytes) -> bytes:
    return pa.decompress(data, decompressed_size=_snappy_size(data), codec="snappy", asbytes=True) if data else b""


CODECS = {
    c.name: c
    for c in (
        Codec("none", 0, lambda b: b, lambda b: b),
        Codec("snappy", 1, lambda b: pa.compress(b, codec="snappy", asbytes=True) if b else b"", _snappy_decode),
        Codec("zlib", 2, lambda b: zlib.compress(b) if b else b"", lambda b: zlib.decompress(b) if b else b""),
    )
}


def codec(which: str | int) -> Codec:
    """By name or number; anything else is an error."""
    for c in CODECS.values():
        if which in (c.name, c.number) and not isinstance(which, bool):
            return c
    raise ValueError(f"no codec is called {which!r}")


def encode(data: Column | str, which: str | int) -> Column:
    """Encoded bytes; null stays null, empty stays empty."""
    c = codec(which)
    if c.number == 0:
        return F.col(data) if isinstance(data, str) else data
    name = c.name

    @F.arrow_udf("binary")
    def run(a: pa.Array) -> pa.Array:
        f = codec(name).encode
        return pa.array([None if x is None else f(x) for x in a.to_pylist()], pa.binary())

    return run(data)


def decode(data: Column | str, which: Column | str) -> Column:
    """Decoded bytes by the codec's number in each row; broken input is an error."""

    @F.arrow_udf("binary")
    def run(a: pa.Array, n: pa.Array) -> pa.Array:
        by = {c.number: c.decode for c in CODECS.values()}
        return pa.array([None if x is None else by[k](x) for x, k in zip(a.to_pylist(), n.to_pylist(), strict=True)], pa.binary())

    return run(data, which)
