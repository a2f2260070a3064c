"""Cutting byte objects into chunks: fixed size in Catalyst, content-defined in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHOD_KEY = "X-Amz-Meta-Chunk-Method"
FIXED, CONTENT = "FixedCDC", "FastCDC"


def byte_gear(seed: int = 0) -> np.ndarray:
    """256 32-bit numbers: the last eight hex digits of each byte's SHA-256, XORed with ``seed``."""
    own = [int(hashlib.sha256(bytes([b])).hexdigest()[-8:], 16) for b in range(256)]
    return np.array(own, np.uint64) ^ np.uint64(seed & 0xFFFFFFFF)


_gear = lru_cache(maxsize=16)(byte_gear)
#: Bytes hashed at once.
_BLOCK = 1 << 17


@dataclass(frozen=True)
class ContentChunker:
    """Content-defined chunking with a gear hash and two masks (normalised).

    A chunk ends after byte i, at the earliest ``minimum`` bytes in, where the low bits of the hash of the
    bytes since then are 0: ``log2(average) + norm`` bits up to the average size, ``log2(average) - norm``
    beyond it, and at ``maximum`` anyway. A rest of at most ``minimum`` is one chunk.
    """

    average: int
    minimum: int = 0
    maximum: int = 0
    norm: int = 2
    seed: int = 0
    gear: np.ndarray | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.average < 1:
            raise ValueError("an average size is needed")
        object.__setattr__(self, "minimum", self.minimum or max(1, self.average // 4))
        object.__setattr__(self, "maximum", self.maximum or self.average * 4)
        if not 64 <= self.minimum <= 1 << 30 or not 64 <= self.average <= 1 << 30 or not 64 <= self.maximum <= 1 << 30:
            raise ValueError("sizes lie between 64 and 2**30")
        if not self.minimum <= self.average <= self.maximum or self.minimum >= self.maximum:
            raise ValueError("sizes must rise from minimum to maximum")
        if not 0 <= self.norm <= 3:
            raise ValueError("norm lies between 0 and 3")

    @property
    def bits(self) -> tuple[int, int]:
        b = int(np.floor(np.log2(self.average) + 0.5))
        return b + self.norm, max(0, b - self.norm)

    def _table(self) -> np.ndarray:
        """The gear's low 32 bits: more are never tested."""
        gear = _gear(self.seed) if self.gear is None else self.gear
        return (gear.astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def lengths(self, data: bytes) -> list[int]:
        """Chunk lengths. The hash of k low bits depends on the last k bytes only, so all places where a
        chunk may end come from sums over windows of 32 bytes, doubled in five steps over the whole buffer; from
        one chunk to the next it takes a search, and a sum for the first k bytes, whose hash began at 0."""
        n = len(data)
        if not n:
            return []
        hard, easy = self.bits
        gear = self._table()
        raw = np.frombuffer(data, np.uint8)
        ends_hard = ends_easy = np.zeros(0, np.int64)
        if n > self.minimum:
            found_hard, found_easy = [], []
            for a in range(0, n, _BLOCK):  # blocks that stay in the cache, each with the 31 bytes before it
                b = max(0, a - 31)
                h = gear[raw[b : a + _BLOCK]]
                for j in (1, 2, 4, 8, 16):
                    if j < len(h):
                        h[j:] += h[:-j] << np.uint32(j)
                own = h[a - b :]
                easy_at = np.flatnonzero((own & np.uint32((1 << easy) - 1)) == 0)
                found_easy.append(easy_at + a)
                found_hard.append(easy_at[(own[easy_at] & np.uint32((1 << hard) - 1)) == 0] + a)
            ends_hard, ends_easy = np.concatenate(found_hard), np.concatenate(found_easy)
        mask_hard, mask_easy = (1 << hard) - 1, (1 << easy) - 1
        out, at = [], 0
        while at < n:
            left = n - at
            if left <= self.minimum:
                out.append(left)
                break
            first, turn, stop = at + self.minimum, at + min(left, self.average), at + min(left, self.maximum)
            cut, fp = 0, 0
            warm = min(first + hard - 1, stop)
            for i, step in enumerate(gear[raw[first:warm]].tolist(), first):
                fp = (fp << 1) + step
                if fp & (mask_hard if i < turn else mask_easy) == 0:
                    cut = i + 1
                    break
            if not cut and warm < turn:
                k = np.searchsorted(ends_hard, warm)
                if k < len(ends_hard) and ends_hard[k] < turn:
                    cut = int(ends_hard[k]) + 1
            if not cut and stop > turn:
                k = np.searchsorted(ends_easy, max(warm, turn))
                if k < len(ends_easy) and ends_easy[k] < stop:
                    cut = int(ends_easy[k]) + 1
            cut = cut or stop
            out.append(cut - at)
            at = cut
        return out


def fixed_chunks(objects: DataFrame, body: str, keys: Sequence[str], size: int, payload: bool = False) -> DataFrame:
    """``<keys>, ordinal, chunk_offset, len, fp`` (and ``payload``) of chunks of ``size`` bytes, the last one
    shorter. An empty or null body has no chunk. Stays in the JVM: explode, slice, hash."""
    if size < 1:
        raise ValueError("chunks have at least one byte")
    n = F.length(body)
    each = objects.where(n > 0).select(*keys, F.col(body).alias("_body"), F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("ordinal"))
    cut = each.select(*keys, "ordinal", F.substring(F.col("_body"), F.col("ordinal") * size + 1, F.lit(size)).alias("payload"))
    out = [F.col(k) for k in keys] + [
        F.col("ordinal"), (F.col("ordinal").cast("bigint") * size).alias("chunk_offset"),
        F.length("payload").cast("bigint").alias("len"), F.sha2("payload", 256).alias("fp"),
    ]
    return cut.select(*out, *(["payload"] if payload else []))


def content_chunks(objects: DataFrame, body: str, keys: Sequence[str], chunker: ContentChunker, payload: bool = False) -> DataFrame:
    """The same columns for content-defined chunks."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ordinal, offset, size, fp, cut = [], [], [], [], [], []
            for i, data in enumerate(batch.column(len(names)).to_pylist()):
                at = 0
                for k, n in enumerate(chunker.lengths(data or b"")):
                    piece = data[at : at + n]
                    row.append(i)
                    ordinal.append(k)
                    offset.append(at)
                    size.append(n)
                    fp.append(hashlib.sha256(piece).hexdigest())
                    if payload:
                        cut.append(piece)
                    at += n
            take = pa.array(row, pa.int64())
            arrays = [batch.column(i).take(take) for i in range(len(names))]
            arrays += [pa.array(ordinal, pa.int32()), pa.array(offset, pa.int64()), pa.array(size, pa.int64()), pa.array(fp, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cut, pa.binary())] if payload else []), names=[*names, "ordinal", "chunk_offset", "len", "fp", *(["payload"] if payload else [])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.select(*names).schema)
    schema += ", ordinal int, chunk_offset bigint, len bigint, fp string" + (", payload binary" if payload else "")
    return objects.select(*names, body).mapInArrow(run, schema)


def method_of(user_defined: Column | str) -> Column:
    """FixedCDC or FastCDC by the object's metadata, without regard to case; anything else is FastCDC."""
    m = F.col(user_defined) if isinstance(user_defined, str) else user_defined
    return F.when(F.upper(F.try_element_at(m, F.lit(METHOD_KEY))) == FIXED.upper(), FIXED).otherwise(CONTENT)


def chunk_by_method(objects: DataFrame, body: str, keys: Sequence[str], user_defined: str, chunker: ContentChunker, payload: bool = False) -> DataFrame:
    """Chunks of each object by its own method; the fixed size is the chunker's average."""
    own = objects.withColumn("_method", method_of(user_defined))
    fixed = fixed_chunks(own.where(F.col("_method") == FIXED), body, [*keys, "_method"], chunker.average, payload)
    content = content_chunks(own.where(F.col("_method") != FIXED), body, [*keys, "_method"], chunker, payload)
    return fixed.unionByName(content).withColumnRenamed("_method", "method")
