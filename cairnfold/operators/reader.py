"""Reading objects and byte ranges back from chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfold.functions.naming import shard_of
from cairnfold.session import cut


def range_plan(entries: DataFrame, start: Column | int, length: Column | int, keys: Sequence[str] = ("manifest_id",)) -> DataFrame:
    """Chunks that a range touches, with ``skip`` (bytes to leave out at its head) and ``take`` (bytes to use).

    ``start`` and ``length`` are numbers or columns; a length of -1 reads to the end, any other negative length
    or start is an error for the caller to find by ``range_error`` and touches nothing here. A range past the end
    is cut off. ``chunk_offset`` must be known, so that the scan can leave out row groups by it.
    """
    a = F.lit(start) if isinstance(start, int) else start
    n = F.lit(length) if isinstance(length, int) else length
    stop = F.when(n == -1, F.lit(2**62)).otherwise(a + n)
    off, end = F.col("chunk_offset"), F.col("chunk_offset") + F.col("len")
    touched = entries.where((a >= 0) & (n >= -1) & (end > a) & (off < stop))
    skip = F.greatest(a - off, F.lit(0))
    take = F.least(end, stop) - F.greatest(off, a)
    return touched.withColumn("skip", skip.cast("bigint")).withColumn("take", take.cast("bigint"))


def range_error(start: Column, length: Column, size: Column, etag: Column | None = None, match: Column | None = None) -> Column:
    """invalid_range, precondition_failed or null."""
    out = F.when((start < 0) | (length < -1) | (start > size), "invalid_range")
    if etag is not None and match is not None:
        out = out.when(match.isNotNull() & ~match.eqNullSafe(etag), "precondition_failed")
    return out


def opened(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The containers that a read opens: ``<keys>, namespace, dcid, shard, reads, bytes``, each once for its object. The
    shards are the folders that hold them."""
    own = plan.groupBy(*keys, "namespace", "dcid").agg(F.count(F.lit(1)).alias("reads"), F.sum("take").cast("bigint").alias("bytes"))
    return own.withColumn("shard", shard_of("dcid"))


def locate(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries with the ``offset, stored_len, codec, payload`` of their block."""
    own = blocks.select("namespace", "dcid", "fp", "offset", "stored_len", "codec", "payload")
    return entries.join(own, ["namespace", "dcid", "fp"])


def missing_blocks(entries: DataFrame, blocks: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Entries whose container lacks their fingerprint; empty where the store is sound. Entries are reduced to their
    keys before these meet the blocks, so that a fingerprint of very many entries is looked up once; what is
    missing goes back to the entries, by a broadcast up to a number of bytes."""
    on = ["namespace", "dcid", "fp"]
    keys = entries.select(*on).distinct()
    missing = cut(keys.join(blocks.select(*on).distinct(), on, "left_anti"))
    wide = missing.agg(F.sum(F.lit(48) + F.coalesce(F.octet_length("namespace"), F.lit(0)) + F.coalesce(F.octet_length("fp"), F.lit(0)))).first()[0] or 0
    null = {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in on}  # a null key finds itself again
    known = missing.withColumns(null).select(*null)
    return entries.withColumns(null).join(F.broadcast(known) if wide <= broadcast_bytes else known, list(null), "left_semi").drop(*null)


def assemble(pieces: DataFrame, keys: Sequence[str], ordinal: str = "ordinal", data: str = "data") -> DataFrame:
    """``keys, body``: pieces of bytes joined in their order, in the JVM and without another form of them. An object
    must fit one row, as any binary value; ``parts`` has no such bound."""
    joined = F.expr(f"listagg(`{data}`) WITHIN GROUP (ORDER BY `{ordinal}`)")
    return pieces.groupBy(*keys).agg(joined.alias("body"))


def parts(pieces: DataFrame, keys: Sequence[str], offset: str, part_bytes: int, ordinal: str = "ordinal", data: str = "data") -> DataFrame:
    """``keys, part, body``: the same for objects of any size, in parts of about ``part_bytes``: each takes the pieces that
    begin in it, by their ``offset`` in what is read."""
    own = pieces.withColumn("part", F.floor(F.col(offset) / part_bytes).cast("bigint"))
    return assemble(own, [*keys, "part"], ordinal, data)


def running_offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, name: str) -> DataFrame:
    """Sum of the sizes before each row of a key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))
