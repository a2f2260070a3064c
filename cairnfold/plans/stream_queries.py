"""A query that runs as a stream over all files there are and ends."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfold.plans import catalog
from cairnfold.session import checkpoint_dir
from cairnfold.streaming import ingest

QUERIES, SQL = {}, {}


def stream_dedup_report(spark: SparkSession, d: str) -> DataFrame:
    """Unique chunks and bytes for each namespace, found chunk by chunk as documents stream in."""
    path = f"{d}/documents.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    docs = source.parquet(path) if folder else source.option("pathGlobFilter", "documents.parquet").parquet(d)
    objects = docs.select(
        F.concat(F.lit("ns-"), F.coalesce("lang", F.lit("und"))).alias("namespace"), F.col("doc_id").alias("obj_seq"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"),
    )
    out = os.path.join(checkpoint_dir(spark), "cairnfold", uuid.uuid4().hex)
    unique = ingest.unique_chunks(objects, catalog.WIDTH).select("namespace", "fp", "len")
    query = unique.writeStream.format("parquet").option("checkpointLocation", out + "-log").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("namespace string, fp string, len bigint").parquet(out).groupBy("namespace").agg(F.count(F.lit(1)).alias("unique_chunks"), F.sum("len").alias("unique_bytes"))


QUERIES["stream_dedup_report"] = stream_dedup_report
SQL["stream_dedup_report"] = catalog._CHUNKS + """SELECT namespace, count(*) AS unique_chunks, CAST(sum(len) AS BIGINT) AS unique_bytes FROM f WHERE rn = 1 GROUP BY ALL"""
