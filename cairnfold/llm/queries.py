"""Queries of the llm problems, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfold.llm.batch_dedup import chunk_verdicts, identified, near_duplicate_sets, set_links
from cairnfold.llm.container_packing import fill_report, pack
from cairnfold.llm.encoding_repair import damaged_documents, restored_documents
from cairnfold.llm.seen_keys import audit, seen_before
from cairnfold.llm.shared_spans import shared_spans, sharing_report
from cairnfold.llm.source_mixing import mix, share_report
from cairnfold.llm.token_sizes import token_sizes
from cairnfold.session import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen_before(table(spark, d, "manifest_entries"), table(spark, d, "chunks"))


def p2_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit(table(spark, d, "manifest_entries"), table(spark, d, "chunks"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """What of the audit SQL can count too."""
    return p2_audit(spark, d).select("batch", "questions", "known", "repeats", "wrong_no")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = shared_spans(table(spark, d, "manifest_entries"))
    return found.select(F.col("record").alias("manifest_id"), F.col("ordinal").cast("int").alias("ordinal"))


def p3_sharing(spark: SparkSession, d: str) -> DataFrame:
    return sharing_report(table(spark, d, "manifest_entries")).withColumnRenamed("record", "manifest_id")


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """Committed objects as batch 0 and the uploads of all batches, each with the set of its fingerprints' bytes."""
    low = F.lower("fp")
    raw = F.coalesce(F.when(F.length(low) == 64, F.try_to_binary(low, F.lit("hex"))), F.encode(low, "UTF-8"))
    own = F.collect_set(raw.cast("string")).alias("elements")
    entries, objects = table(spark, d, "manifest_entries"), table(spark, d, "objects")
    named = objects.where("manifest_id is not null and namespace is not null and obj_seq is not null")
    named = named.select("manifest_id", F.col("namespace").alias("scope"), F.col("obj_seq").alias("obj")).distinct()
    history = entries.groupBy("manifest_id").agg(own).join(named, "manifest_id").select("scope", "obj", F.lit(0).alias("batch"), "elements")
    uploads = table(spark, d, "chunks").where("namespace is not null and obj_seq is not null")
    uploads = uploads.groupBy(F.col("namespace").alias("scope"), F.col("obj_seq").alias("obj")).agg(F.min("batch_no").cast("int").alias("batch"), own)
    return cut(identified(history.unionByName(uploads)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicate_sets(_sets(spark, d)).select(F.least("obj_a", "obj_b").alias("obj_a"), F.greatest("obj_a", "obj_b").alias("obj_b"))
    return pairs.distinct()


def p4_uploads(spark: SparkSession, d: str) -> DataFrame:
    return set_links(_sets(spark, d)).select(F.col("obj").alias("obj_seq"), F.col("batch").alias("batch_no"), "class_id", "copies", "links")


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_verdicts(table(spark, d, "chunks"), table(spark, d, "manifest_entries"), table(spark, d, "fp_index"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(token_sizes(table(spark, d, "documents"), "text", ["doc_id"]))
    return pack(sizes, table(spark, d, "pack_limits"))[0].withColumnRenamed("size", "n_tokens")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "pack_limits")
    sizes = cut(token_sizes(table(spark, d, "documents"), "text", ["doc_id"]))
    placed, plans = pack(sizes, limits)
    return fill_report(placed, limits, plans)


def _document_sizes(spark: SparkSession, d: str) -> DataFrame:
    return token_sizes(table(spark, d, "documents"), "text", ["doc_id", "source"])


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_document_sizes(spark, d), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(_document_sizes(spark, d))
    return share_report(*mix(sizes, table(spark, d, "mix_targets")), sizes)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return damaged_documents(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored_documents(table(spark, d, "documents"))


QUERIES = {
    "p2_found": p2_found, "p2_audit": p2_audit, "p2_counts": p2_counts,
    "p3_found": p3_found, "p3_sharing": p3_sharing,
    "p4_found": p4_found, "p4_uploads": p4_uploads, "p4_chunks": p4_chunks,
    "p6_packing": p6_packing, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_restored": p8_restored,
}

_P3 = """
WITH e AS (SELECT DISTINCT manifest_id, ordinal, lower(fp) AS fp, len FROM manifest_entries),
r AS (SELECT *, sum(len) OVER w AS after, sum(len) OVER w - len AS before,
        sum(CASE WHEN fp IS NULL THEN 1 ELSE 0 END) OVER w AS run FROM e
      WINDOW w AS (PARTITION BY manifest_id ORDER BY ordinal)),
k AS (SELECT * FROM r WHERE fp IS NOT NULL),
fwd AS (SELECT a.manifest_id, a.ordinal AS s, min(b.ordinal) AS t FROM k a JOIN k b
        ON a.manifest_id = b.manifest_id AND a.run = b.run AND b.ordinal >= a.ordinal AND b.after - a.before >= 1048576
        GROUP BY ALL),
bwd AS (SELECT b.manifest_id, max(a.ordinal) AS s, b.ordinal AS t FROM k a JOIN k b
        ON a.manifest_id = b.manifest_id AND a.run = b.run AND b.ordinal >= a.ordinal AND b.after - a.before >= 1048576
        GROUP BY ALL),
w AS (SELECT manifest_id, s, t FROM fwd UNION SELECT manifest_id, s, t FROM bwd),
c AS (SELECT w.manifest_id, s, t, md5(string_agg(fp || ':' || len, ',' ORDER BY ordinal)) AS content
      FROM w JOIN k ON k.manifest_id = w.manifest_id AND ordinal BETWEEN s AND t GROUP BY ALL),
g AS (SELECT content FROM c GROUP BY ALL HAVING count(DISTINCT manifest_id) > 1),
f AS (SELECT DISTINCT k.manifest_id, k.ordinal FROM c JOIN g USING (content)
      JOIN k ON k.manifest_id = c.manifest_id AND k.ordinal BETWEEN s AND t)
"""

_P4 = """
WITH s AS (SELECT DISTINCT o.namespace AS ns, obj_seq AS obj, 0 AS b, lower(fp) AS fp
           FROM manifest_entries m JOIN objects o USING (manifest_id) WHERE fp IS NOT NULL
           UNION SELECT namespace, obj_seq, batch_no, lower(fp) FROM chunks WHERE fp IS NOT NULL),
n AS (SELECT ns, obj, b, count(*) AS n, md5(string_agg(fp, ',' ORDER BY fp)) AS content FROM s GROUP BY ALL),
i AS (SELECT x.obj AS a, y.obj AS c, count(*) AS i FROM s x JOIN s y ON x.ns = y.ns AND x.fp = y.fp
      WHERE y.b > 0 AND x.b < y.b GROUP BY ALL),
pairs AS (SELECT i.a, i.c, na.content = nc.content AS same FROM i JOIN n na ON na.obj = i.a JOIN n nc ON nc.obj = i.c
          WHERE i.i >= 0.7 * (na.n + nc.n - i.i) - 1e-9)
"""

SQL = {
    "p2_found": """
WITH c AS (SELECT DISTINCT chunk_id, namespace, lower(fp) AS fp FROM chunks WHERE fp IS NOT NULL),
f AS (SELECT namespace, fp, min(chunk_id) AS first FROM c GROUP BY ALL),
h AS (SELECT DISTINCT namespace, lower(fp) AS fp FROM manifest_entries WHERE fp IS NOT NULL)
SELECT DISTINCT chunk_id FROM c JOIN f USING (namespace, fp) LEFT JOIN (SELECT namespace, fp, 1 AS old FROM h) USING (namespace, fp)
WHERE old = 1 OR first < chunk_id""",
    "p2_counts": """
WITH c AS (SELECT batch_no AS batch, namespace, lower(fp) AS fp, count(*) AS n FROM chunks WHERE namespace IS NOT NULL AND fp IS NOT NULL GROUP BY ALL),
f AS (SELECT namespace, fp, min(batch) AS first FROM c GROUP BY ALL),
h AS (SELECT DISTINCT namespace, lower(fp) AS fp, 1 AS old FROM manifest_entries WHERE fp IS NOT NULL)
SELECT batch, count(*) AS questions, count(*) FILTER (old = 1 OR first < batch) AS known, CAST(sum(n - 1) AS BIGINT) AS repeats, 0 AS wrong_no
FROM c JOIN f USING (namespace, fp) LEFT JOIN h USING (namespace, fp) GROUP BY ALL""",
    "p4_found": _P4 + "SELECT a AS obj_a, c AS obj_b FROM pairs",
    "p4_uploads": _P4 + """, ids AS (SELECT ns, content, min(obj) AS class_id FROM n GROUP BY ALL),
l AS (SELECT c, count(*) AS links, count(*) FILTER (same) AS copies FROM pairs GROUP BY ALL)
SELECT n.obj AS obj_seq, n.b AS batch_no, class_id, coalesce(copies, 0) AS copies, coalesce(links, 0) AS links
FROM n JOIN ids ON ids.ns = n.ns AND ids.content = n.content LEFT JOIN l ON l.c = n.obj WHERE n.b > 0""",
    "p4_chunks": """
WITH c AS (SELECT DISTINCT chunk_id, namespace, lower(fp) AS fp FROM chunks),
f AS (SELECT namespace, fp, min(chunk_id) AS first FROM c WHERE fp IS NOT NULL GROUP BY ALL),
h AS (SELECT DISTINCT namespace, lower(fp) AS fp FROM manifest_entries WHERE fp IS NOT NULL),
x AS (SELECT namespace, lower(fp) AS fp, min(dcid) AS dcid FROM fp_index GROUP BY ALL)
SELECT DISTINCT chunk_id, coalesce(h.fp IS NOT NULL OR f.first < chunk_id, false) AS deduped, x.dcid
FROM c LEFT JOIN f ON f.namespace = c.namespace AND f.fp = c.fp LEFT JOIN h ON h.namespace = c.namespace AND h.fp = c.fp
LEFT JOIN x ON x.namespace = c.namespace AND x.fp = c.fp""",
    "p3_found": _P3 + "SELECT manifest_id, ordinal FROM f",
    "p3_sharing": _P3 + """SELECT e.manifest_id, CAST(sum(len) AS BIGINT) AS bytes,
  CAST(coalesce(sum(len) FILTER (f.ordinal IS NOT NULL), 0) AS BIGINT) AS shared_bytes,
  coalesce(sum(len) FILTER (f.ordinal IS NOT NULL), 0) / sum(len) AS shared_part
FROM e LEFT JOIN f ON f.manifest_id = e.manifest_id AND f.ordinal = e.ordinal GROUP BY ALL""",
}
