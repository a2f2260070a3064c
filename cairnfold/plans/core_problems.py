"""Queries of the general problems 1 and 5, with SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfold.operators.heavy_keys import key_loads, overloading
from cairnfold.operators.orphan_refs import Reference, orphan_references, orphan_report
from cairnfold.session import table

HEAVY = 0.02


def _references(spark: SparkSession, d: str) -> dict[str, Reference]:
    fp = F.lower("fp")
    return {
        "manifest_entries": Reference(
            table(spark, d, "manifest_entries"), "namespace", "dcid", "committed_at",
            F.concat("manifest_id", F.lit(":"), F.col("ordinal").cast("string")),
        ),
        "fp_index": Reference(
            table(spark, d, "fp_index"), "namespace", "dcid", "indexed_at", F.concat("namespace", F.lit(":"), fp)
        ),
    }


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphan_references(_references(spark, d), table(spark, d, "containers"), table(spark, d, "deleted_containers"))
    return found.select("tbl", "ref_key", "dcid", "period").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_references(spark, d), table(spark, d, "containers"), table(spark, d, "deleted_containers"))


def _loads(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "manifest_entries").withColumn("fp", F.lower("fp"))
    return key_loads(entries, ["fp", "dcid"], group="manifest_id", row_key=["manifest_id", "ordinal"], size="len")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overloading(_loads(spark, d), table(spark, d, "manifest_entries").count(), HEAVY)


def p5_loads(spark: SparkSession, d: str) -> DataFrame:
    return _loads(spark, d).withColumnsRenamed({"groups": "manifests"})


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p5_found": p5_found, "p5_loads": p5_loads}

_P1 = """
WITH refs AS (
  SELECT 'manifest_entries' AS tbl, manifest_id || ':' || ordinal AS ref_key, namespace, dcid, committed_at AS tm
  FROM manifest_entries WHERE dcid IS NOT NULL
  UNION ALL
  SELECT 'fp_index', namespace || ':' || lower(fp), namespace, dcid, indexed_at FROM fp_index WHERE dcid IS NOT NULL),
c AS (SELECT namespace, dcid, min(sealed_at) AS since FROM containers GROUP BY ALL),
q AS (SELECT DISTINCT namespace, dcid FROM deleted_containers WHERE dcid IS NOT NULL),
judged AS (
  SELECT tbl, ref_key, refs.dcid, strftime(tm AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN c.dcid IS NULL AND q.dcid IS NULL THEN 'missing' WHEN c.dcid IS NULL THEN 'missing'
         WHEN q.dcid IS NOT NULL THEN 'deleted' WHEN since > tm THEN 'later' END AS reason
  FROM refs LEFT JOIN c ON c.namespace = refs.namespace AND c.dcid = refs.dcid
  LEFT JOIN q ON q.namespace = refs.namespace AND q.dcid = refs.dcid)
"""

_P5 = """
WITH e AS (SELECT lower(fp) AS fp, dcid, manifest_id, ordinal, len FROM manifest_entries),
r AS (SELECT fp, dcid, manifest_id, ordinal, len, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT 'fp' AS key_col, fp AS key_val, * FROM r WHERE fp IS NOT NULL
      UNION ALL SELECT 'dcid', CAST(dcid AS VARCHAR), * FROM r WHERE dcid IS NOT NULL)
"""

SQL = {
    "p1_found": _P1 + "SELECT DISTINCT tbl, ref_key, dcid, period FROM judged WHERE reason IS NOT NULL",
    "p1_report": _P1 + """, o AS (SELECT DISTINCT tbl, ref_key, dcid, period, reason FROM judged WHERE reason IS NOT NULL)
SELECT j.tbl, j.period, j.refs, coalesce(missing, 0) AS missing, coalesce(deleted, 0) AS deleted,
  coalesce(later, 0) AS later, coalesce(orphans, 0) AS orphans
FROM (SELECT tbl, period, count(*) AS refs FROM judged GROUP BY ALL) j LEFT JOIN (
  SELECT tbl, period, count(*) FILTER (reason = 'missing') AS missing, count(*) FILTER (reason = 'deleted') AS deleted,
    count(*) FILTER (reason = 'later') AS later, count(*) AS orphans FROM o GROUP BY ALL) o
ON o.tbl = j.tbl AND o.period IS NOT DISTINCT FROM j.period""",
    "p5_found": _P5 + """SELECT key_col, key_val FROM k GROUP BY ALL
HAVING sum(n) >= 0.02 * (SELECT count(*) FROM manifest_entries)""",
    "p5_loads": _P5 + """SELECT key_col, key_val, CAST(sum(n) AS BIGINT) AS deliveries, count(*) AS records,
  CAST(sum(len) AS BIGINT) AS bytes, count(DISTINCT manifest_id) AS manifests FROM k GROUP BY ALL""",
}
