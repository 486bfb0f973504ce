"""Queries p1, p2 and p4 and, where DuckDB can express them on whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.drift import schema_changes, unified_pages
from riskframe.operators.hierarchy import declared_tree, descendants
from riskframe.operators.snapshots import method_result_changes
from riskframe.runtime import table


def p1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return method_result_changes(table(spark, sf_dir, "callable_snapshots"), table(spark, sf_dir, "snapshot_manifest"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_changes(spark, sf_dir).select("repository", "snapshot_no", "id", "change")


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_changes(spark, sf_dir).groupBy("repository", "snapshot_no").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")],
        F.count_if(F.array_contains("fields", "signature")).alias("signature_changed"),
        F.count_if(F.array_contains("fields", "risk")).alias("risk_changed"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared_tree(table(spark, sf_dir, "graph_edges"), paths=False).select("node_id", "root_id", "depth")


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared_tree(table(spark, sf_dir, "graph_edges")).select("node_id", "root_id", "depth", "cyclic", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(declared_tree(table(spark, sf_dir, "graph_edges")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "report_pages"))


def p4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "report_pages")
    return unified_pages(pages, schema_changes(pages))


QUERIES = {f.__name__: f for f in (p1_found, p1_summary, p2_found, p2_hierarchy, p2_descendants, p4_found, p4_pages)}

_P1 = r"""
WITH last AS (
  SELECT repository, snapshot_no, lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id,
         max(row(delivered_at, regexp_replace(regexp_replace(signature, '\s+', ' ', 'g'), '^ | $', '', 'g'), risk)) AS r
  FROM callable_snapshots WHERE lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) <> '' GROUP BY 1, 2, 3),
listed AS (
  SELECT repository, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repository ORDER BY snapshot_no) AS before,
         lead(snapshot_no) OVER (PARTITION BY repository ORDER BY snapshot_no) AS after
  FROM (SELECT DISTINCT repository, snapshot_no FROM snapshot_manifest)),
rows AS (SELECT l.repository, l.snapshot_no, l.id, struct_extract_at(r, 2) AS sig, struct_extract_at(r, 3) AS risk, before, after
  FROM last l JOIN listed USING (repository, snapshot_no)),
found AS (
  SELECT n.repository, n.snapshot_no, n.id, CASE WHEN o.id IS NULL THEN 'added' ELSE 'changed' END AS change,
         o.id IS NOT NULL AND n.sig IS DISTINCT FROM o.sig AS sig_differs,
         o.id IS NOT NULL AND CASE WHEN n.risk IS NULL OR o.risk IS NULL THEN n.risk IS DISTINCT FROM o.risk ELSE abs(n.risk - o.risk) >= 0.01 - 1e-9 END AS risk_differs
  FROM rows n LEFT JOIN rows o ON o.repository = n.repository AND o.id = n.id AND o.snapshot_no = n.before
  WHERE n.before IS NOT NULL
  UNION ALL
  SELECT o.repository, o.after, o.id, 'removed', false, false FROM rows o
  WHERE o.after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rows n WHERE n.repository = o.repository AND n.id = o.id AND n.snapshot_no = o.after)),
kept AS (SELECT * FROM found WHERE change <> 'changed' OR sig_differs OR risk_differs)
"""

_P2 = r"""
WITH RECURSIVE e AS (
  SELECT DISTINCT from_id AS p, to_id AS n FROM graph_edges
  WHERE lower(regexp_replace(type, '^\s+|\s+$', '', 'g')) IN ('contains', 'declares') AND from_id IS NOT NULL AND to_id IS NOT NULL),
nodes AS (SELECT p AS id FROM e UNION SELECT n FROM e),
up AS (SELECT n AS id, p AS anc FROM e UNION SELECT up.id, e.p FROM up JOIN e ON e.n = up.anc),
looped AS (SELECT DISTINCT id FROM up WHERE id = anc),
bad AS (SELECT id FROM looped UNION SELECT up.id FROM up JOIN looped l ON l.id = up.anc),
down AS (SELECT id, id AS root, 0 AS depth, id AS path FROM nodes WHERE id NOT IN (SELECT n FROM e)
  UNION SELECT e.n, root, depth + 1, path || '/' || e.n FROM down JOIN e ON e.p = down.id WHERE e.n NOT IN (SELECT id FROM bad)),
best AS (SELECT id, min(row(depth, root, path)) AS b FROM down GROUP BY id)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT repository, snapshot_no, id, change FROM kept",
    "p1_summary": _P1
    + """SELECT repository, snapshot_no, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
  count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (sig_differs) AS signature_changed, count(*) FILTER (risk_differs) AS risk_changed
FROM kept GROUP BY 1, 2""",
    "p2_found": _P2
    + """SELECT id AS node_id, struct_extract_at(b, 2) AS root_id, struct_extract_at(b, 1) AS depth FROM best
UNION ALL SELECT id, '', -1 FROM bad""",
    "p2_hierarchy": _P2
    + """SELECT id AS node_id, struct_extract_at(b, 2) AS root_id, struct_extract_at(b, 1) AS depth, false AS cyclic, struct_extract_at(b, 3) AS path FROM best
UNION ALL SELECT id, '', -1, true, NULL FROM bad""",
    "p2_descendants": _P2
    + """, parts AS (SELECT id, string_split(struct_extract_at(b, 3), '/') AS ids FROM best)
SELECT ids[i] AS ancestor_id, id AS node_id, CAST(len(ids) - i AS INTEGER) AS distance FROM parts, range(1, len(ids)) t(i)""",
}
