"""Queries of the general data problems (1, 3, 4, 5 and 6) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import hierarchy, incremental, orphans, rolling, skewcount
from loamgraph.sources.tables import table

TENANT_SHARE, TAG_SHARE = 0.04, 0.01


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "tenant_id", "row_key", "ref_id", "reason")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(*(table(spark, d, t) for t in ("entity_tags", "tags", "nodes", "node_content")))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_assignments(table(spark, d, "entity_tags"), table(spark, d, "trend_progress"))


def p3_backlog(spark: SparkSession, d: str) -> DataFrame:
    """New (key, version) pairs per tenant and shard."""
    return incremental.changed_since(table(spark, d, "entity_tags"), table(spark, d, "trend_progress")).groupBy("tenant_id", "source_shard").agg(F.count("*").alias("n_versions"), F.max("entity_seq").alias("max_seq"))


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(table(spark, d, "tag_activity"), ["tenant_id", "tag_id"], "bucket", "attaches", (7, 30), where=F.col("grain") == 86400)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d).where("age >= 29 and total_7 >= 40 and 4 * total_7 >= 3 * total_30").select("tenant_id", "tag_id", "bucket")


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d).select("tenant_id", "tag_id", "bucket", "total_7", "total_30", F.round("avg_7", 6).alias("avg_7"), F.round("avg_30", 6).alias("avg_30"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tree_faults(table(spark, d, "nodes"))


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "nodes")).select("tenant_id", "node_id", "root_id", "depth", "path", "n_descendants", "state")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skewcount.heavy_keys(table(spark, d, "entity_tags"), {"tenant_id": TENANT_SHARE, "tag_id": TAG_SHARE}).select("field", "key_value")


def p6_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows, assignments (which repeated rows and null tags don't count for) and entities of every value."""
    return skewcount.per_key_results(table(spark, d, "entity_tags"), ("tenant_id", "tag_id"), ("tenant_id", "entity_type", "entity_id"), "tag_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_backlog, p4_found, p4_rolling, p5_found, p5_hierarchy, p6_found, p6_per_key)}

_NOW = """
tag_now AS (SELECT tenant_id, tag_id, arg_max(deleted, version) AS deleted, min(created_at) AS created_at FROM tags GROUP BY ALL),
node_now AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY tenant_id, node_id ORDER BY version DESC, updated_at DESC) = 1)"""

_P1 = f"""WITH {_NOW},
refs AS (
  SELECT 'entity_tags' AS ref_table, tenant_id, entity_type || '/' || entity_id AS row_key, tag_id AS ref_id, min(created_at) AS ref_at FROM entity_tags WHERE tag_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'nodes', tenant_id, CAST(node_id AS VARCHAR), parent_id, created_at FROM node_now WHERE parent_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'node_content', tenant_id, CAST(node_id AS VARCHAR), node_id, make_timestamp(((node_id >> 22) + 1704067200000) * 1000) FROM node_content WHERE node_id IS NOT NULL),
targets AS (
  SELECT 'entity_tags' AS ref_table, tenant_id, tag_id AS id, deleted, created_at FROM tag_now
  UNION ALL SELECT 'nodes', tenant_id, node_id, false, created_at FROM node_now
  UNION ALL SELECT 'node_content', tenant_id, node_id, false, NULL FROM node_now),
joined AS (SELECT r.*, t.id, t.deleted, t.created_at FROM refs r LEFT JOIN targets t ON r.ref_table = t.ref_table AND r.tenant_id = t.tenant_id AND r.ref_id = t.id),
found AS (
  SELECT ref_table, tenant_id, row_key, ref_id, 'missing' AS reason, ref_at FROM joined WHERE id IS NULL
  UNION ALL SELECT ref_table, tenant_id, row_key, ref_id, 'deleted', ref_at FROM joined WHERE deleted
  UNION ALL SELECT ref_table, tenant_id, row_key, ref_id, 'late', ref_at FROM joined WHERE ref_at < created_at)
"""

_P4 = """WITH act AS (SELECT tenant_id, tag_id, bucket, max(coalesce(attaches, 0)) AS attaches FROM tag_activity WHERE grain = 86400 GROUP BY ALL),
days AS (SELECT tenant_id, tag_id, first, unnest(range(first, (SELECT max(bucket) + 1 FROM act))) AS bucket FROM (SELECT tenant_id, tag_id, min(bucket) AS first FROM act GROUP BY ALL)),
dense AS (SELECT d.*, coalesce(a.attaches, 0) AS attaches FROM days d LEFT JOIN act a USING (tenant_id, tag_id, bucket)),
rolled AS (SELECT *, CAST(sum(attaches) OVER (w ROWS 6 PRECEDING) AS BIGINT) AS total_7, CAST(sum(attaches) OVER (w ROWS 29 PRECEDING) AS BIGINT) AS total_30 FROM dense WINDOW w AS (PARTITION BY tenant_id, tag_id ORDER BY bucket))
"""

_P5 = f"""WITH RECURSIVE {_NOW},
up AS (
  SELECT tenant_id, node_id AS start, node_id, parent_id, [node_id] AS ids, false AS ring FROM node_now
  UNION ALL
  SELECT u.tenant_id, u.start, n.node_id, n.parent_id, list_append(u.ids, n.node_id), list_contains(u.ids, n.node_id)
  FROM up u JOIN node_now n ON n.tenant_id = u.tenant_id AND n.node_id = u.parent_id WHERE NOT u.ring),
ends AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY tenant_id, start ORDER BY len(ids) DESC) = 1),
told AS (SELECT tenant_id, start AS node_id, node_id AS root_id, ids, ring, parent_id,
  CASE WHEN NOT ring AND parent_id IS NULL THEN 'rooted' WHEN NOT ring THEN 'dangling' WHEN ids[len(ids)] = ids[1] THEN 'cycle' ELSE 'below_cycle' END AS state,
  '/' || array_to_string(list_reverse(ids), '/') || '/' AS path, CAST(len(ids) - 1 AS INTEGER) AS depth FROM ends)
"""

SQL = {
    "p1_found": _P1 + "SELECT DISTINCT ref_table, tenant_id, row_key, ref_id, reason FROM found",
    "p1_report": _P1 + "SELECT ref_table, strftime(ref_at, '%Y-%m') AS month, reason, count(*) AS n_refs, count(DISTINCT (tenant_id, ref_id)) AS n_targets FROM found GROUP BY ALL",
    "p3_found": """SELECT DISTINCT e.tenant_id, e.entity_type, e.entity_id, e.tag_id FROM entity_tags e
LEFT JOIN (SELECT * FROM trend_progress QUALIFY row_number() OVER (PARTITION BY tenant_id, source_shard ORDER BY last_seq DESC, updated_at DESC) = 1) p USING (tenant_id, source_shard)
WHERE e.tag_id IS NOT NULL AND (p.last_seq IS NULL OR e.entity_seq > p.last_seq OR e.created_at > p.updated_at)""",
    "p3_backlog": """SELECT tenant_id, source_shard, count(*) AS n_versions, max(entity_seq) AS max_seq FROM (
SELECT DISTINCT e.tenant_id, e.entity_type, e.entity_id, e.tag_id, e.source_shard, e.entity_seq, e.created_at FROM entity_tags e
LEFT JOIN (SELECT * FROM trend_progress QUALIFY row_number() OVER (PARTITION BY tenant_id, source_shard ORDER BY last_seq DESC, updated_at DESC) = 1) p USING (tenant_id, source_shard)
WHERE e.tag_id IS NOT NULL AND (p.last_seq IS NULL OR e.entity_seq > p.last_seq OR e.created_at > p.updated_at)) GROUP BY ALL""",
    "p4_found": _P4 + "SELECT tenant_id, tag_id, bucket FROM rolled WHERE bucket >= first + 29 AND total_7 >= 40 AND 4 * total_7 >= 3 * total_30",
    "p4_rolling": _P4 + "SELECT tenant_id, tag_id, bucket, total_7, total_30, round(total_7 / 7.0, 6) AS avg_7, round(total_30 / 30.0, 6) AS avg_30 FROM rolled",
    "p5_found": _P5
    + """SELECT tenant_id, node_id, state AS fault FROM told WHERE ring
UNION ALL SELECT n.tenant_id, n.node_id, 'path' FROM told t JOIN node_now n USING (tenant_id, node_id) WHERE state = 'rooted' AND n.path IS DISTINCT FROM t.path
UNION ALL SELECT n.tenant_id, n.node_id, 'depth' FROM told t JOIN node_now n USING (tenant_id, node_id) WHERE state = 'rooted' AND n.depth IS DISTINCT FROM t.depth""",
    "p5_hierarchy": _P5
    + """, below AS (SELECT t.tenant_id, u.id AS node_id, count(*) - 1 AS n_descendants FROM told t, unnest(t.ids) AS u(id) WHERE NOT t.ring GROUP BY ALL)
SELECT t.tenant_id, t.node_id, CASE WHEN NOT ring THEN root_id END AS root_id, CASE WHEN NOT ring THEN depth END AS depth, CASE WHEN NOT ring THEN path END AS path, n_descendants, state
FROM told t LEFT JOIN below b ON b.tenant_id = t.tenant_id AND b.node_id = t.node_id AND NOT t.ring""",
    "p6_found": """SELECT 'tenant_id' AS field, tenant_id AS key_value FROM entity_tags WHERE tenant_id IS NOT NULL GROUP BY tenant_id HAVING count(*) >= 0.04 * (SELECT count(*) FROM entity_tags)
UNION ALL SELECT 'tag_id', CAST(tag_id AS VARCHAR) FROM entity_tags WHERE tag_id IS NOT NULL GROUP BY tag_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM entity_tags)""",
    "p6_per_key": """SELECT 'tenant_id' AS field, tenant_id AS key_value, count(*) AS n_rows, count(DISTINCT (tenant_id, entity_type, entity_id, tag_id)) FILTER (tag_id IS NOT NULL) AS n_assignments, count(DISTINCT (tenant_id, entity_type, entity_id)) AS n_entities FROM entity_tags GROUP BY tenant_id
UNION ALL SELECT 'tag_id', CAST(tag_id AS VARCHAR), count(*), count(DISTINCT (tenant_id, entity_type, entity_id, tag_id)) FILTER (tag_id IS NOT NULL), count(DISTINCT (tenant_id, entity_type, entity_id)) FROM entity_tags GROUP BY tag_id""",
}
