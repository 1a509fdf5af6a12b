"""Tree store queries (h)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import lexorank
from loamgraph.functions.paths import is_valid, path_ids, under, upper_bound
from loamgraph.operators import hierarchy, trending, tree
from loamgraph.operators.orphans import id_time
from loamgraph.operators.skew import next_above
from loamgraph.plans.views import using
from loamgraph.session import Scratch
from loamgraph.sources import domain
from loamgraph.sources.tables import table

Q: dict = {}
SQL: dict = {}


def _q(sql: str | None = None, views: str = "", recursive: bool = False):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = using(views, sql, recursive) if views else sql
        return f

    return add


# The subtree the paged queries look at: the largest by stored paths among depth-1 nodes.
_PICK = """ids AS (SELECT tenant_id, node_id, depth, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS ids FROM node_current),
under_ AS (SELECT tenant_id, unnest(ids) AS anc_id, depth FROM ids),
sizes AS (SELECT tenant_id, anc_id, count(*) AS n, CAST(max(depth) AS INTEGER) AS deepest FROM under_ GROUP BY ALL),
pick AS (SELECT n.* FROM node_current n JOIN sizes z ON z.tenant_id = n.tenant_id AND z.anc_id = n.node_id WHERE n.depth = 1 AND n.status = 'ACTIVE' ORDER BY z.n DESC, n.node_id LIMIT 1),
gone AS (SELECT DISTINCT i.tenant_id, i.node_id FROM (SELECT tenant_id, node_id, unnest(ids) AS anc_id FROM ids) i JOIN node_current t ON t.tenant_id = i.tenant_id AND t.node_id = i.anc_id WHERE t.status = 'TRASHED')"""


def _pick(s, d) -> dict:
    nodes = domain.node_current(s, d)
    size = tree.subtree_sizes(nodes).select(F.col("tenant_id").alias("z_tenant"), F.col("anc_id"), "n")
    best = nodes.where("depth = 1 and status = 'ACTIVE'").join(size, (F.col("tenant_id") == F.col("z_tenant")) & (F.col("node_id") == F.col("anc_id")))
    return best.orderBy(F.desc("n"), "node_id").first().asDict()


def _restrictions(s, d) -> DataFrame:
    """View rules on every seventh node of depth 1 or 2, edit rules on every eleventh."""
    n = domain.node_current(s, d).where("depth in (1, 2)")
    k = F.shiftright("node_id", 22)
    view = n.where(k % 7 == 0).select("tenant_id", "node_id", F.lit("VIEW").alias("op"), F.concat(F.lit("group:g"), k % 3).alias("principal"))
    edit = n.where(k % 11 == 0).select("tenant_id", "node_id", F.lit("EDIT").alias("op"), F.concat(F.lit("group:g"), k % 2).alias("principal"))
    return view.unionByName(edit)


_RULES = "rules AS (SELECT tenant_id, node_id, 'VIEW' AS op, 'group:g' || ((node_id >> 22) % 3) AS principal FROM node_current WHERE depth IN (1, 2) AND (node_id >> 22) % 7 = 0 UNION ALL SELECT tenant_id, node_id, 'EDIT', 'group:g' || ((node_id >> 22) % 2) FROM node_current WHERE depth IN (1, 2) AND (node_id >> 22) % 11 = 0)"


@_q("SELECT tenant_id, node_id, regexp_matches(path, '^/([0-9]+/)+$') AS valid, substring(path, 1, length(path) - 1) || '0' AS upper_bound, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS n_ids FROM node_current", "node_current")
def h01_paths(s, d):
    p = F.col("path")
    return domain.node_current(s, d).select("tenant_id", "node_id", is_valid(p).alias("valid"), upper_bound(p).alias("upper_bound"), F.size(path_ids(p)).alias("n_ids"))


@_q(f"WITH {_PICK} SELECT n.tenant_id, n.node_id, g.node_id IS NOT NULL AS in_trash FROM node_current n LEFT JOIN gone g ON g.tenant_id = n.tenant_id AND g.node_id = n.node_id", "node_current")
def h02_in_trash(s, d):
    return tree.with_trash_flag(domain.node_current(s, d)).select("tenant_id", "node_id", "in_trash")


@_q(f"WITH {_PICK}, steps AS (SELECT tenant_id, node_id, unnest(ids) AS anc_id, generate_subscripts(ids, 1) - 1 AS pos FROM ids) SELECT s.tenant_id, s.node_id, CAST(pos AS INTEGER) AS pos, s.anc_id, a.title AS anc_title FROM steps s JOIN node_current a ON a.tenant_id = s.tenant_id AND a.node_id = s.anc_id WHERE s.anc_id <> s.node_id", "node_current")
def h03_breadcrumbs(s, d):
    return tree.breadcrumbs(domain.node_current(s, d)).select("tenant_id", "node_id", "pos", "anc_id", "anc_title")


@_q(f"WITH {_PICK} SELECT node_id, rank FROM node_current WHERE tenant_id = (SELECT tenant_id FROM pick) AND parent_id = (SELECT parent_id FROM pick) AND status = 'ACTIVE' AND (rank, node_id) > ('9010', 0) ORDER BY rank, node_id LIMIT 11", "node_current")
def h04_children_page(s, d):
    at = _pick(s, d)
    return tree.children_page(domain.node_current(s, d), at["tenant_id"], at["parent_id"], ("9010", 0), 10).select("node_id", "rank")


@_q("SELECT tenant_id, parent_id, node_id, CAST(row_number() OVER (PARTITION BY tenant_id, parent_id ORDER BY rank, node_id) AS INTEGER) AS place FROM node_current WHERE status = 'ACTIVE' AND parent_id IS NOT NULL", "node_current")
def h04_children(s, d):
    return tree.all_children(domain.node_current(s, d))


@_q(f"WITH {_PICK} SELECT n.node_id, n.path FROM node_current n, pick p WHERE n.tenant_id = p.tenant_id AND starts_with(n.path, p.path) AND n.path <> p.path AND n.depth <= p.depth + 3 AND n.node_id NOT IN (SELECT node_id FROM gone g WHERE g.tenant_id = p.tenant_id) ORDER BY n.path LIMIT 51", "node_current")
def h05_descendants_page(s, d):
    at = _pick(s, d)
    return tree.descendants_page(domain.node_current(s, d), at["tenant_id"], at["path"], at["depth"], 3, None, 50).select("node_id", "path")


@_q("SELECT tenant_id, depth, count(*) AS nodes, CAST(max(length(path)) AS INTEGER) AS longest FROM node_current GROUP BY ALL", "node_current")
def h05_shape(s, d):
    n = domain.node_current(s, d)
    return n.groupBy("tenant_id", "depth").agg(F.count("*").alias("nodes"), F.max(F.length("path")).alias("longest"))


@_q(f"WITH {_PICK} SELECT n.node_id, CASE WHEN n.tenant_id = p.tenant_id AND starts_with(n.path, p.path) THEN '/1/2/' || substring(n.path, length(p.path) + 1) ELSE n.path END AS path, CAST(CASE WHEN n.tenant_id = p.tenant_id AND starts_with(n.path, p.path) THEN n.depth + 2 ELSE n.depth END AS INTEGER) AS depth FROM node_current n, pick p WHERE true", "node_current")
def h06_overlay(s, d):
    at = _pick(s, d)
    return tree.effective(domain.node_current(s, d), at["tenant_id"], at["path"], "/1/2/", 2).select("node_id", "path", "depth")


@_q("SELECT tenant_id, space_id, node_id, CAST(row_number() OVER (PARTITION BY tenant_id, space_id ORDER BY trashed_at DESC NULLS LAST, node_id) AS INTEGER) AS place FROM node_current WHERE status = 'TRASHED' QUALIFY place <= 1000", "node_current")
def h07_trash(s, d):
    return tree.trash_list(domain.node_current(s, d)).select("tenant_id", "space_id", "node_id", "place")


@_q("SELECT tenant_id, parent_id, rank, lag(rank) OVER w AS below, lead(rank) OVER w AS above FROM (SELECT DISTINCT tenant_id, parent_id, rank FROM node_current WHERE parent_id IS NOT NULL) WINDOW w AS (PARTITION BY tenant_id, parent_id ORDER BY rank)", "node_current")
def h08_rank_neighbours(s, d):
    return tree.rank_neighbours(domain.node_current(s, d))


@_q()
def h09_ranks_between(s, d):
    """A rank for a new sibling before every distinct rank; null beside a text that is no rank."""
    rows = tree.rank_neighbours(domain.node_current(s, d))

    @F.pandas_udf("string")
    def mid(low: pd.Series, high: pd.Series) -> pd.Series:
        fine = lambda r: r is None or lexorank.is_rank(r)
        return pd.Series([lexorank.between(a, b) if b is not None and fine(a) and fine(b) else None for a, b in zip(low, high, strict=True)], dtype=object)

    return rows.select("tenant_id", "parent_id", "below", "rank", mid("below", "rank").alias("fresh"))


_MAY = "(node_type <> 'space' AND coalesce(parent_type, '') <> 'task')"


@_q(
    f"WITH {_PICK}, req AS (SELECT tenant_id, node_id + 1 AS new_id, CASE WHEN (node_id >> 22) % 5 = 0 THEN node_id + 3 ELSE node_id END AS parent_id, CASE WHEN (node_id >> 22) % 4 = 0 THEN 'space' ELSE 'page' END AS node_type FROM node_current), tops AS (SELECT tenant_id, parent_id, max(rank) AS max_rank FROM node_current GROUP BY ALL), j AS (SELECT r.*, p.path AS pp, p.depth AS pd, p.node_type AS parent_type, g.node_id IS NOT NULL AS dead, t.max_rank FROM req r LEFT JOIN node_current p ON p.tenant_id = r.tenant_id AND p.node_id = r.parent_id LEFT JOIN gone g ON g.tenant_id = r.tenant_id AND g.node_id = r.parent_id LEFT JOIN tops t ON t.tenant_id = r.tenant_id AND t.parent_id = r.parent_id), v AS (SELECT *, CASE WHEN pp IS NULL THEN 'NO_PARENT' WHEN dead THEN 'PARENT_TRASHED' WHEN pd >= 63 THEN 'TOO_DEEP' WHEN NOT {_MAY} THEN 'TYPE' ELSE 'CREATED' END AS verdict FROM j) SELECT tenant_id, new_id, parent_id, verdict, CASE WHEN verdict = 'CREATED' THEN pp || new_id || '/' END AS path, CAST(CASE WHEN verdict = 'CREATED' THEN pd + 1 END AS INTEGER) AS depth, CASE WHEN verdict = 'CREATED' THEN max_rank END AS after_rank FROM v",
    "node_current",
)
def h10_create(s, d):
    n = domain.node_current(s, d)
    k = F.shiftright("node_id", 22)
    req = n.select("tenant_id", (F.col("node_id") + 1).alias("new_id"), F.when(k % 5 == 0, F.col("node_id") + 3).otherwise(F.col("node_id")).alias("parent_id"), F.when(k % 4 == 0, "space").otherwise("page").alias("node_type"))
    return tree.check_create(req, n, F.expr(_MAY))


@_q(
    f"WITH {_PICK}, target AS (SELECT n.* FROM node_current n, pick p WHERE n.tenant_id = p.tenant_id AND n.parent_id IS NULL ORDER BY n.space_id = p.space_id, n.node_id LIMIT 1) SELECT n.node_id, CASE WHEN n.tenant_id = p.tenant_id AND n.path = p.path THEN t.node_id ELSE n.parent_id END AS parent_id, CASE WHEN n.tenant_id = p.tenant_id AND starts_with(n.path, p.path) THEN t.path || p.node_id || '/' || substring(n.path, length(p.path) + 1) ELSE n.path END AS path, CAST(CASE WHEN n.tenant_id = p.tenant_id AND starts_with(n.path, p.path) THEN n.depth + t.depth + 1 - (length(p.path) - length(replace(p.path, '/', '')) - 2) ELSE n.depth END AS INTEGER) AS depth FROM node_current n, pick p, target t WHERE true",
    "node_current",
)
def h11_move(s, d):
    at, n = _pick(s, d), domain.node_current(s, d)
    mine = n.where(F.col("tenant_id") == at["tenant_id"])
    to = mine.where("parent_id is null").orderBy(F.col("space_id") == at["space_id"], "node_id").first()
    return tree.move_subtree(n, at["tenant_id"], at["path"], to["path"], to["node_id"], to["depth"]).select("node_id", "parent_id", "path", "depth")


_MOVES = """asked AS (SELECT tenant_id, node_id, CASE (node_id >> 22) % 6 WHEN 0 THEN parent_id WHEN 1 THEN node_id + 1 ELSE (SELECT min(x.node_id) FROM node_current x WHERE x.tenant_id = n.tenant_id AND x.depth = (n.node_id >> 22) % 4 AND x.node_id > n.node_id) END AS to_id FROM node_current n)"""


@_q(
    f"WITH {_PICK}, {_MOVES}, j AS (SELECT a.*, n.path, n.depth, n.parent_id, n.space_id, z.n, z.deepest, t.path AS t_path, t.depth AS t_depth, t.space_id AS t_space, (a.tenant_id, a.node_id) IN (SELECT (tenant_id, node_id) FROM gone) OR (a.tenant_id, a.to_id) IN (SELECT (tenant_id, node_id) FROM gone) AS dead FROM asked a JOIN node_current n ON n.tenant_id = a.tenant_id AND n.node_id = a.node_id LEFT JOIN sizes z ON z.tenant_id = a.tenant_id AND z.anc_id = a.node_id LEFT JOIN node_current t ON t.tenant_id = a.tenant_id AND t.node_id = a.to_id WHERE a.to_id IS NOT NULL) SELECT tenant_id, node_id, to_id, CASE WHEN t_path IS NULL THEN 'NO_TARGET' WHEN parent_id = to_id THEN 'SAME_PARENT' WHEN parent_id IS NULL THEN 'ROOT' WHEN dead THEN 'TRASHED' WHEN starts_with(t_path, path) THEN 'CYCLE' WHEN deepest - depth + t_depth + 1 > 63 THEN 'TOO_DEEP' WHEN n > 5 AND space_id IS DISTINCT FROM t_space THEN 'TOO_LARGE' WHEN n > 5 THEN 'JOB' ELSE 'DONE' END AS verdict, n AS size FROM j",
    "node_current",
)
def h11_move_checks(s, d):
    """Every node asked to move below its parent, a missing node or a later one of another depth; subtrees above five nodes are large."""
    scratch = Scratch(s, "asked")
    n = scratch.keep(domain.node_current(s, d).select("tenant_id", "node_id", "parent_id", "space_id", "path", "depth", "status"))
    k = F.shiftright("node_id", 22)
    # the next node of each depth: candidates and askers in one order, each asker sees the first candidate behind it
    known = n.where("tenant_id is not null and node_id is not null")
    targets = known.select("tenant_id", F.col("depth").cast("long").alias("level"), "node_id", F.lit(None).cast("long").alias("parent_id"), F.lit(True).alias("target"))
    askers = known.select("tenant_id", (k % 4).alias("level"), "node_id", "parent_id", F.lit(False).alias("target"))
    asked = next_above(targets.unionByName(askers), ["tenant_id", "level"], "node_id", "target", scratch)
    to = F.when(k % 6 == 0, F.col("parent_id")).when(k % 6 == 1, F.col("node_id") + 1).otherwise(F.col("next"))
    return tree.check_moves(asked.select("tenant_id", "node_id", to.alias("to_id")).where("to_id is not null"), n, 5)


@_q(f"WITH {_PICK} SELECT tenant_id, anc_id, n, deepest FROM sizes", "node_current")
def h11_subtree_sizes(s, d):
    return tree.subtree_sizes(domain.node_current(s, d))


@_q(
    f"WITH {_PICK}, k AS (SELECT n.tenant_id, n.node_id, row_number() OVER (ORDER BY n.node_id) <= 6 AS now FROM node_current n, pick p WHERE n.tenant_id = p.tenant_id AND starts_with(n.path, p.path)) SELECT n.tenant_id, n.node_id, CASE WHEN k.now THEN '/1/2/' || substring(n.path, length(p.path) + 1) ELSE n.path END AS path, CASE WHEN k.node_id IS NOT NULL THEN '/1/2/' || substring(n.path, length(p.path) + 1) ELSE n.path END AS read_path, CAST(CASE WHEN k.now THEN n.depth + 2 ELSE n.depth END AS INTEGER) AS depth FROM node_current n JOIN pick p ON true LEFT JOIN k ON k.tenant_id = n.tenant_id AND k.node_id = n.node_id",
    "node_current",
)
def h13_move_batches(s, d):
    """After two batches of three rows: what is stored, and what a read through the running move sees."""
    at, n = _pick(s, d), domain.node_current(s, d)
    for _ in range(2):
        n = tree.rewrite_batch(n, at["tenant_id"], at["path"], "/1/2/", 2, 3)
    seen = tree.effective(n, at["tenant_id"], at["path"], "/1/2/", 2).select(F.col("tenant_id").alias("e_tenant"), F.col("node_id").alias("e_node"), F.col("path").alias("read_path"))
    both = n.join(seen, F.col("tenant_id").eqNullSafe(F.col("e_tenant")) & (F.col("node_id") == F.col("e_node")))
    return both.select("tenant_id", "node_id", "path", "read_path", "depth")


@_q(f"WITH {_PICK}, {_RULES}, closed AS (SELECT tenant_id, node_id FROM rules WHERE op = 'VIEW' GROUP BY ALL HAVING NOT bool_or(principal IN ('group:g1', 'group:g9'))), bad AS (SELECT DISTINCT i.tenant_id, i.node_id FROM (SELECT tenant_id, node_id, unnest(ids) AS anc_id FROM ids) i JOIN closed c ON c.tenant_id = i.tenant_id AND c.node_id = i.anc_id) SELECT tenant_id, node_id FROM node_current WHERE (tenant_id, node_id) NOT IN (SELECT (tenant_id, node_id) FROM bad)", "node_current")
def h12_visible(s, d):
    return tree.visible(domain.node_current(s, d), _restrictions(s, d), ["group:g1", "group:g9"]).select("tenant_id", "node_id")


@_q(f"WITH {_PICK}, {_RULES}, closed AS (SELECT tenant_id, node_id, op FROM rules GROUP BY ALL HAVING NOT bool_or(principal = 'group:g1')), bad AS (SELECT DISTINCT i.tenant_id, i.node_id FROM (SELECT tenant_id, node_id, unnest(ids) AS anc_id FROM ids) i JOIN closed c ON c.tenant_id = i.tenant_id AND c.node_id = i.anc_id) SELECT tenant_id, count(*) AS editable FROM node_current WHERE (tenant_id, node_id) NOT IN (SELECT (tenant_id, node_id) FROM bad) GROUP BY tenant_id", "node_current")
def h12_editable(s, d):
    return tree.visible(domain.node_current(s, d), _restrictions(s, d), ["group:g1"], "EDIT").groupBy("tenant_id").agg(F.count("*").alias("editable"))


@_q(
    "WITH e AS (SELECT tenant_id, node_id, version, status, title AS had, version - CASE WHEN (node_id >> 22) % 6 = 0 THEN 1 ELSE 0 END AS expected_version, (['TITLE', 'TRASH', 'RESTORE'])[(node_id >> 22) % 3 + 1] AS action FROM node_current), o AS (SELECT *, CASE WHEN version <> expected_version THEN 'STALE' WHEN action = 'TRASH' AND status = 'TRASHED' OR action = 'RESTORE' AND status = 'ACTIVE' THEN 'NO_CHANGE' ELSE 'APPLIED' END AS outcome FROM e) SELECT tenant_id, node_id, outcome, CAST(version + CASE WHEN outcome = 'APPLIED' THEN 1 ELSE 0 END AS INTEGER) AS version, CASE WHEN outcome = 'APPLIED' AND action = 'TRASH' THEN 'TRASHED' WHEN outcome = 'APPLIED' AND action = 'RESTORE' THEN 'ACTIVE' ELSE status END AS status, CASE WHEN outcome = 'APPLIED' AND action = 'TITLE' THEN 'new title' ELSE had END AS title FROM o",
    "node_current",
)
def h14_edits(s, d):
    n = domain.node_current(s, d)
    k = F.shiftright("node_id", 22)
    action = F.element_at(F.array(F.lit("TITLE"), F.lit("TRASH"), F.lit("RESTORE")), (k % 3 + 1).cast("int"))
    edits = n.select("tenant_id", "node_id", (F.col("version") - (k % 6 == 0).cast("int")).alias("expected_version"), action.alias("action"), F.lit("new title").alias("title"))
    return tree.apply_edits(n, edits)


@_q(f"WITH {_PICK}, {_RULES} SELECT 'nodes' AS part, count(*) AS left_over FROM node_current WHERE (tenant_id, node_id) NOT IN (SELECT (tenant_id, node_id) FROM gone) UNION ALL SELECT 'content', count(*) FROM node_content WHERE (tenant_id, node_id) NOT IN (SELECT (tenant_id, node_id) FROM gone) UNION ALL SELECT 'restrictions', count(*) FROM rules WHERE (tenant_id, node_id) NOT IN (SELECT (tenant_id, node_id) FROM gone)", "node_current")
def h15_purge(s, d):
    kept = tree.purge(domain.node_current(s, d), table(s, d, "node_content"), _restrictions(s, d))
    out = None
    for name, part in zip(("nodes", "content", "restrictions"), kept, strict=True):
        one = part.agg(F.count("*").alias("left_over")).select(F.lit(name).alias("part"), "left_over")
        out = one if out is None else out.unionByName(one)
    return out


@_q(
    "SELECT c.tenant_id, c.node_id, 'path' AS problem FROM node_current c JOIN node_current p ON p.tenant_id = c.tenant_id AND p.node_id = c.parent_id WHERE c.path IS DISTINCT FROM p.path || c.node_id || '/' UNION ALL SELECT c.tenant_id, c.node_id, 'depth' FROM node_current c JOIN node_current p ON p.tenant_id = c.tenant_id AND p.node_id = c.parent_id WHERE c.depth IS DISTINCT FROM p.depth + 1 UNION ALL SELECT c.tenant_id, c.node_id, 'space' FROM node_current c JOIN node_current p ON p.tenant_id = c.tenant_id AND p.node_id = c.parent_id WHERE c.space_id IS DISTINCT FROM p.space_id UNION ALL SELECT tenant_id, node_id, 'root_path' FROM node_current WHERE parent_id IS NULL AND path IS DISTINCT FROM '/' || node_id || '/' UNION ALL SELECT tenant_id, node_id, 'root_depth' FROM node_current WHERE parent_id IS NULL AND depth IS DISTINCT FROM 0",
    "node_current",
)
def h16_violations(s, d):
    return tree.violations(domain.node_current(s, d))


@_q(
    "WITH down AS (SELECT tenant_id, node_id, '/' || node_id || '/' AS path, 0 AS depth FROM node_current WHERE parent_id IS NULL UNION ALL SELECT c.tenant_id, c.node_id, p.path || c.node_id || '/', p.depth + 1 FROM down p JOIN node_current c ON c.tenant_id = p.tenant_id AND c.parent_id = p.node_id) SELECT * FROM down",
    "node_current",
    True,
)
def h17_repair(s, d):
    """Paths and depths rebuilt from parent links, for nodes that reach a root."""
    return hierarchy.hierarchy(table(s, d, "nodes")).where("state = 'rooted'").select("tenant_id", "node_id", "path", "depth")


@_q("SELECT seq, s IS NULL OR seq < s AS relayed FROM (SELECT event_id + 1 AS seq FROM events WHERE event_id NOT IN (3000, 9000)), (SELECT min(event_id) + 1 AS s FROM events WHERE event_id = 9001 AND ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAYS)")
def h19_relay(s, d):
    log = domain.tag_log(s, d).where("seq not in (3001, 9001)")
    return trending.relay_positions(log, log.agg(F.max("at")).scalar(), "10 days").select("seq", "relayed")


@_q("SELECT node_id, strftime(make_timestamp(((node_id >> 22) + 1704067200000) * 1000), '%Y-%m-%d %H:%M:%S') AS made, (node_id >> 12) & 1023 AS worker, node_id & 4095 AS seq FROM nodes GROUP BY ALL")
def h21_id_parts(s, d):
    n = table(s, d, "nodes").select("node_id").distinct()
    return n.select("node_id", F.date_format(id_time("node_id"), "yyyy-MM-dd HH:mm:ss").alias("made"), F.shiftright("node_id", 12).bitwiseAND(F.lit(1023).cast("long")).alias("worker"), F.col("node_id").bitwiseAND(F.lit(4095).cast("long")).alias("seq"))


@_q("WITH req AS (SELECT tenant_id, CASE WHEN node_id % 10 = 0 THEN lower(node_type) ELSE upper(substring(node_type, 1, 3)) || (node_id >> 22) % 20 END AS key, node_id AS seq FROM node_current) SELECT tenant_id, key, seq, CASE WHEN NOT regexp_matches(key, '^[A-Z][A-Z0-9]{1,15}$') THEN 'BAD_KEY' WHEN row_number() OVER (PARTITION BY tenant_id, key ORDER BY seq) > 1 THEN 'TAKEN' ELSE 'CREATED' END AS verdict FROM req", "node_current")
def h22_spaces(s, d):
    n = domain.node_current(s, d)
    key = F.when(F.col("node_id") % 10 == 0, F.lower("node_type")).otherwise(F.concat(F.upper(F.substring("node_type", 1, 3)), F.shiftright("node_id", 22) % 20))
    return tree.check_spaces(n.select("tenant_id", key.alias("key"), F.col("node_id").alias("seq")))


@_q(f"WITH {_RULES} SELECT tenant_id, node_id, op, principal FROM rules WHERE NOT (op = 'VIEW' AND (node_id >> 22) % 14 = 0) UNION ALL SELECT tenant_id, node_id, op, 'user:u1' FROM rules WHERE op = 'VIEW' AND (node_id >> 22) % 14 = 0", "node_current")
def h22_set_restrictions(s, d):
    r = _restrictions(s, d)
    want = r.where((F.col("op") == "VIEW") & (F.shiftright("node_id", 22) % 14 == 0)).withColumn("principal", F.lit("user:u1"))
    return tree.set_restrictions(r, want)


@_q("SELECT tenant_id, greatest(0, coalesce(1756684800000 - epoch_us(min(updated_at) FILTER (version > 1 AND status = 'ACTIVE')) // 1000, 0)) AS lag_ms FROM node_current GROUP BY tenant_id", "node_current")
def h23_outbox_lag(s, d):
    """Changed active nodes stand for rows not yet relayed."""
    rows = domain.node_current(s, d).select("tenant_id", F.col("updated_at").alias("at"), ((F.col("version") <= 1) | (F.col("status") != "ACTIVE")).alias("relayed"))
    return tree.outbox_lag_ms(rows, F.expr("timestamp_ntz'2025-09-01'")).select("tenant_id", "lag_ms")


@_q("SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAYS")
def h23_prune_idempotency(s, d):
    """Clicks stand for the recorded requests."""
    e = table(s, d, "events").where("event_type = 'click'").select("event_id", "ts")
    return trending.prune_older(e, "ts", table(s, d, "events").agg(F.max("ts")).scalar(), "5 days")


@_q(f"WITH {_PICK} SELECT n.tenant_id, n.node_id FROM node_current n, pick p WHERE n.tenant_id = p.tenant_id AND starts_with(n.path, p.path)", "node_current")
def h01_subtree_range(s, d):
    at = _pick(s, d)
    n = domain.node_current(s, d)
    return n.where((F.col("tenant_id") == at["tenant_id"]) & under(F.col("path"), F.lit(at["path"]))).select("tenant_id", "node_id")


QUERIES = Q
