"""Tree store reads and writes over current nodes with materialised paths.

Nodes are ``(tenant_id, node_id, space_id, parent_id, path, depth, rank,
node_type, title, status, ...)``, one current row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.paths import child_path, path_ids, root_path, under
from loamgraph.operators.skew import first_in_order, is_small, meet, sized_join, with_places
from loamgraph.session import Scratch

KEY = ["tenant_id", "node_id"]
MAX_DEPTH = 63
MOVE_LIMIT = 10_000
#: Which types may lie below which (fixed rules of the tree store, by child).
SPACE_KEY = r"^[A-Z][A-Z0-9]{1,15}$"


def _sized(big: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return sized_join(big, unique, keys, Scratch(big.sparkSession, "tree"), how)


def on_path(nodes: DataFrame) -> DataFrame:
    """``(tenant_id, node_id, anc_id, pos)``: every id on a node's path, itself last."""
    return nodes.select(*KEY, F.posexplode(path_ids(F.col("path"))).alias("pos", "anc_id"))


def trashed_below(nodes: DataFrame) -> DataFrame:
    """Keys of nodes in the trash: any id on the path is trashed.

    Driven from the trashed nodes: few are broadcast; of many, those that a large
    part of all nodes lies below still are.
    """
    bad = nodes.where("status = 'TRASHED'").select("tenant_id", F.col("node_id").alias("anc_id")).distinct()
    return _sized(on_path(nodes), bad, ["tenant_id", "anc_id"]).select(*KEY).distinct()


def with_trash_flag(nodes: DataFrame) -> DataFrame:
    marked = trashed_below(nodes).select(F.col("tenant_id").alias("b_tenant"), F.col("node_id").alias("b_node"))
    on = F.col("tenant_id").eqNullSafe(F.col("b_tenant")) & (F.col("node_id") == F.col("b_node"))
    return nodes.join(marked, on, "left").withColumn("in_trash", F.col("b_node").isNotNull()).drop("b_tenant", "b_node")


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """``(tenant_id, node_id, pos, anc_id, title)``: ancestors root first, without the node itself."""
    up = on_path(nodes).where("anc_id <> node_id")
    names = nodes.select("tenant_id", F.col("node_id").alias("anc_id"), F.col("title").alias("anc_title"))
    return _sized(up, names, ["tenant_id", "anc_id"])


def children_page(nodes: DataFrame, tenant: str, parent: int, after: tuple[str, int] | None, limit: int) -> DataFrame:
    """Active children by (rank, id) behind a row key, one more than asked."""
    rows = nodes.where((F.col("tenant_id") == tenant) & (F.col("parent_id") == parent) & (F.col("status") == "ACTIVE"))
    if after:
        rows = rows.where((F.col("rank") > after[0]) | ((F.col("rank") == after[0]) & (F.col("node_id") > after[1])))
    return rows.orderBy("rank", "node_id").limit(limit + 1)


def all_children(nodes: DataFrame) -> DataFrame:
    """Active children of every parent with their place, without sorting one hot parent in a task."""
    active = nodes.where("status = 'ACTIVE' and parent_id is not null").select("tenant_id", "parent_id", "node_id", "rank")
    placed = with_places(active, ["tenant_id", "parent_id"], ["rank", "node_id"], Scratch(nodes.sparkSession, "children"))
    return placed.select("tenant_id", "parent_id", "node_id", (F.col("place") + 1).cast("int").alias("place"))


def descendants_page(nodes: DataFrame, tenant: str, root_path_value: str, root_depth: int, max_depth: int, after: str | None, limit: int) -> DataFrame:
    """Pre-order page below a root (path order), hiding everything under a trashed id."""
    rows = nodes.where((F.col("tenant_id") == tenant) & under(F.col("path"), F.lit(root_path_value)) & (F.col("path") != root_path_value) & (F.col("depth") <= root_depth + max_depth))
    if after is not None:
        rows = rows.where(F.col("path") > after)
    hidden = trashed_below(nodes.where(F.col("tenant_id") == tenant))
    return rows.join(hidden, KEY, "left_anti").orderBy("path").limit(limit + 1)


def effective(nodes: DataFrame, tenant: str, old_prefix: str, new_prefix: str, depth_delta: int) -> DataFrame:
    """Rows read through a running move: a tenant's stored paths below the old prefix appear below the new."""
    moved = F.coalesce((F.col("tenant_id") == tenant) & F.col("path").startswith(old_prefix), F.lit(False))
    return nodes.withColumns({"path": F.when(moved, F.concat(F.lit(new_prefix), F.expr(f"substring(path, {len(old_prefix) + 1})"))).otherwise(F.col("path")), "depth": F.when(moved, F.col("depth") + depth_delta).otherwise(F.col("depth")).cast("int")})


def trash_list(nodes: DataFrame, limit: int = 1000) -> DataFrame:
    """Trashed nodes of each space, newest first, at most ``limit`` a space (the feature's page)."""
    rows = nodes.where("status = 'TRASHED'")
    order = Window.partitionBy("tenant_id", "space_id").orderBy(F.desc_nulls_last("trashed_at"), "node_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def rank_neighbours(nodes: DataFrame) -> DataFrame:
    """``below`` and ``above``: nearest strictly lower and higher rank among siblings, also of a parent with very many."""
    scratch = Scratch(nodes.sparkSession, "ranks")
    keys = ["tenant_id", "parent_id"]
    placed = scratch.keep(with_places(nodes.where("parent_id is not null").select(*keys, "rank").distinct(), keys, ["rank"], scratch))
    beside = lambda by, name: placed.select(*keys, (F.col("place") + by).alias("place"), F.col("rank").alias(name))
    out = meet(meet(placed, beside(1, "below"), [*keys, "place"], "left"), beside(-1, "above"), [*keys, "place"], "left")
    return out.select(*keys, "rank", "below", "above")


def max_ranks(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").groupBy("tenant_id", "parent_id").agg(F.max("rank").alias("max_rank"))


def check_create(requests: DataFrame, nodes: DataFrame, allowed: Column) -> DataFrame:
    """Verdict on creations ``(tenant_id, new_id, parent_id, node_type)``.

    ``allowed`` tells from ``parent_type`` and ``node_type`` what may lie where.
    """
    parent = with_trash_flag(nodes).select("tenant_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("parent_type"), F.col("path").alias("parent_path"), F.col("depth").alias("parent_depth"), "in_trash")
    top = max_ranks(nodes)
    out = _sized(requests, parent, ["tenant_id", "parent_id"], "left")
    out = _sized(out, top, ["tenant_id", "parent_id"], "left")
    verdict = F.when(F.col("parent_path").isNull(), "NO_PARENT").when(F.col("in_trash"), "PARENT_TRASHED").when(F.col("parent_depth") >= MAX_DEPTH, "TOO_DEEP").when(~F.coalesce(allowed, F.lit(False)), "TYPE").otherwise("CREATED")
    ok = verdict == "CREATED"
    return out.select("tenant_id", "new_id", "parent_id", verdict.alias("verdict"), F.when(ok, child_path(F.col("parent_path"), F.col("new_id"))).alias("path"), F.when(ok, F.col("parent_depth") + 1).cast("int").alias("depth"), F.when(ok, F.col("max_rank")).alias("after_rank"))


def move_subtree(nodes: DataFrame, tenant: str, old_path: str, new_parent_path: str, new_parent_id: int, new_parent_depth: int) -> DataFrame:
    """All nodes after a move: the subtree's paths and depths rewritten, the moved root reparented.

    Moving below itself is refused.  One projection; no batches are needed.
    """
    if new_parent_path.startswith(old_path):
        raise ValueError("a node can't move below itself")
    root = old_path.rstrip("/").rsplit("/", 1)[1]
    new_path = f"{new_parent_path}{root}/"
    delta = new_parent_depth + 1 - (old_path.count("/") - 2)
    inside = (F.col("tenant_id") == tenant) & F.col("path").startswith(old_path)
    is_root = (F.col("tenant_id") == tenant) & (F.col("path") == old_path)
    return nodes.withColumns(
        {
            "parent_id": F.when(is_root, F.lit(new_parent_id)).otherwise(F.col("parent_id")),
            "depth": F.when(inside, F.col("depth") + delta).otherwise(F.col("depth")).cast("int"),
            "path": F.when(inside, F.concat(F.lit(new_path), F.expr(f"substring(path, {len(old_path) + 1})"))).otherwise(F.col("path")),
        }
    )


def rewrite_batch(nodes: DataFrame, tenant: str, old_prefix: str, new_prefix: str, depth_delta: int, batch: int) -> DataFrame:
    """One batch of a background move: the first ``batch`` rows by id still below the old prefix get their new path and depth.

    Between batches ``effective`` reads the same tree; a move is done when nothing is left below the old prefix.
    """
    below = nodes.where((F.col("tenant_id") == tenant) & F.col("path").startswith(old_prefix))
    now = first_in_order(below.select("node_id"), ["node_id"], batch, Scratch(nodes.sparkSession, "batch")).select(F.col("node_id").alias("b_node"))
    mine = (F.col("tenant_id") == tenant) & F.col("b_node").isNotNull()
    met = nodes.join(now, (F.col("node_id") == F.col("b_node")) & (F.col("tenant_id") == tenant), "left")
    path = F.concat(F.lit(new_prefix), F.expr(f"substring(path, {len(old_prefix) + 1})"))
    return met.withColumns({"path": F.when(mine, path).otherwise(F.col("path")), "depth": F.when(mine, F.col("depth") + depth_delta).otherwise(F.col("depth")).cast("int")}).drop("b_node")


def check_moves(requests: DataFrame, nodes: DataFrame, limit: int = MOVE_LIMIT) -> DataFrame:
    """Verdict on moves ``(tenant_id, node_id, to_id)`` from probes of the subtree: its size and deepest node.

    In this order: NO_NODE, NO_TARGET, SAME_PARENT (a mere reordering), ROOT, TRASHED
    (either), CYCLE (the target lies inside), TOO_DEEP, TOO_LARGE (above ``limit``
    into another space), JOB (above it in the same space) or DONE.  ``nodes`` is
    read several times, so it should be stored.
    """
    scratch = Scratch(nodes.sparkSession, "moves")
    asked = scratch.keep(requests.select("tenant_id", "node_id", "to_id"))
    bad = trashed_below(nodes).select(F.col("tenant_id").alias("b_tenant"), F.col("node_id").alias("b_node"))
    on = F.col("tenant_id").eqNullSafe(F.col("b_tenant")) & (F.col("anc_id") == F.col("b_node"))
    both = subtree_sizes(nodes).join(bad, on, "full")
    probed = scratch.keep(both.select(F.coalesce("tenant_id", "b_tenant").alias("tenant_id"), F.coalesce("anc_id", "b_node").alias("node_id"), "n", "deepest", F.col("b_node").isNotNull().alias("in_trash")))
    small = is_small(probed)
    out = sized_join(asked, probed, ["tenant_id", "node_id"], scratch, "left", small=small)
    out = scratch.keep(sized_join(out, probed.select("tenant_id", F.col("node_id").alias("to_id"), F.col("in_trash").alias("to_in_trash")), ["tenant_id", "to_id"], scratch, "left", small=small, counted=asked))
    trashed = F.coalesce("in_trash", F.lit(False)) | F.coalesce("to_in_trash", F.lit(False))
    at = nodes.select("tenant_id", "node_id", "parent_id", "space_id", "path", "depth")
    target = nodes.select("tenant_id", F.col("node_id").alias("to_id"), *[F.col(c).alias(f"to_{c}") for c in ("space_id", "path", "depth")])
    small = is_small(nodes.select("tenant_id", "node_id", "parent_id", "space_id", "path", "depth"))
    out = sized_join(out, at, ["tenant_id", "node_id"], scratch, "left", small=small, counted=asked)
    # paths are long; one travels on only where the verdict may hang on it
    settled = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("to_id")) | trashed
    out = out.withColumn("known", F.col("path").isNotNull()).withColumn("path", F.when(~settled, F.col("path")))
    out = sized_join(out, target, ["tenant_id", "to_id"], scratch, "left", small=small, counted=asked)
    large, elsewhere = F.col("n") > limit, ~F.col("space_id").eqNullSafe(F.col("to_space_id"))
    verdict = (
        F.when(~F.col("known"), "NO_NODE").when(F.col("to_path").isNull(), "NO_TARGET").when(F.col("parent_id") == F.col("to_id"), "SAME_PARENT").when(F.col("parent_id").isNull(), "ROOT")
        .when(trashed, "TRASHED").when(F.col("to_path").startswith(F.col("path")), "CYCLE").when(F.col("deepest") - F.col("depth") + F.col("to_depth") + 1 > MAX_DEPTH, "TOO_DEEP")
        .when(large & elsewhere, "TOO_LARGE").when(large, "JOB").otherwise("DONE")
    )
    return out.select("tenant_id", "node_id", "to_id", verdict.alias("verdict"), F.col("n").alias("size"))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """``(tenant_id, anc_id, n, deepest)``: nodes in each subtree and their greatest stored depth."""
    return nodes.select("tenant_id", "depth", F.explode(path_ids(F.col("path"))).alias("anc_id")).groupBy("tenant_id", "anc_id").agg(F.count("*").alias("n"), F.max("depth").cast("int").alias("deepest"))


def denied(nodes: DataFrame, restrictions: DataFrame, principals: list[str], op: str = "VIEW") -> DataFrame:
    """Keys a caller may not use: some restricted node on the path lists none of their principals.

    Editing needs viewing as well.  Nodes without restrictions on their path are open.
    """
    ops = ["VIEW"] if op == "VIEW" else ["VIEW", op]
    rules = restrictions.where(F.col("op").isin(ops)).groupBy("tenant_id", F.col("node_id").alias("anc_id"), "op").agg(F.bool_or(F.col("principal").isin(principals)).alias("ok"))
    closed = rules.where("not ok").select("tenant_id", "anc_id").distinct()
    return _sized(on_path(nodes), closed, ["tenant_id", "anc_id"]).select(*KEY).distinct()


def visible(nodes: DataFrame, restrictions: DataFrame, principals: list[str], op: str = "VIEW") -> DataFrame:
    return nodes.join(denied(nodes, restrictions, principals, op), KEY, "left_anti")


def apply_edits(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Outcome of ``(tenant_id, node_id, expected_version, action, title)``: title, trash or restore.

    A stale version changes nothing; trashing a trashed or restoring an active node is NO_CHANGE.
    """
    now = nodes.select(*KEY, "version", "status", F.col("title").alias("had"))
    out = edits.join(now, KEY, "left")
    same = (F.col("action") == "TRASH") & (F.col("status") == "TRASHED") | (F.col("action") == "RESTORE") & (F.col("status") == "ACTIVE")
    outcome = F.when(F.col("version").isNull(), "NOT_FOUND").when(F.col("version") != F.col("expected_version"), "STALE").when(same, "NO_CHANGE").otherwise("APPLIED")
    ok = outcome == "APPLIED"
    status = F.when(ok & (F.col("action") == "TRASH"), "TRASHED").when(ok & (F.col("action") == "RESTORE"), "ACTIVE").otherwise(F.col("status"))
    return out.select(*KEY, outcome.alias("outcome"), (F.col("version") + F.when(ok, 1).otherwise(0)).cast("int").alias("version"), status.alias("status"), F.when(ok & (F.col("action") == "TITLE"), F.col("title")).otherwise(F.col("had")).alias("title"))


def purge(nodes: DataFrame, content: DataFrame, restrictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without what lies in the trash."""
    gone = trashed_below(nodes)
    return nodes.join(gone, KEY, "left_anti"), content.join(gone, KEY, "left_anti"), restrictions.join(gone, KEY, "left_anti")


def violations(nodes: DataFrame) -> DataFrame:
    """``(tenant_id, node_id, problem)`` by comparing each node with its stored parent."""
    parent = nodes.select("tenant_id", F.col("node_id").alias("parent_id"), F.col("path").alias("p_path"), F.col("depth").alias("p_depth"), F.col("space_id").alias("p_space"))
    linked = _sized(nodes.where("parent_id is not null"), parent, ["tenant_id", "parent_id"])
    wrong = [
        F.when(~F.col("path").eqNullSafe(child_path(F.col("p_path"), F.col("node_id"))), F.lit("path")),
        F.when(~F.col("depth").cast("int").eqNullSafe((F.col("p_depth") + 1).cast("int")), F.lit("depth")),
        F.when(~F.col("space_id").eqNullSafe(F.col("p_space")), F.lit("space")),
    ]
    roots = nodes.where("parent_id is null")
    root_wrong = [F.when(~F.col("path").eqNullSafe(root_path(F.col("node_id"))), F.lit("root_path")), F.when(~F.col("depth").cast("int").eqNullSafe(F.lit(0)), F.lit("root_depth"))]
    listed = lambda df, xs: df.select(*KEY, F.explode(F.filter(F.array(*xs), lambda x: x.isNotNull())).alias("problem"))
    return listed(linked, wrong).unionByName(listed(roots, root_wrong))


def check_spaces(requests: DataFrame) -> DataFrame:
    """Space keys: form, and the first of equal keys in a tenant wins."""
    first = F.row_number().over(Window.partitionBy("tenant_id", "key").orderBy("seq"))
    verdict = F.when(~F.coalesce(F.col("key").rlike(SPACE_KEY), F.lit(False)), "BAD_KEY").when(first > 1, "TAKEN").otherwise("CREATED")
    return requests.select("tenant_id", "key", "seq", verdict.alias("verdict"))


def set_restrictions(current: DataFrame, wanted: DataFrame, limit: int = 100) -> DataFrame:
    """Restrictions after replacing all principals of each (node, op) named in ``wanted``; more than ``limit`` are refused."""
    key = [*KEY, "op"]
    counted = wanted.groupBy(*key).agg(F.countDistinct("principal").alias("n"))
    fine = counted.where(F.col("n") <= limit).select(*key)
    kept = current.select(*key, "principal").join(fine, key, "left_anti")
    return kept.unionByName(wanted.where("principal is not null").select(*key, "principal").distinct().join(fine, key, "left_semi"))


def outbox_lag_ms(outbox: DataFrame, now: Column) -> DataFrame:
    """``(tenant_id, lag_ms)``: age of the oldest row of ``(tenant_id, at, relayed)`` that is not relayed, 0 where there is none."""
    oldest = F.min(F.when(~F.coalesce(F.col("relayed"), F.lit(False)), F.col("at")))
    ms = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / 1000).cast("long")
    return outbox.groupBy("tenant_id").agg(F.greatest(F.lit(0).cast("long"), F.coalesce(ms(now) - ms(oldest), F.lit(0).cast("long"))).alias("lag_ms"))
