"""Parent-child links to full hierarchies (problem 5).

1. Nodes get dense ids; each link is resolved once.
2. Leaves are peeled to expose cycles.  A node survives t rounds of peeling
   exactly if some node lies t levels below it, that is, if it is in the image
   of the parent function applied t times.  Doubling the jump peels 1, 2, 4, ...
   levels a round; when a round peels nothing more, what is left are the rings,
   and the nodes whose jump still leads somewhere are those on or below them.
3. The rest is a forest.  Its Euler tours (enter and exit of every node) are
   linked lists that are ranked in parallel, carrying counts and +1/-1 weights:
   entry and exit positions, depth and root.  Every eighth element, by hash, is a
   splitter: all elements double their pointers up to the nearest splitter before
   them, the list of splitters, an eighth as long, is ranked the same way, and
   the others add the rank of theirs.  A list of at most ``LOCAL`` elements, a
   bound of some 20 MB whatever the input, is ranked in one task.
4. Cut into blocks of positions, with the intervals open at a block's start
   carried in, a single scan of each block with a stack gives the paths.

Ancestors and descendants are interval containment.  Nothing is gathered: the
children of one hot parent are linked in buckets and the buckets to each
other; a block is of bounded size whatever the tree; the root of a tree that
holds most nodes is sent to its nodes and not they to it.

Defined results: the highest version of a node counts, ties by ``updated_at``;
rows without node_id are ignored; a null tenant is a tenant of its own; links
to a missing parent end there and give no path; a node that is its own parent
is a ring; null stored paths or depths count as wrong; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators.orphans import current
from loamgraph.operators.skew import hot_join, meet, sized_join
from loamgraph.session import Scratch

BLOCK, BUCKET, LOCAL, SPLIT = 50_000, 100_000, 500_000, 8
RANKED = "el long, pred long, head long, pos long, w long"


def linked_nodes(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(nid, pid, dangling, tenant_id, node_id, path, depth)`` of the current nodes."""
    now = current(nodes.where("node_id is not null"), ["tenant_id", "node_id"], "version", "updated_at", "parent_id", "path", "depth")
    own = scratch.keep(now.withColumn("nid", F.monotonically_increasing_id()).drop("updated_at", "version"))
    ids = own.select("tenant_id", F.col("node_id").alias("parent_id"), F.col("nid").alias("pid"))
    linked = hot_join(own.where("parent_id is not null"), ids, ["tenant_id", "parent_id"], scratch, "left")
    cols = ["nid", "pid", "dangling", "tenant_id", "node_id", "path", "depth"]
    tops = own.where("parent_id is null").withColumns({"pid": F.lit(None).cast("long"), "dangling": F.lit(False)})
    return scratch.keep(linked.withColumn("dangling", F.col("pid").isNull()).select(*cols).unionByName(tops.select(*cols)))


def peel(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(nid, kind)`` of nodes on ('cycle') or below ('below_cycle') a ring of links (nid, pid)."""
    jump = scratch.keep(links.where("pid is not null").select("nid", F.col("pid").alias("to")))
    left = -1
    while True:
        met = jump.groupBy("to").count().agg(F.count("*").alias("targets"), F.max("count").alias("most")).first()
        if met.targets in (left, 0):
            break
        left = met.targets
        # every node whose jump ends falls out of both sides, so the table shrinks to the rings and what hangs on them
        ahead = jump.select(F.col("nid").alias("to"), F.col("to").alias("far"))
        joined = hot_join(jump, ahead, ["to"], scratch) if met.most > BUCKET else meet(jump, ahead, ["to"], "inner")
        nxt = scratch.keep(joined.select("nid", F.col("far").alias("to")))
        scratch.drop(jump)
        jump = nxt
    ring = jump.select(F.col("to").alias("r")).distinct()
    return jump.join(ring, F.col("nid") == F.col("r"), "left").select("nid", F.when(F.col("r").isNotNull(), "cycle").otherwise("below_cycle").alias("kind"))


def euler_links(forest: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """Predecessor links of the tours: ``(el, pred, w)`` with el = 2*nid (enter) or 2*nid + 1 (exit)."""
    kids = forest.where("pid is not null").select("nid", "pid")
    # a parent's children sit in as many buckets as its child count asks for; at most one in bucket_rows rows is such a parent
    many = kids.groupBy("pid").count().where(F.col("count") > bucket_rows).select("pid", F.ceil(F.col("count") / F.lit(bucket_rows)).cast("int").alias("n_b"))
    kids = meet(kids, F.broadcast(many), ["pid"], "left").withColumn("b", F.when(F.col("n_b").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("nid"), F.col("n_b"))).cast("int")).drop("n_b")
    within = Window.partitionBy("pid", "b").orderBy("nid")
    kids = kids.withColumn("before", F.lag("nid").over(within))
    ends = kids.groupBy("pid", "b").agg(F.max("nid").alias("last"))
    by_bucket = Window.partitionBy("pid").orderBy("b")
    ends = ends.withColumn("prev_last", F.lag("last").over(by_bucket)).withColumn("final", F.lead("b").over(by_bucket).isNull())
    firsts = ends.where("prev_last is not null").select(F.col("pid").alias("e_pid"), F.col("b").alias("e_b"), "prev_last")
    entered = kids.join(firsts, (F.col("pid") == F.col("e_pid")) & (F.col("b") == F.col("e_b")) & F.col("before").isNull(), "left")
    prev = F.coalesce("before", "prev_last")
    enters = entered.select((F.col("nid") * 2).alias("el"), F.coalesce(prev * 2 + 1, F.col("pid") * 2).alias("pred"), F.lit(1).cast("long").alias("w"))
    last_kid = ends.where("final").select(F.col("pid").alias("x_pid"), "last")
    exits = forest.select("nid").join(last_kid, F.col("nid") == F.col("x_pid"), "left").select((F.col("nid") * 2 + 1).alias("el"), F.coalesce(F.col("last") * 2 + 1, F.col("nid") * 2).alias("pred"), F.lit(-1).cast("long").alias("w"))
    roots = forest.where("pid is null").select((F.col("nid") * 2).alias("el"), F.lit(None).cast("long").alias("pred"), F.lit(0).cast("long").alias("w"))
    return enters.unionByName(exits).unionByName(roots)


def _is_splitter(el: str, level: int) -> Column:
    """One element in ``SPLIT``, others on every level."""
    return F.pmod(F.xxhash64(F.col(el), F.lit(level)), F.lit(SPLIT)) == 0


def _rank_local(table: pa.Table) -> pa.Table:
    """All of a short list at once: ranks by pointer doubling over arrays."""
    el, pos, w = (table[c].to_numpy().copy() for c in ("el", "pos", "w"))
    order = np.argsort(el)
    pred = table["pred"].fill_null(-1).to_numpy()
    at = np.where(pred >= 0, order[np.searchsorted(el, pred, sorter=order).clip(max=max(0, len(el) - 1))], -1)
    top = np.arange(len(el))
    while (open_ := at >= 0).any():
        to = at[open_]
        add_pos, add_w, new_top, new_at = pos[to], w[to], top[to], at[to]
        pos[open_] += add_pos
        w[open_] += add_w
        top[open_], at[open_] = new_top, new_at
    head = table["head"].to_numpy(zero_copy_only=False)[top].astype(np.int64)
    return pa.table({"el": el, "head": head, "pos": pos, "level": w})


def _to_splitters(steps: DataFrame, scratch: Scratch, level: int) -> DataFrame:
    """Pointers doubled up to the nearest splitter: ``(el, pred, head, pos, w)``, pred null where the list's head is reached."""
    done, active = scratch.keep_split(steps.withColumn("done", F.col("pred").isNull() | _is_splitter("pred", level)), "done")
    ended = [done] if done is not None else []
    while active is not None:
        known = active.withColumn("done", F.lit(False))
        for x in ended:
            known = known.unionByName(x.withColumn("done", F.lit(True)))
        ahead = known.select(F.col("el").alias("a_el"), F.col("pred").alias("a_pred"), F.col("head").alias("a_head"), F.col("pos").alias("a_pos"), F.col("w").alias("a_w"), "done")
        moved = active.join(ahead, F.col("pred") == F.col("a_el")).select("el", F.col("a_pred").alias("pred"), F.col("a_head").alias("head"), (F.col("pos") + F.col("a_pos")).alias("pos"), (F.col("w") + F.col("a_w")).alias("w"), "done")
        done, nxt = scratch.keep_split(moved, "done")
        scratch.drop(active)
        active = nxt
        ended += [done] if done is not None else []
    out = ended[0] if ended else steps
    for x in ended[1:]:
        out = out.unionByName(x)
    return out


def _rank(steps: DataFrame, scratch: Scratch, local: int, level: int = 0) -> DataFrame:
    """``(el, head, pos, level)`` of stored steps ``(el, pred, head, pos, w)``; without pred the others are final."""
    if steps.count() <= local:
        return scratch.keep(steps.groupBy(F.lit(0).alias("_all")).applyInArrow(_rank_local, "el long, head long, pos long, level long"))
    near = _to_splitters(steps, scratch, level)
    short = _rank(scratch.keep(near.where(_is_splitter("el", level))), scratch, local, level + 1)
    rest = near.where(~_is_splitter("el", level))
    ahead = short.select(F.col("el").alias("s_el"), F.col("head").alias("s_head"), F.col("pos").alias("s_pos"), F.col("level").alias("s_level"))
    told = rest.where("pred is not null").join(ahead, F.col("pred") == F.col("s_el")).select("el", F.col("s_head").alias("head"), (F.col("pos") + F.col("s_pos")).alias("pos"), (F.col("w") + F.col("s_level")).alias("level"))
    return scratch.keep(short.unionByName(told).unionByName(rest.where("pred is null").select("el", "head", "pos", F.col("w").alias("level"))))


def rank_lists(links: DataFrame, scratch: Scratch, local: int = LOCAL) -> DataFrame:
    """List ranking: ``(el, head, pos, level)``; ``pos`` counts the steps from the list's head, ``level`` sums the weights."""
    first = F.col("pred").isNull()
    steps = links.select("el", "pred", F.when(first, F.col("el")).alias("head"), F.when(first, 0).otherwise(1).cast("long").alias("pos"), "w")
    return _rank(scratch.keep(steps), scratch, local)


def intervals(forest: DataFrame, scratch: Scratch, local: int = LOCAL) -> DataFrame:
    """``(nid, root_nid, entry, exit, true_depth)``."""
    ranked = rank_lists(euler_links(forest), scratch, local)
    is_exit = F.col("el") % 2 == 1
    return ranked.groupBy(F.shiftright("el", 1).alias("nid")).agg(
        F.max(F.shiftright("head", 1)).alias("root_nid"), F.max(F.when(~is_exit, F.col("pos"))).alias("entry"), F.max(F.when(is_exit, F.col("pos"))).alias("exit"), F.max(F.when(~is_exit, F.col("level"))).cast("int").alias("true_depth")
    )


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths from a stack; rows come sorted by (root, block, entry)."""
    where, stack = None, []
    for frame in frames:
        paths = []
        for root, block, out, node in zip(frame["root_nid"], frame["block"], frame["exit"], frame["node_id"], strict=True):
            if (root, block) != where:
                where, stack = (root, block), []
            while stack and stack[-1][0] < out:
                stack.pop()
            stack.append((out, f"{stack[-1][1] if stack else '/'}{node}/"))
            paths.append(stack[-1][1])
        own = ~frame["carried"]
        yield frame.assign(true_path=pd.Series(paths, index=frame.index, dtype=object)).loc[own].drop(columns=["carried", "block"])


def paths(spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """``spans`` with ``true_path``, by scanning blocks of the tours.

    Needs ``node_id``, ``root_nid``, ``entry`` and ``exit``; other columns stay.
    """
    first, last = (F.floor(F.col(c) / F.lit(block)).cast("long") for c in ("entry", "exit"))
    own = spans.withColumns({"block": first, "carried": F.lit(False)})
    carried = spans.where(last > first).withColumns({"block": F.explode(F.sequence(first + 1, last)), "carried": F.lit(True)})
    rows = own.unionByName(carried).repartition("root_nid", "block").sortWithinPartitions("root_nid", "block", "entry")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.schema.fields)
    return rows.mapInPandas(_scan, f"{kept}, true_path string")


def resolve(nodes: DataFrame, what: str = "tree") -> DataFrame:
    """All current nodes with their tours, roots, depths and paths; nulls for those on or below rings."""
    scratch = Scratch(nodes.sparkSession, what)
    own = linked_nodes(nodes, scratch)
    rings = scratch.keep(peel(own.select("nid", "pid"), scratch))
    caught = rings.select(F.col("nid").alias("c_nid"), "kind")
    forest = scratch.keep(own.join(caught, F.col("nid") == F.col("c_nid"), "left_anti"))
    spans = intervals(forest.select("nid", "pid"), scratch).withColumnRenamed("nid", "t_nid")
    placed = scratch.keep(forest.drop("pid").join(spans, F.col("nid") == F.col("t_nid")).drop("t_nid"))
    roots = forest.where("pid is null").select(F.col("nid").alias("root_nid"), F.col("node_id").alias("root_id"), F.col("dangling").alias("r_dangling"))
    told = sized_join(scratch.keep(paths(placed)), roots, ["root_nid"], scratch).withColumn("kind", F.lit(None).cast("string")).drop("root_nid")
    ringed = own.drop("pid").join(caught, F.col("nid") == F.col("c_nid")).drop("c_nid")
    return told.unionByName(ringed, allowMissingColumns=True)


def hierarchy(nodes: DataFrame) -> DataFrame:
    """One row per node: root, depth, path, tour interval, number of descendants, state.

    state: 'rooted', 'dangling' (the ancestors end at a missing parent; root and
    path are those of the fragment), 'cycle' or 'below_cycle' (nulls elsewhere).
    Descendants of v: same tenant and root, entry and exit inside v's.
    """
    full = resolve(nodes, "hierarchy")
    state = F.coalesce(F.col("kind"), F.when(F.col("r_dangling"), "dangling").otherwise("rooted")).alias("state")
    return full.select("tenant_id", "node_id", "root_id", F.col("true_depth").alias("depth"), F.col("true_path").alias("path"), "entry", "exit", ((F.col("exit") - F.col("entry") - 1) / 2).cast("long").alias("n_descendants"), state)


def tree_faults(nodes: DataFrame) -> DataFrame:
    """``(tenant_id, node_id, fault)``: ring members, nodes below rings, wrong stored path or depth."""
    full = resolve(nodes, "faults")
    rooted = F.col("kind").isNull() & ~F.col("r_dangling")
    faults = F.filter(
        F.array(F.col("kind"), F.when(rooted & ~F.col("path").eqNullSafe(F.col("true_path")), F.lit("path")), F.when(rooted & ~F.col("depth").cast("int").eqNullSafe(F.col("true_depth")), F.lit("depth"))),
        lambda x: x.isNotNull(),
    )
    return full.select("tenant_id", "node_id", F.explode(faults).alias("fault"))


def descendants(tree: DataFrame, tenant_id: str, node_id: int) -> DataFrame:
    """Rows of ``hierarchy`` strictly below one node."""
    top = tree.where((F.col("tenant_id") == tenant_id) & (F.col("node_id") == node_id)).select(F.col("root_id").alias("t_root"), F.col("entry").alias("t_in"), F.col("exit").alias("t_out"))
    inside = (F.col("root_id") == F.col("t_root")) & (F.col("entry") > F.col("t_in")) & (F.col("exit") < F.col("t_out"))
    return tree.where(F.col("tenant_id") == tenant_id).join(F.broadcast(top), inside).select(*tree.columns)


def ancestors(tree: DataFrame, tenant_id: str, node_id: int) -> DataFrame:
    """Rows of ``hierarchy`` strictly above one node, root first."""
    low = tree.where((F.col("tenant_id") == tenant_id) & (F.col("node_id") == node_id)).select(F.col("root_id").alias("t_root"), F.col("entry").alias("t_in"), F.col("exit").alias("t_out"))
    around = (F.col("root_id") == F.col("t_root")) & (F.col("entry") < F.col("t_in")) & (F.col("exit") > F.col("t_out"))
    return tree.where(F.col("tenant_id") == tenant_id).join(F.broadcast(low), around).select(*tree.columns).orderBy("depth")
