"""Graph algebra and level-synchronous graph computations over DataFrames.

A graph is ``vertices(id, ord)`` and ``edges(src, dst, weight)``; ``ord`` is the
explicit insertion order that ties and group numbers refer to.  An undirected
graph keeps each edge once with ``src <= dst``.

Iterative operators run one Spark job a round; state between rounds is a
written table (see ``session.Scratch``) to which a round appends, read as one
scan of many folders, so a plan never grows with the rounds, no round writes
what did not change, and a lost executor costs only its tasks.  Joins are on
vertex ids; all messages to one vertex are combined map-side before the
shuffle, and where the links of one vertex have to meet its row, hot vertices
are broadcast and their links stay where they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators.skew import counted_join, meet, sized_join, with_places
from loamgraph.operators.splitting import split_groups
from loamgraph.session import Scratch


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    weighted: bool = False

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, directed: bool = True, weighted: bool = False) -> Graph:
        """Missing endpoints become vertices; of parallel edges the first (by ``ord``, else lowest weight) stays.

        Null ids are dropped.  A weighted graph needs a weight on every edge.
        """
        if weighted != ("weight" in edges.columns):
            raise ValueError("edges carry weights if and only if the graph is weighted")
        e = edges.where("src is not null and dst is not null")
        if not directed:
            e = e.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        order = F.col("ord") if "ord" in e.columns else F.col("weight") if weighted else F.lit(0)
        kept = F.min_by("weight", order) if weighted else F.lit(None).cast("double")
        e = e.groupBy("src", "dst").agg(F.min(order).alias("_o"), kept.alias("weight")).drop("_o")
        v = vertices.where("id is not null").groupBy("id").agg(F.min("ord" if "ord" in vertices.columns else "id").alias("ord"))
        ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        v = v.unionByName(ends.join(v, "id", "left_anti").withColumn("ord", F.col("id").cast("long")))
        return Graph(v, e, directed, weighted)

    def both_ways(self) -> DataFrame:
        """Arcs in the directions they can be followed."""
        if self.directed:
            return self.edges
        back = self.edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return self.edges.unionByName(back)

    def _pair(self, df: DataFrame) -> DataFrame:
        return df if self.directed else df.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})

    def add_nodes(self, ids: DataFrame) -> Graph:
        top = self.vertices.agg(F.coalesce(F.max("ord"), F.lit(-1))).scalar()
        fresh = ids.select("id").distinct().join(self.vertices, "id", "left_anti").withColumn("ord", F.col("id").cast("long") + top + 1)
        return replace(self, vertices=self.vertices.unionByName(fresh))

    def remove_nodes(self, ids: DataFrame) -> Graph:
        gone = ids.select(F.col("id").alias("g")).distinct()
        v = self.vertices.join(gone, F.col("id") == F.col("g"), "left_anti")
        e = self.edges.join(gone, F.col("src") == F.col("g"), "left_anti").join(gone, F.col("dst") == F.col("g"), "left_anti")
        return replace(self, vertices=v, edges=e)

    def rename_node(self, old, new) -> Graph:
        """Keeps edges, weights and place; fails where ``new`` exists or ``old`` doesn't."""
        held = {r[0] for r in self.vertices.where(F.col("id").isin(old, new)).select("id").limit(2).collect()}
        if new in held and old != new:
            raise ValueError(f"node {new} exists")
        if old not in held:
            raise ValueError(f"no node {old}")
        swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)
        return replace(self, vertices=self.vertices.select(swap("id"), "ord"), edges=self._pair(self.edges.select(swap("src"), swap("dst"), "weight")))

    def add_edges(self, more: DataFrame) -> Graph:
        """Adds missing endpoints; an edge that exists keeps its weight."""
        fresh = self._pair(more.select("src", "dst", F.col("weight") if self.weighted else F.lit(None).cast("double").alias("weight")))
        fresh = fresh.groupBy("src", "dst").agg(F.min("weight").alias("weight")).join(self.edges, ["src", "dst"], "left_anti")
        ends = fresh.select(F.col("src").alias("id")).union(fresh.select("dst"))
        return replace(self.add_nodes(ends), edges=self.edges.unionByName(fresh))

    def remove_edges(self, pairs: DataFrame) -> Graph:
        return replace(self, edges=self.edges.join(self._pair(pairs.select("src", "dst")).distinct(), ["src", "dst"], "left_anti"))

    def update_edges(self, pairs: DataFrame) -> Graph:
        """New weights for edges that exist; of several for one edge the lowest."""
        if not self.weighted:
            raise ValueError("the graph has no weights")
        new = self._pair(pairs.select("src", "dst", "weight")).groupBy("src", "dst").agg(F.min("weight").alias("new"))
        return replace(self, edges=self.edges.join(new, ["src", "dst"], "left").select("src", "dst", F.coalesce("new", "weight").alias("weight")))

    def contains_edges(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``contained`` and ``weight``; ends in either order where undirected."""
        asked = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
        keyed = asked.withColumns({"src": F.col("a"), "dst": F.col("b")}) if self.directed else asked.withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})
        held = self.edges.withColumn("contained", F.lit(True))
        return keyed.join(held, ["src", "dst"], "left").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.coalesce("contained", F.lit(False)).alias("contained"), "weight")

    def counts(self) -> DataFrame:
        return self.vertices.agg(F.count("*").alias("nodes")).join(self.edges.agg(F.count("*").alias("edges")))

    def neighbours(self, ids: DataFrame, reverse: bool = False) -> DataFrame:
        """``(id, neighbour)``; an id that is no vertex gives no row."""
        arcs = self.both_ways()
        here, there = ("dst", "src") if reverse and self.directed else ("src", "dst")
        return arcs.join(ids.select(F.col("id").alias("_q")).distinct(), F.col(here) == F.col("_q"), "left_semi").select(F.col(here).alias("id"), F.col(there).alias("neighbour"))

    def degrees(self) -> DataFrame:
        """``(id, out_degree, in_degree)``; undirected: both the degree, a loop counts once."""
        arcs = self.both_ways()
        ends = arcs.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(arcs.select("dst", F.lit(0), F.lit(1)))
        rows = ends.union(self.vertices.select("id", F.lit(0), F.lit(0)))
        return rows.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))

    def subgraph(self, keep: DataFrame) -> Graph:
        k = keep.select(F.col("id").alias("k")).distinct()
        v = self.vertices.join(k, F.col("id") == F.col("k"), "left_semi")
        e = self.edges.join(k, F.col("src") == F.col("k"), "left_semi").join(k, F.col("dst") == F.col("k"), "left_semi")
        return replace(self, vertices=v, edges=e)


# --- traversals -----------------------------------------------------------


def bfs(arcs: DataFrame, roots: DataFrame, max_depth: int | None = None, what: str = "bfs") -> DataFrame:
    """``(id, depth)``: fewest arcs from any root.  ``arcs(src, dst)``; loops and cycles are fine."""
    scratch = Scratch(arcs.sparkSession, what)
    arcs = scratch.keep(arcs.select("src", "dst").distinct())
    seen = scratch.log(roots.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    while max_depth is None or seen.rounds <= max_depth:
        front = seen.last.select(F.col("id").alias("src"))
        reached = arcs.join(front, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        if not seen.append(reached.join(seen.all.select("id"), "id", "left_anti").withColumn("depth", F.lit(seen.rounds))):
            break
    return seen.all


def components(vertices: DataFrame, edges: DataFrame, what: str = "wcc", named: bool = False) -> tuple[DataFrame, int]:
    """``(id, label)`` with the smallest ``ord`` of the weakly connected component, and the rounds taken.

    Large-star and small-star alternate: links are redirected to the smallest
    known member, so long chains take a logarithmic number of rounds.  With
    ``named`` a vertex's id is its ``ord`` and every end of an edge is a vertex, so
    neither is looked up.
    """
    scratch = Scratch(vertices.sparkSession, what)
    v = scratch.keep(vertices.select("id", "ord"))
    o = v.withColumnRenamed("id", "k")
    if named:
        ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    else:
        ends = edges.join(o.withColumnRenamed("ord", "a"), F.col("src") == F.col("k")).drop("k").join(o.withColumnRenamed("ord", "b"), F.col("dst") == F.col("k"))
    links = scratch.keep(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rounds, before, most_links = 0, None, v.count()
    while True:
        rounds += 1
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, most = _minima(both, scratch)
        large = counted_join(both.where("v > u"), low, ["u"], "n", most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a vertex that is its own minimum keeps no link to itself
        large = scratch.keep(large.where("u <> v"))
        least, most = _minima(large, scratch)
        small = counted_join(large, least, ["u"], "n", most).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        nxt = scratch.keep(small.where("u <> v").distinct())
        state = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        for used in (links, low, large, least):
            scratch.drop(used)
        links = nxt
        scratch.tidy()
        # fewer links than vertices may be stars, which another round would leave as they are
        if tuple(state) == before or state[0] < most_links and _are_stars(links):
            break
        before = tuple(state)
    label = links.groupBy("u").agg(F.min("v").alias("m"))
    return v.join(label, F.col("ord") == F.col("u"), "left").select("id", F.coalesce("m", "ord").alias("label")), rounds


def _are_stars(links: DataFrame) -> bool:
    """Whether every vertex has one link at most, and no link leads to a vertex that has one."""
    ends = links.select("u", F.lit(True).alias("out")).union(links.select("v", F.lit(False)).distinct())
    return ends.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _minima(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``(u, m, n)``: the smallest of each vertex and its neighbours, and their number; the largest number."""
    low = scratch.keep(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    return low, low.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def min_label_rounds(vertices: DataFrame, edges: DataFrame, what: str = "labels") -> tuple[DataFrame, int, int]:
    """Plain label propagation: ``(id, label)``, rounds and messages; only changed vertices send."""
    scratch = Scratch(vertices.sparkSession, what)
    both = scratch.keep(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    labels = scratch.keep(vertices.select("id", F.col("ord").alias("label"), F.lit(True).alias("changed")))
    rounds = messages = 0
    while True:
        sent = both.join(labels.where("changed").select(F.col("id").alias("src"), "label"), "src").select(F.col("dst").alias("to"), "label")
        got = scratch.keep(sent.groupBy("to").agg(F.min("label").alias("best"), F.count("*").alias("n")))
        n = got.agg(F.sum("n")).first()[0]
        if not n:
            return labels.select("id", "label"), rounds, messages
        rounds, messages = rounds + 1, messages + n
        nxt = scratch.keep(labels.join(got, F.col("id") == F.col("to"), "left").select("id", F.least("label", F.coalesce("best", "label")).alias("label"), F.coalesce(F.col("best") < F.col("label"), F.lit(False)).alias("changed")))
        scratch.drop(labels)
        labels = nxt


def waves(vertices: DataFrame, edges: DataFrame, what: str = "waves") -> DataFrame:
    """``(id, round)`` of topological waves; null for vertices on or below a cycle (a loop is one).

    A round hands each finished vertex's successors one decrement; decrements
    to a vertex are summed map-side before they travel.  What a round sends is
    appended to a log; only the vertices it touched are looked at, and those
    are ripe whose decrements of all rounds add up to their predecessors.
    """
    scratch = Scratch(vertices.sparkSession, what)
    arcs = scratch.keep(edges.select("src", "dst").distinct())
    ids = scratch.keep(vertices.select("id").distinct())
    need = scratch.keep(arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("open")))
    done = scratch.log(ids.join(need, "id", "left_anti").withColumn("round", F.lit(0)))
    sent = None
    while True:
        cut = arcs.join(done.last.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        if sent is None:
            sent = scratch.log(cut)
        elif not sent.append(cut):
            break
        got = sent.all.join(sent.last.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("n").alias("n"))
        ripe = need.join(got, "id").where(F.col("n") == F.col("open")).join(ids, "id", "left_semi")
        if not done.append(ripe.select("id", F.lit(done.rounds).alias("round"))):
            break
    return ids.join(done.all, "id", "left").select("id", "round")


def eligible(vertices: DataFrame, edges: DataFrame, policy: str = "ISOLATE_GROUP") -> DataFrame:
    """``(id, group, eligible)``: what may run where cyclic groups are isolated; REJECT_GRAPH fails instead."""
    blocked = waves(vertices, edges, "policy").where("round is null").select(F.col("id").alias("b"))
    if policy == "REJECT_GRAPH":
        if not blocked.isEmpty():
            raise ValueError("the graph has a cycle")
        blocked = blocked.where("false")
    grouped, _ = components(vertices, edges, "policy-groups")
    bad = grouped.join(blocked, F.col("id") == F.col("b"), "left_semi").select(F.col("label").alias("bad")).distinct()
    scratch = Scratch(vertices.sparkSession, "eligible")
    marked = sized_join(grouped, bad.select(F.col("bad").alias("label"), F.lit(True).alias("bad")), ["label"], scratch, "left")
    return marked.select("id", F.col("label").alias("group"), F.col("bad").isNull().alias("eligible"))


def run_waves(vertices: DataFrame, edges: DataFrame, failing: DataFrame) -> DataFrame:
    """``(id, round, status)``: a failed task's descendants are skipped, all others run."""
    timed = waves(vertices, edges, "run")
    failed = failing.select("id").distinct()
    heirs = edges.join(failed, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
    below = bfs(edges, heirs, what="skip").select(F.col("id").alias("s"))
    f = failed.select(F.col("id").alias("f"))
    out = timed.join(below, F.col("id") == F.col("s"), "left").join(f, F.col("id") == F.col("f"), "left")
    status = F.when(F.col("round").isNull(), "BLOCKED").when(F.col("s").isNotNull(), "SKIPPED").when(F.col("f").isNotNull(), "FAILED").otherwise("DONE")
    return out.select("id", "round", status.alias("status"))


def traverse(vertices: DataFrame, edges: DataFrame, roots: DataFrame, admit: Column, failing: Column, max_depth: int) -> DataFrame:
    """``(id, depth, outcome)``: excluded, unreachable, too_deep, failed or completed.

    Depth counts admitted vertices only; those beyond ``max_depth`` still expand,
    and a failing vertex does not stop the traversal.
    """
    v = vertices.withColumns({"_in": admit, "_bad": failing})
    inside = v.where("_in").select(F.col("id").alias("k"))
    arcs = edges.join(inside, F.col("src") == F.col("k"), "left_semi").join(inside, F.col("dst") == F.col("k"), "left_semi")
    start = roots.join(inside, F.col("id") == F.col("k"), "left_semi")
    depth = bfs(arcs, start, what="traverse").select(F.col("id").alias("d_id"), "depth")
    out = v.join(depth, F.col("id") == F.col("d_id"), "left")
    kind = F.when(~F.col("_in"), "excluded").when(F.col("depth").isNull(), "unreachable").when(F.col("depth") > max_depth, "too_deep").when(F.col("_bad"), "failed").otherwise("completed")
    return out.select("id", "depth", kind.alias("outcome"))


def default_roots(vertices: DataFrame, edges: DataFrame, admit: Column | None = None) -> DataFrame:
    """Vertices without predecessors; a group that has none starts at its first admitted vertex."""
    free = vertices.join(edges.where("src <> dst").select(F.col("dst").alias("d")).distinct(), F.col("id") == F.col("d"), "left_anti")
    grouped, _ = components(vertices, edges, "roots")
    labelled = vertices.join(grouped.withColumnRenamed("id", "g"), F.col("id") == F.col("g")).drop("g")
    rooted = labelled.join(free.select(F.col("id").alias("f")), F.col("id") == F.col("f"), "left_semi").select(F.col("label").alias("r")).distinct()
    rootless = sized_join(labelled, rooted.select(F.col("r").alias("label")), ["label"], Scratch(vertices.sparkSession, "rootless"), "left_anti")
    if admit is not None:
        rootless = rootless.where(admit)
    first = rootless.groupBy("label").agg(F.min_by("id", "ord").alias("id"))
    return free.select("id").union(first.select("id"))


def lanes(rows: DataFrame, lane: str, order: str, delay_ms: int) -> DataFrame:
    """Round-robin over lanes: the first of every lane, then the second; starts lie a delay apart in a lane."""
    placed = with_places(rows, [lane], [order], Scratch(rows.sparkSession, "lanes"), "turn")
    return placed.withColumn("turn", F.col("turn").cast("int")).withColumn("start_ms", (F.col("turn") * delay_ms).cast("long"))


def java_hash(key: Column, kind: str) -> Column:
    """Hash of a key as stable placement has it: of texts the polynomial in 31 over characters, of numbers both halves xored, as 32-bit signed."""
    if kind == "string":
        wide = F.aggregate(F.transform(F.filter(F.split(key, ""), lambda c: c != ""), F.ascii), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    else:
        wide = key.cast("long").bitwiseXOR(F.shiftrightunsigned(key.cast("long"), 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide).cast("int")


def partition_by_key(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """``part``: equal keys always go to the same part; balance is as good as that of the keys.  A null key goes to part 0."""
    kind = dict(rows.dtypes)[key]
    return rows.withColumn("part", F.coalesce(F.pmod(java_hash(F.col(key), kind), F.lit(parts)), F.lit(0)).cast("int"))


def edge_cut(edges: DataFrame, owners: DataFrame) -> DataFrame:
    a = owners.select(F.col("id").alias("src"), F.col("owner").alias("oa"))
    b = owners.select(F.col("id").alias("dst"), F.col("owner").alias("ob"))
    return edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("oa") != F.col("ob")).alias("cut"), F.count("*").alias("edges"))


def message_stats(edges: DataFrame, rounds: DataFrame, owners: DataFrame) -> DataFrame:
    """Decrements sent and the combined batches, one per (from, to, round), that carry them."""
    o = owners.select("id", "owner")
    sent = edges.join(rounds.where("round is not null").select(F.col("id").alias("src"), "round"), "src")
    sent = sent.join(o.select(F.col("id").alias("src"), F.col("owner").alias("f")), "src").join(o.select(F.col("id").alias("dst"), F.col("owner").alias("t")), "dst")
    per = sent.groupBy("f", "t", "round").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("decrement_edges"), F.count("*").alias("batches_sent"))


def pending_after(edges: DataFrame, rounds: DataFrame, upto: int) -> DataFrame:
    """Rebuild from a log cut at round ``upto``: open predecessors of every vertex with any."""
    done = rounds.where(F.col("round") < upto).select(F.col("id").alias("src"), F.lit(1).alias("ok"))
    return edges.join(done, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("ok").isNull()).alias("pending"))


def ready_at(edges: DataFrame, rounds: DataFrame, upto: int) -> DataFrame:
    """Readiness without counters: vertices all of whose predecessors were done before ``upto``."""
    r = rounds.select(F.col("id").alias("src"), "round")
    return edges.join(r, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.bool_and(F.coalesce(F.col("round") < upto, F.lit(False))).alias("ready"))


def dedupe_batches(batches: DataFrame) -> DataFrame:
    """Replayed batches (same sender, receiver, round) apply once."""
    return batches.dropDuplicates(["sender", "receiver", "round"])


def run_report(arrivals: DataFrame) -> DataFrame:
    """Totals of a run's arrivals (worker, round, attempt, done, failed, skipped, batches, edges)."""
    return arrivals.agg(
        (F.max("round") + 1).alias("rounds"), F.sum("done").alias("done"), F.sum("failed").alias("failed"), F.sum("skipped").alias("skipped"), F.sum("batches").alias("batches"), F.sum("edges").alias("edges"),
        F.count_if(F.col("attempt") > 0).alias("recoveries"), F.countDistinct("worker").alias("workers"),
    )


def fenced_arrivals(arrivals: DataFrame, claims: DataFrame) -> DataFrame:
    """Arrivals ``(shard, round, attempt, seq)`` that count: made under the newest claim ``(shard, attempt, seq)`` so far, the first of each round.

    A worker whose shard was taken over meanwhile is fenced off: its arrival carries an older attempt.
    """
    both = claims.select("shard", F.lit(None).cast("long").alias("round"), "attempt", "seq", F.col("attempt").alias("claimed")).unionByName(arrivals.select("shard", "round", "attempt", "seq", F.lit(None).cast(dict(claims.dtypes)["attempt"]).alias("claimed")))
    newest = F.max("claimed").over(Window.partitionBy("shard").orderBy("seq", F.desc_nulls_last("claimed")).rowsBetween(Window.unboundedPreceding, 0))
    held = both.withColumn("newest", newest).where((F.col("round").isNotNull()) & (F.col("attempt") == F.col("newest")))
    return held.groupBy("shard", "round").agg(F.min(F.struct("seq", "attempt")).alias("f")).select("shard", "round", "f.attempt", "f.seq")


def first_outcome(log: DataFrame) -> DataFrame:
    """Completion log: the first write of each id stands (``seq`` orders writes)."""
    return log.groupBy("id").agg(F.min_by(F.struct("status", "round", "error"), "seq").alias("o")).select("id", "o.status", "o.round", "o.error")


# --- sequential algorithms, on one group at a time ------------------------


def dfs_preorder(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, id, pos)``: preorder per root with ascending neighbours.

    Depth-first order is sequential; each root's reachable part is one group
    and has to fit into one task (roots' parts run in parallel).
    """
    reach = roots.select(F.col("id").alias("root"), F.col("id").alias("src"))
    scratch = Scratch(arcs.sparkSession, "dfs")
    arcs = scratch.keep(arcs.select("src", "dst").distinct())
    seen = scratch.log(reach)
    while seen.append(seen.last.join(arcs, "src").select("root", F.col("dst").alias("src")).distinct().join(seen.all, ["root", "src"], "left_anti")):
        pass
    owned = seen.all.join(arcs, "src", "left").select("root", "src", "dst")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        root = int(pdf["root"].iloc[0])
        out: dict[int, list[int]] = {}
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            if d == d and d is not None:
                out.setdefault(int(s), []).append(int(d))
        order, stack, met = [], [root], set()
        while stack:
            x = stack.pop()
            if x not in met:
                met.add(x)
                order.append(x)
                stack.extend(sorted(out.get(x, ()), reverse=True))
        return pd.DataFrame({"root": root, "id": order, "pos": range(len(order))})

    return owned.groupBy("root").applyInPandas(walk, "root long, id long, pos int")


def greedy_partition(vertices: list, neighbours: dict, parts: int, slack: float = 0.1) -> dict:
    """Linear deterministic greedy (Stanton and Kliot): each vertex, in order, to the part where its placed neighbours, discounted by load, weigh most.

    A part takes at most ceil((1 + slack) n / parts) vertices; equal weights go to the lightest, then the first part.
    """
    capacity = math.ceil(len(vertices) * (1 + slack) / parts)
    load = np.zeros(parts)
    home: dict = {}
    for x in vertices:
        held = np.bincount([home[y] for y in neighbours.get(x, ()) if y in home], minlength=parts)
        weight = np.where(load < capacity, held * (1 - load / max(1, capacity)), -1.0)
        part = int(np.lexsort((load, -weight))[0])
        home[x] = part
        load[part] += 1
    return home


def place_groups(groups: DataFrame, parts: int, placed: list[int] | None = None) -> DataFrame:
    """Whole groups to parts, longest first to the lightest; ``(group, part, whole)``.

    ``groups(group, size)``.  Groups above ceil(V / parts) are marked to be split
    (part null); ``placed`` has the vertices that their split put in each part
    (see ``place_nodes``).  The group list is what one task can sort; sizes of
    whole groups are at most V / parts each.
    """
    total = groups.agg(F.sum("size")).scalar()
    marked = groups.withColumn("limit", F.ceil(total / F.lit(parts)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "group"], ascending=[False, True], kind="stable")
        load, part = list(placed or [0] * parts), []
        for size, limit in zip(pdf["size"], pdf["limit"], strict=True):
            if size > limit:
                part.append(None)
                continue
            k = min(range(parts), key=lambda p: (load[p], p))
            load[k] += int(size)
            part.append(k)
        return pd.DataFrame({"group": pdf["group"], "part": pd.array(part, dtype="Int32"), "whole": [p is not None for p in part]})

    return marked.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(fill, "group long, part int, whole boolean")


def greedy_by_group(vertices: DataFrame, edges: DataFrame, parts: int, slack: float = 0.1) -> DataFrame:
    """``(group, id, part)``: each group's vertices ``(group, id, ord)`` in order by ``greedy_partition``; edges ``(group, src, dst)`` inside groups.

    Sequential in a group, which one task holds as arrays; groups run in parallel.
    """

    def run(mine: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        ids = mine.sort_values(["ord", "id"])["id"].tolist()
        near: dict[int, list[int]] = {}
        for a, b in zip(arcs["src"].tolist(), arcs["dst"].tolist(), strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        home = greedy_partition(ids, near, parts, slack)
        return pd.DataFrame({"group": mine["group"].iloc[:1].repeat(len(home)).to_numpy(), "id": list(home), "part": list(home.values())})

    return vertices.groupBy("group").cogroup(edges.groupBy("group")).applyInPandas(run, "group long, id long, part int")


def place_nodes(members: DataFrame, edges: DataFrame, parts: int, slack: float = 0.1) -> DataFrame:
    """Every vertex to a part, group by group; ``(id, group, part, whole)``.

    ``members(id, ord, group)``.  Groups above ceil(V / parts) are split first, by
    vertex; the others then go whole, longest first, to the lightest part.  There
    are fewer than ``parts`` groups to split; that is sequential, and their
    vertices and edges have to fit into one task as arrays (see ``splitting``).
    Ids, edges and groups are numbers; ``edges`` is best stored.
    """
    scratch = Scratch(members.sparkSession, "placement")
    members = scratch.keep(members.select("id", "ord", "group"))
    groups = scratch.keep(members.groupBy("group").agg(F.count("*").alias("size")))
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    above = groups.where(F.col("size") > math.ceil(total / parts))
    n = above.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = members.join(F.broadcast(above.select("group")), "group", "left_semi")
    # where the large groups are the lesser part, the arcs of the others stay behind
    near = edges if 2 * n >= total else edges.join(large.select(F.col("id").alias("src")), "src", "left_semi")
    split = split_groups(large, n, near, parts, slack, scratch)
    placed = {r["part"]: r["n"] for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    whole = place_groups(groups, parts, [placed.get(p, 0) for p in range(parts)]).where("whole")
    rest = sized_join(members, whole.select("group", "part"), ["group"], scratch)
    return split.withColumn("whole", F.lit(False)).unionByName(rest.select("id", "group", "part", F.lit(True).alias("whole")))


def load_graph(vertices: DataFrame, edges: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Bulk load: merged vertices and de-duplicated edges with the shard of their source."""
    shard = lambda c: F.pmod(F.hash(c), F.lit(shards))
    return vertices.select("id").distinct().withColumn("shard", shard("id")), edges.select("src", "dst").distinct().withColumn("shard", shard("src"))


def page_of_nodes(vertices: DataFrame, after, limit: int) -> DataFrame:
    rows = vertices if after is None else vertices.where(F.col("id") > after)
    return rows.orderBy("id").limit(limit)


def adjacency(vertices: DataFrame, arcs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(id, successors)`` with edgeless vertices kept and unknown ids omitted."""
    asked = vertices.select("id") if ids is None else vertices.join(ids.select("id").distinct(), "id", "left_semi").select("id")
    lists = arcs.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("successors"))
    return meet(asked.withColumnRenamed("id", "src"), lists, ["src"], "left").select(F.col("src").alias("id"), F.coalesce("successors", F.array().cast("array<long>")).alias("successors"))
