"""Graph queries: algebra (g), priority queue (q), graph execution (x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.operators import graph as gr
from loamgraph.plans.views import using
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


def _trade(s, d, directed=True, weighted=True) -> gr.Graph:
    e = domain.trade(s, d)
    return gr.Graph.of(domain.nations(s, d), e if weighted else e.drop("weight"), directed, weighted)


def _ids(s: SparkSession, *ids: int) -> DataFrame:
    return s.createDataFrame([(i,) for i in ids], "id long")


_UND = "und AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(weight) AS weight FROM trade GROUP BY 1, 2)"


@_q(f"WITH {_UND} SELECT 'directed' AS kind, count(*) AS edges, sum(weight) AS weight FROM trade UNION ALL SELECT 'undirected', count(*), sum(weight) FROM und UNION ALL SELECT 'unweighted', count(*), NULL FROM trade", "trade")
def g01_kinds(s, d):
    out = None
    for kind, g in (("directed", _trade(s, d)), ("undirected", _trade(s, d, False)), ("unweighted", _trade(s, d, weighted=False))):
        one = g.edges.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")).select(F.lit(kind).alias("kind"), "edges", "weight")
        out = one if out is None else out.union(one)
    return out


@_q("SELECT src, dst, weight FROM trade WHERE src % 5 <> 2 AND dst % 5 <> 2", "trade")
def g02_remove_nodes(s, d):
    return _trade(s, d).remove_nodes(domain.nations(s, d).where("id % 5 = 2")).edges.select("src", "dst", "weight")


@_q("SELECT CASE src WHEN 3 THEN 1003 ELSE src END AS src, CASE dst WHEN 3 THEN 1003 ELSE dst END AS dst, weight FROM trade", "trade")
def g03_rename_node(s, d):
    return _trade(s, d).rename_node(3, 1003).edges.select("src", "dst", "weight")


@_q("SELECT src, dst, weight FROM trade UNION ALL SELECT n, n + 100, 1.5 FROM (SELECT id AS n FROM nations)", "trade nations")
def g04_add_edges(s, d):
    more = domain.nations(s, d).select(F.col("id").alias("src"), (F.col("id") + 100).alias("dst"), F.lit(1.5).alias("weight"))
    again = domain.trade(s, d).withColumn("weight", F.lit(-1.0))
    return _trade(s, d).add_edges(more.unionByName(again)).edges.select("src", "dst", "weight")


@_q("SELECT src, dst, CASE WHEN src % 2 = 0 THEN 0.5 ELSE weight END AS weight FROM trade WHERE dst % 3 <> 1", "trade")
def g05_remove_and_update_edges(s, d):
    g = _trade(s, d)
    gone = g.edges.where("dst % 3 = 1")
    return g.remove_edges(gone).update_edges(g.edges.where("src % 2 = 0").withColumn("weight", F.lit(0.5))).edges.select("src", "dst", "weight")


@_q(f"WITH {_UND}, asked AS (SELECT a.id AS src, b.id AS dst FROM nations a, nations b WHERE true) SELECT q.src, q.dst, u.src IS NOT NULL AS contained, weight FROM asked q LEFT JOIN und u ON least(q.src, q.dst) = u.src AND greatest(q.src, q.dst) = u.dst", "trade nations")
def g05_contains_edges(s, d):
    n = domain.nations(s, d).select("id")
    asked = n.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("dst"))
    return _trade(s, d, directed=False).contains_edges(asked)


@_q(f"WITH {_UND} SELECT (SELECT count(*) FROM nations) AS nodes, (SELECT count(*) FROM und) AS edges", "trade nations")
def g06_counts(s, d):
    return _trade(s, d, directed=False).counts()


@_q("SELECT src AS id, dst AS neighbour, 'out' AS way FROM trade WHERE src IN (1, 4, 7) UNION ALL SELECT dst, src, 'in' FROM trade WHERE dst IN (1, 4, 7)", "trade")
def g07_neighbours(s, d):
    g = _trade(s, d)
    ask = _ids(s, 1, 4, 7, 9999)
    return g.neighbours(ask).withColumn("way", F.lit("out")).unionByName(g.neighbours(ask, reverse=True).withColumn("way", F.lit("in")))


@_q("SELECT id, (SELECT count(*) FROM trade WHERE src = id) AS out_degree, (SELECT count(*) FROM trade WHERE dst = id) AS in_degree FROM nations", "trade nations")
def g08_degrees(s, d):
    return _trade(s, d).degrees()


@_q(f"WITH {_UND}, e AS (SELECT src, dst FROM und UNION SELECT dst, src FROM und) SELECT id, count(e.src) AS out_degree, count(e.src) AS in_degree FROM nations LEFT JOIN e ON id = e.src GROUP BY id", "trade nations")
def g08_degrees_undirected(s, d):
    return _trade(s, d, directed=False).degrees()


@_q("SELECT src, dst FROM trade WHERE src < 12 AND dst < 12", "trade")
def g09_subgraph(s, d):
    return _trade(s, d).subgraph(_ids(s, *range(12), 500)).edges.select("src", "dst")


_BFS = "walk AS (SELECT {root} AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.id WHERE w.depth < {most})"


@_q("WITH " + _BFS.format(root="(SELECT min(src) FROM trade)", edges="trade", most=25) + " SELECT id, min(depth) AS depth FROM walk GROUP BY id", "trade", True)
def g10_bfs(s, d):
    e = domain.trade(s, d)
    return gr.bfs(e, e.agg(F.min("src").alias("id")))


@_q("SELECT id, CAST(floor(log2(id)) AS INTEGER) AS depth FROM heap_nodes", "heap_nodes")
def g10_bfs_heap(s, d):
    return gr.bfs(domain.heap(s, d), _ids(s, 1))


@_q()
def g11_dfs(s, d):
    return gr.dfs_preorder(domain.heap(s, d), _ids(s, 1, 2, 3))


@_q("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def q01_top(s, d):
    return table(s, d, "events").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@_q("SELECT event_id, value FROM events WHERE event_type <> 'click' ORDER BY value DESC, event_id LIMIT 25")
def q02_remove(s, d):
    e = table(s, d, "events").select("event_id", "event_type", "value")
    gone = e.where("event_type = 'click'").select("event_id")
    return e.join(gone, "event_id", "left_anti").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@_q("SELECT event_id, CASE WHEN event_type = 'view' THEN -value ELSE value END AS priority FROM events ORDER BY priority, event_id LIMIT 25")
def q03_rekey(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.when(F.col("event_type") == "view", -F.col("value")).otherwise(F.col("value")).alias("priority")).orderBy("priority", "event_id").limit(25)


def _bip(s, d):
    e = domain.bipartite(s, d)
    return _vertices(e), e


def _vertices(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("ord", F.col("id"))


_WCC = """both_ways AS (SELECT src, dst FROM bipartite UNION ALL SELECT dst, src FROM bipartite),
labels(id, label) USING KEY (id) AS (SELECT DISTINCT src, src FROM both_ways UNION SELECT b.dst, min(w.label) FROM labels w JOIN both_ways b ON b.src = w.id JOIN recurring.labels r ON r.id = b.dst WHERE w.label < r.label GROUP BY b.dst)"""


@_q(f"WITH {_WCC} SELECT id, label FROM labels", "bipartite", True)
def x01_groups(s, d):
    return gr.components(*_bip(s, d))[0]


@_q(f"WITH {_WCC} SELECT label, count(*) AS members FROM labels GROUP BY label", "bipartite", True)
def x02_label_propagation(s, d):
    return gr.min_label_rounds(*_bip(s, d))[0].groupBy("label").agg(F.count("*").alias("members"))


_BLOCKED = """seeds AS (SELECT event_id AS src, event_id >> 2 AS dst FROM events WHERE event_id >= 400 AND event_id % 97 = 0 AND substring(bin(event_id), 2, 1) = '0'),
walk AS (SELECT dst AS id FROM seeds UNION SELECT e.dst FROM walk w JOIN heap e ON e.src = w.id)"""


@_q(f"WITH {_BLOCKED} SELECT DISTINCT id FROM walk", "heap", True)
def x03_blocked(s, d):
    return gr.waves(domain.heap_nodes(s, d), domain.heap_cyclic(s, d)).where("round is null").select("id")


@_q(
    f"WITH {_BLOCKED}, grp AS (SELECT id, CASE WHEN id < 2 THEN id ELSE 2 + ((id >> (CAST(floor(log2(id)) AS INTEGER) - 1)) & 1) END AS g FROM heap_nodes) SELECT id, g AS grp, g NOT IN (SELECT (CASE WHEN w.id < 2 THEN w.id ELSE 2 + ((w.id >> (CAST(floor(log2(w.id)) AS INTEGER) - 1)) & 1) END) FROM walk w) AS eligible FROM grp WHERE id >= 2",
    "heap heap_nodes",
    True,
)
def x04_policy(s, d):
    """Without node 1 the heap falls into two groups, below 2 and below 3; back edges stay inside them."""
    e = domain.heap_cyclic(s, d).where("src >= 2 and dst >= 2")
    return gr.eligible(domain.heap_nodes(s, d).where("id >= 2"), e).withColumnRenamed("group", "grp")


# The round of a vertex is the longest way to it, by any of its predecessors.
_ROUNDS = "ways AS (SELECT 1 AS id, 0 AS k UNION SELECT f.dst, w.k + 1 FROM ways w JOIN fan f ON f.src = w.id), rounds AS (SELECT id, max(k) AS round FROM ways GROUP BY id)"


@_q(f"WITH {_ROUNDS} SELECT id, round FROM rounds", "fan", True)
def x05_waves(s, d):
    return gr.waves(domain.heap_nodes(s, d), domain.fan(s, d))


@_q(
    f"WITH {_ROUNDS}, heirs AS (SELECT dst AS id FROM fan WHERE src % 1037 = 700 UNION SELECT f.dst FROM heirs h JOIN fan f ON f.src = h.id) SELECT id, round, CASE WHEN id IN (SELECT id FROM heirs) THEN 'SKIPPED' WHEN id % 1037 = 700 THEN 'FAILED' ELSE 'DONE' END AS status FROM rounds",
    "fan",
    True,
)
def x06_failures(s, d):
    v = domain.heap_nodes(s, d)
    return gr.run_waves(v, domain.fan(s, d), v.where("id % 1037 = 700"))


def _start(s, d) -> DataFrame:
    return domain.trade(s, d).where("src % 6 <> 5 and dst % 6 <> 5").agg(F.min("src").alias("id"))


_TRAVERSE = "ok AS (SELECT * FROM trade WHERE src % 6 <> 5 AND dst % 6 <> 5), " + _BFS.format(root="(SELECT min(src) FROM ok)", edges="ok", most=25) + ", depths AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"


@_q(
    f"WITH {_TRAVERSE} SELECT n.id, depth, CASE WHEN n.id % 6 = 5 THEN 'excluded' WHEN depth IS NULL THEN 'unreachable' WHEN depth > 2 THEN 'too_deep' WHEN n.id % 7 = 3 THEN 'failed' ELSE 'completed' END AS outcome FROM nations n LEFT JOIN depths d ON d.id = n.id",
    "trade nations",
    True,
)
def x07_traversal(s, d):
    return gr.traverse(domain.nations(s, d), domain.trade(s, d), _start(s, d), F.col("id") % 6 != 5, F.col("id") % 7 == 3, 2)


@_q(f"WITH {_WCC} SELECT DISTINCT id FROM labels WHERE id NOT IN (SELECT dst FROM bipartite)", "bipartite", True)
def x08_default_roots(s, d):
    v, e = _bip(s, d)
    return gr.default_roots(v, e)


@_q(f"WITH {_TRAVERSE} SELECT depth, count(*) AS nodes, count(*) FILTER (depth > 2) AS marked_only FROM depths GROUP BY depth", "trade", True)
def x09_too_deep(s, d):
    out = gr.traverse(domain.nations(s, d), domain.trade(s, d), _start(s, d), F.col("id") % 6 != 5, F.lit(False), 2).where("depth is not null")
    return out.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if(F.col("outcome") == "too_deep").alias("marked_only"))


@_q("SELECT event_id, user_id, CAST(row_number() OVER w - 1 AS INTEGER) AS turn, (row_number() OVER w - 1) * 250 AS start_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def x10_lanes(s, d):
    return gr.lanes(table(s, d, "events").select("event_id", "user_id"), "user_id", "event_id", 250)


_TEXT_HASH = "list_reduce([CAST(0 AS BIGINT)] || list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substring(k, i, 1)) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


@_q(
    f"WITH v AS (SELECT 'host-' || (user_id * 7919) || '.' || event_type AS k, event_id * 4295000000 + user_id AS n FROM events), h AS (SELECT k, n, {_TEXT_HASH} AS t, xor(n, n >> 32) % 4294967296 AS u FROM v), w AS (SELECT k, n, CASE WHEN t >= 2147483648 THEN t - 4294967296 ELSE t END AS t, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS u FROM h) SELECT k, n, CAST((t % 7 + 7) % 7 AS INTEGER) AS by_text, CAST((u % 7 + 7) % 7 AS INTEGER) AS by_number FROM w"
)
def x11_partition_by_key(s, d):
    e = table(s, d, "events")
    rows = e.select(F.concat(F.lit("host-"), F.col("user_id") * 7919, F.lit("."), "event_type").alias("k"), (F.col("event_id") * F.lit(4_295_000_000) + F.col("user_id")).alias("n"))
    both = gr.partition_by_key(gr.partition_by_key(rows, "k", 7).withColumnRenamed("part", "by_text"), "n", 7)
    return both.withColumnRenamed("part", "by_number")


@_q("SELECT event_id AS id, user_id AS grp, CAST((row_number() OVER w - 1) // CAST(ceil(count(*) OVER (PARTITION BY user_id) * (1 + CAST(0.1 AS DOUBLE)) / 4) AS BIGINT) AS INTEGER) AS part FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def x12_greedy(s, d):
    """Each user's events form a chain, which the greedy rule cuts into full parts one after the other."""
    e = table(s, d, "events").select(F.col("user_id").alias("group"), F.col("event_id").alias("id"), F.col("event_id").alias("ord"))
    before = F.lag("id").over(Window.partitionBy("group").orderBy("id"))
    arcs = e.select("group", before.alias("src"), F.col("id").alias("dst")).where("src is not null")
    return gr.greedy_by_group(e, arcs, 4).select("id", F.col("group").alias("grp"), "part")


@_q()
def x13_placement(s, d):
    # repeated edges make no difference, and here a vertex's id is its ord
    e = domain.holdings(s, d).where("src is not null and dst is not null")
    members = gr.components(_vertices(e), e, named=True)[0].select("id", F.col("id").alias("ord"), F.col("label").alias("group"))
    return gr.place_nodes(members, e, 4).withColumnRenamed("group", "grp")


@_q("SELECT count(*) FILTER (src % 4 <> dst % 4) AS cut, count(*) AS edges FROM trade", "trade")
def x14_edge_cut(s, d):
    return gr.edge_cut(domain.trade(s, d), domain.nations(s, d).select("id", (F.col("id") % 4).alias("owner")))


@_q(f"WITH {_ROUNDS} SELECT count(*) AS decrement_edges, count(DISTINCT (src % 4, dst % 4, round)) AS batches_sent FROM fan JOIN rounds ON id = src", "fan", True)
def x15_message_combining(s, d):
    v, e = domain.heap_nodes(s, d), domain.fan(s, d)
    return gr.message_stats(e, gr.waves(v, e), v.select("id", (F.col("id") % 4).alias("owner")))


@_q("SELECT DISTINCT src % 4 AS sender, dst % 4 AS receiver, CAST(floor(log2(src)) AS INTEGER) AS round FROM heap", "heap")
def x16_replays(s, d):
    b = domain.heap(s, d).select((F.col("src") % 4).alias("sender"), (F.col("dst") % 4).alias("receiver"), F.floor(F.log2("src")).cast("int").alias("round"))
    return gr.dedupe_batches(b.union(b))


@_q(f"WITH {_ROUNDS} SELECT dst AS id, count(*) FILTER (round >= 6) AS pending FROM fan JOIN rounds ON id = src GROUP BY dst", "fan", True)
def x17_rebuild(s, d):
    v, e = domain.heap_nodes(s, d), domain.fan(s, d)
    return gr.pending_after(e, gr.waves(v, e), 6)


@_q(f"WITH {_ROUNDS} SELECT dst AS id, bool_and(round < 6) AS ready FROM fan JOIN rounds ON id = src GROUP BY dst", "fan", True)
def x18_ready(s, d):
    v, e = domain.heap_nodes(s, d), domain.fan(s, d)
    return gr.ready_at(e, gr.waves(v, e), 6)


@_q("SELECT CAST(max(user_id % 9) + 1 AS BIGINT) AS rounds, CAST(sum(user_id) AS BIGINT) AS done, CAST(sum(event_id % 3) AS BIGINT) AS failed, CAST(sum(event_id % 2) AS BIGINT) AS skipped, count(*) AS batches, CAST(sum(event_id % 5) AS BIGINT) AS edges, count(*) FILTER (event_id % 10 = 0) AS recoveries, count(DISTINCT user_id % 6) AS workers FROM events")
def x19_report(s, d):
    e = table(s, d, "events")
    arrivals = e.select((F.col("user_id") % 6).alias("worker"), (F.col("user_id") % 9).alias("round"), (F.col("event_id") % 10 == 0).cast("int").alias("attempt"), F.col("user_id").alias("done"), (F.col("event_id") % 3).alias("failed"), (F.col("event_id") % 2).alias("skipped"), F.lit(1).alias("batches"), (F.col("event_id") % 5).alias("edges"))
    return gr.run_report(arrivals)


@_q(
    "WITH c AS (SELECT user_id % 6 AS shard, row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id) AS attempt, event_id AS seq FROM events WHERE event_id % 53 = 0), a AS (SELECT e.user_id % 6 AS shard, e.event_id // 100 AS round, (SELECT count(*) FROM c WHERE c.shard = e.user_id % 6 AND c.seq <= e.event_id) - CASE WHEN e.event_id % 4 = 0 THEN 1 ELSE 0 END AS attempt, (SELECT max(attempt) FROM c WHERE c.shard = e.user_id % 6 AND c.seq <= e.event_id) AS newest, e.event_id AS seq FROM events e WHERE e.event_id % 53 <> 0) SELECT shard, round, arg_min(attempt, seq) AS attempt, min(seq) AS seq FROM a WHERE attempt = newest GROUP BY shard, round"
)
def x20_fenced_arrivals(s, d):
    """Every 53rd event claims its shard anew; every fourth arrival still carries the attempt before."""
    e = table(s, d, "events").select((F.col("user_id") % 6).alias("shard"), F.col("event_id").alias("seq"))
    by_seq = Window.partitionBy("shard").orderBy("seq")
    claims = e.where("seq % 53 = 0").withColumn("attempt", F.row_number().over(by_seq).cast("long"))
    numbered = e.withColumn("held", F.count_if(F.col("seq") % 53 == 0).over(by_seq.rowsBetween(Window.unboundedPreceding, 0)))
    arrivals = numbered.where("seq % 53 <> 0").select("shard", F.floor(F.col("seq") / 100).cast("long").alias("round"), (F.col("held") - (F.col("seq") % 4 == 0).cast("int")).cast("long").alias("attempt"), "seq")
    return gr.fenced_arrivals(arrivals, claims)


@_q("SELECT id, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM trade WHERE src = id), '') AS successors FROM nations", "trade nations")
def x21_adjacency(s, d):
    lists = gr.adjacency(domain.nations(s, d), domain.trade(s, d))
    return lists.select("id", F.array_join(F.transform("successors", lambda x: x.cast("string")), ",").alias("successors"))


@_q("SELECT id FROM heap_nodes WHERE id > 500 ORDER BY id LIMIT 40", "heap_nodes")
def x21_node_page(s, d):
    return gr.page_of_nodes(domain.heap_nodes(s, d).select("id"), 500, 40)


@_q("WITH e AS (SELECT src, dst FROM trade WHERE src < 12 AND dst < 12) SELECT id FROM nations WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)", "trade nations")
def x22_isolated(s, d):
    """Sources of an undirected store are its isolated vertices; here trade among the first twelve nations only."""
    near = domain.trade(s, d).where("src < 12 and dst < 12").drop("weight")
    return gr.Graph.of(domain.nations(s, d), near, directed=False).degrees().where("out_degree = 0").select("id")


@_q("SELECT count(*) AS edges, count(DISTINCT src) AS sources FROM (SELECT DISTINCT src, dst FROM bipartite)", "bipartite")
def x23_bulk_load(s, d):
    v, e = _bip(s, d)
    loaded = gr.load_graph(v, e.union(e), 8)[1]
    return loaded.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


@_q("SELECT user_id AS id, arg_min(event_type, event_id) AS status, CAST(arg_min(event_id, event_id) % 5 AS BIGINT) AS round FROM events GROUP BY user_id")
def x05_completion_log(s, d):
    log = table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), (F.col("event_id") % 5).alias("round"), F.lit(None).cast("string").alias("error"))
    return gr.first_outcome(log).select("id", "status", "round")


QUERIES = Q

