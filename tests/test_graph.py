import random

import pytest
from support import listed

from loamgraph.operators import graph as gr


def random_graph(seed=7, n=80, m=200, acyclic=False):
    r = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = r.randrange(n), r.randrange(n)
        if acyclic:
            a, b = min(a, b), max(a, b)
        if a != b or not acyclic:
            edges.add((a, b))
    return list(range(n + 5)), sorted(edges)


def frames(spark, nodes, edges):
    return spark.createDataFrame([(x, x) for x in nodes], "id long, ord long"), spark.createDataFrame(edges, "src long, dst long")


def py_bfs(edges, roots):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    depth = dict.fromkeys(roots, 0)
    queue = list(roots)
    for x in queue:
        for y in out.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    return depth


def test_bfs_and_components(spark):
    nodes, edges = random_graph(42, 120, 110)
    v, e = frames(spark, nodes, edges)
    got = {r.id: r.depth for r in gr.bfs(e, spark.createDataFrame([(0,), (1,)], "id long")).collect()}
    assert got == py_bfs(edges, [0, 1])
    both = edges + [(b, a) for a, b in edges]
    want = {}
    for x in nodes:
        want[x] = min(py_bfs(both, [x]))
    assert {r.id: r.label for r in gr.components(v, e)[0].collect()} == want
    assert {r.id: r.label for r in gr.min_label_rounds(v, e)[0].collect()} == want


def test_long_chain_takes_few_rounds(spark):
    n = 300
    v, e = frames(spark, range(n), [(i + 1, i) for i in range(n - 1)])
    labels, rounds = gr.components(v, e)
    assert labels.where("label <> 0").count() == 0 and rounds <= 14


def test_waves_and_failures(spark):
    nodes, edges = random_graph(7, 60, 120, acyclic=True)
    level = dict.fromkeys(nodes, 0)
    for x in nodes:
        for a, b in edges:
            if a == x:
                level[b] = max(level[b], level[x] + 1)
    v, e = frames(spark, nodes, edges)
    assert {r.id: r.round for r in gr.waves(v, e).collect()} == level
    bad = [3, 20]
    below = set(py_bfs(edges, [b for a, b in edges if a in bad]))
    got = {r.id: r.status for r in gr.run_waves(v, e, spark.createDataFrame([(x,) for x in bad], "id long")).collect()}
    assert got == {x: "SKIPPED" if x in below else "FAILED" if x in bad else "DONE" for x in nodes}


def test_cycles_block_what_is_below(spark):
    v, e = frames(spark, range(8), [(0, 1), (1, 2), (2, 1), (2, 3), (4, 5), (6, 6), (6, 7)])
    assert {r.id for r in gr.waves(v, e).where("round is null").collect()} == {1, 2, 3, 6, 7}
    got = {r.id: r.eligible for r in gr.eligible(v, e).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}
    with pytest.raises(ValueError):
        gr.eligible(v, e, "REJECT_GRAPH")


def test_algebra(spark):
    v, e = frames(spark, [1, 2, 3], [(1, 2), (2, 1), (3, 3), (9, 1)])
    g = gr.Graph.of(v, e, directed=False)
    assert listed(g.edges.select("src", "dst")) == [(1, 2), (1, 9), (3, 3)]
    assert {r.id: r.out_degree for r in g.degrees().collect()} == {1: 2, 2: 1, 3: 1, 9: 1}
    assert tuple(g.counts().first()) == (4, 3)
    with pytest.raises(ValueError):
        g.rename_node(1, 2)
    with pytest.raises(ValueError):
        g.rename_node(77, 78)
    assert listed(g.rename_node(1, 50).edges.select("src", "dst")) == [(2, 50), (3, 3), (9, 50)]
    with pytest.raises(ValueError):
        gr.Graph.of(v, e, weighted=True)


def test_dfs_preorder(spark):
    v, e = frames(spark, range(6), [(0, 1), (0, 4), (1, 2), (2, 0), (1, 3), (4, 3)])
    got = gr.dfs_preorder(e, spark.createDataFrame([(0,), (4,)], "id long")).orderBy("root", "pos").collect()
    assert [(r.root, r.id) for r in got] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (4, 4), (4, 3)]


def test_default_roots(spark):
    v, e = frames(spark, range(6), [(0, 1), (2, 3), (3, 2), (5, 5)])
    assert {r.id for r in gr.default_roots(v, e).collect()} == {0, 2, 4, 5}


def test_placement(spark):
    groups = spark.createDataFrame([(1, 5), (2, 4), (3, 3), (4, 20)], "group long, size long")
    got = {r.group: (r.part, r.whole) for r in gr.place_groups(groups, 2).collect()}
    assert got[4] == (None, False) and got[1][0] != got[2][0]
    home = gr.greedy_partition(list(range(8)), {i: {i ^ 1} for i in range(8)}, 2)
    assert all(home[i] == home[i ^ 1] for i in range(8)) and sum(home.values()) == 4


def placed_plainly(groups, near, parts):
    """Split groups first, then whole ones, one vertex after the other."""
    limit, load, home = -(-sum(map(len, groups)) // parts), [0] * parts, {}
    for g in (g for g in groups if len(g) > limit):
        order = [g[0]]
        for x in order:
            order += [y for y in near[x] if y not in order]
        for x, p in gr.greedy_partition(order, near, parts).items():
            home[x] = (p, False)
            load[p] += 1
    for g in sorted((g for g in groups if len(g) <= limit), key=lambda g: -len(g)):
        p = load.index(min(load))
        home |= {x: (p, True) for x in g}
        load[p] += len(g)
    return home


def test_large_groups_are_split_by_vertex(spark):
    r = random.Random(11)
    groups = [list(range(60)), list(range(60, 64)), [64, 65, 66], [67], list(range(70, 115))]
    edges = [(r.choice(g[:i]), x) for g in groups for i, x in enumerate(g) if i]
    edges += [(r.choice(g), r.choice(g)) for g in groups for _ in range(len(g) // 2)]
    near = {x: sorted({b for a, b in edges if a == x != b} | {a for a, b in edges if b == x != a}) for g in groups for x in g}
    v, e = frames(spark, near, edges)
    members = gr.components(v, e)[0].selectExpr("id", "id as ord", "label as group")
    for parts in (3, 4):
        got = gr.place_nodes(members, e, parts).collect()
        assert len(got) == len(near)
        assert {x.id: (x.part, x.whole) for x in got} == placed_plainly(groups, near, parts)
    assert all(x.whole and x.part == 0 for x in gr.place_nodes(members, e, 1).collect())
    assert gr.place_nodes(members.limit(0), e, 4).count() == 0


def test_placement_query_places_every_vertex(spark, data_dir):
    from loamgraph.plans.graphs import QUERIES, _bip

    got = QUERIES["x13_placement"](spark, data_dir).toPandas()
    assert sorted(got["id"]) == sorted(r.id for r in _bip(spark, data_dir)[0].collect())
    assert set(got["part"]) == {0, 1, 2, 3}
    assert got.groupby("part").size().max() <= -(-len(got) * 11 // 40)


def longest(n, edges):
    """Brute force: longest way to each vertex, None on or below a cycle."""
    out, left = {}, set(range(n))
    while True:
        ripe = {x for x in left if all(a in out for a, b in edges if b == x)}
        if not ripe:
            return {x: out.get(x) for x in range(n)}
        out |= {x: max((out[a] + 1 for a, b in edges if b == x), default=0) for x in ripe}
        left -= ripe


@pytest.mark.parametrize("seed", range(3))
def test_waves_with_several_predecessors(spark, seed):
    """In-degrees up to five, uneven ways, repeated edges, a few cycles."""
    r = random.Random(seed)
    edges = [(r.randrange(max(0, x - 12), x), x) for x in range(1, 60) for _ in range(r.randint(0, 5))]
    edges += [(x, r.randrange(x)) for x in r.sample(range(40, 60), 2)] + [(59, 59)]
    v, e = frames(spark, range(60), edges + edges[:9])
    assert {x.id: x.round for x in gr.waves(v, e).collect()} == longest(60, set(edges))


def test_star_and_chain_components(spark):
    """One vertex with all links, and one long chain: one label each."""
    v, e = frames(spark, range(700), [(0, x) for x in range(1, 400)] + [(x, x + 1) for x in range(400, 699)])
    assert {(x.id, x.label) for x in gr.components(v, e)[0].collect()} == {(i, 0 if i < 400 else 400) for i in range(700)}


@pytest.mark.parametrize("key", ["", "a", "host-7919.click", "zzzzzzzzzz"])
def test_java_hash(spark, key):
    want = 0
    for c in key:
        want = (want * 31 + ord(c) + 2**31) % 2**32 - 2**31
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(key, -5, 2**40 + 3)], "k string, a long, b long").select(gr.java_hash(F.col("k"), "string").alias("k"), gr.java_hash(F.col("a"), "bigint").alias("a"), gr.java_hash(F.col("b"), "bigint").alias("b")).first()
    assert tuple(row) == (want, 4, 2**8 ^ 3)


def test_fenced_arrivals(spark):
    claims = spark.createDataFrame([(1, 1, 0), (1, 2, 10)], "shard long, attempt long, seq long")
    rows = [(1, 5, 1, 3), (1, 5, 1, 4), (1, 6, 1, 12), (1, 6, 2, 13), (2, 5, 1, 1)]
    got = gr.fenced_arrivals(spark.createDataFrame(rows, "shard long, round long, attempt long, seq long"), claims)
    assert sorted(map(tuple, got.collect())) == [(1, 5, 1, 3), (1, 6, 2, 13)]


def test_empty(spark):
    v, e = frames(spark, [], [])
    assert gr.components(v, e)[0].count() == 0 and gr.waves(v, e).count() == 0
    assert gr.bfs(e, v.select("id")).count() == 0
