import random
from datetime import datetime

import pytest
from support import listed

from loamgraph.operators import hierarchy as hi
from loamgraph.session import Scratch

S = "tenant_id string, node_id long, parent_id long, path string, depth short, version int, updated_at timestamp_ntz, nid long, root_id long"
T = datetime(2024, 5, 1)


def node(t, n, p, path="", depth=0, version=1):
    return (t, n, p, path, depth, version, T, 0, 0)


def walk(parent):
    """Brute force: n -> (state, ids from the top)."""
    out = {}
    for n in parent:
        seen, at = [n], parent[n]
        while at is not None and at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is None:
            out[n] = ("rooted", seen[::-1])
        elif at in seen:
            out[n] = ("cycle" if at == n else "below_cycle", seen[::-1])
        else:
            out[n] = ("dangling", seen[::-1])
    return out


def random_forest(seed, n):
    r = random.Random(seed)
    parent = {}
    for i in range(n):
        x = r.random()
        parent[i] = None if x < 0.05 or i == 0 else 10_000 if x < 0.08 else r.randrange(n) if x < 0.14 else r.randrange(max(0, i - 8), i)
    return parent


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    parent = random_forest(seed, 200)
    want = walk(parent)
    rows = [node("a", n, p, "/" + "/".join(map(str, want[n][1])) + "/", len(want[n][1]) - 1) for n, p in parent.items()]
    df = spark.createDataFrame(rows + rows[:30], S)
    got = {r.node_id: r for r in hi.hierarchy(df).collect()}
    assert len(got) == 200
    for n, (state, ids) in want.items():
        assert got[n].state == state
        if state in ("rooted", "dangling"):
            below = sum(1 for s, x in want.values() if s == state and n in x[:-1])
            assert (got[n].depth, got[n].root_id, got[n].path, got[n].n_descendants) == (len(ids) - 1, ids[0], "/" + "/".join(map(str, ids)) + "/", below)
        else:
            assert got[n].path is None
    rings = sorted(("a", n, s) for n, (s, _) in want.items() if "cycle" in s)
    assert listed(hi.tree_faults(df)) == sorted(rings, key=str)


def test_faults_and_versions(spark):
    rows = [
        node("a", 1, None, "/1/"), node("a", 2, 1, "/1/2/", 1), node("a", 2, 9, "/9/2/", 5, 0), node("a", 3, 1, "/wrong/", 1), node("a", 4, 3, "/1/3/4/", 7), node("a", 5, 5, None, None), node("a", 6, 5, "/5/6/", 1),
        node("a", 7, 99, "x", 0), node("b", 2, None, None, None), (None, 8, None, "/8/", 0, 1, T, 0, 0), (None, 9, 8, "/8/9/", 1, 1, T, 0, 0), node("a", None, 1),
    ]
    got = listed(hi.tree_faults(spark.createDataFrame(rows, S)))
    assert got == sorted([("a", 3, "path"), ("a", 4, "depth"), ("a", 5, "cycle"), ("a", 6, "below_cycle"), ("b", 2, "depth"), ("b", 2, "path")], key=str)


def test_descendants_and_ancestors(spark):
    rows = [node("a", 1, None), node("a", 2, 1), node("a", 3, 2), node("a", 4, 2), node("a", 5, 1), node("b", 3, None)]
    tree = hi.hierarchy(spark.createDataFrame(rows, S)).cache()
    assert listed(hi.descendants(tree, "a", 2).select("node_id")) == [(3,), (4,)]
    assert [r.node_id for r in hi.ancestors(tree, "a", 4).collect()] == [1, 2]


@pytest.mark.parametrize("local", [10, 1000])
def test_small_blocks_and_hot_parent(spark, local):
    """Blocks far smaller than a tree, children of one parent in several buckets, lists contracted several times: nothing changes."""
    parent = {0: None} | {i: 0 if i % 3 else i // 2 for i in range(1, 90)} | {i: None for i in range(200, 230)}
    want = walk(parent)
    scratch = Scratch(spark, "t")
    own = hi.linked_nodes(spark.createDataFrame([node("a", n, p) for n, p in parent.items()], S), scratch)
    ranked = hi.rank_lists(hi.euler_links(own.select("nid", "pid"), bucket_rows=7), scratch, local)
    assert ranked.count() == 240 and ranked.select("head", "pos").distinct().count() == 240
    spans = scratch.keep(hi.intervals(own.select("nid", "pid"), scratch, local).join(own.select("nid", "node_id"), "nid"))
    got = {r.node_id: (r.true_path, r.true_depth) for r in hi.paths(spans, block=11).collect()}
    assert got == {n: ("/" + "/".join(map(str, ids)) + "/", len(ids) - 1) for n, (_, ids) in want.items()}


@pytest.mark.parametrize("shape", ["chain", "star", "broom"])
def test_one_tree_holds_all(spark, shape, monkeypatch):
    """One root, one parent or one chain with all rows, hot parents kept apart: ranks, depths and paths are right."""
    monkeypatch.setattr(hi, "LOCAL", 50)
    monkeypatch.setattr(hi, "BUCKET", 40)
    n = 400
    parent = {0: None} | {i: i - 1 if shape == "chain" or shape == "broom" and i < 150 else 0 if shape == "star" else 149 for i in range(1, n)}
    want = walk(parent)
    got = {r.node_id: (r.depth, r.path, r.n_descendants) for r in hi.hierarchy(spark.createDataFrame([node("a", i, p) for i, p in parent.items()], S)).collect()}
    below = {i: 0 for i in parent}
    for _, ids in want.values():
        for i in ids[:-1]:
            below[i] += 1
    assert got == {i: (len(ids) - 1, "/" + "/".join(map(str, ids)) + "/", below[i]) for i, (_, ids) in want.items()}


def test_empty(spark):
    assert hi.hierarchy(spark.createDataFrame([], S)).count() == 0
    assert hi.tree_faults(spark.createDataFrame([], S)).count() == 0
