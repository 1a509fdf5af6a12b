"""Splitting large groups: arrays of bounded size, ids in any order, repeats and arcs to elsewhere."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_graph import placed_plainly

from loamgraph.operators import graph as gr
from loamgraph.operators import splitting

NAMES = [c.split()[0] for c in splitting._PACKED.split(", ")]  # noqa: SLF001


def block(arcs, group, firsts, counts, seconds):
    raw = [np.array(x, np.int64).tobytes() for x in (firsts, counts, seconds)]
    return pa.RecordBatch.from_pylist([dict(zip(NAMES, (arcs, group, 0, 0, len(seconds), *raw), strict=True))])


@pytest.mark.parametrize("gap", [1, 1000])
def test_memory_of_a_split(gap):
    """About four bytes an arc and thirty to fifty a vertex; places by table and by search give the same."""
    r = np.random.default_rng(3)
    n, m = 20_000, 200_000
    a, b = r.integers(0, n, m), r.integers(0, n, m)
    a, b = np.concatenate([a, b, np.arange(n - 1), np.arange(1, n)]), np.concatenate([b, a, np.arange(1, n), np.arange(n - 1)])
    pairs = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
    total = pairs.shape[1]

    def rows():
        yield block(False, 7, [], [], np.arange(n) * gap)
        for i in range(0, total, 1000):
            src, dst = pairs[:, i : i + 1000]
            firsts, counts = np.unique(src, return_counts=True)
            yield block(True, 0, firsts * gap, counts, dst * gap)

    tracemalloc.start()
    got = {}
    for x in splitting._split(rows(), n, total, 4, 0.1):  # noqa: SLF001
        got |= dict(zip((x.column(0).to_numpy() // gap).tolist(), x.column(2).to_pylist(), strict=True))
        peak = tracemalloc.get_traced_memory()[1] if len(got) == x.num_rows else peak
    tracemalloc.stop()
    assert peak < 4 * total + 60 * n + (2 << 20)
    near: dict = {x: [] for x in range(n)}
    for s, d in zip(*pairs.tolist(), strict=True):
        near[s].append(d)
    met = dict.fromkeys([0])
    order = [0]
    for x in order:
        fresh = [y for y in near[x] if y not in met]
        met |= dict.fromkeys(fresh)
        order += fresh
    assert got == gr.greedy_partition(order, near, 4)


def test_split_by_order_repeats_and_other_groups(spark):
    """``ord`` against the ids, far apart ids, repeated and looped edges, two split groups and whole ones between them."""
    r = random.Random(2)
    ids = [x * 10**12 + 5 for x in r.sample(range(-500, 500), 130)]
    groups = [ids[:60], ids[60:63], ids[63:115], ids[115:]]
    edges = [(r.choice(g[:i]), x) for g in groups for i, x in enumerate(g) if i]
    edges += [(r.choice(g), r.choice(g)) for g in groups for _ in range(len(g))] + edges[:40]
    place = {x: i for i, x in enumerate(ids)}
    near = {x: sorted({b for a, b in edges if a == x != b} | {a for a, b in edges if b == x != a}, key=place.get) for x in ids}
    members = spark.createDataFrame([(x, place[x], k) for k, g in enumerate(groups) for x in g], "id long, ord long, `group` long")
    e = spark.createDataFrame(edges, "src long, dst long")
    for parts in (2, 3, 4):
        got = gr.place_nodes(members, e, parts).collect()
        assert len(got) == len(ids)
        assert {x.id: (x.part, x.whole) for x in got} == placed_plainly(groups, near, parts)
        assert {x.id: x.group for x in got} == {x: k for k, g in enumerate(groups) for x in g}


def test_components_by_name(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)]
    v, e = spark.createDataFrame([(i, i) for i in range(80)], "id long, ord long"), spark.createDataFrame(edges, "src long, dst long")
    assert sorted(gr.components(v, e, named=True)[0].collect()) == sorted(gr.components(v, e)[0].collect())
    assert gr._are_stars(spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "u long, v long"))  # noqa: SLF001
    assert not gr._are_stars(spark.createDataFrame([(2, 1), (3, 2)], "u long, v long"))  # noqa: SLF001
    assert not gr._are_stars(spark.createDataFrame([(3, 1), (3, 2)], "u long, v long"))  # noqa: SLF001
