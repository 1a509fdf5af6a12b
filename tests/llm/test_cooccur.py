import random
from collections import Counter
from itertools import combinations

from support import listed

from loamgraph.llm import cooccur

S = "tenant_id string, entity_type string, entity_id string, tag_id long, n long, items string, grp int"
ENTITY = ["tenant_id", "entity_type", "entity_id"]


def brute(rows, least, ratio=None):
    sets = {}
    for t, k, e, tag, *_ in rows:
        if tag is not None:
            sets.setdefault((t, k, e), set()).add(tag)
    n, one, two = Counter(), Counter(), Counter()
    for (t, _, _), tags in sets.items():
        n[t] += 1
        one.update((t, x) for x in tags)
        two.update((t, a, b) for a, b in combinations(sorted(tags), 2))
    return sorted(((t, a, b, n[t], one[t, a], one[t, b], c) for (t, a, b), c in two.items() if c >= least and (ratio is None or c * n[t] >= ratio * one[t, a] * one[t, b])), key=str)


def rows(seed=2):
    r = random.Random(seed)
    out = []
    for i in range(300):
        t = r.choice(["hot"] * 4 + ["b", None])
        base = r.choice([[1, 2], [3, 4, 5], [1], [6, 7], [None]])
        for tag in base + ([r.randrange(8, 20)] if r.random() < 0.5 else []):
            out.append((t, r.choice(["x", "x", None]), f"e{i % 250}", tag, 1, "i", 1))
    return out + out[:80]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, S)
    assert listed(cooccur.pair_counts(df, "tenant_id", ENTITY, "tag_id", 3)) == brute(data, 3)
    for ratio in (1.5, 5):
        assert listed(cooccur.pair_counts(df, "tenant_id", ENTITY, "tag_id", 2, ratio)) == brute(data, 2, ratio)


def test_every_pair_without_a_bound(spark):
    data = rows()
    assert listed(cooccur.pair_counts(spark.createDataFrame(data, S), "tenant_id", ENTITY, "tag_id", 1)) == brute(data, 1)


def test_wide_baskets_are_cut(spark):
    """Pairs of one large record, cut into blocks of 7, once each."""
    r = random.Random(6)
    held = [("t", sorted(r.sample(range(100), n)), n) for n in (1, 2, 6, 7, 8, 20, 49)] + [(None, list(range(15)), 1)]
    got = cooccur.weighted_pairs(spark.createDataFrame(held, "grp string, items array<long>, weight long"), 7)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((g, a, b, w)) for g, items, w in held for a, b in combinations(items, 2))


def test_scores(spark):
    pairs = spark.createDataFrame([("t", 1, 2, 100, 10, 20, 10), ("t", 1, 3, 100, 10, 20, 5)], "grp string, item_a long, item_b long, n long, n_a long, n_b long, n_ab long")
    got = {r.item_b: (r.lift, r.conviction) for r in cooccur.scored(pairs).collect()}
    assert got == {2: (5.0, None), 3: (2.5, 1.6)}


def test_empty(spark):
    assert cooccur.pair_counts(spark.createDataFrame([], S), "tenant_id", ENTITY, "tag_id", 1).count() == 0
