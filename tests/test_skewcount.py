import random
from collections import Counter

import pytest

from support import listed

from loamgraph.operators import skewcount as sk

S = "tenant_id string, tag_id long, entity_type string, entity_id string, key string, n long, block int"


def rows(n=3000):
    r = random.Random(5)
    return [(r.choice(["hot"] * 6 + ["b", "c", None]), r.choice([1] * 5 + [None, *range(2, 60)]), "t", f"e{r.randrange(200)}", "k", 1, 1) for _ in range(n)]


def test_counts(spark):
    data = rows()
    df = spark.createDataFrame(data, S).repartition(5)
    for i, k in ((0, "tenant_id"), (1, "tag_id")):
        want = Counter(None if r[i] is None else str(r[i]) for r in data)
        assert {r.key: r.n for r in sk.dense_counts(df, k, block_size=8).collect()} == dict(want)


def test_heavy_and_entities(spark):
    data = rows()
    df = spark.createDataFrame(data, S)
    want = {k for k, n in Counter(r[0] for r in data).items() if k and n >= 0.1 * len(data)}
    assert {r.key_value for r in sk.heavy_keys(df, {"tenant_id": 0.1, "tag_id": 2.0}).collect()} == want
    got = {(r.field, r.key_value): (r.n_rows, r.n_entities) for r in sk.per_key_results(df, ("tenant_id",), ("tenant_id", "entity_type", "entity_id")).collect()}
    for k in {r[0] for r in data}:
        mine = [r for r in data if r[0] == k]
        assert got["tenant_id", k] == (len(mine), len({r[3] for r in mine}))


def test_assignments_per_key(spark):
    data = rows()
    df = spark.createDataFrame(data, S)
    got = {(r.field, r.key_value): r for r in sk.per_key_results(df, ("tenant_id", "tag_id", "key"), ("tenant_id", "entity_type", "entity_id"), "tag_id").collect()}
    for i, field in ((0, "tenant_id"), (1, "tag_id"), (4, "key")):
        for k in {r[i] for r in data}:
            mine = [r for r in data if r[i] == k]
            one = got.pop((field, None if k is None else str(k)))
            assert one.n_rows == len(mine)
            assert one.n_assignments == len({(r[0], r[2], r[3], r[1]) for r in mine if r[1] is not None})
            assert one.n_entities == len({(r[0], r[2], r[3]) for r in mine})
    assert not got


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_rounds_of_the_reduction(spark, fan_in):
    """Many splits, few keys, one of them hot; blocks of a few codes: summed in rounds."""
    df = spark.range(0, 5000, 1, 23).selectExpr("if(id % 3 = 0, 'hot', cast(id % 40 as string)) as k", "if(id % 7 = 0, null, id % 2) as j")
    got = {(r.field, r.key): r.n for r in sk.dense_counts(df, "k", "j", block_size=8, fan_in=fan_in).collect()}
    want = Counter()
    for r in df.collect():
        want["k", r.k] += 1
        want["j", None if r.j is None else str(r.j)] += 1
    assert got == want


def test_split_dictionary_restarts():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(["a", "b", None, "a"])], ["key"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["key"])]
    out = [dict(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) for b in sk._count_split(iter(batches))]
    assert out == [{"a": 2, "b": 1, None: 1}]


def test_split_dictionary_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sk, "SPLIT_KEYS", 2)
    batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array([1] * len(x)).cast(pa.string())], ["k", "j"]) for x in (["a", "b"], ["b", "c", "b"], ["a"])]
    total = Counter()
    for b in sk._count_split(iter(batches)):
        for _, f, k, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[f, k] += n
    assert total == {("k", "a"): 2, ("k", "b"): 3, ("k", "c"): 1, ("j", "1"): 6}


def test_empty(spark):
    df = spark.createDataFrame([], S)
    assert sk.dense_counts(df, "tag_id").count() == 0
    assert sk.heavy_keys(df, {"tag_id": 0.01}).count() == 0
    assert listed(sk.per_key_results(df, ("tag_id",), ("tenant_id",))) == []
