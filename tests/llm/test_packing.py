import random
from collections import defaultdict

import numpy as np
import pytest

from loamgraph.llm import packing


def naive(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= s
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(1, 100) for _ in range(400)), reverse=True)
    assert packing.first_fit_decreasing(np.array(sizes), 100).tolist() == naive(sizes, 100)


def test_edges():
    assert packing.first_fit_decreasing(np.array([], dtype=np.int64), 10).tolist() == []
    assert packing.first_fit_decreasing(np.array([10, 10]), 10).tolist() == [0, 1]


def items(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "item long, size long")


def test_packing_is_whole(spark):
    r = random.Random(9)
    sizes = [r.randint(1, 400) for _ in range(3000)] + [1024, 1025, 5000, 2048, 0]
    rows = packing.pack(items(spark, sizes), 1024, group_size=700).collect()
    used, by_item = defaultdict(int), defaultdict(list)
    for x in rows:
        used[x.container] += x.size
        by_item[x.item].append(x)
    assert max(used.values()) <= 1024
    for i, s in enumerate(sizes):
        parts = by_item[i]
        assert sum(p.size for p in parts) == s and len({p.piece for p in parts}) == len(parts)
        if 0 < s <= 1024:
            assert len(parts) == 1 and parts[0].n_pieces == 1
    assert sum(1 for p in by_item[3002] if p.size == 1024) == 4 and len(by_item[3002]) == 5
    assert sum(used.values()) / (1024 * len(used)) > 0.97


def test_repeated_ids_and_empty(spark):
    rows = packing.pack(spark.createDataFrame([(1, 5), (1, 5), (2, 5)], "item long, size long"), 10).collect()
    assert len(rows) == 3 and len({r.container for r in rows}) == 2
    assert packing.pack(items(spark, []), 10).count() == 0
    assert packing.fill_report(packing.pack(items(spark, []), 10)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items(spark, [1]), 0)


def test_one_id_on_many_rows_spreads(spark):
    """A third of all rows repeat one id and size: no group gets them all, no container mixes them up."""
    rows = packing.pack(spark.createDataFrame([(7, 300)] * 300 + [(i, 300) for i in range(100, 700)], "item long, size long"), 1024, group_size=100).collect()
    per = defaultdict(int)
    for x in rows:
        per[x.container.split("/")[0]] += x.item == 7
    assert len(rows) == 900 and len(per) == 9 and max(per.values()) < 70
    whole = packing.pack(spark.createDataFrame([(7, 10), (7, 10)], "item long, size long"), 10).collect()
    assert len({x.container for x in whole}) == 2


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x " * 20_000), (5, "<|endoftext|>"), (6, "ü" * 50_000)], "doc_id long, text string")
    got = {r.item: r.size for r in packing.token_counts(docs, "doc_id", "text").collect()}
    encode = packing.encoder(packing.rank_file(packing.TOKENIZER)).encode_ordinary
    assert set(got) == {1, 4, 5, 6} and got[1] == 2 and got[5] == len(encode("<|endoftext|>")) > 1 and got[4] == len(encode("x " * 20_000))


def test_round_trip_of_the_tokenizer():
    enc = packing.encoder(packing.rank_file(packing.TOKENIZER))
    text = "Zwei Wörter\n\n  and 3 números — ok​."
    assert enc.decode(enc.encode_ordinary(text)) == text
