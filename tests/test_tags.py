import itertools
import random

import pytest
from support import listed

from loamgraph.operators import tagsearch as ts
from loamgraph.operators import trending as tr

S = "tenant_id string, entity_type string, entity_id string, entity_seq long, tag_id long, source_shard string"


@pytest.fixture(scope="module")
def assigned(spark):
    r = random.Random(1)
    rows = {("a", r.choice(["issue", "page"]), f"e{i}", i, t, "s") for i in range(1, 60) for t in range(1, 7) if r.random() < 0.4}
    kinds = {}
    rows = [(a, kinds.setdefault(e, k), e, n, t, s) for a, k, e, n, t, s in sorted(rows)]
    return spark.createDataFrame(sorted(set(rows)), S), rows


@pytest.mark.parametrize(("every", "some", "none"), list(itertools.product([(), (1,), (1, 2)], [(), (3, 4)], [(), (5,), (5, 6)])))
def test_search_forms_agree(assigned, every, some, none):
    df, rows = assigned
    if not every and not some:
        with pytest.raises(ValueError):
            ts.TagQuery(all=every, any=some, none=none)
        return
    q = ts.TagQuery(all=every, any=some, none=none)
    held = {}
    for a, k, e, _, t, _ in rows:
        held.setdefault((a, k, e), set()).add(t)
    want = sorted((e for e, t in held.items() if set(every) <= t and (not some or t & set(some)) and not t & set(none)), key=str)
    for form in (ts.search, ts.search_semi, ts.search_sets):
        assert [r[:3] for r in listed(form(df, q))] == want
    total = ts.search_bitmaps(ts.postings(df), q).first()
    assert (total.total if total else 0) == len(want)


def test_terms():
    q = ts.TagQuery(all={1}, any={2, 3}, none={4, 5})
    assert ts.resolve_terms(q, {1, 3, 5}) == ts.TagQuery(all={1}, any={3}, none={5})
    assert ts.resolve_terms(q, {2, 3}) is None and ts.resolve_terms(q, {1}) is None
    with pytest.raises(ValueError):
        ts.TagQuery(all=set(range(40)))
    assert (ts.page_size(None), ts.page_size(0), ts.page_size(9999)) == (50, 1, 200)


def test_names(spark):
    assert ts.normalize_name("  Ｆｕｌｌ  Width ") == "full width"
    assert ts.normalize_name("x" * 65) is None and ts.normalize_name("a\x07") is None and ts.normalize_name(None) is None and ts.normalize_name(" ") is None


def test_cursor(spark):
    df = spark.createDataFrame([(5,), (123456789,)], "seq long").withColumn("c", ts.seq_cursor("seq"))
    assert [r.back for r in df.withColumn("back", ts.read_seq_cursor("c")).orderBy("seq").collect()] == [5, 123456789]
    bad = spark.createDataFrame([("!!!",), ("bjE6NQ",), ("",)], "c string")
    assert [r.b for r in bad.select(ts.read_seq_cursor("c").alias("b")).collect()] == [None, None, None]


def test_edits(spark):
    tags = spark.createDataFrame([("a", 1, 3, "x", False), ("a", 2, 1, "y", False), ("a", 3, 1, "z", True)], "tenant_id string, tag_id long, version long, name_norm string, deleted boolean")
    edits = spark.createDataFrame([("a", 1, 3, "y", False), ("a", 2, 1, None, True), ("a", 3, 1, "q", False), ("a", 9, 1, "q", False)], "tenant_id string, tag_id long, expected_version long, name_norm string, delete boolean")
    got = {r.tag_id: (r.outcome, r.name_norm) for r in ts.apply_tag_edits(tags, edits).collect()}
    assert got == {1: ("NAME_TAKEN", None), 2: ("APPLIED", "y~2"), 3: ("NOT_FOUND", None), 9: ("NOT_FOUND", None)}


def test_trend_ranks(spark):
    w = spark.createDataFrame([("t", "1", 5, 3), ("t", "2", 3, 0), ("t", "3", 1, 2), ("t", "4", 0, 7), ("t", "5", 3, 3)], "tenant string, tag string, cnt long, prev long")
    assert [r.tag for r in tr.top(w, "POPULAR", 9).orderBy("place").collect()] == ["1", "2", "5", "3"]
    assert [r.tag for r in tr.top(w, "RISING", 9).orderBy("place").collect()] == ["2", "1"]
    live = spark.createDataFrame([("t", "2"), ("t", "3")], "tenant string, tag string")
    assert [r.tag for r in tr.top(w, "POPULAR", 1, live).collect()] == ["2"]


def test_relay_gaps(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(s, s) for s in (1, 2, 4, 5, 8, 9)], "seq long, m int").selectExpr("seq", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,m) as at")
    end = F.expr("timestamp_ntz'2024-01-01 00:10:00'")
    done = lambda gap: [r.seq for r in tr.relay_positions(rows, end, gap).where("relayed").orderBy("seq").collect()]
    assert done("1 minute") == [1, 2, 4, 5, 8, 9]
    assert done("5 minutes") == [1, 2, 4, 5]
    assert done("9 minutes") == [1, 2]


def test_hot_keys_join(spark):
    from loamgraph.operators.skew import first_in_order, hot_join, salted_join, sized_join
    from loamgraph.session import Scratch

    big = spark.range(1000).selectExpr("if(id % 3 = 0, null, id % 2) as k", "id", "1 as v")
    small = spark.createDataFrame([(None, "n"), (0, "zero")], "k long, what string")
    got = salted_join(big, small, ["k"], "id", 4)
    assert got.count() == big.where("k is null or k = 0").count() and got.columns == ["k", "id", "v", "what"]
    assert salted_join(big, small, ["k"], "id", 4, "left").count() == 1000
    scratch = Scratch(spark, "hot")
    for limit in (0, 100):  # shuffled with hot keys apart, and broadcast
        assert sorted(map(str, sized_join(big, small, ["k"], scratch, limit=limit).collect())) == sorted(map(str, got.collect()))
        left = sized_join(big, small, ["k"], scratch, "left", limit=limit)
        assert left.count() == 1000 and left.where("what is null").count() == big.where("k = 1").count()
    even = spark.range(50_000).selectExpr("id % 5000 as k", "id")  # no hot key
    assert hot_join(even, small, ["k"], scratch, share=1000).count() == 10
    assert hot_join(even.where("false"), small, ["k"], scratch).count() == 0
    big = spark.range(250_000).selectExpr("hash(id) as h", "id")
    cut = first_in_order(big, ["h", "id"], 120_000, Scratch(spark, "t"))
    assert cut.count() == 120_000 and cut.agg({"h": "max"}).first()[0] <= big.join(cut, "id", "left_anti").agg({"h": "min"}).first()[0]


def test_joins_and_places_of_hot_keys(spark):
    """Hot keys apart or not, null keys, ties broken by a second column: the same rows and places."""
    from pyspark.sql import functions as F

    from loamgraph.operators.skew import counted_join, is_small, with_places
    from loamgraph.session import Scratch

    scratch = Scratch(spark, "places")
    big = scratch.keep(spark.range(0, 3000, 1, 7).selectExpr("if(id % 5 = 0, null, if(id % 3 > 0, 0, id % 11)) as k", "hash(id) % 50 as o", "id", "1 as n"))
    counts = scratch.keep(big.groupBy("k").agg(F.count("*").alias("c"), F.max("id").alias("top")))
    most = counts.agg(F.max("c")).first()[0]
    plain = sorted(map(str, counted_join(big, counts, ["k"], "c", most, 10**9).collect()))
    assert len(plain) == 3000 and plain == sorted(map(str, counted_join(big, counts, ["k"], "c", most, 100).collect()))
    want = {}
    for r in sorted(big.collect(), key=lambda r: (r.o, r.id)):
        want[r.id] = sum(1 for x in want.values() if x[0] == r.k), r.k
        want[r.id] = (r.k, want[r.id][0])
    got = with_places(big, ["k"], ["o", "id"], scratch)
    assert got.columns == [*big.columns, "place"] and {r.id: (r.k, r.place) for r in got.collect()} == want
    assert with_places(big.where("false"), ["k"], ["o", "id"], scratch).count() == 0
    wide = scratch.keep(spark.range(10).selectExpr("id", "repeat('x', 1000) as s", "array(id, id) as a"))
    assert is_small(wide, 20_000) and not is_small(wide, 9_000) and is_small(wide.where("false"), 0)


def test_scratch_is_dropped_and_never_local_on_a_cluster(spark):
    import os

    from loamgraph.session import Scratch, scratch_root, scratch_scope

    with scratch_scope():
        held = Scratch(spark, "scope")
        held.keep(spark.range(3))
        log = held.log(spark.range(1))
        assert log.append(spark.range(2)) and not log.append(spark.range(0)) and log.rounds == 2 and log.all.count() == 3
        where = held.base.removeprefix("file://")
        assert os.path.isdir(where)
    assert not os.path.isdir(where)

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Elsewhere.conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Elsewhere)


def test_read_barrier_and_outbox(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from loamgraph.operators import tagsearch as ts
    from loamgraph.operators import trending as tr

    log = spark.createDataFrame([("a", "x", "ON", 1), ("a", "x", "OFF", 5), ("a", "y", "ON", 6), ("b", "x", "ON", 1), ("c", "x", "ON", 2)], "tenant string, tag string, type string, seq long")
    marks = spark.createDataFrame([("a", 4, 3), ("b", -1, None), ("c", 1, 2)], "tenant string, applied long, barrier long")
    assert sorted(tuple(r) for r in ts.read_at(log, marks).collect()) == [("a", "x", "ON", 1, "index"), ("b", "x", "ON", 1, "store"), ("c", "x", "ON", 2, "store")]
    assert sorted(tuple(r) for r in ts.read_at(log, marks, "EVENTUAL").collect()) == [("a", "x", "ON", 1, "index"), ("b", "x", "ON", 1, "store")]
    t = [datetime(2024, 1, d) for d in (1, 2, 9)]
    box = spark.createDataFrame([("a", 1, t[0], True), ("a", 2, t[1], False), ("a", 3, t[2], True), ("b", 4, None, None)], "tenant string, seq long, at timestamp_ntz, relayed boolean")
    assert {r.tenant: (r.latest_seq, r.relayed_seq, r.oldest_unrelayed) for r in tr.outbox_lag(box, ["tenant"]).collect()} == {"a": (3, 3, t[1]), "b": (4, None, None)}
    assert sorted(r.seq for r in tr.prune_relayed(box, F.lit(t[2]).cast("timestamp_ntz"), "3 days").collect()) == [2, 3, 4]
