from datetime import datetime

import pytest
from support import listed

from loamgraph.operators import orphans

T1, T2, T3 = datetime(2024, 5, 1), datetime(2024, 6, 1), datetime(2024, 7, 1)
TAGS = "tenant_id string, tag_id long, version long, deleted boolean, updated_at timestamp_ntz, created_at timestamp_ntz, salt int"
ET = "tenant_id string, entity_type string, entity_id string, tag_id long, created_at timestamp_ntz, key string, kind string"
NODES = "tenant_id string, node_id long, parent_id long, version int, updated_at timestamp_ntz, created_at timestamp_ntz"
CONTENT = "tenant_id string, node_id long, body string"


@pytest.fixture
def tables(spark):
    tags = spark.createDataFrame([("a", 1, 1, False, T1, T1, 0), ("a", 1, 2, True, T2, T1, 0), ("a", 2, 1, False, T1, T2, 0), ("a", 2, 1, False, T1, T2, 0), (None, 3, 1, None, T1, T1, 0)], TAGS)
    et = spark.createDataFrame(
        [("a", "t", "e1", 1, T3, "x", "y"), ("a", "t", "e1", 1, T3, "x", "y"), ("a", "t", "e2", 2, T1, "x", "y"), ("a", "t", "e2", 2, T3, "x", "y"), ("b", "t", "e3", 2, T3, None, None), ("a", "t", "e4", None, T3, "x", "y"), (None, "t", "e5", 3, T3, "x", "y"), (None, "t", "e6", 4, None, "x", "y")],
        ET,
    )
    nodes = spark.createDataFrame([("a", 10, None, 1, T1, T1), ("a", 11, 10, 1, T1, T2), ("a", 12, 99, 1, T1, T2), ("a", 12, 11, 0, T1, T2), ("a", 13, 11, 1, T1, T1)], NODES)
    content = spark.createDataFrame([("a", 10, "x"), ("a", 77, "x"), ("a", 77, "y"), ("b", 10, "z"), ("a", None, "z")], CONTENT)
    return et, tags, nodes, content


def test_faults(tables):
    found = orphans.find_orphans(*tables).select("ref_table", "tenant_id", "row_key", "ref_id", "reason")
    assert listed(found) == sorted(
        [
            ("entity_tags", "a", "t/e1", 1, "deleted"), ("entity_tags", "a", "t/e2", 2, "late"), ("entity_tags", "b", "t/e3", 2, "missing"), ("entity_tags", None, "t/e6", 4, "missing"),
            ("nodes", "a", "12", 99, "missing"), ("nodes", "a", "13", 11, "late"), ("node_content", "a", "77", 77, "missing"), ("node_content", "b", "10", 10, "missing"),
        ],
        key=str,
    )


def test_empty(tables):
    none = [t.where("false") for t in tables]
    assert orphans.find_orphans(*none).count() == 0
    assert orphans.orphan_report(orphans.find_orphans(*none)).count() == 0


def versions(tags, nodes):
    return orphans.tag_versions(tags).unionByName(orphans.node_versions(nodes))


def test_batches_equal_one(tables, spark, tmp_path):
    """State kept by deltas, times included, is the state made at once; references taken back leave it."""
    et, tags, nodes, content = tables
    refs = orphans.assignment_refs(et).unionByName(orphans.content_refs(content))
    whole = orphans.OrphanState(spark, f"{tmp_path}/whole").apply(versions(tags, nodes), refs)
    late = refs.where("row_key in ('t/e3', 't/e6')")
    early = refs.where("row_key not in ('t/e3', 't/e6')")
    # the older version of node 12 and of tag 1 arrive after the newer ones
    newer, older = versions(tags.where("version = 2 or tag_id <> 1"), nodes.where("version = 1")), versions(tags.where("version = 1 and tag_id = 1"), nodes.where("version = 0"))
    stepped = orphans.OrphanState(spark, f"{tmp_path}/steps").apply(newer, early)
    before = listed(stepped.counts())
    stepped.apply(older, late)
    assert listed(stepped.counts()) == listed(whole.counts()) and listed(stepped.current()) == listed(whole.current())
    stepped.apply(older.where("false"), refs.where("false"), late)
    assert listed(stepped.counts()) == before
    assert {r.key for r in orphans.orphan_keys(stepped.counts()).collect()} == {1, 2, 99, 77, 10, 11}


def test_target_deleted_and_created_anew(spark, tmp_path):
    """After -1 and +1 the new creation time counts: kept state and full recount agree that the reference is not, or is, late."""
    nodes = lambda *rows: orphans.node_versions(spark.createDataFrame([("a", 11, None, v, t, t) for v, t in rows], NODES))
    ref = orphans.assignment_refs(spark.createDataFrame([], ET)).unionByName(spark.createDataFrame([("nodes", "node", "a", "13", 11, T2)], "ref_table string, kind string, tenant_id string, row_key string, key long, ref_at timestamp_ntz"))
    for first, second, reasons in ((T1, T3, {"late"}), (T3, T1, set())):
        state = orphans.OrphanState(spark, f"{tmp_path}/{first:%m}").apply(nodes((1, first)), ref)
        state.apply(nodes((2, second)), ref.where("false"))
        at_once = orphans.OrphanState(spark, f"{tmp_path}/{first:%m}-whole").apply(nodes((1, first), (2, second)), ref)
        assert listed(state.counts()) == listed(at_once.counts())
        assert {r.reason for r in orphans.faults(ref, state.counts()).collect()} == reasons


def test_lost_batch_and_late_writer(tables, spark, tmp_path):
    """A batch that failed before its commit is applied again; a second writer of a committed batch changes nothing."""
    et, tags, nodes, content = tables
    refs = orphans.assignment_refs(et)
    state = orphans.OrphanState(spark, str(tmp_path / "s")).apply(versions(tags, nodes), refs.where("row_key = 't/e1'"))
    lost = orphans.OrphanState(spark, str(tmp_path / "s"))
    lost.log.publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        lost.apply(versions(tags, nodes), refs)
    before = listed(state.counts())
    late = orphans.OrphanState(spark, str(tmp_path / "s"))
    late.log.numbers = lambda: []  # believes that nothing is committed yet
    with pytest.raises(RuntimeError, match="another writer"):
        late.apply(versions(tags, nodes), refs)
    assert listed(state.counts()) == before
    assert listed(state.apply(versions(tags, nodes), refs).counts()) != before


def test_id_time(spark):
    row = spark.range(1).selectExpr("21916686701563904 as node_id").select(orphans.id_time("node_id").alias("t")).first()
    assert row.t == datetime(2024, 3, 1, 11, 29, 5, 302000) or row.t.date() == datetime(2024, 3, 1).date()
