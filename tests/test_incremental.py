from datetime import datetime, timedelta

import pytest
from support import listed

from loamgraph.operators import incremental as inc

S = "tenant_id string, entity_type string, entity_id string, tag_id long, entity_seq long, source_shard string, created_at timestamp_ntz, updated_at timestamp_ntz, known boolean"
P = "tenant_id string, source_shard string, last_seq long, updated_at timestamp_ntz"
D = datetime(2024, 5, 1)


def h(n):
    return D + timedelta(hours=n)


def row(e, tag, seq, at, tenant="a", shard="s0"):
    return (tenant, "t", e, tag, seq, shard, at, None, None)


@pytest.fixture
def source(spark):
    return spark.createDataFrame(
        [row("e1", 1, 1, h(0)), row("e2", 1, 2, h(1)), row("e2", 1, 2, h(1)), row("e3", 1, 3, h(2)), row("e1", 2, 1, h(9)), row("e4", None, 9, h(9)), row("e5", 5, 1, h(0), "b"), row("e6", 6, 1, None, None), row("e7", 7, None, None)],
        S,
    )


def test_changed(spark, source):
    progress = spark.createDataFrame([("a", "s0", 1, h(7)), ("a", "s0", 2, h(3)), ("a", "s0", 2, h(5)), (None, "s0", 5, h(5))], P)
    got = listed(inc.changed_assignments(source, progress))
    assert got == [("a", "t", "e1", 2), ("a", "t", "e3", 1), ("b", "t", "e5", 5)]


def test_oldest_open_transaction(spark):
    """The window starts where the oldest row left by the marks began, however long ago."""
    data = spark.createDataFrame([row("e1", 1, 1, h(0)), row("e2", 1, 2, h(100)), row("e3", 1, 3, h(-500)), row("e4", 1, 4, None), row("e5", 1, None, h(101))], S)
    progress = spark.createDataFrame([("a", "s0", 2, h(100))], P)
    assert [tuple(r) for r in inc.open_transactions(data, progress).collect()] == [("a", "s0", h(-500))]
    assert listed(inc.changed_assignments(data, progress)) == [("a", "t", "e3", 1), ("a", "t", "e4", 1), ("a", "t", "e5", 1)]


@pytest.mark.parametrize("days", [0, 4, 6])
def test_what_an_open_transaction_brings_late(spark, tmp_path, days):
    """A row with an older time and a lower number comes five days late: delivered once by a window that reaches to its transaction."""
    runs = inc.IncrementalRuns(spark, f"{tmp_path}/{days}")
    first = spark.createDataFrame([row("e1", 1, 1, h(0)), row("e3", 1, 3, h(200))], S)
    runs.run(first)
    late = first.unionByName(spark.createDataFrame([row("e2", 1, 2, h(80))], S))
    since = spark.createDataFrame([("a", "s0", h(200 - 24 * days))], "tenant_id string, source_shard string, oldest_open timestamp_ntz")
    assert listed(runs.run(late, since).select("entity_id")) == ([("e2",)] if days == 6 else [])
    assert listed(runs.run(late).select("entity_id")) == ([] if days == 6 else [("e2",)])
    assert runs.run(late).count() == 0 and runs.delivered().count() == 3


def test_late_writer_changes_nothing(spark, source, tmp_path):
    where = f"file://{tmp_path}/state"
    runs = inc.IncrementalRuns(spark, where)
    runs.run(source.where("entity_id = 'e1'"))
    late = inc.IncrementalRuns(spark, where)
    late.log.numbers = lambda: []  # an attempt at the first run that was thought lost
    with pytest.raises(RuntimeError, match="another writer"):
        late.run(source)
    assert {r.entity_id for r in runs.delivered().collect()} == {"e1"}
    assert "e1" not in {r.entity_id for r in runs.run(source).collect()}


def test_empty(spark, source):
    none = spark.createDataFrame([], P)
    assert inc.changed_assignments(source.where("false"), none).count() == 0
    assert inc.changed_assignments(source, none).count() == 7  # every assignment with a tag, each once


def test_runs_deliver_each_version_once(spark, source, tmp_path):
    runs = inc.IncrementalRuns(spark, f"file://{tmp_path}/state")
    first = source.where("created_at <= timestamp_ntz'2024-05-01 01:00:00'")
    assert runs.run(first).count() == 3
    assert runs.run(first).count() == 0
    # a straggler with an old time and number, from a transaction open at the last run
    late = first.unionByName(spark.createDataFrame([row("e0", 4, 1, h(0))], S)).unionByName(source.where("entity_id = 'e3'"))
    assert listed(runs.run(late).select("entity_id")) == [("e0",), ("e3",)]
    assert runs.run(late).count() == 0
    assert runs.delivered().count() == 5


def test_rows_far_below_the_marks_are_delivered_once(spark, tmp_path):
    runs = inc.IncrementalRuns(spark, f"file://{tmp_path}/state")
    progress = spark.createDataFrame([("a", "s0", 2, h(100))], P)
    first = spark.createDataFrame([row("e1", 1, 1, h(0)), row("e3", 1, 3, h(101))], S)
    runs.begin(first, progress)
    assert listed(runs.run(first).select("entity_id")) == [("e3",)]
    late = first.unionByName(spark.createDataFrame([row("e0", 4, 1, h(1)), row("e0", 4, 1, h(1)), row("e2", 4, None, None)], S))
    assert listed(runs.run(late).select("entity_id")) == [("e0",), ("e2",)]
    assert runs.run(late).count() == 0
    assert runs.delivered().count() == 3


def test_failed_run_is_repeated(spark, source, tmp_path):
    class Broken(inc.IncrementalRuns):
        def __init__(self, *a):
            super().__init__(*a)
            publish = self.log.publish

            def failing(number, info):
                if number == 1:
                    raise RuntimeError("lost")
                publish(number, info)

            self.log.publish = failing

    where = f"file://{tmp_path}/state"
    first = source.where("entity_id in ('e1', 'e2') and tag_id = 1")
    Broken(spark, where).run(first)
    with pytest.raises(RuntimeError):
        Broken(spark, where).run(source)
    again = inc.IncrementalRuns(spark, where)
    assert again.committed() == [0]
    again.run(source)
    keys = listed(again.delivered().select("entity_id", "tag_id", "entity_seq"))
    assert len(keys) == len(set(keys)) and ("e3", 1, 3) in keys and ("e1", 2, 1) in keys
