"""Moves: the next candidate of many under one key, and checks of targets."""

import random

from support import listed

from loamgraph.operators import tree
from loamgraph.operators.skew import next_above
from loamgraph.plans.trees import QUERIES, SQL
from loamgraph.session import Scratch


def test_next_above(spark):
    """One hot key over several partitions, equal values, keys without candidates."""
    r = random.Random(5)
    rows = [(r.choice("aaaaaab"), r.randrange(2), r.randrange(300), r.random() < 0.2) for _ in range(3000)] + [("c", 0, 7, False), (None, 0, 3, False), (None, 0, 4, True)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = listed(next_above(spark.createDataFrame(rows, "k string, l int, v int, t boolean"), ["k", "l"], "v", "t", Scratch(spark, "next")).select("k", "l", "v", "next"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = lambda k, l, v: min((x[2] for x in rows if x[3] and x[:2] == (k, l) and x[2] > v), default=None)
    assert got == sorted(((k, l, v, least(k, l, v)) for k, l, v, t in rows if not t), key=str)


def test_moves_of_one_hot_tenant(spark, duck, tmp_path):
    """All nodes in one tenant: same rows as the SQL, and no frame that is summed anew for every row."""
    made = "SELECT 't' AS tenant_id, (i::BIGINT << 22) AS node_id, 1::BIGINT AS space_id, CASE WHEN i > 1 THEN (i // 2)::BIGINT << 22 END AS parent_id, CASE WHEN i > 1 THEN '/' || ((i // 2) << 22) ELSE '' END || '/' || (i << 22) || '/' AS path, (i % 5)::SMALLINT AS depth, 'a' AS rank, 'page' AS node_type, 'x' AS title, CASE WHEN i % 50 = 7 THEN 'TRASHED' ELSE 'ACTIVE' END AS status, NULL::TIMESTAMP AS trashed_at, 1::INTEGER AS version, 'u' AS created_by, TIMESTAMP '2025-01-01' AS created_at, TIMESTAMP '2025-01-01' AS updated_at FROM range(1::BIGINT, 3000) t(i)"
    duck.execute(f"COPY ({made}) TO '{tmp_path}/nodes.parquet' (FORMAT parquet)")
    out = QUERIES["h11_move_checks"](spark, str(tmp_path))
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    cur = duck.cursor()
    cur.execute(f"CREATE TEMP VIEW nodes AS SELECT * FROM '{tmp_path}/nodes.parquet'")
    want = cur.execute(SQL["h11_move_checks"]).fetchall()
    assert listed(out.select("tenant_id", "node_id", "to_id", "verdict", "size")) == sorted(want, key=str)


def test_checks_of_targets_and_missing_nodes(spark):
    nodes = spark.createDataFrame([("t", 1, 1, None, "/1/", 0, "ACTIVE"), ("t", 2, 1, 1, "/1/2/", 1, "ACTIVE"), ("t", 3, 1, 1, "/1/9/3/", 2, "ACTIVE"), (None, 4, 1, None, "/4/", 0, "ACTIVE")], "tenant_id string, node_id long, space_id long, parent_id long, path string, depth int, status string")
    asked = spark.createDataFrame([("t", 2, 3), ("t", 2, 1), ("t", 9, 1), ("t", 8, 1), ("t", 2, 9), (None, 4, 4)], "tenant_id string, node_id long, to_id long")
    got = listed(tree.check_moves(asked, nodes))
    assert got == sorted([("t", 2, 3, "DONE", 1), ("t", 2, 1, "SAME_PARENT", 1), ("t", 9, 1, "NO_NODE", 1), ("t", 8, 1, "NO_NODE", None), ("t", 2, 9, "NO_TARGET", 1), (None, 4, 4, "ROOT", 1)], key=str)
