from loamgraph.streaming import trends


def write(spark, folder, n, rows):
    df = spark.createDataFrame(rows, "seq long, shard string, tenant string, type string, tag string, entity long, m int").selectExpr("*", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,m) as at").drop("m")
    df.coalesce(1).write.mode("append").parquet(folder)


SCHEMA = "seq long, shard string, tenant string, type string, tag string, entity long, at timestamp"


def event(seq, tag="x", kind="TAGS_ATTACHED", entity=1, m=0, shard="s"):
    return (seq, shard, "t", kind, tag, entity, m)


def test_restart_counts_once(spark, tmp_path):
    """Events delivered again in a later run, after a restart from the checkpoint, are not counted again."""
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    write(spark, src, 0, [event(1), event(2), event(2)])
    trends.bucket_counts(stream(), out)
    write(spark, src, 1, [event(2), event(3), event(4, kind="TAGS_DETACHED")])
    got = trends.bucket_counts(stream(), out).where("grain = 86400").first()
    assert got.attaches == 3


def test_marks_skip_old(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, src, 0, [event(1), event(3)])
    trends.above_marks(spark.readStream.schema(SCHEMA).parquet(src), out)
    write(spark, src, 1, [event(2), event(4), event(4), event(1, shard="u")])
    got = trends.above_marks(spark.readStream.schema(SCHEMA).parquet(src), out)
    assert sorted((r.shard, r.seq) for r in got.collect()) == [("s", 1), ("s", 3), ("s", 4), ("u", 1)]


def test_relay_waits_for_the_gap(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, src, 0, [event(1, m=0), event(3, m=1)])
    run = lambda: sorted(r.seq for r in trends.relayed(spark.readStream.schema(SCHEMA).parquet(src), out, "30 minutes").collect())
    assert run() == [1]
    write(spark, src, 1, [event(2, m=1), event(4, m=2)])
    assert run() == [1, 2, 3, 4]


def test_index_fold(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, src, 0, [event(1), event(2, entity=2)])
    trends.folded(spark.readStream.schema(SCHEMA).parquet(src), out)
    write(spark, src, 1, [event(3, kind="TAGS_DETACHED"), event(2, entity=2)])
    got = trends.folded(spark.readStream.schema(SCHEMA).parquet(src), out)
    assert [(r.tag, r.entity) for r in got.collect()] == [("x", 2)]
