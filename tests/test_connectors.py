"""Connectors: a database (the one that comes with Spark), folders of files, options of those that need a jar."""

from support import listed

from loamgraph.sources import streams


def test_database_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    df = spark.range(100).selectExpr("id", "if(id % 7 = 0, null, concat('n', id)) as name", "id / 4.0 as amount")
    streams.write_jdbc(df.selectExpr("id", "name", "cast(amount as double) as amount"), url, "parts", driver=driver)
    whole = streams.jdbc(spark, url, "parts", driver=driver).toDF("id", "name", "amount")
    assert listed(whole) == listed(df.selectExpr("id", "name", "cast(amount as double)"))
    cut = streams.jdbc(spark, url, "parts", key="id", low=0, high=100, parts=4, driver=driver).toDF("id", "name", "amount")
    assert cut.rdd.getNumPartitions() == 4 and listed(cut) == listed(whole)
    streams.write_jdbc(df.limit(0).selectExpr("id", "name", "cast(amount as double) as amount"), url, "parts", driver=driver)
    assert streams.jdbc(spark, url, "parts", driver=driver).count() == 100


def test_blobs(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.bin").write_bytes(b"\x00\x01")
    (tmp_path / "a" / "b" / "empty").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.content)) for r in streams.blobs(spark, str(tmp_path / "a")).collect()}
    assert got == {"x.bin": (2, b"\x00\x01")}  # a file without bytes gives no row


def test_tables_by_tenant(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "if(id % 2 = 0, 'hot', concat('t', id % 5)) as tenant_id")
    streams.write_by_tenant(df, str(tmp_path / "out"), files_per_key=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert listed(back.select("id", "tenant_id")) == listed(df)
    assert {x.name for x in (tmp_path / "out").glob("tenant_id=*")} == {f"tenant_id={t}" for t in ("hot", "t0", "t1", "t2", "t3", "t4")}


def test_json_events(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"event_id": 1, "event_type": "click"}\n{"event_id": 2}\n')
    assert listed(streams.json_events(spark, str(tmp_path), "event_id long, event_type string")) == [(1, "click"), (2, None)]


def test_queue_options():
    """The queue's jar is not at hand: the options that reach the reader and the writer."""

    class Recorder:
        def __init__(self):
            self.seen = {}

        def format(self, x):
            self.seen["format"] = x
            return self

        def options(self, **x):
            self.seen |= x
            return self

        def load(self):
            return self

        def selectExpr(self, *x):
            return self

        def start(self):
            return self

        readStream = writeStream = property(lambda self: self)

    r = Recorder()
    streams.kafka_stream(r, "h:9", "t", startingOffsets="latest")
    assert r.seen == {"format": "kafka", "kafka.bootstrap.servers": "h:9", "subscribe": "t", "startingOffsets": "latest"}
    w = Recorder()
    streams.write_kafka(w, "h:9", "t", "/c")
    assert w.seen == {"format": "kafka", "kafka.bootstrap.servers": "h:9", "topic": "t", "checkpointLocation": "/c"}
