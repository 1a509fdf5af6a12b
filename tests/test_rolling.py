import random

from support import listed

from loamgraph.operators.rolling import rolling_totals

S = "tenant_id string, tag_id long, grain int, bucket long, attaches long, amount long, age int"


def brute(rows, periods):
    day = {}
    for t, g, _, b, a, *_ in rows:
        if None not in (t, g, b):
            day[t, g, b] = max(day.get((t, g, b), 0), a or 0)
    last = max((k[2] for k in day), default=0)
    out = []
    for t, g in sorted({k[:2] for k in day}):
        first = min(k[2] for k in day if k[:2] == (t, g))
        for b in range(first, last + 1):
            out.append((t, g, b, *[sum(day.get((t, g, x), 0) for x in range(b - n + 1, b + 1)) for n in periods]))
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.choice([1, 2, None]), 86400, r.choice([*range(100, 140), None]), r.choice([None, 0, 3, 9]), 7, 1) for _ in range(120)]
    rows += rows[:20] + [("c", 9, 86400, 120, 5, 1, 1)]
    got = rolling_totals(spark.createDataFrame(rows, S), ["tenant_id", "tag_id"], "bucket", "attaches", (3, 7))
    assert listed(got.select("tenant_id", "tag_id", "bucket", "total_3", "total_7")) == sorted(brute(rows, (3, 7)), key=str)
    one = got.where("tenant_id = 'c' and bucket = 122").first()
    assert (one.total_3, one.age, round(one.avg_7, 6)) == (5, 2, round(5 / 7, 6))


def test_empty(spark):
    assert rolling_totals(spark.createDataFrame([], S), ["tenant_id", "tag_id"], "bucket", "attaches").count() == 0


def test_filtered_to_nothing(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 1, 3600, 5, 1, 1, 1)], S)
    assert rolling_totals(rows, ["tenant_id", "tag_id"], "bucket", "attaches", where=F.col("grain") == 86400).count() == 0
