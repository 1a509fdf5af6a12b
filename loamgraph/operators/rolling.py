"""Rolling totals over trailing periods, days without activity included (problem 4).

Daily values are aggregated first, so whatever the skew of the raw rows, an
entity holds at most one row a day afterwards.  The calendar is generated per
entity with ``explode(sequence(...))``: the entity-calendar product without
a join.  A sum over a fixed number of preceding rows is the difference of two
running sums, that of the row and that of the row as many places before.

Defined results: null amounts count as 0; repeated (key, day) rows take the
largest amount; rows with a null day or null key column are ignored; days run
from an entity's first day to the last day of the whole table, and a trailing
period that starts before the first day sums what there is; averages divide
by the full length of the period.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(df: DataFrame, keys: list[str], day: str, amount: str) -> DataFrame:
    known = F.lit(True)
    for c in [*keys, day]:
        known = known & F.col(c).isNotNull()
    return df.where(known).groupBy(*keys, day).agg(F.max(F.coalesce(F.col(amount), F.lit(0))).cast("long").alias("amount"))


def densify(per_day: DataFrame, keys: list[str], day: str, last_day: Column) -> DataFrame:
    """A row for every key and day from the key's first day to ``last_day``, a scalar.

    Each stored day brings the empty days up to the next one with it, so a row
    is made from one row and costs the same whatever the history of its key.
    """
    order = Window.partitionBy(*keys).orderBy(day)
    following = F.coalesce(F.lead(day).over(order) - 1, last_day)
    spans = per_day.select(*keys, "amount", F.col(day).alias("_from"), following.alias("_to"), F.min(day).over(Window.partitionBy(*keys)).alias("_first"))
    dense = spans.select(*keys, "_first", "_from", "amount", F.explode(F.sequence("_from", "_to")).alias(day))
    return dense.select(*keys, day, "_first", F.when(F.col(day) == F.col("_from"), F.col("amount")).otherwise(F.lit(0)).cast("long").alias("amount"))


def rolling_totals(df: DataFrame, keys: list[str], day: str, amount: str, periods: tuple[int, ...] = (7, 30), where: Column | None = None) -> DataFrame:
    """``total_N`` and ``avg_N`` for each key, day and N; ``age`` counts days since the key's first."""
    rows = df if where is None else df.where(where)
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    last_day = rows.where(known).agg(F.max(day)).scalar()
    dense = densify(daily(rows, keys, day, amount), keys, day, last_day)
    order = Window.partitionBy(*keys).orderBy(day)
    run = dense.withColumn("_run", F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the sum over the last n rows, for one addition a row however long the period
    out = [(F.col("_run") - F.coalesce(F.lag("_run", n).over(order), F.lit(0))).alias(f"total_{n}") for n in periods]
    summed = run.select(*keys, day, "amount", (F.col(day) - F.col("_first")).alias("age"), *out)
    return summed.select("*", *[(F.col(f"total_{n}") / F.lit(float(n))).alias(f"avg_{n}") for n in periods])
