"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import Scratch

TOP_K = 100_000
BROADCAST_BYTES = 32 << 20


def salted_join(big: DataFrame, unique: DataFrame, keys: list[str], salt_by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Null-safe join of ``big`` with a side that has one row per key.

    The unique side is repeated once per salt and the rows of ``big`` choose a
    salt by ``salt_by``, so one key's rows are joined by ``salts`` tasks.  If
    the unique side turns out small, adaptive execution broadcasts it anyway.
    """
    right = unique.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in unique.columns if c not in keys], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_r_salt"))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    on = F.col("_salt") == F.col("_r_salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def meet(big: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe join that keeps the columns of ``big`` and adds those of ``right`` that are no keys."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return big.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def hot_join(big: DataFrame, unique: DataFrame, keys: list[str], scratch: Scratch, how: str = "inner", share: int = 1000, counted: DataFrame | None = None) -> DataFrame:
    """Join of ``big`` with a side that has one row per key, hot keys apart.

    Keys with more than 1/``share`` of the rows, of which there are fewer than
    ``share``, meet their rows by a broadcast; all others are shuffled once and no
    task gets more than its part and one such key.  ``big`` is counted by key
    first, so it should be stored or cheap to read; where it isn't, ``counted`` is
    a table with the same keys that is.
    """
    counted = big if counted is None else counted
    total = counted.count()
    heavy = scratch.keep(counted.groupBy(*keys).count().where(F.col("count") * share > total).select(*keys))
    if heavy.isEmpty():
        return meet(big, unique, keys, how)
    few = F.broadcast(heavy)
    hot_side = meet(unique, few, keys, "left_semi")
    hot = meet(meet(big, few, keys, "left_semi"), F.broadcast(hot_side), keys, how)
    return hot.unionByName(meet(meet(big, few, keys, "left_anti"), unique, keys, how))


def is_small(stored: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a stored table take at most ``limit`` bytes in memory, measured over all of them."""
    wide = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in stored.dtypes if kind in ("string", "binary")]
    wide += [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0)) for c, kind in stored.dtypes if kind.startswith(("array", "map", "struct"))]
    row = F.lit(16 + 8 * len(stored.columns)).cast("long")
    for w in wide:
        row = row + w
    return (stored.agg(F.sum(row)).first()[0] or 0) <= limit


def sized_join(big: DataFrame, unique: DataFrame, keys: list[str], scratch: Scratch, how: str = "inner", limit: int = BROADCAST_BYTES, small: bool | None = None, counted: DataFrame | None = None) -> DataFrame:
    """The same, but without moving ``big`` where the unique side is small.

    The unique side is written and measured; up to ``limit`` bytes it is
    broadcast, beyond that ``hot_join`` takes over.  A caller that has stored and
    measured it says so by ``small``.
    """
    kept = scratch.keep(unique) if small is None else unique
    if small is None:
        small = is_small(kept, limit)
    if small:
        return meet(big, F.broadcast(kept), keys, how)
    return hot_join(big, kept, keys, scratch, how, counted=counted)


def first_in_order(df: DataFrame, order: list[str], n: int, scratch: Scratch) -> DataFrame:
    """The first ``n`` rows by ``order``, which has to be unique.

    Small n use Spark's bounded heap.  A large n would put all its rows into
    one heap or partition, so rows are range-partitioned, written with their
    place in the partition and cut by the partitions' running counts.
    """
    if n <= TOP_K:
        return df.orderBy(*order).limit(max(0, n))
    placed = scratch.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(before, "_part")
    inside = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) < n
    return joined.where(inside).select(*df.columns)


def counted_join(big: DataFrame, unique: DataFrame, keys: list[str], count: str, most: int, bucket: int = 100_000, how: str = "inner") -> DataFrame:
    """Join with a stored side that knows how many rows of ``big`` each key has (``count``, at most ``most``).

    Keys with more than ``bucket`` rows, at most one in ``bucket`` rows, are
    broadcast and their rows stay where they are; the others are shuffled.
    """
    if most <= bucket:
        return meet(big, unique, keys, how)
    hot = F.broadcast(unique.where(F.col(count) > bucket))
    rest = meet(big, hot.select(*keys), keys, "left_anti")
    return meet(meet(big, hot.select(*keys), keys, "left_semi"), hot, keys, how).unionByName(meet(rest, unique, keys, how))


def with_places(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its key, in an order that is unique within it.

    Rows are range-partitioned by key and order, so the rows of one hot key
    spread over many partitions; a place is the one inside the partition plus
    the counts of the key in the partitions before.
    """
    placed = scratch.keep(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    per = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(*keys, "_part", (before - F.col("_first")).alias("_off"))
    return meet(placed, offsets, [*keys, "_part"], "inner").withColumn(name, F.col("_at") + F.col("_off")).drop("_at", "_part", "_off")


def next_above(rows: DataFrame, keys: list[str], value: str, flag: str, scratch: Scratch, name: str = "next") -> DataFrame:
    """The rows not flagged, each with the least ``value`` above its own among the flagged rows of its key; null where there is none.

    ``value`` must not be null.  Rows are range-partitioned by key and value; a
    row that finds nothing in its partition takes the first of the key in the
    partitions behind, so neither sorting nor looking up puts one hot key into a
    task.  Looking from the highest value down, frames only grow.
    """
    placed = scratch.keep(rows.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    hit = F.when(F.col(flag), F.col(value))
    down = Window.partitionBy("_part", *keys).orderBy(F.desc(value), flag).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    later = placed.groupBy(*keys, "_part").agg(F.min(hit).alias("_min")).select(*keys, "_part", F.min("_min").over(behind).alias("_later"))
    found = placed.withColumn("_here", F.min(hit).over(down)).where(~F.col(flag))
    return meet(found, later, [*keys, "_part"], "inner").withColumn(name, F.coalesce("_here", "_later")).drop(flag, "_part", "_here", "_later")
