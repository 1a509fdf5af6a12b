"""Items that appear together (problem 2).

Basket collapsing: the items of each record become one sorted set, equal sets
collapse to a weight, pairs are enumerated once per distinct set and weights
are summed, map-side first, so two items that stand together in a third of all
records send one number from each split.  Counts are then scored.

The collapsed baskets are written once; totals, single counts and pairs all
read them.  A basket of more than ``WIDE`` items is cut into blocks of that many;
each two of its blocks are one row, spread over the tasks, so that no task has
to make all pairs of one large record.

Defined results: null items are left out, a record left empty counts nowhere;
repeated rows count once; a null group or record key is a value of its own;
pairs have the smaller item first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.skew import is_small, sized_join
from loamgraph.session import Scratch

WIDE = 256


def baskets(df: DataFrame, group: str, record: list[str], item: str) -> DataFrame:
    """``(grp, items, weight)``: distinct item sets per group with the number of records that hold them."""
    sets = df.where(F.col(item).isNotNull()).groupBy(F.col(group).alias("grp"), *record).agg(F.sort_array(F.collect_set(item)).alias("items"))
    return sets.groupBy("grp", "items").agg(F.count("*").alias("weight"))


def weighted_pairs(held: DataFrame, wide: int = WIDE) -> DataFrame:
    """``(grp, item_a, item_b, weight)``: every pair of every basket, the smaller item first."""
    firsts = held.where((F.size("items") > 1) & (F.size("items") <= wide)).select("grp", "items", "weight", F.posexplode("items").alias("i", "item_a")).where("i < size(items) - 1")
    narrow = firsts.select("grp", "item_a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("item_b"), "weight")
    blocks = F.ceil(F.size("items") / F.lit(wide)).cast("int") - 1
    left = held.where(F.size("items") > wide).withColumn("i", F.explode(F.sequence(F.lit(0), blocks)))
    cut = lambda at: F.expr(f"slice(items, {at} * {wide} + 1, {wide})")
    both = left.withColumn("j", F.explode(F.sequence("i", blocks))).select("grp", "weight", "i", "j", cut("i").alias("a"), cut("j").alias("b"))
    spread = both.repartition("grp", F.element_at("a", 1), F.element_at("b", 1), "i", "j")
    large = spread.select("grp", "weight", "b", F.explode("a").alias("item_a")).select("grp", "item_a", F.explode("b").alias("item_b"), "weight").where("item_a < item_b")
    return narrow.unionByName(large)


def pair_counts(df: DataFrame, group: str, record: list[str], item: str, min_count: int = 1, min_ratio: float | None = None) -> DataFrame:
    """``(grp, item_a, item_b, n, n_a, n_b, n_ab)`` of pairs in at least ``min_count`` records, ``min_ratio`` times as often as by chance."""
    scratch = Scratch(df.sparkSession, "pairs")
    held = scratch.keep(baskets(df, group, [c for c in record if c != group], item))
    total = held.groupBy("grp").agg(F.sum("weight").alias("n"))
    single = scratch.keep(held.select("grp", F.explode("items").alias("item"), "weight").groupBy("grp", "item").agg(F.sum("weight").alias("n_i")))
    summed = scratch.keep(weighted_pairs(held).groupBy("grp", "item_a", "item_b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_count))
    small = is_small(single)
    out = sized_join(summed, single.select("grp", F.col("item").alias("item_a"), F.col("n_i").alias("n_a")), ["grp", "item_a"], scratch, small=small)
    out = sized_join(out if small else scratch.keep(out), single.select("grp", F.col("item").alias("item_b"), F.col("n_i").alias("n_b")), ["grp", "item_b"], scratch, small=small)
    out = sized_join(out if small else scratch.keep(out), total, ["grp"], scratch)
    if min_ratio is not None:
        out = out.where(F.col("n_ab") * F.col("n") >= F.col("n_a") * F.col("n_b") * min_ratio)
    return out.select("grp", "item_a", "item_b", "n", "n_a", "n_b", "n_ab")


def scored(pairs: DataFrame) -> DataFrame:
    """Adds lift and conviction of a -> b; conviction is null where b always follows."""
    n = F.col("n").cast("double")
    lift = F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))
    misses = 1 - F.col("n_ab") / F.col("n_a").cast("double")
    return pairs.withColumn("lift", F.round(lift, 6)).withColumn("conviction", F.when(F.col("n_ab") < F.col("n_a"), F.round((1 - F.col("n_b") / n) / misses, 6)))
