"""Per-key results where a few keys hold most rows (problem 6).

Dense accumulator arrays: every input split counts its own rows with a local
dictionary and ``numpy.bincount``, so its cost depends on its size and not on
which keys it holds.  Distinct keys get a dense code ``(block, position)``;
the splits' partial counts, at most one row per split and key, are scattered
into the block's array and the arrays are summed.  No row of a hot key
travels; a key held by every split sends one number from each.

Neither the dictionary nor the arrays are ever gathered in one place: a block
holds about ``block_size`` codes, and there are as many blocks as needed.  The
splits' arrays of a block are summed in rounds of at most ``FAN_IN`` each, so a
task holds ``FAN_IN`` x ``block_size`` numbers, however many splits there are.

Defined results: null keys are counted under a null key of their own; an empty
table gives no rows; ties need no order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import Scratch

SPLIT_KEYS, FAN_IN = 1_000_000, 64


class _Column:
    """Dictionary and counts of one column of a split."""

    def __init__(self, field: str):
        self.field, self.index, self.counts = field, {}, np.zeros(1024, dtype=np.int64)

    def add(self, values: pa.Array) -> None:
        coded = values.dictionary_encode(null_encoding="encode")
        local = [self.index.setdefault(k, len(self.index)) for k in coded.dictionary.to_pylist()]
        if not local:
            return
        if len(self.index) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(max(len(self.index), len(self.counts)), dtype=np.int64)])
        self.counts[np.asarray(local)] += np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(local))

    def take(self, split: int) -> pa.RecordBatch:
        n = len(self.index)
        out = [pa.array([split] * n, pa.int64()), pa.array([self.field] * n, pa.string()), pa.array(list(self.index), pa.string()), pa.array(self.counts[:n])]
        self.__init__(self.field)
        return pa.RecordBatch.from_arrays(out, ["split", "field", "key", "n"])


def _count_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every column of one split: dictionary codes, then one bincount a batch."""
    task = TaskContext.get()
    split = task.partitionId() if task else 0
    columns: list[_Column] = []
    for batch in batches:
        columns = columns or [_Column(f) for f in batch.schema.names]
        for c, values in zip(columns, batch.columns, strict=True):
            c.add(values)
            if len(c.index) >= SPLIT_KEYS:  # bounds the split's dictionary; its other rows start the next one
                yield c.take(split)
    for c in columns:
        if c.index:
            yield c.take(split)


def _sum_arrays(key: tuple, table: pa.Table) -> pa.Table:
    """One group of arrays of a block: scatter-add into one dense array."""
    pos = table["pos"].to_numpy()
    dense = np.zeros(int(pos.max()) + 1 if len(pos) else 0, dtype=np.int64)
    np.add.at(dense, pos, table["n"].to_numpy())
    held = np.unique(pos)
    n = len(held)
    return pa.table({"block": pa.array([key[0].as_py()] * n, pa.int32()), "split": pa.array([key[1].as_py()] * n, pa.int64()), "pos": pa.array(held, pa.int32()), "n": pa.array(dense[held])})


def dense_counts(df: DataFrame, *fields: str, block_size: int = 65_536, fan_in: int = FAN_IN) -> DataFrame:
    """``(field string, key string, n long)``: rows per value of each field, from one pass over the rows."""
    scratch = Scratch(df.sparkSession, "counts")
    splits = scratch.keep(df.select(*[F.col(f).cast("string").alias(f) for f in fields]).mapInArrow(_count_split, "split long, field string, key string, n long"))
    dictionary = scratch.keep(splits.select("field", "key").distinct())
    blocks = max(1, -(-dictionary.count() // block_size))
    coded = dictionary.withColumn("block", F.pmod(F.xxhash64("field", "key"), F.lit(blocks)).cast("int"))
    coded = scratch.keep(coded.select(F.col("field").alias("d_field"), F.col("key").alias("d_key"), "block", (F.row_number().over(Window.partitionBy("block").orderBy("field", "key")) - 1).cast("int").alias("pos")))
    on = (F.col("field") == F.col("d_field")) & F.col("key").eqNullSafe(F.col("d_key"))
    arrays, left = splits.join(coded, on).select("block", "split", "pos", "n"), (splits.agg(F.max("split")).first()[0] or 0) + 1
    while True:
        arrays = arrays.withColumn("split", F.floor(F.col("split") / F.lit(fan_in)).cast("long")).groupBy("block", "split").applyInArrow(_sum_arrays, "block int, split long, pos int, n long")
        left = -(-left // fan_in)
        if left == 1:
            break
        arrays = scratch.keep(arrays)
    named = arrays.select(F.col("block").alias("a_block"), F.col("pos").alias("a_pos"), "n")
    return scratch.keep(coded.join(named, (F.col("block") == F.col("a_block")) & (F.col("pos") == F.col("a_pos"))).select(F.col("d_field").alias("field"), F.col("d_key").alias("key"), "n"))


def heavy_keys(df: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(field, key_value, n, total)``: values holding at least their field's share of all rows (null values count only in the total)."""
    counted = dense_counts(df, *shares)
    total = counted.where(F.col("field") == next(iter(shares))).agg(F.sum("n")).scalar()
    share = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("field"))
    return counted.select("field", F.col("key").alias("key_value"), "n", total.alias("total")).where(F.col("key_value").isNotNull() & (F.col("n") >= share * F.col("total")))


def _distinct_counts(df: DataFrame, keys: tuple[str, ...], of: tuple[str, ...], name: str) -> DataFrame:
    """``(d_field, d_key, name)``: distinct values of ``of`` per value of each key; keys within ``of`` share one pass."""
    counted = None
    for some in [[k for k in keys if k in of], *[[k] for k in keys if k not in of]]:
        if some:
            one = dense_counts(df.select(*dict.fromkeys([*some, *of])).distinct(), *some)
            counted = one if counted is None else counted.unionByName(one)
    return counted.select(F.col("field").alias("d_field"), F.col("key").alias("d_key"), F.col("n").alias(name))


def per_key_results(df: DataFrame, keys: tuple[str, ...], entity: tuple[str, ...], item: str | None = None) -> DataFrame:
    """Rows, distinct entities and, where ``item`` is named, distinct assignments per value of each key.

    An assignment is an entity with a non-null item, however many rows repeat it.
    Both are formed on the whole entity key, which no single value dominates,
    before they are counted with ``dense_counts``.
    """
    same = (F.col("field") == F.col("d_field")) & F.col("key").eqNullSafe(F.col("d_key"))
    out = dense_counts(df, *keys).withColumnRenamed("n", "n_rows").join(_distinct_counts(df, keys, entity, "n_entities"), same).drop("d_field", "d_key")
    columns = ["n_rows", "n_entities"]
    if item is not None:
        held = _distinct_counts(df.where(F.col(item).isNotNull()), keys, (*entity, item), "n_assignments")
        out = out.join(held, same, "left").withColumn("n_assignments", F.coalesce("n_assignments", F.lit(0).cast("long")))
        columns.insert(1, "n_assignments")
    return out.select("field", F.col("key").alias("key_value"), *columns)
