"""Filling fixed-capacity containers with items (problem 7).

Sizes are counted in tokens of a public tokenizer.  An item above the capacity
is cut into full pieces, each a container of its own, and one rest; nothing
else is cut.  The other pieces go to randomised groups of about
``group_size`` pieces and each group is packed by first-fit decreasing over a
tournament tree of remaining capacities, O(log bins) a piece.  Groups are
independent, so the work spreads evenly whatever the sizes or ids look like,
and at most the last, least filled containers of each group are lost to it.

The tokenizer's file is read by the driver and sent along, so the executors
need none.

Defined results: null texts and texts without tokens need no room and appear
in no container; equal sizes are placed by id and piece; rows that repeat an id
are items of their own and spread over the groups by their place in the stored
table, so a packing is reproducible for one layout of the input; an empty table
gives an empty packing; the capacity must be positive.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import Scratch, spread

CAPACITY, GROUP_SIZE, SEED = 1024, 20_000, 7
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Split pattern of the byte-level vocabulary (fixed value of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    """The tokenizer of a rank file's bytes; built once a Python worker."""
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("loam", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_counts(documents: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(item long, size long)`` for every text that has tokens."""
    kept = documents.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    shared = documents.sparkSession.sparkContext.broadcast(rank_file(tokenizer))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(shared.value).encode_ordinary
        for frame in frames:
            yield pd.DataFrame({"item": frame["item"], "size": [len(encode(t)) for t in frame["text"]]})

    return spread(kept, "item").mapInPandas(run, "item long, size long").where("size > 0")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size (given in decreasing order): the first with room.

    The tree's leaves hold the room left per container and inner nodes their
    maximum; untouched containers count as empty, so a new one is opened just
    when no earlier one has room.
    """
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = np.zeros(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        out[i] = k - leaves
        tree[k] -= size
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            best = left if left >= right else right
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, seed: int = SEED) -> DataFrame:
    """``(item, piece, n_pieces, size, container)`` of a table (item long, size long).

    ``container`` names a container across the result.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    scratch = Scratch(items.sparkSession, "packing")
    sized = scratch.keep(items.select("item", "size").where("size > 0").withColumn("row", F.monotonically_increasing_id()))
    full = F.floor(F.col("size") / F.lit(capacity))
    rest = F.col("size") % capacity
    counted = sized.withColumn("full", full.cast("int")).withColumn("rest", rest).withColumn("n_pieces", (F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("int"))
    whole = counted.where("full > 0").select("item", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), "n_pieces", F.lit(capacity).cast("long").alias("size"), "row")
    whole = whole.withColumn("container", F.concat(F.lit("full/"), F.col("row"), F.lit("/"), F.col("piece"))).drop("row")
    open_items = counted.where("rest > 0").select("item", F.col("full").alias("piece"), "n_pieces", F.col("rest").alias("size"), "row")
    groups = max(1, -(-open_items.count() // group_size))
    # the row joins the key so that repeated item ids spread as well
    grouped = open_items.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "item", "row"), F.lit(groups)).cast("int")).drop("row")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("item", "ascending"), ("piece", "ascending")])
        bins = first_fit_decreasing(table["size"].to_numpy(), capacity)
        group = table["group"][0].as_py() if len(table) else 0
        names = pa.array([f"g{group}/{b}" for b in bins.tolist()], pa.string())
        return table.select(["item", "piece", "n_pieces", "size"]).append_column("container", names)

    filled = grouped.groupBy("group").applyInArrow(fill, "item long, piece int, n_pieces int, size long, container string")
    return whole.unionByName(filled)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of room used, by group of containers."""
    used = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return used.groupBy(F.substring_index("container", "/", 1).alias("grouping")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * F.lit(float(capacity))), 6).alias("fill"))
