"""Groups too large for one part, split vertex by vertex.

Breadth-first order and greedy choice are sequential, so one task takes the
vertices and edges of the large groups.  It gets them packed: tasks before it
sort, drop repeats and hand out blocks of plain numbers, so the last task neither
sorts rows nor holds them, but four bytes for each direction of an edge and
about thirty for each vertex (twice that beyond 2^31 of them).
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.session import Scratch

BLOCK = 1 << 16
_PACKED = "arcs boolean, group long, part int, seq int, n long, firsts binary, counts binary, seconds binary"


def _pack(batches: Iterator[pa.RecordBatch], arcs: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks: of arcs ``(src, dst)`` the sources, their numbers and the targets, of vertices ``(group, id)`` the ids of one group."""
    from pyspark import TaskContext

    part, seq, last = TaskContext.get().partitionId(), 0, None
    held: list[np.ndarray] = []

    def blocks(first: np.ndarray, second: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal seq, last
        if arcs:
            fresh = np.ones(len(first), bool)
            fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            fresh[0] = (first[0], second[0]) != last
            last = (first[-1], second[-1])
            first, second = first[fresh], second[fresh]
            if not len(first):
                return
        runs = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        counts = np.diff(np.append(runs, len(first)))
        if arcs:
            rows = [(first[0], len(first), first[runs].tobytes(), counts.tobytes(), second.tobytes())]
        else:
            rows = [(first[a], n, b"", b"", second[a : a + n].tobytes()) for a, n in zip(runs.tolist(), counts.tolist(), strict=True)]
        for group, n, firsts, many, seconds in rows:
            values = ([arcs], [int(group)], [part], [seq], [int(n)], [firsts], [many], [seconds])
            kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            names = [c.split()[0] for c in _PACKED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)
            seq += 1

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]))
        if sum(x.shape[1] for x in held) >= BLOCK:
            yield from blocks(*np.concatenate(held, axis=1))
            held = []
    if sum(x.shape[1] for x in held):
        yield from blocks(*np.concatenate(held, axis=1))


def _places(ids: np.ndarray, kind: type) -> Callable[[np.ndarray], np.ndarray]:
    """Function from ids to their places in ``ids``, -1 for those it hasn't: by a table where the ids lie close, else by search."""
    low, span = int(ids.min()), int(ids.max()) - int(ids.min()) + 1
    if span <= 4 * len(ids) + BLOCK:
        table = np.full(span, -1, kind)
        table[ids - low] = np.arange(len(ids), dtype=kind)

        def look(x: np.ndarray) -> np.ndarray:
            # compared before subtracting, which could overflow
            good = (x >= low) & (x <= low + span - 1)
            return np.where(good, table[np.where(good, x, low) - low], -1).astype(kind)

        return look
    by_id = None if bool((ids[1:] > ids[:-1]).all()) else np.argsort(ids).astype(kind)
    ranked = ids if by_id is None else ids[by_id]

    def search(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)  # neighbouring searches touch neighbouring memory
        at = np.empty(len(x), kind)
        at[order] = np.searchsorted(ranked, x[order]).clip(max=len(ranked) - 1)
        return np.where(ranked[at] == x, at if by_id is None else by_id[at], -1).astype(kind)

    return search


def _greedy(low: int, high: int, begin: memoryview, end: memoryview, dst: memoryview, ordered: bool, home, order, parts: int, slack: float) -> None:
    """Breadth first from each vertex of low..high not yet met, each placed as ``graph.greedy_partition`` does when its turn comes.

    ``home`` holds the part, ``parts`` for a vertex met but not placed, above for one not met; ``order`` gets the vertices in order.
    """
    capacity = math.ceil((high - low) * (1 + slack) / parts)
    top, load = max(1, capacity), [0] * parts
    done = len(order)
    for root in range(low, high):
        if home[root] <= parts:
            continue
        home[root] = parts
        order.append(root)
        while done < len(order):
            x = order[done]
            done += 1
            held: dict[int, int] = {}
            near = dst[begin[x] : end[x]].tolist()
            for y in near if ordered else sorted(near):
                h = home[y]
                if h < parts:
                    held[h] = held.get(h, 0) + 1
                elif h > parts:
                    home[y] = parts
                    order.append(y)
            # a part with neighbours and room outweighs all without; among the latter the lightest
            best = None
            for p, n in held.items():
                if load[p] < capacity:
                    key = (-n * (1 - load[p] / top), load[p], p)
                    if best is None or key < best:
                        best = key
            part = load.index(min(load)) if best is None else best[2]
            home[x] = part
            load[part] += 1


def _split(batches: Iterator[pa.RecordBatch], n: int, m: int, parts: int, slack: float) -> Iterator[pa.RecordBatch]:
    """Packed vertices, then packed arcs, to ``(id, group, part)``."""
    kind = np.int32 if max(n, m) < 1 << 31 else np.int64
    ids, groups, filled = np.empty(n, np.int64), [], 0  # groups: (group, first place)
    begin, end, dst, used = np.zeros(n, kind), np.zeros(n, kind), np.empty(m, kind), 0
    place = None
    ordered = True
    for b in batches:
        for i in range(b.num_rows):
            second = np.frombuffer(b.column(7)[i].as_buffer(), np.int64)
            if not b.column(0)[i].as_py():
                if not groups or groups[-1][0] != (g := b.column(1)[i].as_py()):
                    groups.append((b.column(1)[i].as_py(), filled))
                ids[filled : filled + len(second)] = second
                filled += len(second)
                continue
            if place is None:
                place = _places(ids, kind)
                ordered = bool((ids[1:] > ids[:-1]).all())
            src = place(np.frombuffer(b.column(5)[i].as_buffer(), np.int64))
            counts = np.frombuffer(b.column(6)[i].as_buffer(), np.int64)
            to = place(second)
            if (src < 0).any() or (to < 0).any():
                run = np.repeat(np.arange(len(src)), counts)
                good = (src[run] >= 0) & (to >= 0)
                to, counts = to[good], np.bincount(run[good], minlength=len(src))
                src, counts = src[counts > 0], counts[counts > 0]
            stop = used + np.cumsum(counts)
            start = stop - counts
            new = begin[src] == end[src]  # else the first source goes on from the block before
            begin[src[new]] = start[new]
            end[src] = stop
            dst[used : used + len(to)] = to
            used += len(to)
    del place
    home = array("B" if parts < 255 else "i", [parts + 1]) * n
    order = array("i" if kind is np.int32 else "q")
    views = memoryview(begin), memoryview(end), memoryview(dst)
    for (_, low), high in zip(groups, [*(low for _, low in groups[1:]), n], strict=True):
        _greedy(low, high, *views, ordered, home, order, parts, slack)
    names, starts = np.array([g for g, _ in groups], np.int64), np.array([low for _, low in groups])
    order, home = np.frombuffer(order, kind), np.frombuffer(home, np.uint8 if home.typecode == "B" else np.int32)
    for a in range(0, n, BLOCK):
        at = order[a : a + BLOCK]
        group = names[np.searchsorted(starts, at, "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(group), pa.array(home[at].astype(np.int32))], names=["id", "group", "part"])


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """A few blocks a batch; the number of rows alone would let all of them into one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def split_groups(large: DataFrame, n: int, edges: DataFrame, parts: int, slack: float, scratch: Scratch) -> DataFrame:
    """``(id, group, part)`` of the ``n`` vertices ``large(id, ord, group)``; ``edges(src, dst)`` to other vertices are left out."""
    if not n:
        return large.select("id", "group", F.lit(None).cast("int").alias("part"))
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    by_place = large.repartitionByRange("group", "ord", "id").sortWithinPartitions("group", "ord", "id").select(*long("group", "id"))
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    arcs = edges.where("src <> dst").select(F.explode(ways).alias("x")).select(*[F.col(f"x.{c}").cast("long").alias(c) for c in ("src", "dst")])
    # a repartition by name is never split, so a source's arcs lie together
    by_source = arcs.repartition("src").sortWithinPartitions("src", "dst")
    packed = scratch.keep(by_place.mapInArrow(lambda rows: _pack(rows, False), _PACKED).unionByName(by_source.mapInArrow(lambda rows: _pack(rows, True), _PACKED)))
    m = packed.where("arcs").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scratch.tidy()
    one = packed.repartition(1).sortWithinPartitions("arcs", "part", "seq")
    with _small_batches(large.sparkSession):
        out = scratch.keep(one.mapInArrow(lambda rows: _split(rows, n, m, parts, slack), "id long, group long, part int"))
    scratch.drop(packed)
    return out
