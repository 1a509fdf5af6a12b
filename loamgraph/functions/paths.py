"""Materialised paths ``/a/b/``: building, splitting and prefix ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def root_path(node: Column) -> Column:
    return F.concat(F.lit("/"), node.cast("string"), F.lit("/"))


def child_path(parent_path: Column, node: Column) -> Column:
    return F.concat(parent_path, node.cast("string"), F.lit("/"))


def path_ids(path: Column) -> Column:
    """Ids from the root to the node itself; parts that are no number are left out."""
    parts = F.split(F.trim(path, F.lit("/")), "/")
    return F.filter(F.transform(parts, lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def upper_bound(path: Column) -> Column:
    """Exclusive end of the range of paths below ``path`` ('0' follows '/' in byte order)."""
    return F.concat(F.substring(path, F.lit(1), F.length(path) - 1), F.lit("0"))


def under(path: Column, prefix: Column) -> Column:
    """Whether a path lies in the subtree of ``prefix``, the subtree's root included."""
    return (path >= prefix) & (path < upper_bound(prefix))


def is_valid(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^/(?:[0-9]+/)+$"), F.lit(False))
