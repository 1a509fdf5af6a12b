"""Registered queries with the SQL that must give the same rows."""

from loamgraph.plans import crawls, graphs, problems, scheduling, streams, tagging, trees

_MODULES = (problems, graphs, tagging, trees, crawls, scheduling, streams)


def core_queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def core_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
