"""loamgraph: tag search, trending, trees, graphs, crawl and scheduling analytics as Spark plans."""

__version__ = "0.1.0"
