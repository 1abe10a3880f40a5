"""lodestrata: versioned tables, property graphs and log-structured maintenance on Spark DataFrames."""

from lodestrata.operators.graph import Graph
from lodestrata.operators.kv import KvTable
from lodestrata.operators.mvcc import EpochClock, ReadOnlyError, latest, snapshot
from lodestrata.sources.segments import SegmentStore

__all__ = ["EpochClock", "Graph", "KvTable", "ReadOnlyError", "SegmentStore", "latest", "open_graph", "open_kv", "snapshot"]


def open_kv(spark, columns, **options):
    """An empty keyed table with the given value columns; see :class:`KvTable`."""
    return KvTable.create(spark, columns, **options)


def open_graph(spark, **options):
    """An empty labelled property graph; see :class:`Graph`."""
    return Graph.create(spark, **options)
