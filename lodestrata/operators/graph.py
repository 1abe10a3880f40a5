"""A labelled property graph: versioned edges, vertices with unversioned properties and dated deletions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata import schema as S
from lodestrata.operators import lsm
from lodestrata.operators.mvcc import EpochClock, Transaction, latest, snapshot
from lodestrata.operators.ordinals import number_rows, running_sum
from lodestrata.sources.segments import SegmentStore

EDGE_KEY = ["label", "src", "dst"]
LOGS = {"edge": S.EDGE_LOG, "vertex": S.VERTEX_LOG, "delete": S.VERTEX_DELETES}
EDGE_LOG_COLUMNS = [c.split()[0] for c in S.EDGE_LOG.split(", ")]


class GraphTransaction(Transaction):
    def add_vertex(self, label: str) -> int | None:
        """The next dense id of the label."""
        return None if self.next_seq() is None else self.owner._new_vertex(label)

    def put_vertex(self, label: str, vertex: int, prop: str) -> None:
        if (seq := self.next_seq()) is not None:
            self.buffer.append(("vertex", (self.owner.vertex_label_id(label), vertex, prop, self.write_epoch, seq)))

    def delete_vertex(self, label: str, vertex: int) -> None:
        """From this epoch on the vertex is gone; its edges stay."""
        if self.next_seq() is not None:
            self.buffer.append(("delete", (self.owner.vertex_label_id(label), vertex, self.write_epoch)))

    def put_edge(self, src: int, dst: int, label: str, prop: float) -> None:
        if (seq := self.next_seq()) is not None:
            self.buffer.append(("edge", (self.owner.edge_label_id(label), src, dst, float(prop), self.write_epoch, seq, False)))

    def delete_edge(self, src: int, dst: int, label: str) -> None:
        if (seq := self.next_seq()) is not None:
            self.buffer.append(("edge", (self.owner.edge_label_id(label), src, dst, None, self.write_epoch, seq, True)))


class Graph:
    def __init__(self, edges: DataFrame, vertices: DataFrame, deletes: DataFrame, clock: EpochClock | None = None):
        self.spark, self.clock = edges.sparkSession, clock or EpochClock()
        self._edges, self._vertices, self._deletes = edges, vertices, deletes
        self.vertex_labels: list[str] = []
        self.edge_labels: list[tuple[str, int, int]] = []
        self.next_id: dict[int, int] = {}
        self.pending: dict[str, list[tuple]] = {"edge": [], "vertex": [], "delete": []}

        self.stores: dict = {}

    @classmethod
    def create(cls, spark, root: str | None = None) -> Graph:
        """An empty graph; with a root folder one that `flush` keeps there, opened again with all that was flushed."""
        g = cls(spark.createDataFrame([], S.EDGE_LOG), spark.createDataFrame([], S.VERTEX_LOG), spark.createDataFrame([], S.VERTEX_DELETES))
        if root:
            g._open(root)
        return g

    # files: edges by (label, src, dst), found by src; properties and deletions of vertices by (label, id)
    def _open(self, root: str) -> None:
        keys = {"edge": (EDGE_KEY, "src"), "vertex": (["label", "id"], "id"), "delete": (["label", "id"], "id")}
        self.stores = {kind: SegmentStore(self.spark, f"{root.rstrip('/')}/{kind}", key, bound=bound, pick=lsm.pick_bytes) for kind, (key, bound) in keys.items()}
        if known := self.stores["edge"].get_json("catalog"):
            self.vertex_labels, self.edge_labels = known["vertex_labels"], [tuple(e) for e in known["edge_labels"]]
            self.next_id = {int(k): v for k, v in known["next_id"].items()}
        self.clock = EpochClock(max(s.max_epoch() for s in self.stores.values()) + 1)

    def flush(self) -> None:
        """Writes what is pending, and the labels, as files of level 0."""
        if not self.stores:
            return
        for kind, schema in LOGS.items():
            if self.pending[kind]:
                self.stores[kind].append(_stored(self.spark.createDataFrame(self.pending[kind], schema)))
                self.pending[kind] = []
        self.stores["edge"].put_json("catalog", {"vertex_labels": self.vertex_labels, "edge_labels": self.edge_labels, "next_id": self.next_id})

    def load_edges(self, edges: DataFrame) -> None:
        """Writes a log of edges (EDGE_LOG columns) as files of level 0."""
        self.stores["edge"].append(edges.select(*EDGE_LOG_COLUMNS))
        self.clock = EpochClock(max(s.max_epoch() for s in self.stores.values()) + 1)

    def merge(self, level: int = 0, oldest_pinned: int | None = None, force: bool = False) -> bool:
        """Merges edges of a level with what they overlap below; deletions stay until the deepest level."""
        return bool(self.stores) and self.stores["edge"].merge(S.EDGE_LOG, level, oldest_pinned, force)

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> Graph:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # catalog: a handful of labels, kept on the driver
    def add_vertex_label(self, name: str) -> int:
        if name in self.vertex_labels:
            raise ValueError(f"vertex label {name!r} exists")
        self.vertex_labels.append(name)
        return len(self.vertex_labels) - 1

    def add_edge_label(self, name: str, src: str, dst: str) -> int:
        if any(name == e[0] for e in self.edge_labels):
            raise ValueError(f"edge label {name!r} exists")
        self.edge_labels.append((name, self.vertex_label_id(src), self.vertex_label_id(dst)))
        return len(self.edge_labels) - 1

    def vertex_label_id(self, name: str) -> int:
        try:
            return self.vertex_labels.index(name)
        except ValueError:
            raise KeyError(f"no vertex label {name!r}") from None

    def edge_label_id(self, name: str) -> int:
        for i, e in enumerate(self.edge_labels):
            if e[0] == name:
                return i
        raise KeyError(f"no edge label {name!r}")

    def vertex_label(self, i: int) -> str:
        return self.vertex_labels[i] if 0 <= i < len(self.vertex_labels) else ""

    def edge_label(self, i: int) -> str:
        return self.edge_labels[i][0] if 0 <= i < len(self.edge_labels) else ""

    def source_label(self, name: str) -> str:
        return self.vertex_labels[self.edge_labels[self.edge_label_id(name)][1]]

    def label_tables(self) -> tuple[DataFrame, DataFrame]:
        return (self.spark.createDataFrame(list(enumerate(self.vertex_labels)), S.VERTEX_LABELS), self.spark.createDataFrame([(i, *e) for i, e in enumerate(self.edge_labels)], S.EDGE_LABELS))

    # writing
    def begin(self, read_only: bool = False, strict: bool = True) -> GraphTransaction:
        return GraphTransaction(self, self.clock, read_only, strict)

    def _new_vertex(self, label: str) -> int:
        i = self.vertex_label_id(label)
        self.next_id[i] = self.next_id.get(i, 0) + 1
        return self.next_id[i] - 1

    def _append(self, rows) -> None:
        for kind, row in rows:
            self.pending[kind].append(row)

    def _log(self, kind: str, base: DataFrame, schema, low: int | None = None, high: int | None = None) -> DataFrame:
        """All versions; of stored ones only files that may hold sources (or ids) from low to high."""
        if self.stores and self.stores[kind].files():
            names = base.columns
            stored = _stored(base)
            base = base.unionByName(self.stores[kind].read(stored.schema, low=low, high=high).toDF(*names))
        return base.unionByName(self.spark.createDataFrame(self.pending[kind], schema)) if self.pending[kind] else base

    @property
    def edge_log(self) -> DataFrame:
        return self._log("edge", self._edges, S.EDGE_LOG)

    # reading
    def edges_asof(self, epoch: int | None = None, src: int | None = None) -> DataFrame:
        """The live edges; src: the source that stored files are chosen by."""
        return snapshot(self._log("edge", self._edges, S.EDGE_LOG, src, src), EDGE_KEY, epoch, ["prop"], ("epoch", "seq"))

    def get_edge(self, src: int, dst: int, label: str, epoch: int | None = None) -> DataFrame:
        return self.edges_asof(epoch, src).where((F.col("label") == self.edge_label_id(label)) & (F.col("src") == src) & (F.col("dst") == dst)).select("prop")

    def edges(self, src: int, label: str, predicate: Callable[[Column], Column] | None = None, epoch: int | None = None) -> DataFrame:
        """(dst, prop) in order of dst; predicate: a function from the property Column to a condition."""
        return neighbours(self.edges_asof(epoch, src), self.edge_label_id(label), src, predicate and predicate(F.col("prop"))).orderBy("dst")

    def edge_label_scan(self, label: str, predicate: Callable[[Column], Column] | None = None, epoch: int | None = None) -> DataFrame:
        rows = self.edges_asof(epoch).where(F.col("label") == self.edge_label_id(label))
        return (rows.where(predicate(F.col("prop"))) if predicate else rows).select("src", "dst", "prop")

    def get_vertex(self, vertex: int, label: str, epoch: int | None = None) -> DataFrame:
        return self.vertices_asof(epoch).where((F.col("label") == self.vertex_label_id(label)) & (F.col("id") == vertex)).select("property")

    def vertices_asof(self, epoch: int | None = None) -> DataFrame:
        """(label, id, property) of vertices not deleted at or before the epoch; properties are not versioned."""
        props = latest(self._log("vertex", self._vertices, S.VERTEX_LOG), ["label", "id"], ["property"], ("epoch", "seq"))
        gone = self._log("delete", self._deletes, S.VERTEX_DELETES)
        return visible(props, gone, ["label", "id"], epoch)

    def vertex_num(self, label: str) -> int:
        """Ids given out, deleted ones included."""
        return self.next_id.get(self.vertex_label_id(label), 0)


def _stored(log: DataFrame) -> DataFrame:
    """The columns as files have them: a deletion's epoch is called epoch there."""
    return log.withColumnRenamed("del_epoch", "epoch")


def visible(vertices: DataFrame, deletes: DataFrame, keys, epoch: int | None = None) -> DataFrame:
    """Vertices without a deletion at or before the epoch."""
    gone = deletes if epoch is None else deletes.where(F.col("del_epoch") <= epoch)
    return vertices.join(gone.select(*keys), list(keys), "left_anti")


def neighbours(edges: DataFrame, label: int, src: int, predicate: Column | None = None) -> DataFrame:
    rows = edges.where((F.col("label") == label) & (F.col("src") == src))
    return (rows if predicate is None else rows.where(predicate)).select("dst", "prop")


def adjacency(edges: DataFrame, label: int, run: int = 10_000) -> DataFrame:
    """(src, degree, dsts): targets in order, joined by commas.

    Targets are gathered in runs of 10,000 ids first, so no task holds more than a run of numbers before the strings of a
    source are put together; the one row a source gets is as long as its degree, as the format asks.
    """
    rows = edges.where(F.col("label") == label).select("src", "dst", F.floor(F.col("dst") / run).alias("_run"))
    runs = rows.groupBy("src", "_run").agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("_s"))
    return runs.groupBy("src").agg(F.sum("_n").alias("degree"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_run", "_s"))), lambda x: x["_s"]), ",").alias("dsts"))


def csr(edges: DataFrame, label: int, n_src: int) -> DataFrame:
    """(src, degree, end_offset, has_edges) for every source from 0 to n_src - 1, those without edges included."""
    degrees = edges.where(F.col("label") == label).groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    dense = edges.sparkSession.range(n_src).withColumnRenamed("id", "src")
    full = dense.join(degrees, "src", "left").select("src", F.coalesce("_d", F.lit(0)).cast("long").alias("degree"))
    return running_sum(full, "src", "degree", name="end_offset").select("src", "degree", "end_offset", (F.col("degree") > 0).alias("has_edges"))


def vertex_ids(vertices: DataFrame, natural: str, order: str) -> DataFrame:
    """(natural_key, vertex_id): dense ids from 0 in the given order."""
    return number_rows(vertices.select(F.col(natural).alias("natural_key"), F.col(order).alias("_o")), "_o", name="vertex_id").select("natural_key", "vertex_id")


def one_hop(vertices: DataFrame, edges: DataFrame, vertex: str, src: str) -> DataFrame:
    """Edges whose source is among the vertices; the optimizer broadcasts the vertices only if they are small."""
    return vertices.join(edges, vertices[vertex] == edges[src])
