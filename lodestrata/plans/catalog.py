"""The registered queries over the supplied tables, each with the SQL that a second engine can run for comparison."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.profile import latency
from lodestrata.operators import dictionary, graph, lsm
from lodestrata.operators.kv import KvTable
from lodestrata.operators.mvcc import active_floor, latest, snapshot
from lodestrata.operators.ordinals import number_rows, running_sum
from lodestrata.sources.tables import edge_log, kv_log, table

CTES = """
kv_log AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id + 1 AS epoch, event_type = 'error' AS tomb, event_type AS v1, json_extract_string(props, '$.k') AS v2 FROM events),
kv_latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY epoch DESC) AS rn FROM kv_log) WHERE rn = 1),
kv_snap AS (SELECT k, v1, v2, epoch FROM kv_latest WHERE NOT tomb),
edge_log AS (SELECT CAST(event_id % 2 AS INTEGER) AS label, user_id AS src, CAST(json_extract_string(props, '$.k') AS INTEGER) AS dst, value AS prop, event_id + 1 AS epoch, event_type = 'error' AS tomb FROM events),
edge_latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, src, dst ORDER BY epoch DESC) AS rn FROM edge_log) WHERE rn = 1),
edge_snap AS (SELECT label, src, dst, prop, epoch FROM edge_latest WHERE NOT tomb)
"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function (spark, folder) -> DataFrame under its name, beside its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {CTES.strip()} {sql}"
        return f

    return add


def kv(spark: SparkSession, d: str) -> KvTable:
    return KvTable(kv_log(spark, d))


def edge_snap(spark: SparkSession, d: str, payload=("prop",)) -> DataFrame:
    return snapshot(edge_log(spark, d), graph.EDGE_KEY, payload=list(payload))


# keyed table


@query("SELECT k, v1, v2 FROM kv_snap")
def kv_scan_all(spark, d):
    return kv(spark, d).scan()


@query("SELECT k, v1, v2 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY epoch DESC) AS r FROM kv_log WHERE epoch <= 5000) WHERE r = 1 AND NOT tomb")
def kv_snapshot_asof(spark, d):
    return kv(spark, d).scan(5000)


@query("SELECT k, v1, v2 FROM kv_snap WHERE k = '7'")
def kv_get_tuple(spark, d):
    return kv(spark, d).get("7")


@query("SELECT q.k, s.k IS NOT NULL AS found, s.v1, s.v2 FROM (VALUES ('1'), ('7'), ('42'), ('99'), ('nokey')) AS q(k) LEFT JOIN kv_snap s ON q.k = s.k")
def kv_multi_get(spark, d):
    return kv(spark, d).multi_get(spark.createDataFrame([(k,) for k in ("1", "7", "42", "99", "nokey")], "k string"))


@query("SELECT k, epoch AS del_epoch FROM kv_latest WHERE tomb")
def kv_deleted_keys(spark, d):
    return kv(spark, d).deleted()


@query("SELECT k, epoch, lag(epoch) OVER (PARTITION BY k ORDER BY epoch) AS prev_epoch, lead(epoch) OVER (PARTITION BY k ORDER BY epoch) AS next_epoch, tomb FROM kv_log")
def kv_version_history(spark, d):
    return kv(spark, d).history()


@query("SELECT k, v1, v2 FROM kv_snap WHERE v2 BETWEEN '10' AND '200'")
def kv_value_range(spark, d):
    return kv(spark, d).value_range("v2", "10", "200")


@query("SELECT k, v1, v2 FROM kv_snap WHERE v2 < '50'")
def kv_value_range_one_sided(spark, d):
    return kv(spark, d).value_bound("v2", "lt", "50")


@query("SELECT count(*) AS n FROM kv_snap WHERE v2 BETWEEN ' ' AND '!'")
def kv_value_range_empty(spark, d):
    return kv(spark, d).value_range("v2", " ", "!").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, v1, v2 FROM kv_snap WHERE k BETWEEN '10' AND '2'")
def kv_key_range(spark, d):
    return kv(spark, d).key_range("10", "2")


@query("SELECT k, v1, v2 FROM kv_snap WHERE k >= '3' ORDER BY k LIMIT 20")
def kv_scan_k(spark, d):
    return kv(spark, d).scan_k("3", 20)


@query("SELECT row_number() OVER (ORDER BY k) - 1 AS pos, k, v1, v2 FROM kv_snap WHERE k >= '3'")
def kv_iter(spark, d):
    return number_rows(kv(spark, d).scan().where(F.col("k") >= "3"), "k").select("pos", "k", "v1", "v2")


@query("SELECT k, v1, v2 FROM kv_snap WHERE k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY')")
def kv_semi_probe(spark, d):
    keys = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("k"))
    return kv(spark, d).contains(keys)


# maintenance


@query("SELECT (epoch - 1) // 4096 AS run, count(*) AS puts, count(DISTINCT k) AS keys, min(k) AS key_min, max(k) AS key_max, max(epoch) AS max_epoch FROM kv_log GROUP BY 1")
def kv_flush_runs(spark, d):
    return lsm.flush_runs(kv_log(spark, d))


@query("SELECT k, run, v1, v2 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run DESC) AS w FROM (SELECT *, (epoch - 1) // 4096 AS run, row_number() OVER (PARTITION BY k, (epoch - 1) // 4096 ORDER BY epoch DESC) AS r FROM kv_log) WHERE r = 1) WHERE w = 1 AND NOT tomb")
def kv_compaction_merge(spark, d):
    merged = lsm.merge_runs(kv_log(spark, d), ["k"], lsm.run_of(F.col("epoch"), lsm.MEMTABLE_ROWS), "run", ["v1", "v2"], True)
    return merged.select("k", "run", "v1", "v2")


@query("SELECT b AS block_id, min(k) AS key_min, max(k) AS key_max, count(*) AS n FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k, (row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1) // 204 AS b FROM orders) GROUP BY b")
def block_layout(spark, d):
    return lsm.layout(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key")), "key", lsm.rows_per_block(1), "block_id", "n")


@query("SELECT f AS file_id, min(k) AS key_min, max(k) AS key_max, count(*) AS key_num FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k, (row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1) // 4096 AS f FROM orders) GROUP BY f")
def file_split(spark, d):
    return lsm.layout(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key")), "key", lsm.MEMTABLE_ROWS, "file_id", "key_num")


@query("SELECT bucket, w, d, rr, rw, CASE WHEN sqrt(CAST(d AS DOUBLE) / w) + CAST(rw AS DOUBLE) / (rr + rw) > 1 THEN 1 ELSE 2 END AS merge_type FROM (SELECT bucket, count(*) FILTER (WHERE event_type NOT IN ('view','error')) AS w, count(*) FILTER (WHERE event_type = 'error') AS d, count(*) FILTER (WHERE rn <= 160 AND event_type = 'view') AS rr, count(*) FILTER (WHERE rn <= 160 AND event_type <> 'view') AS rw FROM (SELECT user_id // 16 AS bucket, event_type, row_number() OVER (PARTITION BY user_id // 16 ORDER BY event_id DESC) AS rn FROM events) GROUP BY bucket)")
def merge_type_decision(spark, d):
    kind = F.col("event_type")
    return lsm.merge_decisions(table(spark, d, "events"), F.floor(F.col("user_id") / 16).cast("long"), "event_id", kind == "view", kind == "error")


@query("SELECT user_id // 64 AS b1, user_id // 16 AS b0, count(*) AS n FROM events GROUP BY ROLLUP (user_id // 64, user_id // 16)")
def access_rollup(spark, d):
    b = lambda n: F.floor(F.col("user_id") / n).cast("long")
    return table(spark, d, "events").select(b(64).alias("b1"), b(16).alias("b0")).rollup("b1", "b0").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.event_id AS write_epoch, min(b.event_id) - 1 AS read_epoch FROM events a JOIN events b ON b.event_id <= a.event_id AND b.event_id >= a.event_id - 99 AND b.event_id + CAST(json_extract_string(b.props, '$.k') AS INTEGER) >= a.event_id GROUP BY a.event_id")
def txn_low_watermark(spark, d):
    t = table(spark, d, "events").select("event_id", (F.col("event_id") + F.get_json_object("props", "$.k").try_cast("int")).alias("last"))
    return active_floor(t, "event_id", "last", 100)


@query("SELECT op, n, total, p99 FROM (SELECT event_type AS op, count(*) OVER (PARTITION BY event_type) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type) AS BIGINT) AS total, CAST(round(value * 100) AS BIGINT) AS p99, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn FROM events) WHERE rn = CAST(floor(CAST(0.99 AS DOUBLE) * n) AS BIGINT) + 1")
def op_latency_profile(spark, d):
    cents = table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return latency(cents, "event_type", "cents")


# dictionaries


@query("SELECT v2 AS str, row_number() OVER (ORDER BY v2) - 1 AS code FROM (SELECT DISTINCT v2 FROM kv_snap)")
def dict_encode(spark, d):
    return dictionary.build(kv(spark, d).scan(columns=["v2"]), "v2")


@query("SELECT k, dense_rank() OVER (ORDER BY v2) - 1 AS code FROM kv_snap")
def dict_encoded_column(spark, d):
    rows = kv(spark, d).scan(columns=["v2"])
    return dictionary.encode(rows, "v2", dictionary.build(rows, "v2")).select("k", "code")


@query("SELECT CAST(count(*) FILTER (WHERE v2 < '10') AS BIGINT) AS lo, CAST(count(*) FILTER (WHERE v2 <= '200') AS BIGINT) - 1 AS hi FROM (SELECT DISTINCT v2 FROM kv_snap)")
def dict_code_range(spark, d):
    return dictionary.code_range(kv(spark, d).scan(columns=["v2"]).select(F.col("v2").alias("str")).distinct(), "10", "200")


@query("SELECT str, row_number() OVER (ORDER BY str) - 1 AS code FROM (SELECT p_type AS str FROM part UNION SELECT o_orderpriority FROM orders)")
def dict_merge(spark, d):
    one, two = table(spark, d, "part").select(F.col("p_type").alias("str")), table(spark, d, "orders").select(F.col("o_orderpriority").alias("str"))
    return dictionary.merge(one.distinct(), two.distinct()).select("str", "code")


# graph


@query("SELECT e.name AS edge_label, s.name AS src_label, d.name AS dst_label FROM (VALUES (0,'places',0,1),(1,'contains',1,2)) AS e(id,name,sid,did) JOIN (VALUES (0,'customer'),(1,'orders'),(2,'part')) AS s(id,name) ON e.sid = s.id JOIN (VALUES (0,'customer'),(1,'orders'),(2,'part')) AS d(id,name) ON e.did = d.id")
def label_catalog(spark, d):
    g = graph.Graph.create(spark)
    for name in ("customer", "orders", "part"):
        g.add_vertex_label(name)
    g.add_edge_label("places", "customer", "orders")
    g.add_edge_label("contains", "orders", "part")
    v, e = g.label_tables()
    ends = lambda side: v.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_label"))
    return e.join(ends("src"), "src_id").join(ends("dst"), "dst_id").select(F.col("name").alias("edge_label"), "src_label", "dst_label")


@query("SELECT n_name AS natural_key, row_number() OVER (ORDER BY n_nationkey) - 1 AS vertex_id FROM nation")
def vertex_add_ids(spark, d):
    return graph.vertex_ids(table(spark, d, "nation"), "n_name", "n_nationkey")


@query("SELECT c_custkey AS vertex_id, c_name AS property FROM customer WHERE c_custkey IN (0, 7, 42, 999999)")
def vertex_get(spark, d):
    return table(spark, d, "customer").where(F.col("c_custkey").isin(0, 7, 42, 999999)).select(F.col("c_custkey").alias("vertex_id"), F.col("c_name").alias("property"))


@query("SELECT c_custkey AS vertex_id, c_name AS property FROM customer WHERE NOT (c_mktsegment = 'MACHINERY' AND c_custkey + 1 <= 700)")
def vertex_visible_asof(spark, d):
    c = table(spark, d, "customer")
    gone = c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("vertex_id"), (F.col("c_custkey") + 1).alias("del_epoch"))
    return graph.visible(c.select(F.col("c_custkey").alias("vertex_id"), F.col("c_name").alias("property")), gone, ["vertex_id"], 700)


@query("SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def vertex_num(spark, d):
    one, two, three = (table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("label"), "n") for t in ("customer", "orders", "part"))
    return one.unionAll(two).unionAll(three)


@query("SELECT label, src, dst, prop, epoch FROM edge_snap")
def edge_snapshot(spark, d):
    return edge_snap(spark, d, ("prop", "epoch"))


@query("SELECT q.src, q.dst, s.src IS NOT NULL AS found, s.prop FROM (SELECT CAST(7 AS BIGINT) AS src, unnest(range(0, 10)) AS dst) q LEFT JOIN edge_snap s ON s.label = 0 AND s.src = q.src AND s.dst = q.dst")
def edge_get(spark, d):
    asked = spark.range(10).select(F.lit(7).cast("long").alias("src"), F.col("id").alias("dst"))
    found = edge_snap(spark, d).where("label = 0 AND src = 7").select("src", F.col("dst").cast("long").alias("dst"), "prop", F.lit(True).alias("_hit"))
    return asked.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("_hit", F.lit(False)).alias("found"), "prop")


@query("SELECT dst, prop FROM edge_snap WHERE label = 0 AND src = 7 AND prop > 50.0")
def edges_of_src(spark, d):
    return graph.neighbours(edge_snap(spark, d), 0, 7, F.col("prop") > 50.0)


@query("SELECT src, dst, prop FROM edge_snap WHERE label = 1")
def edge_label_scan(spark, d):
    return edge_snap(spark, d).where("label = 1").select("src", "dst", "prop")


@query("SELECT src, count(*) AS degree, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS dsts FROM edge_snap WHERE label = 0 GROUP BY src")
def adjacency_list(spark, d):
    return graph.adjacency(edge_snap(spark, d), 0)


@query("SELECT g.src, coalesce(d.degree, 0) AS degree, CAST(sum(coalesce(d.degree, 0)) OVER (ORDER BY g.src) AS BIGINT) AS end_offset, coalesce(d.degree, 0) > 0 AS has_edges FROM (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS src) g LEFT JOIN (SELECT src, count(*) AS degree FROM edge_snap WHERE label = 0 GROUP BY src) d ON g.src = d.src")
def csr_offsets(spark, d):
    n = table(spark, d, "events").agg(F.max("user_id")).first()[0]
    return graph.csr(edge_snap(spark, d), 0, 0 if n is None else n + 1)


@query("SELECT label, src, dst, file_id, tomb FROM (SELECT *, row_number() OVER (PARTITION BY label, src, dst ORDER BY file_id DESC) AS w FROM (SELECT *, (epoch - 1) // 2500 AS file_id, row_number() OVER (PARTITION BY label, src, dst, (epoch - 1) // 2500 ORDER BY epoch DESC) AS r FROM edge_log) WHERE r = 1) WHERE w = 1")
def sst_compaction_merge(spark, d):
    return lsm.merge_runs(edge_log(spark, d), graph.EDGE_KEY, lsm.run_of(F.col("epoch"), 2500), "file_id", [], False).select("label", "src", "dst", "file_id", "tomb")


@query("SELECT src, dst, prop FROM (SELECT l_orderkey AS src, l_partkey AS dst, l_quantity AS prop, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_suppkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1")
def order_part_edges(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("prop"), "l_shipdate", "l_suppkey", "l_linenumber")
    return latest(lines, ["src", "dst"], ["prop"], ("l_shipdate", "l_suppkey", "l_linenumber"))


@query("SELECT c.c_custkey AS src, count(*) AS degree, max(o.o_totalprice) AS max_prop FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'MACHINERY' AND o.o_totalprice > 100000.0 GROUP BY c.c_custkey")
def graph_one_hop(spark, d):
    c, o = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'"), table(spark, d, "orders").where("o_totalprice > 100000.0")
    return graph.one_hop(c, o, "c_custkey", "o_custkey").groupBy(F.col("c_custkey").alias("src")).agg(F.count(F.lit(1)).alias("degree"), F.max("o_totalprice").alias("max_prop"))


@query("SELECT c_custkey AS vertex_id, CAST(sum(length(c_name)) OVER (ORDER BY c_custkey) AS BIGINT) AS end_offset FROM customer")
def property_offsets(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("vertex_id"), F.length("c_name").cast("long").alias("_n"))
    return running_sum(c, "vertex_id", "_n", name="end_offset").select("vertex_id", "end_offset")


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS qty_cents FROM lineitem GROUP BY ALL")
def lineitem_status_totals(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("qty_cents"))




# graphs in files


def _stored_graph(spark: SparkSession, d: str) -> graph.Graph:
    """The supplied edges in files of a new store in the shared folder, in two flushes."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="shared-")
    g = graph.Graph.create(spark, root=f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}")
    log = edge_log(spark, d).withColumns({"prop": F.col("prop").cast("double"), "seq": F.lit(0).cast("long"), "dst": F.col("dst").cast("long")})
    for part in (F.col("epoch") % 2 == 0, F.col("epoch") % 2 == 1):
        g.load_edges(log.where(part))
    return g


@query("SELECT label, src, dst, prop FROM edge_snap")
def edge_store_scan(spark, d):
    return _stored_graph(spark, d).edges_asof().withColumn("dst", F.col("dst").cast("int"))


@query("SELECT label, src, dst, prop FROM edge_snap WHERE src = 7")
def edge_store_merge(spark, d):
    g = _stored_graph(spark, d)
    g.merge(force=True)
    return g.edges_asof(src=7).where("src = 7").withColumn("dst", F.col("dst").cast("int"))
