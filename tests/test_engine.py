"""Public objects: scenarios, regressions and metamorphic checks."""

import pytest
from pyspark.sql import functions as F

from lodestrata import EpochClock, ReadOnlyError, SegmentStore, open_graph, open_kv
from lodestrata.functions import bloom, profile
from lodestrata.operators import dictionary, lsm
from lodestrata.operators.kv import KvTable
from lodestrata.schema import kv_log


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_updates_keep_the_last_value(spark):
    t = open_kv(spark, ["v1"])
    for i in range(2048):
        with t.begin() as x:
            x.put(str(i % 200), str(i))
    want = sorted((str(k), str(max(i for i in range(2048) if i % 200 == k))) for k in range(200))
    assert rows(t.scan()) == want
    assert [r.k for r in t.scan_k("3", 5).collect()] == sorted(k for k, _ in want if k >= "3")[:5]
    assert [r.k for page in t.pages("3", 40) for r in page] == [r.k for r in t.iterate("3")] == sorted(k for k, _ in want if k >= "3")


def test_deletes_snapshots_and_ranges(spark):
    t = open_kv(spark, ["v1", "v2"])
    with t.begin() as x:
        x.put("a", "5", "x")
        x.put("b", "10", "y")
        first = x.write_epoch
    with t.begin() as x:
        x.delete("a")
        x.put("b", "99", "y")
    assert rows(t.scan(first)) == [("a", "5", "x"), ("b", "10", "y")]
    assert rows(t.scan()) == [("b", "99", "y")] and t.get("a").collect() == []
    assert t.value_range("v1", "10", "20").collect() == []  # the newer version hides the older match
    assert t.value_range("v1", " ", "!").collect() == []
    assert rows(t.deleted())[0][0] == "a" and t.history().count() == 4


def test_read_only_and_failed_transactions(spark):
    t = open_kv(spark, ["v1"])
    with pytest.raises(ReadOnlyError):
        t.begin(read_only=True).put("a", "1")
    t.begin(read_only=True, strict=False).put("a", "1")
    with pytest.raises(ZeroDivisionError), t.begin() as x:
        x.put("a", "1")
        1 / 0
    assert t.scan().collect() == []


def test_clock():
    c = EpochClock()
    a, read_a = c.begin()
    b, read_b = c.begin()
    assert (a, read_a, b, read_b) == (1, 0, 2, 0)
    c.end(b)
    assert c.read_epoch() == 0
    c.end(a)
    assert c.read_epoch() == 2


def test_segments_survive_merges(spark, tmp_path):
    schema = kv_log(["v1"])
    store = SegmentStore(spark, str(tmp_path / "store"))
    t = KvTable(spark.createDataFrame([], schema), store=store)
    for i in range(4):
        t.put_many(spark.createDataFrame([(str(k), f"{i}-{k}") for k in range(i, 60, i + 1)], "k string, v1 string"))
    t.delete_many(spark.createDataFrame([("7",)], "k string"))
    before, old = rows(t.scan()), rows(t.scan(2))
    store.merge(schema, 0, oldest_pinned=2, force=True)
    assert rows(t.scan()) == before and rows(t.scan(2)) == old
    store.compact_all(schema)
    assert rows(t.scan()) == before and store.read(schema).count() == len(before)
    assert store.vacuum() > 0 and rows(t.scan()) == before
    assert rows(KvTable(spark.createDataFrame([], schema), store=SegmentStore(spark, store.root)).scan()) == before
    assert {r.k for r in store.read(schema, low="3", high="4").where("k between '3' and '4'").collect()} == {k for k, _ in before if "3" <= k <= "4"}


def test_reopened_store_goes_on_behind_the_newest_epoch(spark, tmp_path):
    schema = kv_log(["v1", "v2"])
    root = str(tmp_path / "store")
    with KvTable(spark.createDataFrame([], schema), store=SegmentStore(spark, root)) as t:
        for i in range(3):
            with t.begin() as x:
                x.put("a", f"old{i}", None)
                x.put("b", None, f"b{i}")
    again = KvTable(spark.createDataFrame([], schema), store=SegmentStore(spark, root))
    with again.begin() as x:
        x.put("a", "NEW", "w")
        x.delete("b")
    assert rows(again.scan()) == [("a", "NEW", "w")] and rows(again.get("b")) == []
    again.close()
    again.store.compact_all(schema)
    assert rows(KvTable(spark.createDataFrame([], schema), store=SegmentStore(spark, root)).scan()) == [("a", "NEW", "w")]
    log = spark.createDataFrame([("a", 9, 0, False, "x", None)], schema)
    over = KvTable(log)
    with over.begin() as x:
        x.put("a", "y", None)
    assert rows(over.scan()) == [("a", "y", None)]


def test_merge_decision_without_writes(spark):
    a = spark.createDataFrame([(1, i, "view") for i in range(3)] + [(2, 1, "error"), (3, 1, "click"), (3, 2, "error"), (3, 3, "error")], "b int, o int, kind string")
    kind = F.col("kind")
    got = {r.bucket: (r.w, r.d, r.merge_type) for r in lsm.merge_decisions(a, F.col("b"), "o", kind == "view", kind == "error").collect()}
    assert got == {1: (0, 0, lsm.TIERING), 2: (0, 1, lsm.TIERING), 3: (1, 2, lsm.LEVELING)}


def test_graph_in_files(spark, tmp_path):
    root = str(tmp_path / "g")
    with open_graph(spark, root=root) as g:
        g.add_vertex_label("person")
        g.add_edge_label("knows", "person", "person")
        with g.begin() as x:
            a, b, c = (x.add_vertex("person") for _ in range(3))
            x.put_vertex("person", a, "A")
            x.put_vertex("person", b, "B")
            for d in (b, c):
                x.put_edge(a, d, "knows", 1.0)
            first = x.write_epoch
        g.flush()
        with g.begin() as x:
            x.delete_edge(a, c, "knows")
            x.put_edge(a, b, "knows", float("nan"))
            x.delete_vertex("person", b)
    g = open_graph(spark, root=root)
    assert g.vertex_num("person") == 3 and g.edge_label_id("knows") == 0
    for step in (lambda: None, lambda: g.merge(force=True, oldest_pinned=first), lambda: g.merge(1, force=True, oldest_pinned=first)):
        step()
        assert [d for d, _ in rows(g.edges(a, "knows"))] == [b] and rows(g.edges(a, "knows", epoch=first)) == [(b, 1.0), (c, 1.0)]
    assert g.get_vertex(b, "person").collect() == [] and rows(g.get_vertex(a, "person")) == [("A",)]
    with g.begin() as x:
        x.put_edge(a, c, "knows", 7.0)
    assert rows(g.get_edge(a, c, "knows")) == [(7.0,)]


def test_picks():
    f = lambda level, lo, hi, n=1, e=1: {"level": level, "k_min": lo, "k_max": hi, "bytes": n, "max_epoch": e}
    a, b, c, d = f(0, 1, 5, e=2), f(0, 4, 9, e=1), f(0, 20, 30, e=3), f(1, 6, 8)
    assert lsm.pick_bytes([a, b, c, d], 0, 4) == [a, b, d] and lsm.pick_bytes([d], 1, 4) == []
    assert lsm.pick_bytes([f(1, 1, 2, 3 << 30), f(1, 5, 6)], 1, 4)[0]["k_min"] == 1
    assert lsm.pick([a, b, c, d], 0, 4) == [b, d] and lsm.pick([d], 1, 4) == []


def test_graph(spark):
    g = open_graph(spark)
    g.add_vertex_label("person")
    g.add_edge_label("knows", "person", "person")
    with g.begin() as x:
        a, b, c = (x.add_vertex("person") for _ in range(3))
        x.put_vertex("person", a, "A")
        x.put_vertex("person", b, "B")
        x.put_edge(a, c, "knows", 1.0)
        x.put_edge(a, b, "knows", 2.0)
        first = x.write_epoch
    with g.begin() as x:
        x.delete_edge(a, c, "knows")
        x.put_edge(a, b, "knows", 5.0)
        x.delete_vertex("person", b)
    assert rows(g.edges(a, "knows")) == [(b, 5.0)] and rows(g.edges(a, "knows", epoch=first)) == [(b, 2.0), (c, 1.0)]
    assert rows(g.edges(a, "knows", lambda p: p > 6)) == [] and rows(g.edge_label_scan("knows")) == [(a, b, 5.0)]
    assert g.get_vertex(b, "person").collect() == [] and rows(g.get_vertex(b, "person", first)) == [("B",)]
    assert g.vertex_num("person") == 3 and g.vertex_label(9) == "" and g.source_label("knows") == "person"
    with pytest.raises(KeyError):
        g.edge_label_id("likes")


def test_dictionary_round_trip(spark):
    df = spark.createDataFrame([("b",), ("a",), ("",), ("b",)], "v string")
    d = dictionary.build(df, "v")
    assert rows(d) == [("", 0), ("a", 1), ("b", 2)]
    assert rows(dictionary.decode(dictionary.encode(df, "v", d), "code", d, "back").select("v", "back")) == [("", ""), ("a", "a"), ("b", "b"), ("b", "b")]
    assert [tuple(r) for r in dictionary.code_range(d, "c", "d").collect()] == [(3, 2)]


def test_sizes_and_bloom(spark):
    assert bloom.sizing(1000) == (9592, 6)
    assert [lsm.rows_per_block(n) for n in (1, 2, 10)] == [204, 170, 73]
    assert [lsm.level_file_limit(n) for n in (1, 2, 3)] == [4, 40, 400] and lsm.bucket_byte_limit(0) == 32 << 20
    assert [profile.p99_index(n) for n in (1, 100, 101)] == [0, 99, 99]
    keys = spark.range(200).select(F.col("id").cast("string").alias("k"))
    asked = spark.range(1200).select(F.col("id").cast("string").alias("k"))
    got = bloom.probe(asked, "k", bloom.build(keys, "k", 200), 200).collect()
    assert all(r.maybe for r in got if int(r.k) < 200) and sum(r.maybe for r in got) < 260


def test_streamed_ingest(spark, tmp_path):
    from lodestrata.streaming.ingest import ingest

    schema = kv_log(["v1"])
    spark.createDataFrame([("a", 1, 0, False, "x"), ("a", 2, 0, False, "y"), ("b", 1, 0, True, None)], schema).write.parquet(str(tmp_path / "in"))
    store = SegmentStore(spark, str(tmp_path / "store"))
    ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(KvTable(spark.createDataFrame([], schema), store=store).scan()) == [("a", "y")]
