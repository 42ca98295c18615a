"""Graphs and vectors: small graphs with known answers, and paths against a plain Dijkstra."""

import heapq
import itertools

import pytest

from tarn.operators import extensions, graph, graph_writes, paths, vectors
from tarn.sources import ingest, store
from tarn.operators.graph import Graph

NODES, EDGES = "id bigint, key string, node_type string, props map<string,string>", "id bigint, src bigint, dst bigint, edge_type string, weight double, props map<string,string>"


def made(spark, nodes: str, edges: list, types=None) -> Graph:
    """nodes as letters; edges as (from, to, type, weight)."""
    number = {k: i for i, k in enumerate(nodes)}
    rows = [(number[a], number[b], *rest) for a, b, *rest in edges]
    return Graph(
        spark.createDataFrame([(i, k, (types or {}).get(k, "t"), {}) for k, i in number.items()], NODES),
        spark.createDataFrame([(i, a, b, *(rest + ["link", 1.0][len(rest) :]), None) for i, (a, b, *rest) in enumerate(rows)], EDGES),
    )


def keys(g, df):
    return sorted(r["key"] for r in g.typed(df.select("id")).collect())


def pair(spark, a, b):
    return spark.createDataFrame([(1, a, b)], "pair int, a bigint, b bigint")


def test_traverse(spark):
    chain = made(spark, "abc", ["ab", "bc"], {"a": "service", "b": "api", "c": "table"})
    hits = chain.typed(graph.traverse(chain, chain.seeds("a"), 5)).orderBy("depth").collect()
    assert [(r["key"], r["node_type"], r["depth"]) for r in hits] == [("a", "service", 0), ("b", "api", 1), ("c", "table", 2)]
    assert keys(chain, graph.traverse(chain, chain.seeds("a"), 5, node_type="table")) == ["a"]  # pruned, not filtered afterwards
    assert keys(chain, graph.traverse(chain, chain.seeds("a"), 5, node_type="nothing")) == ["a", "b", "c"]
    assert keys(chain, graph.traverse(chain, chain.seeds("a"), 0)) == ["a"] and keys(chain, graph.traverse(chain, chain.seeds("c"), 5, graph.IN)) == ["a", "b", "c"]
    assert keys(chain, graph.traverse(chain, chain.seeds("a"), 5, limit=2)) == ["a", "b"]
    with pytest.raises(ValueError):
        chain.arcs("UP")


def test_edge_types(spark):
    g = made(spark, "abc", [("a", "b", "calls"), ("a", "c", "owns")])
    walk = lambda *types: keys(g, graph.traverse(g, g.seeds("a"), 5, edge_types=list(types)))
    assert walk("calls") == ["a", "b"] and walk("calls", "owns") == ["a", "b", "c"] and walk("unknown") == ["a"]


def test_neighbors(spark):
    g = made(spark, "abc", ["ab", "ab", "ac", "cc"])
    near = lambda k, d: keys(g, graph.neighbors(g, g.seeds(k), d))
    assert near("a", graph.OUT) == ["b", "c"] and near("a", graph.IN) == [] and near("c", graph.BOTH) == ["a", "c"]


def test_impact(spark):
    g = made(spark, "rabc", [("r", "a", "depends_on"), ("r", "b", "owns"), ("a", "c", "depends_on")], {"b": "database"})
    total = lambda **o: {r["type_name"]: r["n"] for r in graph.impact(g, g.seeds("r"), **o).collect()}
    assert total() == {"total": 3, "t": 2, "database": 1} and total(edge_types=["depends_on"])["total"] == 2
    assert total(node_types=["database"]) == {"total": 1, "database": 1} and total(edge_types=["none"]) == {"total": 0}


def test_shortest(spark):
    g = made(spark, "abcde", ["ab", "bc", "ad", "dc"])
    got = paths.shortest(g, pair(spark, 0, 2)).first()
    assert (got["hops"], got["path"]) == (2, [0, 1, 2])
    assert paths.shortest(g, pair(spark, 2, 0)).first()["hops"] == 2  # directions are ignored
    assert paths.shortest(g, pair(spark, 1, 1)).first()["path"] == [1] and paths.shortest(g, pair(spark, 0, 4)).count() == 0
    assert paths.shortest(g, pair(spark, 0, 2), 1).count() == 0


def test_lightest(spark):
    g = made(spark, "abc", [("a", "b", "link", 1.0), ("b", "c", "link", 1.0), ("a", "c", "link", 10.0)])
    got = paths.lightest(g, pair(spark, 0, 2)).first()
    assert (got["weight"], got["path"]) == (2.0, [0, 1, 2]) and paths.lightest(g, pair(spark, 2, 0)).count() == 0
    five = made(spark, "abcde", [("a", "b", "link", 1.0), ("b", "c", "link", 2.0), ("a", "c", "link", 10.0), ("c", "d", "link", 1.0), ("d", "e", "link", 1.0), ("a", "e", "link", 20.0)])
    assert paths.lightest(five, pair(spark, 0, 4)).first()["weight"] == 5.0


def test_lightest_like_dijkstra(spark):
    arcs = [(i, (i + 7 * j + 1) % 100, float((3 * i + 5 * j) % 10 + 1)) for i in range(100) for j in range(3)]
    g = Graph(spark.createDataFrame([(i, f"n{i}", "t", {}) for i in range(100)], NODES), spark.createDataFrame([(i, a, b, "link", w, None) for i, (a, b, w) in enumerate(arcs)], EDGES))
    pairs = [(q, 7 * q % 100, (13 * q + 50) % 100) for q in range(50)]
    got = {r["pair"]: r["weight"] for r in paths.lightest(g, spark.createDataFrame(pairs, "pair int, a bigint, b bigint")).collect()}
    for q, a, b in pairs:
        best, heap = {a: 0.0}, [(0.0, a)]
        while heap:
            d, x = heapq.heappop(heap)
            for s, t, w in arcs:
                if s == x and d + w < best.get(t, 1e9):
                    best[t] = d + w
                    heapq.heappush(heap, (d + w, t))
        assert abs(got[q] - best[b]) < 1e-9


def test_paths_to_type(spark):
    g = made(spark, "smex", ["sm", "me", "ex", "xe", "se"], {"e": "deployment", "x": "deployment"})
    found = lambda **o: sorted(r["path"] for r in paths.to_type(g, g.seeds("s"), o.pop("t", "deployment"), **o).collect())
    assert found() == [[0, 1, 2], [0, 2]] and found(limit=1) == [[0, 2]] and found(t="nothing") == [] and found(depth=0) == []


def test_writes(spark):
    g = ingest.empty_graph(spark)
    rows = spark.createDataFrame([(1, "a", "x", {"k": "1", "j": "0"}), (2, "a", "y", {"k": "2"}), (3, "b", "x", {})], "seq int, key string, node_type string, props map<string,string>")
    g = graph_writes.upsert_nodes(g, rows)
    assert {r["key"]: (r["node_type"], r["props"]) for r in g.nodes.collect()} == {"a": ("x", {"k": "2", "j": "0"}), "b": ("x", {})}
    edges = spark.createDataFrame([(1, "a", "b", "l", {"p": "1"}), (2, "a", "b", "l", {"p": "2"}), (3, "a", "c", "l", {})], "seq int, from_key string, to_key string, edge_type string, props map<string,string>")
    g = graph_writes.upsert_edges(g, edges)
    assert sorted((r["edge_type"], r["weight"], r["props"].get("p", "")) for r in g.edges.collect()) == [("l", 1.0, ""), ("l", 1.0, "2")]
    assert graph.list_by_type(g, "unknown").first()["key"] == "c"
    more = spark.createDataFrame([(7, "a", "b", "l", None), (8, "a", "nobody", "l", None)], "id bigint, from_key string, to_key string, edge_type string, weight double")
    assert graph_writes.add_edges(g, more).edges.count() == 3
    assert graph_writes.delete_edges(graph_writes.add_edges(g, more), more).edges.count() == 2
    assert graph.stats(graph_writes.delete_nodes(g, spark.createDataFrame([("a",)], "key string"))).first()[:] == (2, 0)
    sets = spark.createDataFrame([(1, "b", "k", "v"), (1, "nobody", "k", "v")], "seq int, key string, k string, v string")
    assert {r["key"]: r["props"] for r in graph.node(graph_writes.set_properties(g, sets), "b", "nobody").collect()} == {"b": {"k": "v"}}


def test_ingest(spark):
    text = """{"nodes": [{"id": "n1", "node_type": "test", "metadata": {"k": "v1", "n": 5, "b": true}}, {"id": "n2", "type": "test"}, {"type": "lost"}],
    "edges": [{"from_id": "n1", "to_id": "n2", "edge_type": "linked"}, {"from": "n2", "to": "n3", "type": "linked"}, {"from": "n2"}]}"""
    g = ingest.ingest(ingest.empty_graph(spark), spark.createDataFrame([(1, text), (2, "not json")], "seq int, json string"))
    assert {r["key"]: (r["node_type"], r["props"]) for r in g.nodes.collect()} == {"n1": ("test", {"k": "v1"}), "n2": ("test", {}), "n3": ("unknown", {})}
    assert keys(g, graph.neighbors(g, g.seeds("n1"))) == ["n2"] and g.edges.count() == 2


def test_compacted(spark):
    g = made(spark, "abc", ["ab", "bc"])
    assert keys(g, graph.traverse(graph.compacted(g, "tarn_test_edges", 4), g.seeds("a"), 5)) == ["a", "b", "c"]


def test_extensions(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in extensions.components(chain).collect()}
    assert {got[i] for i in range(201)} == {0} and got[901] == 900 and extensions.components(chain.where("false")).count() == 0
    shared = spark.createDataFrame([(i, v) for v, ids in {"x": [1, 2], "y": [1, 2, 3], "z": range(60)}.items() for i in ids], "id int, value string")
    assert sorted(map(tuple, extensions.cooccurrence(shared).collect())) == [(1, 2, 2.0), (1, 3, 1.0), (2, 3, 1.0)]
    g = made(spark, "abc", ["ab", "bc", "ca"])
    assert all(abs(r["rank"] - 1 / 3) < 1e-9 for r in extensions.pagerank(g, 3).collect())
    memories = spark.createDataFrame([(1, [1.0, 0.0], 1.0, 1023, 0), (2, [1.0, 0.0], 1.0, 1023, 1000)], "memory int, vec array<double>, importance double, uses int, at_ms bigint")
    assert [(r["memory"], round(r["score"], 6)) for r in extensions.recall(memories, [2.0, 0.0], 1000, 5, 1000.0).collect()] == [(2, 1.0), (1, 0.5)]
    assert [r["memory"] for r in extensions.decayed(memories, 1000, 1000.0, 0.6).collect()] == [2]


def embedded(spark, *vecs):
    return spark.createDataFrame([(i, "emb", list(map(float, v))) for i, v in enumerate(vecs)], "node_id bigint, field string, vec array<float>")


def test_vector_search(spark):
    ten = embedded(spark, (1, 0, 0), (0.9, 0.1, 0), (0, 1, 0), (0, 0, 1), (0.5, 0.5, 0), (0.7, 0.7, 0), (0.1, 0.9, 0), (0, 0.1, 0.9), (0.8, 0.2, 0), (0.3, 0.3, 0.3))
    assert [r["node_id"] for r in vectors.nearest(ten, [1, 0, 0], 3).collect()] == [0, 1, 8]
    assert vectors.nearest(ten.where("false"), [1, 0, 0], 3).count() == 0
    queries = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (9, [0.0, 0.0, 1.0])], "query bigint, vec array<double>")
    got = vectors.nearest_many(ten, queries, 2).orderBy("query", "rank").collect()
    assert [(r["query"], r["node_id"], r["rank"]) for r in got] == [(7, 0, 1), (7, 1, 2), (9, 3, 1), (9, 7, 2)]
    assert vectors.nearest_many(ten, queries.where("false"), 2).count() == 0


def test_vector_writes(spark):
    new = spark.createDataFrame([(1, 0, "emb", [3.0, 4.0]), (2, 1, "emb", [1.0]), (3, 0, "emb", [0.0, 5.0])], "seq int, node_id bigint, field string, vec array<double>")
    held = graph_writes.set_vectors(spark.createDataFrame([], "node_id bigint, field string, vec array<float>"), new)
    assert [(r["node_id"], r["vec"]) for r in held.collect()] == [(0, [0.0, 1.0])]  # another dimension is left out


def test_retrieve(spark):
    g = Graph(
        spark.createDataFrame([(0, "doc:1", "document", {"t": "x"}), (1, "doc:2", "document", {}), (2, "topic:ai", "topic", {})], NODES),
        spark.createDataFrame([(0, 0, 2, "about", 1.0, None)], EDGES),
    )
    found = vectors.retrieve(g, embedded(spark, (1, 0, 0), (0, 1, 0)), [0.9, 0.1, 0], 2).orderBy("score", ascending=False).collect()
    assert [(r["key"], r["neighbors"]) for r in found] == [("doc:1", ["topic:ai"]), ("doc:2", [])] and found[0]["score"] > 0.5 and found[0]["props"] == {"t": "x"}
    assert all(r["neighbors"] == [] for r in vectors.retrieve(g, embedded(spark, (1, 0, 0), (0, 1, 0)), [0.9, 0.1, 0], 2, depth=0).collect())
    assert [r["key"] for r in vectors.retrieve(Graph(g.nodes.where("id > 0"), g.edges), embedded(spark, (1, 0, 0), (0, 1, 0)), [1, 0, 0], 2).collect()] == ["doc:2"]
    assert vectors.subgraph(g, g.nodes.select("id")).count() == 1


def test_snapshot(spark, tmp_path):
    g = made(spark, "ab", [("a", "b", "reads", 1.5)])
    folder = str(tmp_path)
    store.save({"nodes": g.nodes, "edges": g.edges}, folder, 1)
    store.save({"nodes": g.nodes.where("id = 0"), "edges": g.edges}, folder, 2)
    assert store.last_save(spark, folder)["at_ms"] == 2
    back = store.load(spark, folder)
    assert back["nodes"].count() == 1 and back["edges"].first()["weight"] == 1.5


def test_log_compaction(spark, tmp_path):
    from tarn.operators import kv

    rows = [(i, i, 0, k, op, v, d, t) for i, (k, op, v, d, t) in enumerate([("a", "SET", "1", None, 90), ("a", "INCRBY", None, 4, None), ("b", "SET", "x", None, 50), ("c", "SET", "y", None, None), ("c", "DEL", None, None, None)])]
    log = spark.createDataFrame(rows, "seq bigint, ts_ms bigint, db int, key string, op string, value string, delta bigint, ttl_ms bigint")
    store.append(log, str(tmp_path / "log"))
    short = store.compact(spark.read.parquet(str(tmp_path / "log")), 9)
    assert short.count() == 2
    assert sorted(map(tuple, kv.final_state(kv.replay(short)).collect())) == sorted(map(tuple, kv.final_state(kv.replay(log)).collect())) == [(0, "a", "5", None), (0, "b", "x", 52)]
    assert list(itertools.chain(short.columns)) == log.columns


@pytest.mark.parametrize("few", ["a", "b"])
def test_lightest_of_pairs_that_share_ends(spark, few):
    """Weight and path, ties included, as all paths give them; whichever end is shared."""
    arcs = [(i, (i * j + j + 1) % 15, float((i + j) % 3) / 2) for i in range(13) for j in range(4)] + [(2, 3, 0.5), (2, 3, 4.0), (3, 2, 0.0)]
    g = Graph(spark.createDataFrame([(i, f"n{i}", "t", {}) for i in range(15)], NODES), spark.createDataFrame([(i, a, b, "link", w, None) for i, (a, b, w) in enumerate(arcs)], EDGES))
    pairs = [(100 * x + y, *((y, x) if few == "b" else (x, y))) for x in (3, 9, 99) for y in range(16)] + [(7, 1, 2), (7, 2, 1)]
    want = {}
    for q, a, b in pairs:
        best, level = {a: (0.0, 1, [a])}, [a]
        while level:
            found = set()
            for s, t, w in arcs:
                if s in level and (way := (best[s][0] + w, best[s][1] + 1, [*best[s][2], t])) < best.get(t, (1e9,)):
                    best[t] = way
                    found.add(t)
            level = found
        if b in best and max(a, b) < 15:
            want[q] = min(best[b], want.get(q, best[b]))
    got = paths.lightest(g, spark.createDataFrame(pairs, "pair int, a bigint, b bigint")).collect()
    assert {r["pair"]: (r["weight"], len(r["path"]), r["path"]) for r in got} == want and len(got) == len(want) > 20


def test_lightest_walks_once_for_a_shared_end(spark, monkeypatch):
    rows = []

    def counted(df, name, write=paths.durable):
        out = write(df, name)
        rows.append(out.count() if name == "lighter" else 0)
        return out

    monkeypatch.setattr(paths, "durable", counted)
    names = "abcdefghijklmnopqrstuvwxyz"
    tail = [("w", "x", "link", 0.1), ("x", "y", "link", 0.2), ("y", "z", "link", 0.3)]
    g = made(spark, names, [(c, "w", "link", 0.0) for c in names[1:22]] + tail + [(c, "a", "link", 1.0) for c in names[1:22]])
    got = paths.lightest(g, spark.createDataFrame([(i, i, 25) for i in range(22)], "pair int, a bigint, b bigint")).collect()
    assert [(r["weight"], r["path"]) for r in sorted(got)] == [(0.1 + 0.2 + 0.3, [i, 22, 23, 24, 25]) for i in range(1, 22)]
    assert sum(rows) == 25  # a row per node on the way, not one per pair and node
    rows.clear()
    got = paths.lightest(g, spark.createDataFrame([(i, 22, i) for i in range(22, 26)], "pair int, a bigint, b bigint")).collect()
    assert len(got) == 4 and sum(rows) == 4


def test_negative_weights_raise(spark):
    g = made(spark, "ab", [("a", "b", "link", -1.0), ("b", "a", "link", -1.0)])
    with pytest.raises(ValueError):
        paths.lightest(g, pair(spark, 0, 1))


def test_nodes_are_added_once(spark):
    g = made(spark, "ab", ["ab"])
    rows = spark.createDataFrame([(1, "a", "x", {}), (2, "new", "first", {"p": "1"}), (3, "new", "second", {})], "seq int, key string, node_type string, props map<string,string>")
    more, refused = graph_writes.add_nodes(g, rows)
    assert {(r["key"], r["node_type"]) for r in more.nodes.collect()} == {("a", "t"), ("b", "t"), ("new", "first")}
    assert sorted((r["seq"], r["key"]) for r in refused.collect()) == [(1, "a"), (3, "new")]


def test_edge_properties(spark):
    g = made(spark, "abc", ["ab", "bc"])
    rows = spark.createDataFrame([(1, 0, "k", "old"), (2, 0, "k", "new"), (1, 99, "k", "none")], "seq int, id bigint, k string, v string")
    assert {r["id"]: r["props"] for r in graph_writes.set_edge_properties(g, rows).edges.collect()} == {0: {"k": "new"}, 1: None}


def test_vectors_go_with_their_nodes(spark):
    g = made(spark, "ab", ["ab"])
    kept = graph_writes.delete_vectors(g, embedded(spark, (1, 0), (0, 1)), spark.createDataFrame([("a",)], "key string"))
    assert [r["node_id"] for r in kept.collect()] == [1]


def test_index_is_read_again(spark, tmp_path):
    rows = embedded(spark, *((float(i % 7 - 3), float(i % 5 - 2), float(i % 3 + 1)) for i in range(60)))
    vectors.save_index(vectors.approximate_index(rows, 3, tables=24), str(tmp_path))
    found = vectors.approximate_nearest_many(vectors.load_index(spark, str(tmp_path)), rows.where("node_id < 3").selectExpr("node_id query", "vec"), 1, together=3)
    assert {r["query"]: round(r["score"], 6) for r in found.collect()} == {0: 1.0, 1: 1.0, 2: 1.0}


def test_shortest_writes_no_level_of_pairs_that_met(spark, monkeypatch):
    """Two hops over 40 shared nodes, by parallel edges too: only one level of each pair's is needed, none is written."""
    rows = {}
    monkeypatch.setattr(paths, "durable", lambda df, name, write=paths.durable: rows.setdefault(name, []).append((out := write(df, name)).count()) or out)
    mid = [f"m{i:02}" for i in range(40)]
    nodes = ["a", "b", "c", *mid]
    edges = [(x, m, "link", 1.0) for x in ("a", "b") for m in mid for _ in range(2)] + [("m07", "c", "link", 1.0)]
    got = paths.shortest(made(spark, nodes, edges), spark.createDataFrame([(1, 0, 1), (2, 0, 2)], "pair int, a bigint, b bigint")).collect()
    assert sorted((r["pair"], r["hops"], r["path"]) for r in got) == [(1, 2, [0, 3, 1]), (2, 2, [0, 10, 2])]
    assert sum(rows["side"]) == 4  # the ends


def test_scores_are_held_in_blocks():
    """Few rows of scores at a time, however many queries and vectors there are; ties go to the least id."""
    import tracemalloc

    import numpy as np

    unit = vectors.unit_rows(np.random.default_rng(1).normal(size=(20_000, 8)))
    unit[7000:7020] = unit[3]
    tracemalloc.start()
    row, node, score = vectors.nearest_rows(unit[:600], unit, np.arange(20_000)[::-1], 5)
    assert tracemalloc.get_traced_memory()[1] < 100e6  # all scores at once are 96 MB, and sorting them takes as much again
    tracemalloc.stop()
    exact = unit[:600] @ unit.T
    assert np.allclose(np.sort(score.reshape(600, 5), axis=1), np.sort(exact, axis=1)[:, -5:])
    assert len(set(node[row == 3])) == 5 and set(node[row == 3]) <= {12_980 + i for i in range(20)} | {19_996}


def test_approximate_search_shuffles_no_pairs(spark):
    """All rows in one bucket: what meets there is k rows a query, not every pair."""
    rows = embedded(spark, *((1.0, i / 1000, 0.0) for i in range(300)))
    found = vectors.approximate_nearest_many(vectors.approximate_index(rows, 3, tables=4, bucket=50.0), rows.selectExpr("node_id query", "vec"), 2)
    assert {r["query"] for r in found.where("query = node_id").collect()} == set(range(300)) and found.count() == 600
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_pagerank_meets_roots_once(spark, monkeypatch):
    """Ranks like a plain loop's, over roots, sinks, a lone node, parallel edges and a loop; roots' ranks are not written each round."""
    written = []
    monkeypatch.setattr(extensions, "durable", lambda df, name, write=extensions.durable: written.append((name, (out := write(df, name)).count())) or out)
    arcs = ["ab", "ab", "ac", "bc", "cb", "cd", "ee", "fe", "gf"]
    nodes = "abcdefghij"
    got = {r["id"]: r["rank"] for r in extensions.pagerank(made(spark, nodes, arcs), 3).collect()}
    rank = {x: 0.1 for x in nodes}
    for _ in range(3):
        lost = sum(r for x, r in rank.items() if not any(a[0] == x for a in arcs))
        rank = {x: 0.015 + 0.85 * (lost / 10 + sum(rank[a[0]] / sum(b[0] == a[0] for b in arcs) for a in arcs if a[1] == x)) for x in nodes}
    assert len(got) == 10 and all(abs(got[i] - rank[x]) < 1e-12 for i, x in enumerate(nodes))
    assert [n for name, n in written if name == "ranks"] == [5, 5, 5]


def test_shortest_walks_shared_nodes_once(spark, monkeypatch):
    """Pairs that meet four hops on, over two nodes with many leaves: what is walked is no product of pairs and leaves."""
    monkeypatch.setattr(paths, "BROADCAST_ROWS", 100)
    walked = []
    monkeypatch.setattr(paths, "dealt", lambda df, keys, rows, deal=paths.dealt: walked.append(df.count()) or deal(df, keys, rows))
    n, leaves = 30, [f"l{i}" for i in range(400)]
    nodes = ["r", "n", "m", "x", *leaves, *(f"{c}{i}" for c in "abpq" for i in range(n)), "c", "d", "u", "v", "w"]
    edges = [("n", "r"), ("m", "r"), *((leaf, "nm"[i % 2]) for i, leaf in enumerate(leaves))]
    edges += [e for i in range(n) for e in ((f"a{i}", "n"), (f"b{i}", "m"), (f"a{i}", f"p{i}"), (f"b{i}", f"q{i}"))]
    edges += [("c", "x"), ("c", "u"), ("u", "v"), ("v", "w"), ("w", "d")]  # c's least neighbour leads nowhere
    at = {name: i for i, name in enumerate(nodes)}
    pairs = [(i, at[f"a{i}"], at[f"b{i}"]) for i in range(n)] + [(n, at["c"], at["d"]), (n + 1, at["c"], at["r"])]
    got = paths.shortest(made(spark, nodes, [(*e, "link", 1.0) for e in edges]), spark.createDataFrame(pairs, "pair int, a bigint, b bigint"), 4)
    expected = [(i, 4, [at[f"a{i}"], at["n"], at["r"], at["m"], at[f"b{i}"]]) for i in range(n)] + [(n, 4, [at[x] for x in "cuvwd"])]
    assert sorted((r["pair"], r["hops"], r["path"]) for r in got.collect()) == expected
    assert max(walked) <= 2 * len(edges)  # pair by pair, each side's step alone is 30 times 200 leaves
    assert not spark.sql("SHOW TABLES").where("tableName like 'arcs_%'").count()


@pytest.mark.parametrize("few", [0, 500_000])
def test_shortest_like_breadth_first(spark, monkeypatch, few):
    """Broadcast or not, walked for each pair or once for all: the least of the shortest paths."""
    from tarn.plans import durable

    monkeypatch.setattr(durable, "BROADCAST_ROWS", few)
    monkeypatch.setattr(paths, "BROADCAST_ROWS", few)
    names = [f"n{i}" for i in range(70)]
    edges = [(i, (i * i + 7 * j + 1) % 64) for i in range(64) for j in range(1 + (i % 3 == 0))] + [(3, i) for i in range(20, 60, 4)] + [(66, 67)] * 2
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(70)}
    pairs = [(q, 5 * q % 70, (11 * q + 33) % 70) for q in range(60)]
    expected = []
    for q, a, b in pairs:
        level, seen = {a: [a]}, {a}
        for hops in range(6):
            if b in level:
                expected.append((q, hops, level[b]))
                break
            following = {}
            for x, path in level.items():
                for y in near[x] - seen:
                    following[y] = min(following.get(y, [99]), [*path, y])
            level, seen = following, seen | set(following)
    got = paths.shortest(made(spark, names, [(names[a], names[b], "link", 1.0) for a, b in edges]), spark.createDataFrame(pairs, "pair int, a bigint, b bigint"), 5)
    assert sorted((r["pair"], r["hops"], r["path"]) for r in got.collect()) == expected
    assert len({hops for _, hops, _ in expected}) > 3
