"""What a task holds is a share of counted rows, not of a file or of a fixed number of tasks."""

from test_graphs import made

from tarn.operators import graph, graph_writes, sets
from tarn.plans import durable
from tarn.sources import domain as D


def dealt_to(df):
    """The plan with its deals by count, none of which is aggregated before."""
    return df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM")


def test_sets_added(spark, monkeypatch):
    monkeypatch.setattr(durable, "TASK_ROWS", 10)
    rows = spark.range(100).selectExpr("0 db", "concat('k', id % 5) key", "id % 20 member")
    more = sets.added(rows, rows)
    assert more.rdd.getNumPartitions() == 20 and more.count() == 20


def test_set_members(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(durable, "TASK_ROWS", 1_000)
    members = D.set_members(spark, sf_dir)
    assert members.rdd.getNumPartitions() >= 5 and dealt_to(sets.cardinalities(members)) == 1


def test_edges_deleted(spark, monkeypatch):
    monkeypatch.setattr(durable, "TASK_ROWS", 1)
    g = made(spark, "abc", ["ab", "bc", "ca", "ab", "cb", "ba"])
    kept = graph_writes.delete_edges(g, g.edges.where("src = 0").select("id"))
    assert dealt_to(kept.edges) == 1 and kept.edges.count() == 4


def test_stats(spark, monkeypatch):
    monkeypatch.setattr(durable, "TASK_ROWS", 1)
    g = made(spark, "abc", ["ab", "bc", "ca", "ab", "cb", "ba"])
    found = graph.stats(graph.Graph(g.nodes.where("id < 2"), g.edges))
    assert dealt_to(found) == 2 and found.first()[:] == (2, 3)


def test_levels(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "durable", lambda df, name, write=graph.durable: plans.append((name, dealt_to(df))) or write(df, name))
    g = made(spark, "abcd", ["ab", "bc", "cd", "ab"])
    assert graph.traverse(g, g.seeds("a"), 3).count() == 4
    assert [n for name, n in plans if name == "level"][1:] == [1, 1, 1]
