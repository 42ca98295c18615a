"""Paths: shortest by hops, lightest by weight, and enumeration of simple paths; for many pairs or starts in one plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import BROADCAST_ROWS, bucketed, dealt, durable, hinted, tasks
from .graph import OUT, Graph


def spread(arcs: DataFrame, frontier: DataFrame, n: int, rows: int, forward: bool, first: bool) -> DataFrame:
    """The next level (pair, id, path) of a breadth-first walk: the least path of every node it steps on. rows: about how many
    steps there are. The first level's paths follow from their ends, so numbers are aggregated, not arrays."""
    step = arcs.join(hinted(frontier.withColumnRenamed("id", "src"), n), "src")
    if first:
        step = dealt(step.select("pair", F.col("dst").alias("id"), "src"), ["pair", "id"], rows).groupBy("pair", "id").agg(F.min("src").alias("src"))
        return step.select("pair", "id", F.array(*(("src", "id") if forward else ("id", "src"))).alias("path"))
    path = F.concat("path", F.array("dst")) if forward else F.concat(F.array("dst"), "path")
    step = step.select("pair", F.col("dst").alias("id"), path.alias("path"))
    return dealt(step, ["pair", "id"], rows).groupBy("pair", "id").agg(F.min("path").alias("path"))


def living(graph: Graph, pairs: DataFrame, n: int) -> DataFrame:
    """Of n pairs (pair, a, b) those whose ends are both nodes."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    alive = durable(graph.nodes.select("id").join(hinted(ends, 2 * n), "id", "left_semi").distinct(), "ends")
    return pairs.join(hinted(alive.toDF("a"), 2 * n), "a", "left_semi").join(hinted(alive.toDF("b"), 2 * n), "b", "left_semi")


class Arcs:
    """A graph's edges, walked both ways as src, dst. They are written once, unshuffled; a frontier too large to be broadcast meets
    them in a table bucketed by source, which is made when it is first needed, so that they stay put. `close` drops it."""

    def __init__(self, graph: Graph):
        one_way = durable(graph.edges.select("src", "dst").where("src <> dst"), "arcs")  # read every round; a loop is on no path
        self.n = 2 * one_way.count()
        self.plain = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        self.table, self.by_src = f"arcs_{uuid.uuid4().hex}", None

    def near(self, n: int) -> DataFrame:
        """The arcs for a frontier of n rows."""
        if n <= BROADCAST_ROWS:
            return self.plain
        if self.by_src is None:
            buckets = tasks(self.plain.sparkSession, self.n)
            self.by_src = bucketed(self.plain.repartition(buckets, "src").distinct(), self.table, buckets, "src")
        return self.by_src

    def steps(self, frontier: DataFrame, n: int) -> int:
        """Steps from a frontier (id) of n rows, counted without making them."""
        at = frontier.groupBy(F.col("id").alias("src")).agg(F.count("*").alias("n"))
        return self.near(n).join(hinted(at, n), "src").agg(F.sum("n")).first()[0] or 0

    def between(self, a: DataFrame, n_a: int, b: DataFrame, n_b: int) -> tuple[DataFrame, int]:
        """The arcs from nodes of a to nodes of b (ids, of n rows each), and how many."""
        arcs = self.near(n_a).join(hinted(a.select(F.col("id").alias("src")).distinct(), n_a), "src", "left_semi")
        arcs = durable(arcs.join(hinted(b.select(F.col("id").alias("dst")).distinct(), n_b), "dst", "left_semi").select("src", "dst"), "between")
        return arcs, arcs.count()

    def close(self) -> None:
        if self.by_src is not None:
            self.plain.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def whole_paths(ahead: DataFrame, rest: DataFrame) -> DataFrame:
    """The least path of each pair where what is walked from its two ends (pair, id, path) meets."""
    met = ahead.join(rest.withColumnRenamed("path", "rest"), ["pair", "id"])
    return met.groupBy("pair").agg(F.min(F.concat("path", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))))).alias("path"))


def over_one_node(arcs: Arcs, a: DataFrame, b: DataFrame, n_a: int, n_b: int, first: tuple[bool, bool]) -> DataFrame:
    """pair, path of the pairs whose frontiers a and b (pair, id, path) are two steps apart: the least path of each.

    Both are walked one step on, pair by pair, while that is no more steps than there are arcs. Where pairs meet at nodes that
    many of them share, it could be the square of that; then the least rows of each pair's a are tried first, as any path on
    from them is less than all others. Two steps are walked from each different one of their nodes, once for all pairs, and
    only pairs that don't get to their b so try their next rows, eight times as many.
    """
    found, tried, width = [], 0, 1
    while True:
        steps = (arcs.steps(a, n_a), arcs.steps(b, n_b))
        if sum(steps) > max(arcs.n, BROADCAST_ROWS):
            rank = F.row_number().over(Window.partitionBy("pair").orderBy("path"))
            batch = durable(a.withColumn("rank", rank).where(F.col("rank") <= tried + width).where(F.col("rank") > tried), "tried")
            n = batch.count()
            roots = durable(batch.select("id").distinct(), "roots")
            n_roots = roots.count()
            once = arcs.near(n_roots).join(hinted(roots.toDF("src"), n_roots), "src").select(F.col("src").alias("root"), F.col("dst").alias("id"))
            n_once = arcs.steps(roots, n_roots)
            shared = arcs.steps(once, n_once)
        if sum(steps) <= max(arcs.n, BROADCAST_ROWS) or not n or shared + width * n_b >= sum(steps):
            ahead = [spread(arcs.near(n), rows, n, many, i == 0, first[i]) for i, (rows, n, many) in enumerate(zip((a, b), (n_a, n_b), steps))]
            found.append(whole_paths(*ahead))
            break
        twice = arcs.near(n_once).join(hinted(once.withColumnRenamed("id", "src"), n_once), "src").select("root", F.col("dst").alias("id"), F.col("src").alias("over"))
        twice = dealt(twice, ["root", "id"], shared).groupBy("root", "id").agg(F.min("over").alias("over"))
        asked = b.select("pair", "id").join(hinted(batch.select("pair", "rank", F.col("id").alias("root")), n), "pair")
        least = F.min(F.struct("rank", "over", "id")).alias("least")  # what is ranked by its path, and a path to b that begins with id
        met = durable(asked.join(twice, ["root", "id"]).groupBy("pair").agg(least).select("pair", "least.*"), "least")
        n = met.count()
        met = b.withColumnRenamed("path", "rest").join(hinted(met, n), ["pair", "id"]).select("pair", "rank", "over", "rest")
        met = durable(batch.select("pair", "rank", "path").join(hinted(met, n), ["pair", "rank"]).select("pair", F.concat("path", F.array("over"), "rest").alias("path")), "met")
        found.append(met)
        a, b = (rows.join(hinted(met.select("pair"), n), "pair", "left_anti") for rows in (a, b))
        n_a, n_b = a.count(), b.count()
        if not n_a or not n_b:
            break
        tried, width = tried + width, 8 * width
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def shortest(graph: Graph, pairs: DataFrame, max_depth: int = 20) -> DataFrame:
    """pairs (pair, a, b) -> pair, hops, path (ids) of a shortest path of at most max_depth hops, directions ignored.

    Both ends are walked towards each other, the side with the smaller frontier first; pairs that met, or have one side
    used up, drop out. Of several shortest paths the one with the least ids in order is returned. a = b is a path of one node.

    A new level, often by far the largest, is first only met with the other side's: over the arcs from one to the other, or
    over the nodes next to both. What is written of it are the nodes of pairs that are still apart once it has to be walked
    on, or both sides' new levels have met.
    """
    arcs = Arcs(graph)
    try:
        return met_in_the_middle(arcs, living(graph, pairs, pairs.count()), max_depth)
    finally:
        arcs.close()


def met_in_the_middle(arcs: Arcs, live: DataFrame, max_depth: int) -> DataFrame:
    """`shortest` for pairs of nodes. The result reads nothing but what was written, so the arcs can be closed."""
    written = [durable(live.select("pair", F.col(c).alias("id"), F.array(c).alias("path")), "side") for c in ("a", "b")]
    seen, depth, ahead = [*written], [0, 0], [False, False]  # ahead: the side's level is one step on from what is written
    sizes = [s.count() for s in written]
    counts, passed = [*sizes], [*sizes]  # rows written of the level, of all levels
    hops, found = 0, None

    def step_on(i: int, over: DataFrame, steps: int) -> DataFrame:
        return spread(over, written[i], counts[i], steps, i == 0, depth[i] == 0)

    while True:
        # a node of an earlier level can't meet: its pair would have met earlier
        if all(ahead):
            whole = over_one_node(arcs, *written, *counts, (depth[0] == 0, depth[1] == 0))
        elif any(ahead):
            i = ahead.index(True)
            to, n = arcs.between(written[i], counts[i], written[1 - i], counts[1 - i])
            ways = [written[j] if j != i else step_on(i, to, min(n * counts[i], sizes[i])) for j in (0, 1)]
            whole = whole_paths(*ways) if n else None
        else:
            whole = whole_paths(*written)
        n = 0
        if whole is not None:
            whole = durable(whole.select("pair", F.lit(hops).alias("hops"), "path"), "met")
            found = whole if found is None else found.unionByName(whole)
            n = whole.count()
        if hops == max_depth:
            return found
        if n:
            written = [w.join(hinted(whole.select("pair"), n), "pair", "left_anti") for w in written]
            counts = [w.count() for w in written]
            sizes = [arcs.steps(w, c) if a and c else c for w, c, a in zip(written, counts, ahead)]
        if not all(sizes):
            return found
        i = int(sizes[1] < sizes[0])
        for j in [j for j in (0, 1) if ahead[j] and (ahead[1 - j] or i == j)]:
            fresh = step_on(j, arcs.near(counts[j]), sizes[j]).join(hinted(seen[j].select("pair", "id"), passed[j]), ["pair", "id"], "left_anti")
            written[j], ahead[j], depth[j] = durable(fresh, "side"), False, depth[j] + 1
            counts[j] = sizes[j] = written[j].count()
            seen[j], passed[j] = seen[j].unionByName(written[j]), passed[j] + counts[j]
        if not all(sizes):
            return found
        i = int(sizes[1] < sizes[0]) if not any(ahead) else i
        ahead[i], sizes[i] = True, arcs.steps(written[i], counts[i])
        hops += 1


def stepped(arcs: DataFrame, frontier: DataFrame, n: int, edges: int) -> int:
    """Steps from a frontier of n rows: counted while it can be broadcast, else an estimate."""
    if n > BROADCAST_ROWS:
        return max(2 * edges, n)
    return arcs.join(hinted(frontier.select(F.col("id").alias("src")), n), "src").count()


def lightest(graph: Graph, pairs: DataFrame, edge_types: list[str] | None = None) -> DataFrame:
    """pairs (pair, a, b) -> pair, weight, path of a lightest directed path; a negative weight is an error.

    Pairs share what is walked: a walk has its root in each different a or, if these are fewer, in each different b, from
    where edges are walked backwards and only among those that some a leads to. Rounds of relaxation: only rows that got
    lighter are walked on and written, none that is heavier than the best paths of all its root's pairs, and none at a node
    that leads nowhere and ends no pair of the root. Of equally light paths the one with fewer nodes, then the least ids, is
    returned. Weights are compared as summed up from the root; the one returned is summed up from a.
    """
    arcs = durable(graph.arcs(OUT, edge_types).select("src", "dst", "weight"), "arcs")  # read every round
    if not arcs.where("weight < 0").isEmpty():
        raise ValueError("lightest paths need weights of 0 or more")
    live = durable(living(graph, pairs, pairs.count()), "pairs")
    of = {c: live.select(F.col(c).alias("id")).distinct() for c in ("a", "b")}
    many = {c: ids.count() for c, ids in of.items()}
    forward = many["a"] <= many["b"]
    root, end = ("a", "b") if forward else ("b", "a")
    ahead = None  # the nodes to walk on from; forwards, the others are not known beforehand
    if not forward:
        arcs, ahead = reached(arcs, of["a"], many["a"])
        arcs = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    edges, n_ahead = arcs.count(), ahead.count() if ahead else 0
    asked = durable(live.select(F.col(root).alias("root"), F.col(end).alias("id")).distinct(), "asked")
    roots = durable(asked.groupBy("root").agg(F.count("*").alias("asked_ids"), F.max(F.col("id") == F.col("root")).alias("asked")), "roots")
    n_asked, n_roots = asked.count(), many[root]

    def marked(rows: DataFrame) -> DataFrame:
        """Rows that are walked on or end a pair."""
        if ahead is None:
            return rows.withColumn("on", F.lit(True))
        return rows.join(hinted(ahead.withColumn("on", F.lit(True)), n_ahead), "id", "left").where("on or asked")

    cost = F.struct(F.lit(0.0).alias("weight"), F.lit(1).alias("n"), F.array("root").alias("path"), F.array().cast("array<double>").alias("steps"))
    lighter = durable(marked(roots.select("root", F.col("root").alias("id"), cost.alias("cost"), "asked")), "lighter")
    best, written, hops = lighter, 0, 0  # what every round wrote: a node's cost is the least of its rows
    while True:
        more, n = lighter.agg(F.count("*"), F.count_if("on")).first()
        if not n:
            break
        written, hops = written + more, hops + 1
        found = best.where("asked").groupBy("root", "id").agg(F.min("cost.weight").alias("weight"))
        found = found.groupBy("root").agg(F.count("*").alias("asked_ids"), F.max("weight").alias("bound"))
        bound = roots.join(found, ["root", "asked_ids"]).select("root", "bound")  # of roots whose pairs all have a path
        walk = lighter.where("on").join(hinted(bound, n_roots), "root", "left").where("bound is null or cost.weight <= bound")
        wide = n * (1 + hops // 4)  # paths grow
        step = arcs.join(hinted(walk.select("root", F.col("id").alias("src"), "cost", "bound"), wide), "src")
        # all paths to a node get the same id added, so they are compared without
        way = F.struct((F.col("cost.weight") + F.col("weight")).alias("weight"), F.col("cost.n").alias("n"), F.col("cost.path").alias("path"), F.col("cost.steps").alias("steps"), F.col("weight").alias("last"))
        step = step.select("root", F.col("dst").alias("id"), way.alias("way"), "bound").where("bound is null or way.weight <= bound").drop("bound")
        rows = step.unionByName(best.select("root", "id", F.col("cost").alias("old")), True).unionByName(asked.withColumn("asked", F.lit(True)), True)
        steps = stepped(arcs, walk, wide, edges)
        rows = dealt(rows, ["root", "id"], steps + written + n_asked).groupBy("root", "id").agg(F.min("way").alias("way"), F.min("old").alias("old"), F.coalesce(F.max("asked"), F.lit(False)).alias("asked"))
        path = F.concat("way.path", F.array("id")) if forward else F.concat(F.array("id"), "way.path")
        steps = F.col("way.steps") if forward else F.concat(F.array("way.last"), "way.steps")
        cost = F.struct(F.col("way.weight").alias("weight"), (F.col("way.n") + 1).alias("n"), path.alias("path"), steps.alias("steps"))
        rows = rows.where("way is not null").select("root", "id", cost.alias("cost"), "old", "asked").where("old is null or cost < old")
        lighter = durable(marked(rows.drop("old")), "lighter")
        best = best.unionByName(lighter)
    ends = best.where("asked").groupBy(F.col("root").alias(root), F.col("id").alias(end)).agg(F.min("cost").alias("cost"))
    weight = F.col("cost.weight") if forward else F.aggregate("cost.steps", F.lit(0.0), lambda total, x: total + x)
    cost = F.struct(weight.alias("weight"), F.col("cost.n").alias("n"), F.col("cost.path").alias("path"))
    return live.join(ends, ["a", "b"]).groupBy("pair").agg(F.min(cost).alias("cost")).select("pair", "cost.weight", "cost.path")


def reached(arcs: DataFrame, starts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The arcs that n starting nodes (id) lead to, each written once with its source's level; and the nodes at their heads."""
    level = durable(starts, "level")
    seen, passed, found, heads = level, n, None, None
    while n:
        out = durable(arcs.join(hinted(level.toDF("src"), n), "src", "left_semi"), "out")
        fresh = dealt(out.select(F.col("dst").alias("id")), ["id"], out.count()).distinct()
        fresh = durable(fresh.join(hinted(seen.withColumn("seen", F.lit(True)), passed), "id", "left"), "heads")
        found, heads = (out, fresh) if found is None else (found.unionByName(out), heads.unionByName(fresh))
        level = fresh.where("seen is null").select("id")
        n = level.count()
        seen, passed = seen.unionByName(level), passed + n
    return found, durable(heads.select("id").distinct(), "heads")


def to_type(graph: Graph, seeds: DataFrame, node_type: str, depth: int = 10, edge_types: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Simple directed paths from each seed (seed, id) to the first node of a type: seed, hops, path.

    A path ends at the first node of the type; the seed is no target; parallel edges make paths of their own. At most
    `limit` paths a seed, the shortest, of equal length those with the least ids; a seed with enough paths is walked no further.
    """
    targets = graph.nodes.where(F.col("node_type") == node_type).select(F.col("id").alias("dst"), F.lit(True).alias("_hit"))
    arcs = durable(graph.arcs(OUT, edge_types).select("src", "dst").join(targets, "dst", "left"), "arcs")  # read every round
    open_ = durable(seeds.select("seed", "id", F.array("id").alias("path")), "open")
    found = None
    for hops in range(1, depth + 1):
        n = open_.count()
        if not n:
            break
        step = arcs.join(hinted(open_.withColumnRenamed("id", "src"), n), "src").where(~F.array_contains("path", F.col("dst")))
        step = durable(step.select("seed", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), "_hit"), "step")
        done = step.where("_hit").select("seed", F.lit(hops).alias("hops"), "path")
        found = done if found is None else found.unionByName(done)
        full = found.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("seed")
        open_ = durable(step.where("_hit is null").select("seed", "id", "path").join(full, "seed", "left_anti"), "open")
    if found is None:
        return seeds.select("seed", F.lit(0).alias("hops"), F.array("id").alias("path")).where("false")
    order = Window.partitionBy("seed").orderBy("hops", "path")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
