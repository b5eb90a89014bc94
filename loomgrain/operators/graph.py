"""Connected components over an edge table, with distributed state only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.operators.shared import dropped, settled


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` of any orderable type -> ``(node, component)``, component = least node reachable.

    Alternating large-star / small-star rewiring: the number of rounds grows with the logarithm of the
    longest chain, every round is two shuffles of the current edges, and each round's edges are written to
    the shared folder once and read on from there. Self loops give components of one node; nulls are ignored;
    repeated and reversed edges count once. A star's hub may hold any share of the edges: the hub's
    neighbours are reduced with a partially aggregated ``min`` joined back, never gathered in a list.
    """
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    cur = settled(_directed(e.where("u <> v")).distinct())
    before = _signature(cur)
    if not before[0]:
        return nodes.select("node", F.col("node").alias("component"))
    for _ in range(max_rounds):
        last, cur = cur, settled(_small_star(_large_star(cur)))
        dropped(last)
        now = _signature(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("component", "node").alias("component"))


def _directed(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _signature(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = e.groupBy("u").agg(F.min("v").alias("m"))  # u > v: only nodes with a smaller neighbour change
    larger = both.where("v > u").alias("b").join(least.alias("l"), F.col("b.u") == F.col("l.u"), "left")
    return larger.select(F.col("b.v").alias("u"), F.coalesce("l.m", "b.u").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.alias("e").join(least.alias("l"), F.col("e.u") == F.col("l.u"))
    moved = linked.where("e.v <> l.m").select(F.col("e.v").alias("u"), F.col("l.m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(node, depth)``: nodes of ``edges(src, dst)`` at the end of a path from ``roots(node)``, roots at depth 0.

    A frontier join for each step; what was seen is anti-joined, so cycles end. A step writes its own frontier only:
    what was seen is the union of the frontiers, read side by side.
    """
    edges = settled(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    frontier = settled(roots.where("node is not null").select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_rounds + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = settled(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % 32 == 0:  # plans stay short on long chains
            seen = settled(seen)
    raise RuntimeError(f"the frontier is not empty after {max_rounds} rounds")


def chains(successor: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, path)`` of a functional graph ``(node, next)``: the nodes from each one on, until none or a repeat.

    Paths double in length with every round: a path is joined to the path that begins where it ends.
    """
    succ = successor.where("node is not null").groupBy("node").agg(F.min("next").alias("next"))
    paths = settled(succ.select("node", F.array("node").alias("path"), "next"))
    for _ in range(max_rounds):
        if paths.where("next is not null").isEmpty():
            break
        tail = paths.select(F.col("node").alias("t"), F.col("path").alias("t_path"), F.col("next").alias("t_next"))
        longer = paths.join(tail, paths["next"] == tail["t"], "left")
        whole = ~F.arrays_overlap("path", "t_path")
        out = longer.select(
            "node",
            F.when(F.col("t").isNull(), F.col("path")).otherwise(F.concat("path", _until_repeat(F.col("path"), F.col("t_path")))).alias("path"),
            F.when(F.col("t").isNotNull() & whole, F.col("t_next")).alias("next"),
        )
        last, paths = paths, settled(out)
        dropped(last)
    return paths.select("node", "path")


def _until_repeat(path, more):
    """Members of ``more`` up to the first that ``path`` holds already."""
    hit = F.transform(more, lambda x: F.array_contains(path, x))
    at = F.coalesce(F.nullif(F.array_position(hit, True), F.lit(0)), F.size(more) + 1)
    return F.slice(more, F.lit(1), (at - 1).cast("int"))
