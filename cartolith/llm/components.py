"""Connected components of an edge table, by alternating stars with a written frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartolith.session import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest value among the node and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them. Every edge has a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    joined = edges.join(least, "a")
    return (joined.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b"))))
                          .alias("e")).select("e.*").where("a <> b").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is the smallest node reachable.

    ``edges`` has long columns a and b; direction, repeats and loops do not matter, nulls are ignored. Each round shrinks
    all paths by stars, is written to the shared folder and read again, so a lost executor costs one round and plans stay
    short. An empty edge table gives an empty result.
    """
    frontier = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(frontier)
    for _ in range(rounds):
        if not mark[0]:
            break
        frontier = materialise(_small_star(_large_star(frontier)), "edges")
        now = _mark(frontier)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = frontier.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return frontier.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def forest(n: int, left, right) -> list[tuple[int, int]]:
    """Those of the edges (left[i], right[i]) over nodes 0..n-1 that join two parts not yet joined."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(left, right):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append((a, b))
    return kept
