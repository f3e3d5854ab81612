"""Category traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import stored

#: Bounds of a traversal: levels, and nodes reached.
MAX_DEPTH, MAX_NODES = 16, 1_000_000_000


class TraversalLimit(ValueError):
    """More nodes were reached than a traversal may take."""


def category_bfs(edges: DataFrame, roots: DataFrame, depth: int, max_nodes: int = MAX_NODES) -> DataFrame:
    """node, depth: every node reachable from ``roots`` (column node) over ``edges`` (parent, child) at its least depth.

    Safe against cycles: a node is visited once. The loop runs at most
    ``depth`` times and ends when a level finds nothing new. Each level is a
    join of the frontier with the edges; it is written to the shared folder, so
    the plan of a level does not hold those before it. More than ``max_nodes`` nodes are an error, not a cut.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 0 to {MAX_DEPTH}")
    schema = "node string, depth int"
    levels = [stored(roots.select(F.col("node").cast("string").alias("node"), F.lit(0).alias("depth")).distinct(), "level")]
    total = levels[0].count()
    for level in range(1, depth + 1):
        seen = levels[0]
        for x in levels[1:]:
            seen = seen.unionByName(x)
        step = levels[-1].select(F.col("node").alias("parent")).join(edges, "parent").select(F.col("child").cast("string").alias("node")).distinct()
        fresh = stored(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth")), "level")
        found = fresh.count()
        if not found:
            break
        total += found
        if total > max_nodes:
            raise TraversalLimit(f"{total} nodes at depth {level}; at most {max_nodes}")
        levels.append(fresh)
    out = roots.sparkSession.createDataFrame([], schema)
    for x in levels:
        out = out.unionByName(x)
    return out
