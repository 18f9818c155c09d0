"""Connected components of a graph given as a table of edges, by star contractions.

Neither edges nor components ever reach the driver; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the least node around it."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").dropDuplicates(["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the component's least node.

    ``edges`` has columns a and b of one orderable type. An edge of a node with itself and
    repeated edges change nothing; no edges give no rows.
    """
    at = written(_clean(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    state = _state(at)
    for _ in range(rounds):
        if not state[0]:
            break
        large = written(_clean(_large_star(at)), "large")
        now = written(_clean(_small_star(large)), "small")
        dropped(at)
        dropped(large)
        at, before, state = now, state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
