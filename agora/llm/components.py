"""Connected components by alternating large and small stars.

Each step points nodes at the least node they know of: a large star moves the
greater neighbours of a node to its least neighbour, a small star moves a node and
its lesser neighbours there. When a whole round leaves the edges as they are, they
are stars around the least id of each component. Neighbours are never gathered in
one place: a step is a partly pre-aggregated minimum, joined back to the edges,
where adaptive execution may split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    moved = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From links (a, b) of ids: (id, component) for every id in a link, the component being its least id.

    Nulls and self-links are ignored. The result is read from the shared folder.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.keep(edges.filter("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).distinct())
    before = _state(now)
    if before[0]:
        for _ in range(most_rounds):
            new = scratch.keep(_small_star(_large_star(now)))
            scratch.drop(now)
            now, after = new, _state(new)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = Scratch(edges.sparkSession).keep(ids.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct(), last=True)
    scratch.drop()
    return out
