"""Connected components by alternating contraction of stars, over nodes of any orderable type, structs among them.

A large-star step ties every larger neighbour of a node to the least node that it or its neighbours are; a small-star step
ties a node's smaller neighbours to the least of them. A chain halves every round, so a few more than log n rounds
leave one star a component. Neighbours' minima are aggregated before they are shuffled and joined back as one row a node, so
that the planner can split the rows of a node with very many edges. Each round is a table in the shared folder, and the
one before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Stored


def _least(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys, "u").agg(F.min("v").alias("low")).select(*keys, F.col("u").alias("of"), F.least("of", "low").alias("low"))


def _both(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(*keys, "b", "a"))


def _tied(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b), a > b, each once."""
    return pairs.where("a > b").distinct()


def large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    near = _both(edges, keys)
    low = _least(near, keys)
    met = near.where("v > u").withColumnRenamed("u", "of").join(low, [*keys, "of"])
    return _tied(met.select(*keys, F.col("v").alias("a"), F.col("low").alias("b")), keys)


def small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    near = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v"))
    low = _least(near, keys)
    met = near.withColumnRenamed("u", "of").join(low, [*keys, "of"])
    own = low.select(*keys, F.col("of").alias("a"), F.col("low").alias("b"))
    return _tied(met.select(*keys, F.col("v").alias("a"), F.col("low").alias("b")).union(own), keys)


def components(edges: DataFrame, keys: list[str], rounds: list[int] | None = None) -> DataFrame:
    """(keys, node, component) of edges (keys, a, b): the least node reachable within equal keys.

    Rows whose ends are equal or null link nothing; nodes without a link are left out. rounds, if given, gets the number of
    rounds appended.
    """
    now = Stored(edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    count, n = now.df.count(), 0
    while True:
        n += 1
        new = Stored(small_star(large_star(now.df, keys), keys), "edges")
        was, count = count, new.df.count()
        # Equal tables: as many rows, and none that was not there.
        if count == was and new.df.join(now.df, [*keys, "a", "b"], "left_anti").isEmpty():
            break
        now.drop()
        now = new
    now.drop()
    if rounds is not None:
        rounds.append(n)
    centres = new.df.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return new.df.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).union(centres)
