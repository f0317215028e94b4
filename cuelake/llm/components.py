"""Connected components by local contraction, in joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected(links: DataFrame) -> DataFrame:
    """links has two long columns, a and b. Returns node, root: for every node of a link, one node of its component.

    Each round maps every node to the neighbour of least hashed rank, itself included, and rewrites the links
    by that map, until no link is left. Ranks are drawn anew each round, so the nodes shrink by a constant
    share whatever the shape: a chain or a star needs no more rounds than anything else. A node of very many
    links is a key of aggregates with map-side sums, and of inner joins against unique keys, which adaptive
    execution splits. Null ends, loops and repeated links have no effect.
    """
    rest = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    rest, maps = materialize(rest, "links"), []
    while not rest.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("rank"), F.col(c).alias("node"))
        ends = rest.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.least(rank("a"), rank("b")).alias("to")), F.struct(F.col("b").alias("node"), F.least(rank("a"), rank("b")).alias("to")))).alias("x")).select("x.*")
        step = materialize(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.col("to.node").alias("to")), "step")
        maps.append(step)
        moved = rest.join(step.toDF("a", "to_a"), "a").join(step.toDF("b", "to_b"), "b")
        moved = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).filter("a <> b").distinct()
        rest = materialize(moved, "links")
    if not maps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps.pop().toDF("node", "root")
    while maps:
        later = roots.toDF("to", "root")
        roots = maps.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
