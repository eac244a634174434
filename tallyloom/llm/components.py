"""Connected components of an edge table by contraction.

In every round each node moves to one of its neighbours or stays, and the edges between the new nodes go on; components
end as single nodes. Even rounds move to the smallest neighbour, which folds stars around their smallest node at once; odd
rounds move to the neighbour with the smallest hash of the round, which shortens chains by a constant share. Only
minima per node are aggregated and joined back, so no list of neighbours is ever collected, and a node with very many
links is pre-aggregated and split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one type): nodes that reach each other have the
    same component, which is one of them.

    Self links and repeated edges may occur; no edges give no rows. Each round is written to the shared folder.
    """
    left = written(_distinct(edges), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        near = left.select(F.inline(ends))
        if len(moves) % 2 == 0:
            moved = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to"))
        else:
            place = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("n"))
            moved = near.groupBy("u").agg(F.least(F.min(place("v")), place("u")).alias("to")).select("u", F.col("to.n").alias("to"))
        moved = written(moved, "moves")
        a, b = moved.select(F.col("u").alias("a"), F.col("to").alias("ta")), moved.select(F.col("u").alias("b"), F.col("to").alias("tb"))
        onward = left.join(a, "a").join(b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        left = written(_distinct(onward), "edges")
        moves.append(moved)
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    names = moves.pop().select(F.col("u").alias("to"), F.col("to").alias("component"))
    while moves:
        step = moves.pop().join(names, "to", "left").select("u", F.coalesce("component", "to").alias("component"))
        names = step.withColumnRenamed("u", "to")
    return written(names.withColumnRenamed("to", "node"), "components")
