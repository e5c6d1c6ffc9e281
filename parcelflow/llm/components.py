"""Connected components of an edge table, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any sortable type -> (node, name): nodes have one name iff they are connected.

    In each round every node takes the name of the neighbour (or itself) that comes first in that round's random
    order, and the edges are rewritten to names. The expected number of names falls by a constant factor a round
    whatever the shape (chains too). A hub's edges meet only in aggregations with map-side combine and in joins
    that adaptive execution can split. Each round is written to the shared folder; nothing goes to the driver
    but a flag. Self-loops are ignored; nodes without another neighbour do not appear. An empty table gives one.
    """
    current = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    rounds: list[DataFrame] = []
    while not current.isEmpty():
        order = lambda c: F.xxhash64(F.lit(len(rounds)), c)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("o"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(order(F.col("a")).alias("o"), F.col("a").alias("n"))
        names = written(nearest.select(F.col("a").alias("node"), F.least("m", own)["n"].alias("name")), "names")
        rounds.append(names)
        left = names.select(F.col("node").alias("a"), F.col("name").alias("na"))
        right = names.select(F.col("node").alias("b"), F.col("name").alias("nb"))
        renamed = current.join(left, "a").join(right, "b").where("na <> nb")
        current = written(renamed.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
    if not rounds:
        return current.select(F.col("a").alias("node"), F.col("b").alias("name"))
    out = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("name"), F.col("name").alias("next"))
        out = out.join(step, "name", "left").select("node", F.coalesce("next", "name").alias("name"))
    return out
