"""Connected components of a table of links, by alternating star contraction.

Each round hooks every vertex to the smallest neighbour it knows ("large star",
then "small star"), until the links form stars around each component's smallest
vertex; the number of rounds grows with the logarithm of a component's size.
Minima are pre-aggregated before the shuffle and written before they are joined
back, so a vertex with very many links is neither gathered in one task nor, in
the join, kept from being split.  Tables of few links are written by few tasks, one for each
ROWS links and FEWEST at least.  Nothing but two sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import cut, forget

ROWS, FEWEST = 50_000, 12


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (id, root): every linked vertex with the smallest vertex of
    its component.  Vertices without links don't appear."""
    ends = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(ends.distinct(), "edges")
    state = _state(e)
    while state[0]:
        tasks = max(FEWEST, -(-state[0] // ROWS))  # a round's tables have twice as many rows at most
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "least")
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
                    .coalesce(tasks), "large")
        forget(least, e)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        forget(least, large)
        state, before = _state(e), state
        if state == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
