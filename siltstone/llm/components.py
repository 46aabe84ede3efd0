"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum, which is combined before the shuffle, and a join back to the
edges; a hub of any degree is never gathered in one row. The edges between two steps are written
to the shared folder, so lost executors cost no earlier step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, drop_cut


SMALL = 1 << 19  # edges of 8-byte nodes whose grouped minima may be broadcast: 32 MB
EACH = 1 << 17  # edges in a written part


def _minima(edges: DataFrame, small: bool) -> DataFrame:
    """(u, v, m): every edge with the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(F.broadcast(least) if small else least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _minima(both, small).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _minima(down, small)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), of any one orderable type: root is the
    least node that it is connected with. Loops and edges with a null are ignored. The steps
    end when the edges are stars, which takes a number of steps logarithmic in the longest path."""
    now = cut(edges.select("u", "v").filter("u <> v").distinct())
    print_of = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    before = None
    while (mark := print_of(now)) != before:
        before, old = mark, now
        # steps never add edges beyond twice their number
        small = 2 * mark["n"] <= SMALL
        step = _small_star(_large_star(now, small), small).filter("u <> v").distinct()
        now = cut(step.coalesce(2 * mark["n"] // EACH + 1) if small else step)
        drop_cut(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
