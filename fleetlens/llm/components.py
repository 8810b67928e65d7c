"""Connected components of a link table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import join_by_key, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node reachable.

    Each step ties a node's neighbours to the smallest of them. The work of a step is linear
    in the links and their number of steps logarithmic; nodes with many links are split.
    Self links, repeated and reversed links change nothing; null ends are left out.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("a is not null and b is not null and u > v").distinct(), "components")

    def tied(both: DataFrame, name: str, total: int) -> DataFrame:
        """Edges from each neighbour v of u, and u itself, to the smallest m of all of these."""
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        least = stored(least, name)
        joined = join_by_key(both, least, ["u"], total)
        if name == "large":
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v")))
        return stored(out.filter("u > v").distinct(), name)

    state = edge_state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = tied(tied(both, "large", 2 * state[0]), "small", state[0])
        before, state = state, edge_state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def edge_state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).head()
    return int(row[0]), int(row[1])
