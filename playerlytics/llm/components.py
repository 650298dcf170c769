"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

#: Each node's minimum is sent to so many parts, so that a hub's edges are dealt to as many tasks.
SALTS = 8


def _with_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest neighbour of u, u itself included."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    spread = least.withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "s"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    near = _with_minimum(edges)
    return (near.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                         F.struct(F.col("u"), F.col("m").alias("v")))))
            .where("u <> v").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it reaches.

    Edges are undirected longs; loops, repeats and rows with a null end add nothing. An empty
    table gives an empty result. Each round is checkpointed, so a lost executor costs one round.
    """
    edges = cut(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = cut(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
