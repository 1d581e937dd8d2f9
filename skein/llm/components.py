"""Connected components by alternating large-star and small-star steps.

Both steps replace each edge by one to the least neighbour, so the edge table never grows, and every step is a partial
aggregation and a join on the vertex. Hot vertices are aggregated before the shuffle; adaptive execution splits the
joins. No links reach the driver: it sees one count a round, of the vertices that are not yet in a star. The edges of a
round are few files in the shared folder, so that the next one does not start with a task for every shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _starry(edges: DataFrame) -> bool:
    """Whether no vertex has two lesser neighbours, or a lesser and a greater one: ``v`` is the least of each component then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.where("below + above > 1").agg(F.count("*")).first()[0] == 0


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any orderable ids -> ``(u, v)``: every vertex but the least of its component, and that one.

    Self loops, repeated edges and null ends are ignored.
    """
    now = edges.select("u", "v").where("u is not null and v is not null and u != v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components-edges", narrow=True)
    for _ in range(rounds):
        if _starry(now):
            return now
        now = stored(_small_star(_large_star(now)), "components-edges", narrow=True)
    if _starry(now):
        return now
    raise RuntimeError(f"no convergence in {rounds} rounds")


def joined_stars(known: DataFrame, edges: DataFrame) -> DataFrame:
    """The stars of ``known``, which are stars, and ``edges`` together. Only the components that edges connect are searched."""
    found = edges.select("u", "v")
    for end in ("u", "v"):
        label = known.select(F.col("u").alias(end), F.col("v").alias("__label"))
        found = found.join(label, end, "left").withColumn(end, F.coalesce("__label", end)).drop("__label")
    more = stars(found)
    moved = known.join(more.select(F.col("u").alias("v"), F.col("v").alias("__label")), "v", "left")
    return stored(moved.select("u", F.coalesce("__label", "v").alias("v")).unionAll(more), "components-stars", narrow=True)


def labelled(found: DataFrame) -> DataFrame:
    """Stars ``(u, v)`` as ``(node, component)``, with the least vertices themselves."""
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any orderable ids -> ``(node, component)``, component being the least id reachable.

    Self loops, repeated edges and null ends are ignored; vertices without an edge do not occur in the result.
    """
    return labelled(stars(edges, rounds))
