"""Connected components by alternating large-star and small-star steps.

The method is that of Kiveris et al., "Connected Components in MapReduce and
Beyond" (2014). Labels and links stay distributed; each round is written to
the shared folder, so a lost executor costs one round at most.

A vertex with very many links is a hot key of the join that gives each link the
smallest neighbour. That one is written first: then both sides of the join come
from shuffles of their own, which Spark's skew join can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.tables import discard, materialize

ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    """(a, least) of the vertices that have larger neighbours and a smaller one: their smallest."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).where("least < a and most > a").select("a", "least")


def _large_star(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """Links each larger neighbour of a vertex to the smallest of the neighbourhood, the vertex itself included. Rows are (larger, smaller)."""
    links = edges.select(F.col("b").alias("vertex"), F.col("a").alias("larger"))
    return links.join(smallest, F.col("vertex") == smallest["a"], "left").select(F.col("larger").alias("a"), F.coalesce("least", "vertex").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the smallest of them. Rows are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    rest = edges.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return rest.unionByName(least.select("a", F.col("least").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of all vertices in links (a, b); a component is named by its smallest vertex.

    Links to oneself and null ends are dropped, repeated links do no harm, and
    no links give an empty result. Vertices without a link to others are not
    in the result.
    """
    known = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    known = materialize(known, "links")
    before = None
    for _ in range(ROUNDS):
        smallest = materialize(_smallest(known), "smallest")
        stars = _small_star(_large_star(known, smallest).distinct()).where("a <> b").distinct()
        last, known = known, materialize(stars, "stars")
        discard(last, smallest)
        now = known.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now["n"] == 0 or (now["n"], now["x"]) == before:
            break
        before = (now["n"], now["x"])
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return known.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(known.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
