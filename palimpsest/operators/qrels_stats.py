"""Statistics of relevance pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import bucket_label
from palimpsest.operators.components import connected_components

#: Inclusive bands of documents a question and a hop; half-open bands of percentages.
QUESTION_BANDS = [(1, 24), (25, 49), (50, 99), (100, 149), (150, 199), (200, 299), (300, None)]
HOP_BANDS = [(1, 2), (3, 5), (6, 10), (11, 20), (21, 40), (41, 70), (71, None)]
PERCENT_BANDS = [(0, 10), (10, 20), (20, 30), (30, 40), (40, 50), (50, 60), (60, 70), (70, None)]


def per_question(pairs: DataFrame) -> DataFrame:
    """Documents and (document, hop) pairs of each question. ``pairs`` has qid, doc_id, hop."""
    return pairs.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_pairs"))


def per_hop(pairs: DataFrame, hops: DataFrame) -> DataFrame:
    """Documents of each hop, hops without any included. ``hops`` has qid, index, hop_type, skipped."""
    counts = pairs.groupBy("qid", F.col("hop").alias("index")).agg(F.countDistinct("doc_id").alias("n_docs"))
    return hops.join(counts, ["qid", "index"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("long")))


def skipped_are_empty(counted: DataFrame) -> bool:
    """Whether just the skipped hops have no document."""
    return counted.where((F.col("n_docs") == 0) != F.col("skipped")).isEmpty()


def banded(values: DataFrame, column: str, bands: list[tuple[int, int | None]]) -> DataFrame:
    """Rows by inclusive band; a value outside all bands is an error."""
    label = bucket_label(F.col(column), bands, "–")
    return values.select(F.coalesce(label, F.raise_error(F.lit("a value lies in no band")).cast("string")).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def percent_banded(values: DataFrame, column: str) -> DataFrame:
    """Rows by half-open band of a percentage."""
    out = None
    for low, high in PERCENT_BANDS:
        test = (F.col(column) >= low) & (F.col(column) < high) if high else F.col(column) >= low
        name = f"{low}-{high}" if high else f"{low}+"
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return values.groupBy(out.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(values: DataFrame, column: str) -> DataFrame:
    """Least, quartiles by the exclusive method, mean and most: a quantile p lies at rank p * (n + 1), between neighbours."""
    ranked = values.select(F.col(column).cast("double").alias("v")).withColumn("rank", F.row_number().over(Window.orderBy("v")))
    total = values.agg(F.count(F.lit(1)).alias("n"), F.min(column).cast("double").alias("least"), F.max(column).cast("double").alias("most"), F.avg(column).alias("mean"))
    rows = ranked.join(F.broadcast(total))

    def at(p: float):
        place = F.lit(p) * (F.col("n") + 1)
        low = F.least(F.greatest(F.floor(place), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
        low_value = F.max(F.when(F.col("rank") == low, F.col("v")))
        high_value = F.max(F.when(F.col("rank") == F.least(low + 1, F.col("n")), F.col("v")))
        share = F.max(place - low)
        return low_value + (high_value - low_value) * share

    return rows.agg(F.max("least").alias("least"), at(0.25).alias("p25"), at(0.5).alias("median"), F.max("mean").alias("mean"), at(0.75).alias("p75"), F.max("most").alias("most"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, with the largest weight."""
    both = edges.select("a", "b", "jaccard").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    return both.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def redundancy(pool: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each question's documents: how many have a near copy among them, groups, redundant ones, the largest group.

    ``pool`` has distinct (qid, doc_id); ``edges`` has (a, b).
    """
    a = pool.select("qid", F.col("doc_id").alias("a"))
    b = pool.select("qid", F.col("doc_id").alias("b"))
    inner = edges.select("a", "b").join(a, "a").join(b, ["qid", "b"]).select("qid", "a", "b")
    # a vertex is a document of a question
    vertex = lambda c: F.struct(F.col("qid"), F.col(c).alias("doc"))
    tied = inner.select(vertex("a").alias("a"), vertex("b").alias("b"))
    groups = connected_components(tied).groupBy("component").agg(F.count(F.lit(1)).alias("size")).select(F.col("component.qid").alias("qid"), "size")
    per = groups.groupBy("qid").agg(F.sum("size").alias("dup"), F.count(F.lit(1)).alias("groups"), F.max("size").alias("largest"))
    zero = F.lit(0).cast("long")
    rows = pool.groupBy("qid").agg(F.count(F.lit(1)).alias("n_docs")).join(per, "qid", "left")
    return rows.select(
        "qid", "n_docs", F.coalesce("dup", zero).alias("n_near_dup"), (F.coalesce("dup", zero) * 100 / F.col("n_docs")).alias("pct_near_dup"), F.coalesce("groups", zero).alias("n_groups"),
        (F.coalesce("dup", zero) - F.coalesce("groups", zero)).alias("n_redundant"), F.coalesce("largest", zero).alias("largest_group"),
    )
