"""What duplication there is (affected), and what deduplication would take (removable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import bucket_label
from palimpsest.operators.records import TIERS as TIERS_AT
from palimpsest.operators.records import facts

TIERS = ("exact", "near_90", "near_80", "near_70")
#: Inclusive bands of duplicates a document has, of neighbours, and of group sizes.
DUP_BANDS = [(1, 1), (2, 2), (3, 4), (5, 9), (10, 24), (25, 99), (100, None)]
COUNT_BANDS = [(1, 1), (2, 4), (5, 9), (10, 99), (100, None)]
SIZE_BANDS = [(2, 2), (3, 4), (5, 9), (10, 99), (100, 999), (1000, None)]


def reaches(jaccard: Column, threshold: float) -> Column:
    """Stored similarities are 32-bit, so a pair on the threshold is compared as such."""
    return jaccard >= F.lit(threshold).cast("float")


def strongest(recorded: DataFrame) -> DataFrame:
    """(doc_id, tier, n): a document's strongest kind of duplicate, and how many it has of it and of weaker ones."""
    best = F.col("best")
    tier = F.when(F.col("n_exact") > 0, "exact").when(reaches(best, 0.9), "near_90").when(reaches(best, 0.8), "near_80").otherwise("near_70")
    return facts(recorded).select("doc_id", tier.alias("tier"), (F.col("n_exact") + F.col("n_near")).cast("long").alias("n"))


def composition(recorded: DataFrame, total_docs: int) -> DataFrame:
    """Documents by strongest tier and without duplicates; the parts add up to the corpus."""
    got = strongest(recorded).groupBy("tier").agg(F.count(F.lit(1)).alias("documents"))
    every = recorded.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string").join(got, "tier", "left").select("tier", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))
    rest = every.agg((F.lit(total_docs) - F.sum("documents")).cast("long").alias("documents")).select(F.lit("none").alias("tier"), "documents")
    return every.unionByName(rest).withColumn("share", F.col("documents") / F.lit(float(max(1, total_docs))))


def moments(recorded: DataFrame, cap: int = 20_001) -> DataFrame:
    """Number of duplicates by tier: mean, population deviation, capped maximum, nearest-rank percentiles."""
    capped = strongest(recorded).withColumn("capped", F.least("n", F.lit(cap)))
    at = [F.expr(f"percentile_disc({p / 100}) within group (order by capped)").cast("long").alias(f"p{p}") for p in (1, 25, 50, 75, 99)]
    return capped.groupBy("tier").agg(F.count(F.lit(1)).alias("documents"), F.avg("capped").alias("mean"), F.stddev_pop("capped").alias("sd"), F.max("capped").alias("most"), *at)


def tier_bands(recorded: DataFrame) -> DataFrame:
    """Documents by tier and band of their number of duplicates."""
    return strongest(recorded).groupBy("tier", bucket_label(F.col("n"), DUP_BANDS).alias("band")).agg(F.count(F.lit(1)).alias("documents"))


def neighbour_stats(recorded: DataFrame, thresholds: tuple[float, ...] = TIERS_AT) -> DataFrame:
    """By threshold: documents with a neighbour, directed and undirected edges, mean neighbours."""
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"near_{int(t * 100)}").alias("n")) for t in thresholds])
    at = facts(recorded).select(F.explode(each).alias("x")).select("x.*").where("n > 0")
    return at.groupBy("threshold").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("directed"), F.floor(F.sum("n") / 2).cast("long").alias("undirected"), F.avg("n").alias("mean_neighbours"))


def neighbour_bands(recorded: DataFrame, threshold: float = 0.7) -> DataFrame:
    n = F.col(f"near_{int(threshold * 100)}")
    return facts(recorded).select(bucket_label(n, COUNT_BANDS).alias("band")).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("documents"))


def jaccard_histogram(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Directed edges between documents by floor(100 * Jaccard), in 32-bit arithmetic.

    ``edges`` join representatives; ``sizes`` has (rep_id, group_size), and
    each edge counts once for each pair of copies, both ways.
    """
    a, b = (sizes.select(F.col("rep_id").alias(k), F.col("group_size").alias(f"n{k}")) for k in "ab")
    rows = edges.join(a, "a").join(b, "b")
    percent = F.floor(F.col("jaccard").cast("float") * F.lit(100).cast("float")).cast("long")
    return rows.groupBy(percent.alias("percent")).agg(F.sum(2 * F.col("na") * F.col("nb")).alias("edges"))


def group_size_histogram(sizes: DataFrame) -> DataFrame:
    """Exact groups and their documents by size band."""
    return sizes.where(F.col("count") >= 2).groupBy(bucket_label(F.col("count"), SIZE_BANDS).alias("band")).agg(F.count(F.lit(1)).alias("groups"), F.sum("count").alias("documents"))


def retention(lengths: DataFrame, exact_drops: DataFrame, near_drops: dict[float, DataFrame], min_tokens: int = 5) -> DataFrame:
    """Documents and tokens that go: exact copies, then with clusters at each threshold, and then short ones too."""
    names = ["exact", *[f"near_{int(t * 100)}" for t in sorted(near_drops, reverse=True)]]
    drops = exact_drops.select("doc_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("step"))
    for t, d in near_drops.items():
        drops = drops.unionByName(d.select("doc_id", F.lit(f"near_{int(t * 100)}").alias("step")))
    # one join for all steps: a document moves once, with the steps in which it goes
    gone = drops.groupBy("doc_id").agg(*[F.max(F.col("step") == n).alias(n) for n in names])
    marked = lengths.join(gone, "doc_id", "left")
    sums = []
    for name in names:
        out = F.coalesce(name, F.lit(False))
        short = ~out & (F.col("n_tokens") < min_tokens)
        sums += [F.count_if(out).alias(f"{name}_d"), F.coalesce(F.sum(F.when(out, F.col("n_tokens"))), F.lit(0)).alias(f"{name}_t"), F.count_if(short).alias(f"{name}_sd"), F.coalesce(F.sum(F.when(short, F.col("n_tokens"))), F.lit(0)).alias(f"{name}_st")]
    row = marked.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), *sums)
    parts = (("removed_docs", "d"), ("removed_tokens", "t"), ("short_docs", "sd"), ("short_tokens", "st"))
    each = [F.struct(F.lit(n).alias("step"), *[F.col(f"{n}_{k}").alias(a) for a, k in parts]) for n in names]
    out = row.select("documents", "tokens", F.explode(F.array(*each)).alias("x")).select("x.step", "documents", "tokens", *[f"x.{a}" for a, _ in parts])
    return out.withColumn("retained_docs", F.col("documents") - F.col("removed_docs") - F.col("short_docs")).withColumn("removed_doc_share", F.col("removed_docs") / F.col("documents")).withColumn("removed_token_share", F.col("removed_tokens") / F.greatest("tokens", F.lit(1)))


def removable_slices(kept: DataFrame) -> DataFrame:
    """What each step of ``retention`` takes beyond the one before."""
    order = Window.orderBy("removed_docs", "step")  # one row a step
    return kept.select("step", (F.col("removed_docs") - F.coalesce(F.lag("removed_docs").over(order), F.lit(0))).alias("added_docs"), (F.col("removed_tokens") - F.coalesce(F.lag("removed_tokens").over(order), F.lit(0))).alias("added_tokens"))
