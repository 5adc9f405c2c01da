"""One duplicate record for each document that has a duplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.shingles import gram_sets
from palimpsest.functions.text import digest


def near_rows(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, neighbour, jaccard): edges of representatives, for every copy on either side.

    ``members`` has (doc_id, rep_id). Copies of one text are exact duplicates
    and never near ones, since an edge joins two texts.
    """
    both = edges.select("a", "b", "jaccard").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    source = members.select(F.col("rep_id").alias("a"), "doc_id")
    target = members.select(F.col("rep_id").alias("b"), F.col("doc_id").alias("neighbour"))
    return both.join(source, "a").join(target, "b").select("doc_id", "neighbour", "jaccard")


def exact_rows(members: DataFrame) -> DataFrame:
    """(doc_id, exact_duplicates) of the documents with copies."""
    groups = members.where("group_size >= 2")
    lists = groups.groupBy("rep_id").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return groups.join(lists, "rep_id").select("doc_id", F.array_except("ids", F.array("doc_id")).alias("exact_duplicates"))


def records(edges: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, exact_duplicates, near_duplicates (Jaccard descending, id ascending), n_exact, n_near."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("jaccard")).alias("by"), F.col("neighbour").alias("doc_id"))))
    near = near_rows(edges, members).groupBy("doc_id").agg(F.transform(ordered, lambda x: F.struct(x["doc_id"].alias("doc_id"), (-x["by"]).cast("float").alias("jaccard"))).alias("near_duplicates"))
    both = exact_rows(members).join(near, "doc_id", "full")
    exact = F.coalesce("exact_duplicates", F.expr("cast(array() as array<bigint>)"))
    near_list = F.coalesce("near_duplicates", F.expr("cast(array() as array<struct<doc_id:bigint,jaccard:float>>)"))
    return both.select("doc_id", exact.alias("exact_duplicates"), near_list.alias("near_duplicates"), F.size(exact).alias("n_exact"), F.size(near_list).alias("n_near"))


#: The similarities at which neighbours are counted.
TIERS = (0.7, 0.8, 0.9)


def counted(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The records without their lists: doc_id, n_exact, n_near, best, near_70, near_80, near_90.

    Lists of a group of k copies have k * k ids; these figures come from the
    groups' sizes, so a group of any size costs a row a document.
    """
    stored = F.col("jaccard").cast("float")
    both = edges.select("a", "b", stored.alias("jaccard")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), stored.alias("jaccard")))
    sizes = members.where("doc_id = rep_id").select(F.col("rep_id").alias("b"), F.col("group_size").alias("n"))
    tiers = [F.sum(F.when(F.col("jaccard") >= F.lit(t).cast("float"), F.col("n")).otherwise(0)).alias(f"near_{int(t * 100)}") for t in TIERS]
    per = both.join(sizes, "b").groupBy(F.col("a").alias("rep_id")).agg(F.sum("n").alias("n_near"), F.max("jaccard").alias("best"), *tiers)
    zero = F.lit(0).cast("long")
    rows = members.join(per, "rep_id", "left").where("group_size >= 2 or n_near is not null")
    return rows.select("doc_id", (F.col("group_size") - 1).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"), "best", *[F.coalesce(f"near_{int(t * 100)}", zero).alias(f"near_{int(t * 100)}") for t in TIERS])


def facts(recorded: DataFrame) -> DataFrame:
    """The columns of ``counted`` from records with lists, or as they are."""
    if "near_duplicates" not in recorded.columns:
        return recorded
    at = lambda t: F.size(F.filter("near_duplicates", lambda x: x["jaccard"] >= F.lit(t).cast("float"))).cast("long")
    best = F.get("near_duplicates", F.lit(0))["jaccard"]  # the list is sorted
    return recorded.select("doc_id", F.col("n_exact").cast("long").alias("n_exact"), F.col("n_near").cast("long").alias("n_near"), best.alias("best"), *[at(t).alias(f"near_{int(t * 100)}") for t in TIERS])


def neighbours(recorded: DataFrame, doc_id: int, threshold: float = 0.7) -> DataFrame:
    """All duplicates of a document; a filter on the id, which sorted files push down."""
    return recorded.where(F.col("doc_id") == doc_id).select("doc_id", "exact_duplicates", F.filter("near_duplicates", lambda x: x["jaccard"] >= threshold).alias("near_duplicates"))


def verify(recorded: DataFrame, docs: DataFrame, slack: float = 0.002) -> DataFrame:
    """Each record against the texts that it refers to: references, and those that don't hold.

    Digests and n-gram sets are made anew from the texts, once for each
    document that a record names, and similarities from the sets.
    """
    exact_refs = recorded.select("doc_id", F.explode("exact_duplicates").alias("other"))
    near_refs = recorded.select("doc_id", F.explode("near_duplicates").alias("x")).select("doc_id", F.col("x.doc_id").alias("other"), F.col("x.jaccard").cast("double").alias("stored"))
    named = recorded.select("doc_id").union(exact_refs.select("other")).union(near_refs.select("other")).distinct()
    texts = docs.select("doc_id", "text").join(named, "doc_id", "left_semi")
    digests = texts.select("doc_id", digest(F.col("text")).alias("sha"))
    sets = gram_sets(texts)

    def both(refs: DataFrame, facts: DataFrame, name: str) -> DataFrame:
        left, right = (facts.withColumnsRenamed({"doc_id": k, name: f"{name}_{k}"}) for k in ("doc_id", "other"))
        return refs.join(left, "doc_id", "left").join(right, "other", "left")

    e = both(exact_refs, digests, "sha").groupBy("doc_id").agg(F.count(F.lit(1)).alias("exact_refs"), F.count_if(~F.coalesce(F.col("sha_doc_id") == F.col("sha_other"), F.lit(False))).alias("wrong_exact"))
    n = both(near_refs, sets, "grams")
    shared = F.size(F.array_intersect("grams_doc_id", "grams_other"))
    real = shared / (F.size("grams_doc_id") + F.size("grams_other") - shared)
    n = n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("near_refs"), F.count_if(~F.coalesce(F.abs(real - F.col("stored")) <= slack, F.lit(False))).alias("wrong_near"))
    zero = F.lit(0).cast("long")
    rows = recorded.select("doc_id").join(e, "doc_id", "left").join(n, "doc_id", "left")
    return rows.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("exact_refs", "wrong_exact", "near_refs", "wrong_near")])


def missing_groups(members: DataFrame, written: DataFrame) -> DataFrame:
    """(rep_id, size) of exact groups of which no member was written. ``written`` has doc_id."""
    groups = members.where("group_size >= 2").select("doc_id", "rep_id", "group_size")
    there = written.select("doc_id").distinct().withColumn("there", F.lit(True))
    rows = groups.join(there, "doc_id", "left").groupBy("rep_id").agg(F.first("group_size").alias("size"), F.count("there").alias("n"))
    return rows.where("n = 0").select("rep_id", "size")


def counts(recorded: DataFrame) -> DataFrame:
    return recorded.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("n_exact") > 0).alias("with_exact"), F.count_if(F.col("n_near") > 0).alias("with_near"),
        F.sum(F.col("n_exact").cast("long")).alias("exact_links"), F.sum(F.col("n_near").cast("long")).alias("near_links"),
    )


def overlap(recorded: DataFrame) -> DataFrame:
    """Records in which a document is both an exact and a near duplicate; there should be none."""
    return recorded.where(F.arrays_overlap("exact_duplicates", F.transform("near_duplicates", lambda x: x["doc_id"]))).agg(F.count(F.lit(1)).alias("overlapping"))
