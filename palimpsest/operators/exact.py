"""Exact duplicates: content digests, groups, verification, summaries.

Texts are stripped of Unicode white space first. Rows shuffle as digests; a
text moves only if its digest has copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import char_len, digest, strip


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, char_len, sha256, was_null); null counts as the empty text."""
    return docs.select("doc_id", char_len(F.col("text")).alias("char_len"), digest(F.col("text")).alias("sha256"), F.col("text").isNull().alias("was_null"))


#: Ids that a list of ids spans at most: a hot length or digest has several lists, one a chunk.
SPAN = 4_000_000


def _chunk() -> Column:
    return F.floor(F.col("doc_id") / SPAN).cast("long").alias("chunk")


def length_map(scanned: DataFrame) -> DataFrame:
    """One row a length and chunk of ids: its count and its ids ascending."""
    return scanned.groupBy("char_len", _chunk()).agg(F.count(F.lit(1)).alias("n_docs"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def _lists(scanned: DataFrame, sizes: DataFrame) -> DataFrame:
    lists = scanned.groupBy("sha256", _chunk()).agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    return lists.join(sizes.select("sha256", "length", "count"), "sha256").select("sha256", "length", "count", "chunk", "doc_ids")


def hash_groups(scanned: DataFrame) -> DataFrame:
    """One row a digest and chunk of ids: length, the digest's count, and the chunk's ids ascending."""
    return _lists(scanned, group_sizes(scanned))


def group_sizes(scanned: DataFrame) -> DataFrame:
    """One row a digest without its ids: combined map-side, so hot digests cost nothing more."""
    return scanned.groupBy("sha256").agg(F.first("char_len").alias("length"), F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("rep_id"))


def exact_groups(scanned: DataFrame) -> DataFrame:
    """The rows of ``hash_groups`` with copies; single documents are left out before lists are made."""
    sizes = group_sizes(scanned).where(F.col("count") >= 2)
    return _lists(scanned.join(sizes.select("sha256"), "sha256", "left_semi"), sizes)


def duplicate_totals(sizes: DataFrame) -> DataFrame:
    many = F.col("count") >= 2
    return sizes.agg(
        F.sum("count").alias("total_docs"), F.count(F.lit(1)).alias("distinct_hashes"), F.count_if(many).alias("n_groups"),
        F.coalesce(F.sum(F.when(many, F.col("count"))), F.lit(0)).alias("docs_in_groups"), F.sum(F.col("count") - 1).alias("redundant_docs"),
        F.sum((F.col("count") - 1) * F.col("length")).alias("redundant_chars"), F.max("count").alias("largest_group"),
    )


def top_groups(sizes: DataFrame, n: int = 20) -> DataFrame:
    return sizes.where(F.col("count") >= 2).orderBy(F.desc("count"), "sha256").limit(n).select("sha256", "length", "count", "rep_id")


def members(scanned: DataFrame) -> DataFrame:
    """(doc_id, rep_id, group_size): the smallest id of a digest stands for it."""
    sizes = group_sizes(scanned)
    return scanned.select("doc_id", "char_len", "sha256").join(sizes.select("sha256", "rep_id", F.col("count").alias("group_size")), "sha256")


def representatives(scanned: DataFrame) -> DataFrame:
    return group_sizes(scanned).select(F.col("rep_id").alias("doc_id"))


def excluded_copies(scanned: DataFrame) -> DataFrame:
    return members(scanned).where("doc_id <> rep_id").select("doc_id", "rep_id")


def verify(docs: DataFrame) -> DataFrame:
    """One row a group of copies: whether each text equals the representative's, and its digest holds on rehashing."""
    scanned = scan(docs)
    copied = members(scanned).where("group_size >= 2")
    texts = docs.select("doc_id", strip(F.col("text")).alias("text"))
    held = copied.join(texts, "doc_id")
    reps = held.where("doc_id = rep_id").select("sha256", F.col("text").alias("rep_text"))
    compared = held.join(reps, "sha256").withColumn("same", F.col("text").eqNullSafe(F.col("rep_text")))
    return compared.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("count"), F.min("rep_id").alias("representative"), F.sort_array(F.collect_list(F.when(~F.col("same"), F.col("doc_id")))).alias("content_mismatch"),
        F.bool_and(F.sha2("rep_text", 256) == F.col("sha256")).alias("sha256_recompute_ok"),
    ).withColumn("ok", (F.size("content_mismatch") == 0) & F.col("sha256_recompute_ok"))


def reconcile(docs: DataFrame) -> DataFrame:
    """Checks that the counts of each step agree, one row."""
    scanned = scan(docs)
    sizes = group_sizes(scanned)
    totals = duplicate_totals(sizes)
    n = docs.agg(F.count(F.lit(1)).alias("corpus_docs"))
    lengths = length_map(scanned).agg(F.sum("n_docs").alias("length_docs"))
    excluded = excluded_copies(scanned).agg(F.count(F.lit(1)).alias("excluded"))
    ok = verify(docs).agg(F.count_if("ok").alias("ok_groups"), F.count_if(~F.col("ok")).alias("bad_groups"))
    one = n.join(totals).join(lengths).join(excluded).join(ok)  # one row each
    return one.select(
        (F.col("corpus_docs") == F.col("total_docs")).alias("scan_covers_corpus"), (F.col("length_docs") == F.col("corpus_docs")).alias("length_map_covers_corpus"),
        (F.col("distinct_hashes") + F.col("redundant_docs") == F.col("total_docs")).alias("hashes_add_up"), (F.col("ok_groups") == F.col("n_groups")).alias("groups_verified"),
        (F.col("bad_groups") == 0).alias("no_failures"), (F.col("excluded") == F.col("redundant_docs")).alias("excluded_match"),
    )


def brute_force_counts(docs: DataFrame, n: int = 6) -> DataFrame:
    """For the largest groups, counts by comparing whole texts, raw and stripped, without digests."""
    top = top_groups(group_sizes(scan(docs)), n)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"), strip(F.col("text")).alias("stripped"))
    targets = top.select(F.col("rep_id").alias("doc_id"), F.col("count").alias("hash_count")).join(texts, "doc_id")
    targets = targets.select(F.col("doc_id").alias("rep_id"), "hash_count", F.col("stripped").alias("want"), F.col("raw").alias("want_raw"))
    got = texts.join(F.broadcast(targets), F.col("stripped") == F.col("want"))  # n rows
    return got.groupBy("rep_id", "hash_count").agg(F.count_if(F.col("raw") == F.col("want_raw")).alias("raw_count"), F.count(F.lit(1)).alias("stripped_count"))
