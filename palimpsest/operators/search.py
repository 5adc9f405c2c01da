"""Retrieval over the corpus: BM25, and passages that documents contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import preview, words
from palimpsest.sources.tables import materialize


def bm25(docs: DataFrame, queries: DataFrame, hits: int = 10, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(query_id, rank, doc_id, score, preview) by the published formula; ties go to the smaller id.

    Only postings of query terms leave the scan. ``queries``: query_id, text.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    sized = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    total = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    postings = materialize(sized.select("doc_id", "n", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_id", "n").agg(F.count(F.lit(1)).alias("tf")), "postings")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = terms.join(df, "term").join(postings, "term").join(F.broadcast(total))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scored = rows.groupBy("query_id", "doc_id").agg(F.sum(idf * tf).alias("score"))
    # sums in another order can differ in their last digits
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= hits)
    # only the texts that are shown are cut
    return top.join(docs.select("doc_id", "text"), "doc_id").withColumn("preview", preview(F.col("text"))).drop("text")


def containing(docs: DataFrame, passages: DataFrame, sets: DataFrame, passage_sets: DataFrame) -> DataFrame:
    """(item_id, doc_id) of documents whose text has a passage verbatim.

    Candidates share all of the passage's n-grams but those at its edges, whose
    first or last word may go on in the document; only their texts are read.
    Passages shorter than an n-gram meet none.
    """
    rows = sets.select("doc_id", F.explode("grams").alias("g"))
    anchors = passage_sets.select("item_id", F.explode("grams").alias("g"))
    held = rows.join(anchors.select("g").distinct(), "g", "left_semi")
    shared = held.join(anchors, "g").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    sizes = passage_sets.select("item_id", F.size("grams").alias("n"))
    # at most the n-grams that touch the first or the last word can be missing
    likely = shared.join(sizes, "item_id").where(F.col("shared") >= F.greatest(F.col("n") - 2, F.lit(1)))
    both = likely.join(passages.select("item_id", F.col("text").alias("passage")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    return both.where(F.contains("text", "passage")).select("item_id", "doc_id")


def most_shared(sets: DataFrame, passage_sets: DataFrame, hits: int = 5) -> DataFrame:
    """(item_id, doc_id, shared, rank): the documents that share the most n-grams with a passage; ties go to the smaller id."""
    anchors = passage_sets.select("item_id", F.explode("grams").alias("g"))
    rows = sets.select("doc_id", F.explode("grams").alias("g"))
    shared = rows.join(anchors, "g").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= hits)
