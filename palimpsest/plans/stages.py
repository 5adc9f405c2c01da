"""The written tables that several queries over one corpus share.

Each is made once a session and data folder, and read by all that need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.shingles import gram_sets
from palimpsest.operators import cliques, exact, lengths, minhash, qrels, records, search, similarity
from palimpsest.sources.tables import materialize, table

_made: dict[tuple[str, str, str], DataFrame] = {}


def clear() -> None:
    """Forget the tables, as between timed runs."""
    _made.clear()


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.docs = table(spark, sf_dir, "documents")

    def once(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _made:
            _made[key] = materialize(make(), name)
        return _made[key]

    def scanned(self) -> DataFrame:
        return self.once("scanned", lambda: exact.scan(self.docs))

    def members(self) -> DataFrame:
        return self.once("members", lambda: exact.members(self.scanned()).select("doc_id", "rep_id", "group_size", "char_len"))

    def sets(self) -> DataFrame:
        """N-gram sets of representatives."""

        def make() -> DataFrame:
            reps = self.members().where("doc_id = rep_id").select("doc_id")
            return gram_sets(self.docs.join(reps, "doc_id", "left_semi"))

        return self.once("sets", make)

    def all_sets(self) -> DataFrame:
        return self.once("all_sets", lambda: gram_sets(self.docs))

    def passages(self) -> DataFrame:
        return table(self.spark, self.dir, "benchmark")

    def passage_sets(self) -> DataFrame:
        return gram_sets(self.passages().select(F.col("item_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item_id")

    def pool(self) -> DataFrame:
        """(item_id, doc_id) of documents that have a passage verbatim."""
        return self.once("pool", lambda: search.containing(self.docs, self.passages(), self.all_sets(), self.passage_sets()))

    def previewed(self) -> DataFrame:
        """(item_id, doc_id, shared, rank) of the documents that share most with a passage."""
        return self.once("previewed", lambda: search.most_shared(self.all_sets(), self.passage_sets()))

    def hops(self) -> DataFrame:
        """A passage's sentences are its hops; of some passages the second one is skipped."""
        rows = self.passages().select(F.col("item_id").alias("qid"), F.posexplode(F.filter(F.split("text", r"[.!?]\s*"), lambda s: s != "")).alias("index", "clue"))
        return rows.withColumn("skipped", (F.col("index") == 1) & (F.col("qid") % 3 == 0)).withColumn("hop_type", F.lit("Required"))

    def pairs(self) -> DataFrame:
        """(qid, doc_id, hop): every hop of a passage with each document that has the passage."""
        hops = self.hops().select(F.col("qid").alias("item_id"), F.col("index").alias("hop"))
        return self.pool().join(hops, "item_id").select(F.col("item_id").alias("qid"), "doc_id", "hop")

    def candidates(self) -> DataFrame:
        """Labels stand in for votes: of good quality supports, poor doesn't, none is open."""
        labels = table(self.spark, self.dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "Supports").when(F.col("quality") == 0, "Does not support").alias("human_judgment"))
        votes = self.pairs().join(labels, "doc_id", "left").select("qid", F.col("hop").alias("hop_index"), "doc_id", "human_judgment")
        return qrels.candidates(votes, self.hops())

    def edges(self) -> DataFrame:
        return self.once("edges", lambda: similarity.near_pairs(self.sets(), 0.7))

    def records(self) -> DataFrame:
        return self.once("records", lambda: records.records(self.edges(), self.members()))

    def counted(self) -> DataFrame:
        """The records without their lists, for statistics."""
        return self.once("counted", lambda: records.counted(self.edges(), self.members()))

    def lengths(self) -> DataFrame:
        return self.once("lengths", lambda: lengths.token_counts(self.docs))

    def components(self) -> DataFrame:
        return self.once("components", lambda: cliques.components(self.edges()))

    def partition(self, threshold: float) -> DataFrame:
        """The clusters at one of the published thresholds, which are found in one pass."""
        found = self.once("cliques", lambda: cliques.partitions(self.edges(), (0.7, 0.8, 0.9), self.components()))
        return found.where(F.col("threshold") == threshold).drop("threshold")

    def bands(self) -> DataFrame:
        """Bands of the small hash family, over all documents."""
        return self.once("bands", lambda: minhash.small_bands(minhash.small_signatures(self.docs)))

    def signed(self, bands: int = 73, rows: int = 7) -> DataFrame:
        return self.once(f"signed_{bands}_{rows}", lambda: minhash.signed_bands(self.sets(), bands, rows))
