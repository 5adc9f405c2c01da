"""Relevance judgments: candidates, verdicts, assembly, and closure over duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import padded
from palimpsest.sources.tables import materialize

#: The votes that force a document in or out, and how a hop is skipped.
INCLUDE = ("Supports", "Partial support")
EXCLUDE = ("Does not support",)
UNDECIDED = ("Unclear",)
SKIP_DECOMPOSITION, SKIP_NOTE = "No", "not needed"
SEPARATOR = "\n\nAssistant:"


def is_in(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def checked_hops(worksheet: DataFrame, questions: DataFrame) -> DataFrame:
    """Worksheet hops with their question, matched by position; a differing count or clue is an error.

    ``worksheet``: qid, index, clue, hop_type, decomposition_judgment, decomposition_note.
    ``questions``: qid, question, answer, clues.
    """
    theirs = questions.select("qid", "question", "answer", F.posexplode("clues").alias("index", "asked"))
    both = worksheet.join(theirs, ["qid", "index"], "full")
    wrong = F.col("clue").isNull() | F.col("asked").isNull() | (F.trim("clue") != F.trim("asked"))
    message = F.concat(F.lit("hop does not match its question: "), F.coalesce(F.col("qid").cast("string"), F.lit("")), F.lit(" "), F.col("index").cast("string"))
    both = both.withColumn("clue", F.when(wrong, F.raise_error(message)).otherwise(F.col("clue")))
    bare = F.coalesce(F.col("decomposition_judgment") == SKIP_DECOMPOSITION, F.lit(False))
    skipped = bare & F.contains(F.lower(F.coalesce("decomposition_note", F.lit(""))), F.lit(SKIP_NOTE))
    return both.drop("asked").withColumn("skipped", skipped).withColumn("needs_review_if_empty", bare & ~skipped)


def candidates(votes: DataFrame, hops: DataFrame) -> DataFrame:
    """Votes (qid, hop_index, doc_id, assistant_flag, human_judgment, human_note) with the flags that follow."""
    live = hops.select("qid", F.col("index").alias("hop_index"), F.col("skipped").alias("hop_skipped"))
    rows = votes.join(live, ["qid", "hop_index"])
    vote = F.col("human_judgment")
    return rows.withColumn("force_include", is_in(vote, INCLUDE) & ~F.col("hop_skipped")).withColumn("force_exclude", is_in(vote, EXCLUDE))


def totals(pool: DataFrame) -> DataFrame:
    return pool.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("hop_skipped")).alias("live_rows"), F.countDistinct("doc_id").alias("documents"),
        F.count_if("force_include").alias("force_included"), F.count_if("force_exclude").alias("force_excluded"),
    )


def undecided(pool: DataFrame) -> DataFrame:
    """Live rows without a clear vote that nothing excludes."""
    open_ = F.col("human_judgment").isNull() | is_in(F.col("human_judgment"), UNDECIDED)
    return pool.where(open_ & ~F.col("hop_skipped") & ~F.col("force_exclude"))


def recorded(pool: DataFrame, rejections: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, hop_index) judged relevant: undecided rows that no one rejected, and overridden ones."""
    taken = undecided(pool).join(rejections.select("qid", "doc_id", "hop_index"), ["qid", "doc_id", "hop_index"], "left_anti").select("qid", "doc_id", "hop_index")
    if overrides is not None:
        taken = taken.unionByName(pool.where("not hop_skipped").join(overrides, ["qid", "doc_id", "hop_index"], "left_semi").select("qid", "doc_id", "hop_index"))
    return taken.distinct()


def assemble(pool: DataFrame, judged: DataFrame, rejections: DataFrame) -> DataFrame:
    """(qid, doc_id, hops): live rows that aren't rejected, and are voted in or judged relevant."""
    key = ["qid", "doc_id", "hop_index"]
    rows = pool.where("not hop_skipped").join(rejections.select(*key), key, "left_anti")
    rows = rows.join(judged.select(*key).distinct().withColumn("judged", F.lit(True)), key, "left")
    kept = rows.where(is_in(F.col("human_judgment"), INCLUDE) | F.coalesce("judged", F.lit(False)))
    return kept.groupBy("qid", "doc_id").agg(F.sort_array(F.collect_set("hop_index")).alias("hops"))


def conflicts(pool: DataFrame, rejections: DataFrame) -> DataFrame:
    """Rows that a vote includes and a rejection takes out again."""
    return pool.where("force_include").join(rejections.select("qid", "doc_id", "hop_index"), ["qid", "doc_id", "hop_index"], "left_semi")


def needs_review(hops: DataFrame, built: DataFrame) -> DataFrame:
    """Live hops without a supporting document."""
    served = built.select("qid", F.explode("hops").alias("index"))
    return hops.where("not skipped").join(served, ["qid", "index"], "left_anti")


def released(built: DataFrame, hops: DataFrame) -> DataFrame:
    """One row a question: question, answer, hops, and a map of document to sorted hops, by document."""
    asked = hops.groupBy("qid").agg(F.first("question").alias("question"), F.first("answer").alias("answer"), F.sort_array(F.collect_list(F.struct("index", "clue", "hop_type", "skipped"))).alias("hops"))
    maps = built.groupBy("qid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_id", "hops")))).alias("qrels"))
    return asked.join(maps, "qid", "left").orderBy(F.col("qid").cast("long"))


def inherit_exact(included: DataFrame, members: DataFrame) -> DataFrame:
    """Adds the copies of included documents with their parent's hops; the smallest parent wins.

    ``members`` has (doc_id, rep_id). A copy that is in already stays as it is.
    """
    groups = included.join(members, "doc_id").select("qid", "rep_id", F.col("doc_id").alias("parent"), "hops")
    first = groups.groupBy("qid", "rep_id").agg(F.min(F.struct("parent", "hops")).alias("x"))
    copies = first.join(members, "rep_id").select("qid", "doc_id", F.col("x.hops").alias("hops"))
    return included.unionByName(copies.join(included, ["qid", "doc_id"], "left_anti"))


def near_frontier(included: DataFrame, checked: DataFrame, decided: DataFrame, near: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(qid, doc_id, parent, jaccard): neighbours to be judged, each with its nearest parent (ties: the smaller id).

    ``near`` has (doc_id, neighbour, jaccard), both ways.
    """
    parents = included.select("qid", "doc_id").join(checked, ["qid", "doc_id"], "left_anti")
    rows = parents.join(near.where(F.col("jaccard") >= threshold), "doc_id").select("qid", F.col("neighbour").alias("doc_id"), F.col("doc_id").alias("parent"), "jaccard")
    rows = rows.join(included.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").join(decided.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    best = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(F.desc("jaccard"), "parent"))
    return rows.withColumn("n", best).where("n = 1").drop("n")


def apply_decisions(included: DataFrame, pending: DataFrame, decisions: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The included documents and the decided ones after every pending row got a decision.

    ``decisions`` has (qid, doc_id, hops, why); hops that are skipped don't
    count, and none left is a rejection. A pending row without one is an error.
    """
    dead = skipped.groupBy("qid").agg(F.collect_set("index").alias("dead"))
    rows = pending.join(decisions, ["qid", "doc_id"], "left").join(dead, "qid", "left")
    hops = F.when(F.col("hops").isNull(), F.raise_error(F.concat(F.lit("no decision for "), F.col("doc_id").cast("string")))).otherwise(F.array_except("hops", F.coalesce("dead", F.expr("cast(array() as array<int>)"))))
    decided = rows.select("qid", "doc_id", hops.alias("hops"), "why", "parent", "jaccard")
    accepted = decided.where(F.size("hops") > 0).select("qid", "doc_id", "hops")
    merged = included.unionByName(accepted).groupBy("qid", "doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("hops")))).alias("hops"))
    return merged, decided


def expand(included: DataFrame, members: DataFrame, near: DataFrame, judge, skipped: DataFrame, threshold: float = 0.7, rounds: int = 20) -> DataFrame:
    """Closure: inherit copies, queue near neighbours, apply the judge's decisions, until nothing is queued.

    ``judge`` maps pending rows to decisions. Each round is written out.
    """
    spark = included.sparkSession
    checked = spark.createDataFrame([], included.select("qid", "doc_id").schema)
    decided = checked
    for _ in range(rounds):
        included = materialize(inherit_exact(included, members), "included")
        pending = materialize(near_frontier(included, checked, decided, near, threshold), "pending")
        checked = included.select("qid", "doc_id")  # all that were scanned, with neighbours or without
        if pending.isEmpty():
            return included
        included, new = apply_decisions(included, pending, judge(pending), skipped)
        decided = materialize(decided.unionByName(new.select("qid", "doc_id")), "decided")
        included = materialize(included, "included")
    raise RuntimeError(f"no closure in {rounds} rounds")


def status(pending: DataFrame) -> DataFrame:
    return pending.groupBy("qid").agg(F.count(F.lit(1)).alias("pending")).orderBy(F.desc("pending"), "qid")


def normalised(rows: DataFrame, *columns: str) -> DataFrame:
    """Padded spellings in id columns."""
    return rows.withColumns({c: padded(F.col(c)) for c in columns})
