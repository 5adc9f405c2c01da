"""From judged questions to tasks, projectable questions and verified hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE = "array<struct<doc_id:string,snippet:string>>"
HOPS = f"array<struct<clue:string,corpus_evidence:{EVIDENCE}>>"
LOOSE = "array<struct<clue:string,status:string>>"
PROJECTION = f"record_id string, question string, answer string, verdict string, discriminating_hops {HOPS}, hops {HOPS}, Traces {HOPS}, redundant_or_unsupported_hops {LOOSE}"
RUN = "qid string, n_hops int, all_supported boolean, coverage_ok boolean, keep boolean, hops array<struct<clue:string,supported:boolean,redundant:boolean,doc_ids:array<string>,note:string>>, uncovered_phrases array<string>, reason string"
#: Verdicts, and the methods that they came by.
PROJECTABLE, SKIPPED, UNKNOWN = "PROJECTABLE", "AUP_SKIP", "?"
INFERRED, BLOCKED = "inference_allowed_1agent", "content_policy_block"


def tasks(questions: DataFrame, dataset: str) -> DataFrame:
    """A task a question: its gold and evidence documents once each, in the order they come.

    ``questions`` has record_id, question, answer, gold_docs and evidence_docs
    (arrays of doc_id, text, title). Documents with equal id and text are one.
    """
    first = F.concat(F.coalesce("gold_docs", F.array()), F.coalesce("evidence_docs", F.array()))
    keys = F.transform("all_docs", lambda d: F.concat_ws("|", d["doc_id"], F.md5(F.coalesce(d["text"], F.lit("")))))
    held = questions.withColumn("all_docs", first).withColumn("doc_keys", keys)
    kept = F.filter("all_docs", lambda d, i: F.array_position(F.col("doc_keys"), F.get("doc_keys", i)) == i + 1)
    return held.select(F.lit(dataset).alias("dataset_name"), "record_id", "question", "answer", kept.alias("provided_docs"))


def verdicts(projected: DataFrame, skip_record: str | None = None, skip_verdict: str = SKIPPED) -> DataFrame:
    """(record_id, verdict, method), with a default row for a record that has none."""
    rows = projected.select("record_id", F.coalesce("verdict", F.lit(UNKNOWN)).alias("verdict"))
    if skip_record is not None:
        extra = projected.sparkSession.createDataFrame([(skip_record, skip_verdict)], "record_id string, verdict string")
        rows = rows.unionByName(extra.join(rows, "record_id", "left_anti"))
    method = F.when(F.col("verdict") == skip_verdict, BLOCKED).otherwise(INFERRED)
    return rows.withColumn("method", method).orderBy(F.col("record_id").cast("long"))


def tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def _filled(name: str) -> Column:
    return F.when(F.size(name) > 0, F.col(name))


def known_hops() -> Column:
    """The hops, under whichever of the three names a projection has them."""
    return F.coalesce(_filled("discriminating_hops"), _filled("hops"), _filled("Traces"), F.expr(f"cast(array() as {HOPS})"))


def projected_list(projected: DataFrame) -> DataFrame:
    """Projectable questions with their number of hops that have a clue, and their supporting ids, once each in order."""
    rows = projected.where(F.col("verdict") == PROJECTABLE).withColumn("known", known_hops())
    ids = F.flatten(F.transform("known", lambda h: F.transform(F.coalesce(h["corpus_evidence"], F.expr(f"cast(array() as {EVIDENCE})")), lambda e: e["doc_id"])))
    clued = F.filter("known", lambda h: F.trim(F.coalesce(h["clue"], F.lit(""))) != "")
    return rows.select("record_id", "question", "answer", F.size(clued).alias("n_hops"), F.array_distinct(F.filter(ids, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")).alias("support_docids")).orderBy(F.col("record_id").cast("long"))


def verification_inputs(projected: DataFrame) -> DataFrame:
    """(qid, question, answer, clues): both kinds of hops one after the other, without blank clues."""
    rows = projected.where(F.col("verdict") == PROJECTABLE)
    loose = F.transform(F.coalesce("redundant_or_unsupported_hops", F.expr(f"cast(array() as {LOOSE})")), lambda h: h["clue"])
    clues = F.concat(F.transform(known_hops(), lambda h: h["clue"]), loose)
    return rows.select(F.col("record_id").alias("qid"), "question", "answer", F.filter(clues, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "").alias("clues"))


def hop_counts(inputs: DataFrame) -> DataFrame:
    n = F.size("clues")
    return inputs.agg(F.min(n).alias("least"), F.median(n).cast("int").alias("median"), F.max(n).alias("most"))


def keeps(runs: DataFrame) -> Column:
    """All hops supported and the question covered; recomputed, whatever the run stored."""
    return (F.size("hops") > 0) & F.forall("hops", lambda h: F.coalesce(h["supported"], F.lit(False))) & F.coalesce("coverage_ok", F.lit(False))


def rebuilt(runs: DataFrame, inputs: DataFrame) -> DataFrame:
    """The questions whose run keeps them, with the hops' ids."""
    kept = runs.where(keeps(runs))
    hops = F.transform("hops", lambda h: F.struct(h["clue"].alias("clue"), F.coalesce(h["doc_ids"], F.expr("cast(array() as array<string>)")).alias("doc_ids"), F.coalesce(h["redundant"], F.lit(False)).alias("redundant")))
    return kept.select("qid", hops.alias("hops")).join(inputs.select("qid", "question", "answer"), "qid").orderBy(F.col("qid").cast("long"))


def first_attempts(attempts: DataFrame) -> DataFrame:
    """The first completed attempt of each query."""
    order = Window.partitionBy("query_id").orderBy("attempt")
    return attempts.where(F.col("status") == "completed").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
