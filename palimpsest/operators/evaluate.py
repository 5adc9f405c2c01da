"""Scores of agent runs, and the checks that a run must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import SECTIONS, is_full_id, section

JUDGED = "extracted_final_answer string, correct_answer string, reasoning string, correct boolean, confidence double, _corrupt_record string"
TOOLS = ("search", "read_document")


def gold(qrels: DataFrame) -> DataFrame:
    """(query_id, gold): the relevant documents of each question."""
    return qrels.where(F.col("relevance") > 0).groupBy("query_id").agg(F.collect_set("doc_id").alias("gold"))


def recalls(runs: DataFrame, relevant: DataFrame) -> DataFrame:
    """Recall of each question's previewed documents, without cut-off; a missing run has recall 0."""
    found = F.size(F.array_intersect(F.coalesce("previewed", F.expr("cast(array() as array<string>)")), "gold"))
    return relevant.join(runs, "query_id", "left").select("query_id", (found / F.size("gold")).alias("recall"))


def macro(runs: DataFrame, relevant: DataFrame, evals: DataFrame, queries: DataFrame) -> DataFrame:
    """Macro recall, accuracy over all queries, and mean tool calls, in percent and rounded last."""
    recall = recalls(runs.select("query_id", "previewed"), relevant).agg((F.avg("recall") * 100).alias("recall"))
    right = queries.join(evals, "query_id", "left").agg((F.count_if(F.coalesce("correct", F.lit(False))) * 100 / F.count(F.lit(1))).alias("accuracy"))
    calls = runs.agg(F.avg("tool_calls").alias("tool_calls"))
    one = recall.join(right).join(calls)  # one row each
    return one.select(F.bround("recall", 2).alias("recall"), F.bround("accuracy", 2).alias("accuracy"), F.bround("tool_calls", 2).alias("tool_calls"))


def judged(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The judge's JSON, with ``parse_error`` where it isn't just such an object."""
    parsed = F.from_json(F.col(column), JUDGED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.withColumn("j", parsed)
    wrong = F.col("j._corrupt_record").isNotNull() | F.col("j.correct").isNull()
    correct = F.when(F.col("j.extracted_final_answer").isNull(), F.lit(False)).otherwise(F.col("j.correct"))
    return rows.select(*raw.columns, F.col("j.extracted_final_answer").alias("extracted_final_answer"), F.when(~wrong, correct).alias("correct"), F.when(~wrong, F.col("j.confidence")).alias("confidence"), wrong.alias("parse_error"))


def tool_call_counts(events: DataFrame) -> DataFrame:
    """(query_id, tool, calls) from a run's chronological results; a failed call counts once, retries don't."""
    calls = events.where((F.col("type") == "tool_call") & ~F.coalesce("is_retry", F.lit(False)))
    return calls.groupBy("query_id", "tool").agg(F.count(F.lit(1)).alias("calls"))


def first_met(lists: Column) -> Column:
    """The ids of a list of lists, each where it comes first."""
    return F.array_distinct(F.flatten(lists))


def agent_documents(opened: Column, cited: Column) -> Column:
    empty = F.expr("cast(array() as array<string>)")
    return F.array_union(F.coalesce(opened, empty), F.coalesce(cited, empty))


def final_answer(text: Column) -> dict[str, Column]:
    """The sections of a final answer by heading."""
    return {name.lower().replace(" ", "_"): section(text, name, SECTIONS[i + 1] if i + 1 < len(SECTIONS) else None) for i, name in enumerate(SECTIONS)}


def sections_in_order(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?s)(?:^|\n)\s*" + r".*?\n\s*".join(f"{s}:" for s in SECTIONS)), F.lit(False))


def validate(runs: DataFrame, queries: DataFrame, qrels: DataFrame, expected_queries: int, expected_qrels: int) -> DataFrame:
    """One row of checks over a run. ``runs``: query_id, status, output_text, results, tool_call_counts (map), tool_calls_total, surfaced, previewed."""
    completed = F.col("status") == "completed"
    same = lambda c: F.coalesce(F.col(c) == F.array_distinct(c), F.lit(True))
    ids = lambda c: F.forall(F.coalesce(c, F.expr("cast(array() as array<string>)")), is_full_id)
    summed = F.aggregate(F.map_values("tool_call_counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    derived = F.forall(F.map_entries("tool_call_counts"), lambda e: F.size(F.filter("results", lambda r: r == e["key"])) == e["value"])
    per = runs.agg(
        F.bool_and(F.col("status").isNotNull()).alias("has_status"), F.bool_and(~completed | sections_in_order(F.col("output_text"))).alias("answers_complete"),
        F.bool_and(derived).alias("counts_agree"), F.bool_and(F.col("tool_calls_total") == summed).alias("totals_agree"), F.bool_and(same("surfaced") & same("previewed")).alias("lists_deduplicated"),
        F.bool_and(ids("surfaced") & ids("previewed")).alias("full_ids"), F.bool_and(F.col("surfaced").eqNullSafe(F.col("previewed"))).alias("surfaced_previewed"), F.count_if(~completed).alias("incomplete"),
        F.bool_and(F.map_contains_key("tool_call_counts", TOOLS[0]) & F.map_contains_key("tool_call_counts", TOOLS[1])).alias("both_tools_counted"),
    )
    asked = queries.agg((F.countDistinct("query_id") == expected_queries).alias("query_count"))
    pairs = qrels.select("query_id", "doc_id").distinct().agg((F.count(F.lit(1)) == expected_qrels).alias("qrel_count"))
    bare = queries.join(qrels, "query_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("every_query_judged"))
    missing = queries.select("query_id").exceptAll(runs.select("query_id")).agg((F.count(F.lit(1)) == 0).alias("same_queries"))
    return per.join(asked).join(pairs).join(bare).join(missing)  # one row each
