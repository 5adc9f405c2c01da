import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import canary, evaluate, projection, qrels, qrels_stats, search
from palimpsest.functions.shingles import gram_sets


def one(df):
    return df.first().asDict()


def test_canary_round_trip(spark):
    key = hashlib.sha256(b"c1").digest()
    masked = base64.b64encode(bytes(b ^ key[i % 32] for i, b in enumerate("quéstion".encode()))).decode()
    rows = spark.createDataFrame([("1", masked, "c1"), ("2", "plain", None)], "id string, question string, canary string")
    got = canary.decode(rows, ("question",)).orderBy("id").collect()
    assert [r["question"] for r in got] == ["quéstion", "plain"]
    assert canary.encode(canary.decode(rows, ("question",)), ("question",)).orderBy("id").first()["question"] == masked


def test_tasks_keep_first_of_equal_documents(spark):
    doc = "struct<doc_id:string,text:string,title:string>"
    rows = spark.createDataFrame([("1", "q", "a", [("d1", "x", "t"), ("d2", "y", "t")], [("d1", "x", "u"), ("d1", "z", "t")])], f"record_id string, question string, answer string, gold_docs array<{doc}>, evidence_docs array<{doc}>")
    got = one(projection.tasks(rows, "set"))
    assert [(d["doc_id"], d["text"], d["title"]) for d in got["provided_docs"]] == [("d1", "x", "t"), ("d2", "y", "t"), ("d1", "z", "t")]


def projected(spark):
    def hop(clue, *ids):
        return (clue, [(i, "s") for i in ids])

    rows = [
        ("10", "q", "a", "PROJECTABLE", [hop("c1", "d1", "", "d2"), hop(" ", "d2")], None, None, [("r1", "redundant"), ("", "x")]),
        ("9", "q", "a", "PROJECTABLE", [], [hop("h", "d3")], None, None),
        ("8", "q", "a", "NOT", None, None, None, None),
        ("7", "q", "a", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, projection.PROJECTION)


def test_projection(spark):
    rows = projected(spark)
    assert [(r["record_id"], r["n_hops"], r["support_docids"]) for r in projection.projected_list(rows).collect()] == [("9", 1, ["d3"]), ("10", 1, ["d1", "d2"])]
    assert {r["verdict"]: r["n"] for r in projection.tally(projection.verdicts(rows, "393")).collect()} == {"PROJECTABLE": 2, "NOT": 1, "?": 1, "AUP_SKIP": 1}
    inputs = {r["qid"]: r["clues"] for r in projection.verification_inputs(rows).collect()}
    assert inputs == {"10": ["c1", "r1"], "9": ["h"]}
    assert one(projection.hop_counts(projection.verification_inputs(rows))) == {"least": 1, "median": 1, "most": 2}


def test_rebuild_recomputes_keep(spark):
    hop = lambda ok: ("c", ok, None, None, None)
    runs = [("1", 1, True, True, False, [hop(True)], [], ""), ("2", 1, True, True, True, [hop(True), hop(False)], [], ""), ("3", 0, True, True, True, [], [], ""), ("4", 1, True, False, True, [hop(True)], [], "")]
    inputs = spark.createDataFrame([(str(i), "q", "a") for i in range(1, 5)], "qid string, question string, answer string")
    assert [r["qid"] for r in projection.rebuilt(spark.createDataFrame(runs, projection.RUN), inputs).collect()] == ["1"]


def pool(spark):
    hops = spark.createDataFrame([("1", 0, "c0", "Required", None, None), ("1", 1, "c1", "Required", "No", "Not needed here"), ("1", 2, "c2", "Required", "No", None)], "qid string, index int, clue string, hop_type string, decomposition_judgment string, decomposition_note string")
    questions = spark.createDataFrame([("1", "q", "a", ["c0", "c1", "c2"])], "qid string, question string, answer string, clues array<string>")
    known = qrels.checked_hops(hops, questions)
    votes = [("1", 0, "a", "Supports"), ("1", 0, "b", None), ("1", 0, "c", "Does not support"), ("1", 0, "d", "Unclear"), ("1", 1, "a", "Supports"), ("1", 0, "e", "Partial support")]
    frame = spark.createDataFrame([(q, h, d, None, v, None) for q, h, d, v in votes], "qid string, hop_index int, doc_id string, assistant_flag string, human_judgment string, human_note string")
    return known, qrels.candidates(frame, known)


def test_hops_and_flags(spark):
    known, rows = pool(spark)
    assert {r["index"]: (r["skipped"], r["needs_review_if_empty"]) for r in known.collect()} == {0: (False, False), 1: (True, False), 2: (False, True)}
    assert one(qrels.totals(rows)) == {"rows": 6, "live_rows": 5, "documents": 5, "force_included": 2, "force_excluded": 1}
    bad = spark.createDataFrame([("1", "q", "a", ["c0", "other", "c2"])], "qid string, question string, answer string, clues array<string>")
    with pytest.raises(Exception, match="does not match"):
        qrels.checked_hops(known.select("qid", "index", "clue", "hop_type", "decomposition_judgment", "decomposition_note"), bad).collect()


def test_assembly(spark):
    known, rows = pool(spark)
    rejected = spark.createDataFrame([("1", "d", 0), ("1", "e", 0)], "qid string, doc_id string, hop_index int")
    judged = qrels.recorded(rows, rejected)
    assert {r["doc_id"] for r in judged.collect()} == {"b"}
    built = qrels.assemble(rows, judged, rejected)
    assert {r["doc_id"]: r["hops"] for r in built.collect()} == {"a": [0], "b": [0]}
    assert [r["index"] for r in qrels.needs_review(known, built).collect()] == [2]
    assert [r["doc_id"] for r in qrels.conflicts(rows, rejected).collect()] == ["e"]
    out = one(qrels.released(built, known))
    assert out["qrels"] == {"a": [0], "b": [0]} and [h["index"] for h in out["hops"]] == [0, 1, 2]


def test_closure(spark):
    included = spark.createDataFrame([("1", 1, [0, 1])], "qid string, doc_id long, hops array<int>")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)], "doc_id long, rep_id long")
    near = spark.createDataFrame([(1, 3, 0.9), (3, 1, 0.9), (3, 4, 0.8), (4, 3, 0.8), (4, 5, 0.75), (5, 4, 0.75)], "doc_id long, neighbour long, jaccard double")
    skipped = spark.createDataFrame([("1", 1)], "qid string, index int")

    def judge(pending):  # 4 is rejected, so 5 is never reached
        hops = F.when(F.col("doc_id") == 4, F.expr("cast(array() as array<int>)")).otherwise(F.array(F.lit(0), F.lit(1)))
        return pending.select("qid", "doc_id", hops.alias("hops"), F.lit("").alias("why"))

    got = {r["doc_id"]: r["hops"] for r in qrels.expand(included, members, near, judge, skipped).collect()}
    assert got == {1: [0, 1], 2: [0, 1], 3: [0]}
    with pytest.raises(Exception, match="no decision"):
        qrels.expand(included, members, near, lambda p: judge(p).limit(0), skipped).collect()


def test_pool_statistics(spark):
    values = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10)], "n long")
    got = one(qrels_stats.quartiles(values, "n"))
    assert got == {"least": 1.0, "p25": 1.5, "median": 3.0, "mean": 4.0, "p75": 7.0, "most": 10.0}
    assert {r["band"]: r["n"] for r in qrels_stats.banded(values, "n", qrels_stats.HOP_BANDS).collect()} == {"1–2": 2, "3–5": 2, "6–10": 1}
    with pytest.raises(Exception, match="no band"):
        qrels_stats.banded(spark.createDataFrame([(0,)], "n long"), "n", qrels_stats.HOP_BANDS).collect()
    pct = spark.createDataFrame([(9.99,), (10.0,), (70.0,), (100.0,)], "p double")
    assert {r["band"]: r["n"] for r in qrels_stats.percent_banded(pct, "p").collect()} == {"0-10": 1, "10-20": 1, "70+": 2}
    docs = spark.createDataFrame([("q", i) for i in range(6)], "qid string, doc_id long")
    edges = spark.createDataFrame([(0, 1, 0.8), (1, 2, 0.8), (3, 4, 0.9), (5, 99, 0.9)], "a long, b long, jaccard double")
    r = one(qrels_stats.redundancy(docs, edges))
    assert (r["n_docs"], r["n_near_dup"], r["n_groups"], r["n_redundant"], r["largest_group"]) == (6, 5, 2, 3, 3)
    assert qrels_stats.symmetric(edges).count() == 8


def test_evaluation(spark):
    queries = spark.createDataFrame([("1",), ("2",), ("3",)], "query_id string")
    relevance = spark.createDataFrame([("1", "a", 1), ("1", "b", 1), ("2", "c", 1), ("2", "x", 0), ("3", "d", 1)], "query_id string, doc_id string, relevance int")
    runs = spark.createDataFrame([("1", ["a", "z"], 4), ("2", ["c", "x"], 5)], "query_id string, previewed array<string>, tool_calls int")
    evals = spark.createDataFrame([("1", True), ("2", False)], "query_id string, correct boolean")
    assert one(evaluate.macro(runs, evaluate.gold(relevance), evals, queries)) == {"recall": 50.0, "accuracy": 33.33, "tool_calls": 4.5}
    raw = [("1", '{"extracted_final_answer": "x", "correct_answer": "x", "reasoning": "", "correct": true, "confidence": 90}'), ("2", '{"extracted_final_answer": null, "correct": true}'), ("3", "not json")]
    got = {r["query_id"]: (r["correct"], r["parse_error"]) for r in evaluate.judged(spark.createDataFrame(raw, "query_id string, raw string")).collect()}
    assert got == {"1": (True, False), "2": (False, False), "3": (None, True)}
    text = "Answer:\nExplanation: because [1]\nExact Answer: 42\nConfidence: 90%"
    row = one(spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in evaluate.final_answer(F.col("t")).items()], evaluate.sections_in_order(F.col("t")).alias("ok")))
    assert (row["explanation"], row["exact_answer"], row["confidence"], row["ok"]) == ("because [1]", "42", "90%", True)


def test_run_checks(spark):
    answer = "Answer:\nExplanation: e\nExact Answer: x\nConfidence: 1%"
    ids = ["shard_00001_00002"]
    runs = spark.createDataFrame([("1", "completed", answer, ["search", "read_document", "search"], {"search": 2, "read_document": 1}, 3, ids, ids)], "query_id string, status string, output_text string, results array<string>, tool_call_counts map<string,int>, tool_calls_total int, surfaced array<string>, previewed array<string>")
    queries, relevance = spark.createDataFrame([("1",)], "query_id string"), spark.createDataFrame([("1", ids[0])], "query_id string, doc_id string")
    good = one(evaluate.validate(runs, queries, relevance, 1, 1))
    assert good.pop("incomplete") == 0 and all(good.values())
    bad = one(evaluate.validate(runs.withColumn("tool_calls_total", F.lit(4)).withColumn("previewed", F.array(F.lit("x"))), queries, relevance, 1, 1))
    assert not bad["totals_agree"] and not bad["full_ids"] and not bad["surfaced_previewed"]


def test_attempts_and_calls(spark):
    attempts = spark.createDataFrame([("1", 1, "failed"), ("1", 2, "completed"), ("1", 3, "completed")], "query_id string, attempt int, status string")
    assert projection.first_attempts(attempts).first()["attempt"] == 2
    events = spark.createDataFrame([("1", "tool_call", "search", False), ("1", "tool_call", "search", True), ("1", "note", None, False)], "query_id string, type string, tool string, is_retry boolean")
    assert evaluate.tool_call_counts(events).first()["calls"] == 1


def test_search(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "zero one two three four five six seven nine"), (3, "cats and dogs"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "one two three four five six seven")], "item_id long, text string")
    sets = gram_sets(docs)
    passage_sets = gram_sets(asked.withColumnRenamed("item_id", "doc_id")).withColumnRenamed("doc_id", "item_id")
    assert {r["doc_id"] for r in search.containing(docs, asked, sets, passage_sets).collect()} == {1, 2}
    assert [r["doc_id"] for r in search.most_shared(sets, passage_sets).orderBy("rank").collect()] == [1, 2]
    top = search.bm25(docs, spark.createDataFrame([("q", "dogs")], "query_id string, text string")).collect()
    assert [(r["doc_id"], r["preview"]) for r in top] == [(3, "cats and dogs")]
    clue = spark.createDataFrame([(" clue \n\nAssistant: aid", "3.0")], "c string, m string").select(T.clean_clue(F.col("c"), qrels.SEPARATOR), T.marker_index(F.col("m"))).first()
    assert tuple(clue) == ("clue", 2)
