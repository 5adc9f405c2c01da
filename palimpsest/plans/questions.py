"""Queries over questions, judgments and runs, derived from the tables.

Benchmark passages are the questions and their sentences the hops; documents
that hold a passage verbatim are its gold documents, and those that share most
n-grams with it stand for what an agent saw. Conversations give attempts and
calls, and labels give votes. All rows of these tables take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import canary, evaluate, projection, qrels, qrels_stats, records
from palimpsest.plans import sql
from palimpsest.plans.registry import joined, query
from palimpsest.plans.stages import Corpus
from palimpsest.sources import corpus as sources
from palimpsest.sources import sinks
from palimpsest.sources.tables import folder, materialize, table

_BASE = sql.PREVIEWED + ", " + sql.POOL_BODY + " "
_SENTENCES = "SELECT item_id AS qid, unnest(cs) AS clue, unnest(range(len(cs))) AS index, len(cs) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[.!?]\\s*'), lambda s: s <> '') AS cs FROM benchmark)"


def _labels(c: Corpus) -> DataFrame:
    return table(c.spark, c.dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def _sentences() -> Column:
    return F.filter(F.split("text", r"[.!?]\s*"), lambda s: s != "")


def _lists(c: Corpus) -> DataFrame:
    """One row a passage: its gold documents by id, and the seen ones by rank."""
    gold = c.pool().groupBy("item_id").agg(F.sort_array(F.collect_list("doc_id")).alias("gold"))
    seen = c.previewed().groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("seen"))
    none = F.expr("cast(array() as array<bigint>)")
    rows = c.passages().join(gold, "item_id", "left").join(seen, "item_id", "left")
    return rows.select("item_id", "text", F.coalesce("gold", none).alias("gold"), F.coalesce("seen", none).alias("seen"))


def _lists_with_texts(c: Corpus) -> DataFrame:
    def make() -> DataFrame:
        wanted = _lists(c).select("item_id", F.explode(F.array_union("gold", "seen")).alias("doc_id"))
        texts = wanted.join(c.docs.select("doc_id", "text", "source"), "doc_id")
        maps = texts.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", F.struct(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("source").alias("title"))))).alias("held"))
        rows = _lists(c).join(maps, "item_id", "left")
        doc = lambda d: F.element_at("held", d)
        return rows.select("item_id", "text", F.transform("gold", doc).alias("gold_docs"), F.transform("seen", doc).alias("evidence_docs"))

    return c.once("lists", make)


# -- tasks and projections

_MET = "met AS (SELECT item_id, doc_id, 0 AS part, doc_id AS place FROM pool UNION ALL SELECT item_id, doc_id, 1, rank FROM previewed), "
_UNION = _MET + "once AS (SELECT item_id, doc_id, min((part, place)) AS place FROM met GROUP BY 1, 2)"


@query(_BASE + f", {_UNION} SELECT 'set' AS dataset_name, b.item_id::VARCHAR AS record_id, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY place), '') AS doc_ids, count(doc_id) AS n_docs FROM benchmark b LEFT JOIN once o ON o.item_id = b.item_id GROUP BY b.item_id")
def tasks(c: Corpus) -> DataFrame:
    rows = _lists_with_texts(c).select(F.col("item_id").cast("string").alias("record_id"), F.col("text").alias("question"), F.lit("").alias("answer"), "gold_docs", "evidence_docs")
    ids = F.transform("provided_docs", lambda d: d["doc_id"])
    return projection.tasks(rows, "set").select("dataset_name", "record_id", F.array_join(ids, ",").alias("doc_ids"), F.size("provided_docs").cast("long").alias("n_docs"))


def _projected(c: Corpus) -> DataFrame:
    """A projection of each passage: hops under one of three names, the last of several sentences as a loose one."""

    def make() -> DataFrame:
        rows = _lists(c).withColumn("cs", _sentences()).withColumn("n", F.size("cs"))
        evidence = F.transform(F.array_union("gold", "seen"), lambda d: F.struct(d.cast("string").alias("doc_id"), F.lit("s").alias("snippet")))
        hops = F.transform(F.slice("cs", F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda s: F.struct(s.alias("clue"), F.col("evidence").alias("corpus_evidence")))
        rows = rows.withColumn("evidence", evidence).withColumn("known", hops)
        name = lambda test: F.when(test, F.col("known"))
        loose = F.when(F.col("n") > 1, F.array(F.struct(F.element_at("cs", -1).alias("clue"), F.lit("redundant").alias("status"))))
        verdict = F.when(F.size("gold") > 0, projection.PROJECTABLE).when(F.size("seen") > 1, "NOT_PROJECTABLE")
        return rows.select(
            F.col("item_id").cast("string").alias("record_id"), F.col("text").alias("question"), F.lit("a").alias("answer"), verdict.alias("verdict"),
            name(F.col("n") == 1).alias("discriminating_hops"), name(F.col("n") == 2).alias("hops"), name(F.col("n") > 2).alias("Traces"), loose.alias("redundant_or_unsupported_hops"),
        )

    return c.once("projected", make)


_VERDICTS = _BASE + ", verdicts AS (SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM pool) THEN 'PROJECTABLE' WHEN (SELECT count(*) FROM previewed p WHERE p.item_id = b.item_id) > 1 THEN 'NOT_PROJECTABLE' END AS verdict FROM benchmark b)"


@query(_VERDICTS + ", rows AS (SELECT item_id, coalesce(verdict, '?') AS verdict FROM verdicts UNION ALL SELECT 999999999, 'AUP_SKIP') SELECT item_id::VARCHAR AS record_id, verdict, CASE WHEN verdict = 'AUP_SKIP' THEN 'content_policy_block' ELSE 'inference_allowed_1agent' END AS method, row_number() OVER (ORDER BY item_id) AS place FROM rows")
def projection_verdicts(c: Corpus) -> DataFrame:
    """Verdicts in the numeric order of their ids, with a default one for a record without."""
    return sources.numbered(projection.verdicts(_projected(c), "999999999"), [F.col("record_id").cast("long")])


@query(_VERDICTS + " SELECT coalesce(verdict, '?') AS verdict, count(*) AS n FROM verdicts GROUP BY 1")
def verdict_tally(c: Corpus) -> DataFrame:
    return projection.tally(projection.verdicts(_projected(c)))


@query(_VERDICTS + f", {_UNION}, s AS ({_SENTENCES}), ids AS (SELECT item_id, string_agg(doc_id::VARCHAR, ',' ORDER BY place) AS ids FROM once GROUP BY 1) SELECT v.item_id::VARCHAR AS record_id, greatest(max(n) - 1, 1) AS n_hops, any_value(ids) AS support_docids FROM verdicts v JOIN s ON s.qid = v.item_id JOIN ids USING (item_id) WHERE verdict = 'PROJECTABLE' GROUP BY v.item_id")
def projected_questions(c: Corpus) -> DataFrame:
    return projection.projected_list(_projected(c)).select("record_id", F.col("n_hops").cast("long").alias("n_hops"), joined("support_docids").alias("support_docids"))


@query(_VERDICTS + f", s AS ({_SENTENCES}) SELECT v.item_id::VARCHAR AS qid, any_value(b.text) AS question, string_agg(clue, '|' ORDER BY index) FILTER (WHERE trim(clue) <> '') AS clues FROM verdicts v JOIN benchmark b USING (item_id) JOIN s ON s.qid = v.item_id WHERE verdict = 'PROJECTABLE' GROUP BY v.item_id")
def verification_inputs(c: Corpus) -> DataFrame:
    return projection.verification_inputs(_projected(c)).select("qid", "question", F.array_join("clues", "|").alias("clues"))


@query(_VERDICTS + f", s AS ({_SENTENCES}), h AS (SELECT item_id, count(*) FILTER (WHERE trim(clue) <> '') AS n FROM verdicts JOIN s ON s.qid = item_id WHERE verdict = 'PROJECTABLE' GROUP BY 1) SELECT min(n)::INTEGER AS least, floor(median(n))::INTEGER AS median, max(n)::INTEGER AS most FROM h")
def hop_count_stats(c: Corpus) -> DataFrame:
    return projection.hop_counts(projection.verification_inputs(_projected(c)))


def _runs(c: Corpus) -> DataFrame:
    """A verification run of each projectable passage: a hop is supported if the best seen document has its words, and the best being a gold one covers the question."""
    inputs = projection.verification_inputs(_projected(c))
    best = c.previewed().where("rank = 1").join(c.docs.select("doc_id", F.col("text").alias("body")), "doc_id").select(F.col("item_id").cast("string").alias("of"), "doc_id", "body")
    gold = c.pool().select(F.col("item_id").cast("string").alias("g"), F.col("doc_id").alias("gd"))
    rows = inputs.join(best, inputs["qid"] == best["of"], "left").join(gold, (F.col("of") == F.col("g")) & (F.col("doc_id") == F.col("gd")), "left")
    hop = lambda s: F.struct(s.alias("clue"), F.coalesce(F.contains("body", s), F.lit(False)).alias("supported"), F.lit(None).cast("boolean").alias("redundant"), F.array(F.col("doc_id").cast("string")).alias("doc_ids"), F.lit("").alias("note"))
    return rows.select("qid", F.size("clues").alias("n_hops"), F.lit(True).alias("all_supported"), F.col("gd").isNotNull().alias("coverage_ok"), F.lit(True).alias("keep"), F.transform("clues", hop).alias("hops"))


@query(_VERDICTS + f", s AS ({_SENTENCES}), best AS (SELECT p.item_id, p.doc_id, d.text FROM previewed p JOIN documents d USING (doc_id) WHERE rank = 1) SELECT item_id::VARCHAR AS qid, string_agg(clue, '|' ORDER BY index) AS clues, any_value(doc_id)::VARCHAR AS doc_id FROM verdicts JOIN s ON s.qid = item_id JOIN best USING (item_id) WHERE verdict = 'PROJECTABLE' AND trim(clue) <> '' AND EXISTS (SELECT 1 FROM pool g WHERE g.item_id = best.item_id AND g.doc_id = best.doc_id) GROUP BY item_id HAVING bool_and(contains(text, clue))")
def rebuilt_questions(c: Corpus) -> DataFrame:
    """The questions that a run keeps, whatever the run itself stored."""
    rebuilt = projection.rebuilt(_runs(c), projection.verification_inputs(_projected(c)))
    return rebuilt.select("qid", F.array_join(F.transform("hops", lambda h: h["clue"]), "|").alias("clues"), F.get("hops", F.lit(0))["doc_ids"][0].alias("doc_id"))


@query("SELECT conv_id AS query_id, min(turn)::BIGINT AS attempt FROM conversations WHERE role = 'assistant' GROUP BY 1")
def first_attempts(c: Corpus) -> DataFrame:
    """A conversation's turns are its attempts, and the assistant's are completed."""
    turns = table(c.spark, c.dir, "conversations")
    attempts = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("long").alias("attempt"), F.when(F.col("role") == "assistant", "completed").otherwise("failed").alias("status"))
    return projection.first_attempts(attempts).select("query_id", "attempt")


# -- worksheets and judgments


def _worksheet(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Hops with notes by length of the clue, and the questions that they belong to."""
    asked = c.passages().select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"), F.lit("a").alias("answer"), _sentences().alias("clues"))
    rows = asked.select("qid", F.posexplode("clues").alias("index", "clue"))
    n = F.length("clue")
    judged = F.when(n < 40, "No").when(n < 80, "Yes")
    return rows.select("qid", "index", "clue", F.when(n < 60, "Required").otherwise("Optional").alias("hop_type"), judged.alias("decomposition_judgment"), F.when(n < 30, "Not needed here").alias("decomposition_note")), asked


@query(f"WITH s AS ({_SENTENCES}) SELECT qid::VARCHAR AS qid, index::INTEGER AS index, CASE WHEN length(clue) < 60 THEN 'Required' ELSE 'Optional' END AS hop_type, length(clue) < 30 AS skipped, length(clue) BETWEEN 30 AND 39 AS needs_review_if_empty FROM s")
def checked_hops(c: Corpus) -> DataFrame:
    return qrels.checked_hops(*_worksheet(c)).select("qid", "index", "hop_type", "skipped", "needs_review_if_empty")


@query(f"WITH s AS ({_SENTENCES}) SELECT qid, index::INTEGER AS index, trim(clue) AS clue, (index + 1) || '.0' AS marker FROM s")
def cleaned_clues(c: Corpus) -> DataFrame:
    """Clues with an assistant's turn after them, and one-based markers."""
    rows = c.passages().select(F.col("item_id").alias("qid"), F.posexplode(_sentences()).alias("i", "s"))
    raw = rows.select("qid", F.concat(F.lit(" "), "s", F.lit("\n" + qrels.SEPARATOR + "aid")).alias("clue"), F.concat((F.col("i") + 1).cast("string"), F.lit(".0")).alias("marker"))
    return raw.select("qid", T.marker_index(F.col("marker")).alias("index"), T.clean_clue(F.col("clue"), qrels.SEPARATOR).alias("clue"), "marker")


@query(sql.CANDIDATES + "SELECT qid, doc_id, hop::BIGINT AS hop_index FROM cand JOIN documents USING (doc_id) WHERE vote = 'Supports' AND NOT skipped AND lang = 'en'")
def vote_conflicts(c: Corpus) -> DataFrame:
    """Rows that a vote includes and a rejection, here of all English documents, takes out."""
    pool = c.candidates()
    rejected = pool.join(c.docs.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("qid", "doc_id", "hop_index")
    return qrels.conflicts(pool, rejected).select("qid", "doc_id", F.col("hop_index").cast("long").alias("hop_index"))


@query(sql.HOPS + ", m AS (SELECT qid, doc_id, string_agg(hop::VARCHAR, '+' ORDER BY hop) AS hs FROM pairs GROUP BY 1, 2), maps AS (SELECT qid, string_agg(doc_id || ':' || hs, ',' ORDER BY doc_id) AS qrels FROM m GROUP BY 1) SELECT item_id AS qid, b.text AS question, (SELECT count(*) FROM hops h WHERE h.qid = item_id) AS n_hops, qrels FROM benchmark b LEFT JOIN maps ON maps.qid = item_id WHERE item_id IN (SELECT qid FROM hops)")
def released_qrels(c: Corpus) -> DataFrame:
    """The released judgments, one JSON file a question, written and read again."""
    built = c.pairs().groupBy("qid", "doc_id").agg(F.sort_array(F.collect_set("hop")).alias("hops"))
    hops = c.hops().join(c.passages().select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit("").alias("answer")), "qid")
    path = f"{folder(c.spark)}/qrels"
    sinks.write_json(qrels.released(built, hops).withColumn("of", F.col("qid")), path, partition_by="of")
    back = sources.read_json_files(c.spark, f"{path}/*", "qid long, question string, hops array<struct<index:int>>, qrels map<string,array<int>>")
    one = F.transform(F.array_sort(F.transform(F.map_entries("qrels"), lambda e: F.struct(e["key"].cast("long").alias("d"), e["value"].alias("h")))), lambda e: F.concat(e["d"].cast("string"), F.lit(":"), F.array_join(e["h"].cast("array<string>"), "+")))
    return back.select("qid", "question", F.size("hops").cast("long").alias("n_hops"), F.array_join(one, ",").alias("qrels"))


def _near(c: Corpus) -> DataFrame:
    return c.once("near_rows", lambda: records.near_rows(c.edges(), c.members()))


_CLOSED = f"""WITH RECURSIVE {sql.NEAR_BODY}, {sql.POOL_BODY}, judged AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
closed(qid, doc_id) AS (SELECT item_id, doc_id FROM pool UNION (SELECT c.qid, m.doc_id FROM closed c JOIN reps r ON r.doc_id = c.doc_id JOIN reps m ON m.rep_id = r.rep_id
UNION SELECT c.qid, n.neighbour FROM closed c JOIN near n ON n.doc_id = c.doc_id LEFT JOIN judged j ON j.doc_id = n.neighbour WHERE coalesce(j.quality, 1) = 1)) """


@query(_CLOSED + "SELECT qid, doc_id, '0' AS hops FROM closed")
def closed_qrels(c: Corpus) -> DataFrame:
    """Gold documents closed over copies and judged near neighbours: a label of poor quality rejects, all else supports the first hop; the second is skipped."""
    included = c.pool().select(F.col("item_id").alias("qid"), "doc_id", F.array(F.lit(0)).alias("hops"))
    poor = _labels(c).where("quality = 0").select(F.col("doc_id").alias("poor"))
    skipped = c.passages().select(F.col("item_id").alias("qid"), F.lit(1).alias("index"))

    def judge(pending: DataFrame) -> DataFrame:
        rows = pending.join(poor, F.col("doc_id") == F.col("poor"), "left")
        return rows.select("qid", "doc_id", F.when(F.col("poor").isNotNull(), F.expr("cast(array() as array<int>)")).otherwise(F.array(F.lit(0), F.lit(1))).alias("hops"), F.lit("").alias("why"))

    closed = qrels.expand(included, c.members().select("doc_id", "rep_id"), _near(c), judge, skipped)
    return closed.select("qid", "doc_id", joined("hops").alias("hops"))


_FRONTIER = sql.NEAR + ", " + sql.POOL_BODY + ", pending AS (SELECT DISTINCT item_id AS qid, neighbour AS doc_id FROM pool JOIN near USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.item_id = pool.item_id AND p.doc_id = neighbour))"


def _pending(c: Corpus) -> DataFrame:
    nothing = c.spark.createDataFrame([], "qid long, doc_id long")
    return c.once("pending", lambda: qrels.near_frontier(c.pool().select(F.col("item_id").alias("qid"), "doc_id"), nothing, nothing, _near(c)))


@query(_FRONTIER + " SELECT qid, count(*) AS pending, row_number() OVER (ORDER BY count(*) DESC, qid) AS place FROM pending GROUP BY 1")
def frontier_status(c: Corpus) -> DataFrame:
    return sources.numbered(qrels.status(_pending(c)), [F.desc("pending"), F.col("qid")])


@query(_FRONTIER + " SELECT qid, doc_id, length(text) AS n_chars, length(text) > 300 AS truncated, substr(text, 1, 300) AS text FROM pending JOIN documents USING (doc_id)")
def review_worksheet(c: Corpus) -> DataFrame:
    rows = _pending(c).select("qid", "doc_id").join(c.docs.select("doc_id", "text"), "doc_id")
    return sinks.worksheet(rows, 300).select("qid", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "truncated", "text")


@query(_FRONTIER + ", judged AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) SELECT qid, doc_id, coalesce(quality, 1) = 1 AS accepted FROM pending LEFT JOIN judged USING (doc_id)")
def applied_decisions(c: Corpus) -> DataFrame:
    """One round of decisions on what is pending."""
    poor = _labels(c).where("quality = 0").select(F.col("doc_id").alias("poor"))
    pending = _pending(c)
    hops = F.when(F.col("poor").isNotNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))  # the second hop is skipped
    decisions = pending.join(poor, F.col("doc_id") == F.col("poor"), "left").select("qid", "doc_id", hops.alias("hops"), F.lit("").alias("why"))
    included = c.pool().select(F.col("item_id").alias("qid"), "doc_id", F.array(F.lit(0)).alias("hops"))
    skipped = c.passages().select(F.col("item_id").alias("qid"), F.lit(1).alias("index"))
    _, decided = qrels.apply_decisions(included, pending, decisions, skipped)
    return decided.select("qid", "doc_id", (F.size("hops") > 0).alias("accepted"))


@query(sql.PAIRS + "SELECT a, b, jaccard FROM pairs UNION ALL SELECT b, a, jaccard FROM pairs")
def symmetric_edges(c: Corpus) -> DataFrame:
    return qrels_stats.symmetric(c.edges())


# -- statistics of pools


def _band(bands: list[tuple[int, int | None]]) -> str:
    return "CASE " + " ".join(f"WHEN n_docs <= {hi} THEN '{lo}–{hi}'" if hi else f"ELSE '{lo}+'" for lo, hi in bands) + " END"


@query(sql.HOPS + f", q AS (SELECT qid, count(DISTINCT doc_id) AS n_docs FROM pairs GROUP BY 1), h AS (SELECT qid, hop, count(DISTINCT doc_id) AS n_docs FROM pairs GROUP BY 1, 2) SELECT 'question' AS kind, {_band(qrels_stats.QUESTION_BANDS)} AS band, count(*) AS n FROM q GROUP BY 2 UNION ALL SELECT 'hop', {_band(qrels_stats.HOP_BANDS)}, count(*) FROM h GROUP BY 2")
def pool_bands(c: Corpus) -> DataFrame:
    pairs = c.pairs()
    per_hop = pairs.groupBy("qid", "hop").agg(F.countDistinct("doc_id").alias("n_docs"))
    both = [qrels_stats.banded(rows, "n_docs", bands).withColumn("kind", F.lit(kind)) for kind, rows, bands in (("question", qrels_stats.per_question(pairs), qrels_stats.QUESTION_BANDS), ("hop", per_hop, qrels_stats.HOP_BANDS))]
    return both[0].unionByName(both[1])


def _percent(value: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {hi} THEN '{lo}-{hi}'" if hi else f"ELSE '{lo}+'" for lo, hi in qrels_stats.PERCENT_BANDS) + " END"


@query(f"SELECT {_percent('p')} AS band, count(*) AS n FROM (SELECT n_chars * 100 / (SELECT max(n_chars) FROM documents)::DOUBLE AS p FROM documents) GROUP BY 1")
def percent_bands(c: Corpus) -> DataFrame:
    """Documents by their length in percent of the longest."""
    longest = c.docs.agg(F.max("n_chars").alias("most"))
    return qrels_stats.percent_banded(c.docs.select("n_chars").join(F.broadcast(longest)).select((F.col("n_chars") * 100 / F.col("most").cast("double")).alias("p")), "p")


@query(
    sql.LENGTHS
    + """, r AS (SELECT n_tokens::DOUBLE AS v, row_number() OVER (ORDER BY n_tokens) AS rank, count(*) OVER () AS n FROM lengths), p AS (SELECT * FROM (VALUES ('p25', 0.25::DOUBLE), ('median', 0.5), ('p75', 0.75)) x(name, p)),
spots AS (SELECT name, p * (n + 1) AS place, n, greatest(1, least(n - 1, floor(p * (n + 1)))) AS low FROM p, (SELECT max(n) AS n FROM r)), q AS (SELECT name, a.v + (b.v - a.v) * (place - low) AS v FROM spots JOIN r a ON a.rank = low JOIN r b ON b.rank = low + 1)
SELECT (SELECT min(v) FROM r) AS least, (SELECT v FROM q WHERE name = 'p25') AS p25, (SELECT v FROM q WHERE name = 'median') AS median, (SELECT round(avg(v), 6) FROM r) AS mean, (SELECT v FROM q WHERE name = 'p75') AS p75, (SELECT max(v) FROM r) AS most"""
)
def exclusive_quartiles(c: Corpus) -> DataFrame:
    return qrels_stats.quartiles(c.lengths(), "n_tokens").withColumn("mean", F.round("mean", 6))


@query(sql.HOPS + "SELECT count(*) FILTER (WHERE (n = 0) <> skipped) = 0 AS skipped_are_empty, count(*) FILTER (WHERE n = 0) AS empty_hops FROM (SELECT h.qid, h.index, any_value(skipped) AS skipped, count(p.doc_id) AS n FROM hops h LEFT JOIN pairs p ON p.qid = h.qid AND p.hop = h.index GROUP BY 1, 2)")
def skipped_hops_check(c: Corpus) -> DataFrame:
    counted = materialize(qrels_stats.per_hop(c.pairs(), c.hops()), "counted")
    return counted.agg(F.lit(qrels_stats.skipped_are_empty(counted)).alias("skipped_are_empty"), F.count_if(F.col("n_docs") == 0).alias("empty_hops"))


# -- runs and their scores


def _calls(c: Corpus) -> DataFrame:
    return table(c.spark, c.dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.count(F.lit(1)).alias("tool_calls"))


@query(
    _BASE
    + """, calls AS (SELECT conv_id AS item_id, count(*) AS n FROM conversations GROUP BY 1), recalls AS (SELECT p.item_id, count(v.doc_id) / count(*)::DOUBLE AS recall FROM pool p LEFT JOIN previewed v ON v.item_id = p.item_id AND v.doc_id = p.doc_id GROUP BY 1),
judged AS (SELECT doc_id AS item_id, max(quality) AS quality FROM labels GROUP BY 1), runs AS (SELECT DISTINCT item_id FROM previewed)
SELECT (SELECT round_even(avg(recall) * 100, 2) FROM recalls) AS recall, (SELECT round_even(count(*) FILTER (WHERE quality = 1) * 100 / count(*)::DOUBLE, 2) FROM benchmark LEFT JOIN judged USING (item_id)) AS accuracy, (SELECT round_even(avg(coalesce(n, 0)), 2) FROM runs LEFT JOIN calls USING (item_id)) AS tool_calls"""
)
def run_scores(c: Corpus) -> DataFrame:
    """Recall of what was seen, accuracy by the label of the document of the same number, and mean calls by the conversation of that number."""
    key = F.col("item_id").alias("query_id")
    runs = c.previewed().groupBy(key).agg(F.collect_set(F.col("doc_id").cast("string")).alias("previewed")).join(_calls(c), "query_id", "left").withColumn("tool_calls", F.coalesce("tool_calls", F.lit(0)))
    relevant = evaluate.gold(c.pool().select(key, F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("relevance")))
    evals = _labels(c).select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("correct"))
    return evaluate.macro(runs, relevant, evals, c.passages().select(key))


@query("SELECT doc_id AS query_id, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS correct, CASE WHEN quality IS NULL THEN NULL ELSE (doc_id % 101)::DOUBLE END AS confidence, quality IS NULL AS parse_error FROM labels")
def judged_answers(c: Corpus) -> DataFrame:
    """A judge's JSON by label: right, without an answer, or not JSON at all."""
    labels = table(c.spark, c.dir, "labels")
    answer = F.when(F.col("quality") == 1, '"x"').otherwise("null")
    raw = F.when(F.col("quality").isNull(), "no verdict").otherwise(F.concat(F.lit('{"extracted_final_answer": '), answer, F.lit(', "correct": true, "reasoning": "", "confidence": '), (F.col("doc_id") % 101).cast("string"), F.lit("}")))
    return evaluate.judged(labels.select(F.col("doc_id").alias("query_id"), raw.alias("raw"))).select("query_id", "correct", "confidence", "parse_error")


@query("SELECT doc_id, coalesce(lang, '') AS explanation, coalesce(source, '') AS exact_answer, n_chars || '%' AS confidence, lang IS NOT NULL AS in_order FROM documents")
def answer_sections(c: Corpus) -> DataFrame:
    """Final answers put together from the documents' columns, and read by heading; without a language the headings are in another order."""
    part = lambda name, value: F.concat(F.lit(f"\n{name}: "), F.coalesce(value, F.lit("")))
    parts = [part("Explanation", F.col("lang")), part("Exact Answer", F.col("source")), part("Confidence", F.concat(F.col("n_chars").cast("string"), F.lit("%")))]
    text = F.concat(F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.lit("Answer:")), *parts)
    return c.docs.select("doc_id", *[col.alias(k) for k, col in evaluate.final_answer(text).items() if k != "answer"], evaluate.sections_in_order(text).alias("in_order"))


@query(_BASE + f", {_UNION} SELECT b.item_id AS query_id, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY place), '') AS doc_ids FROM benchmark b LEFT JOIN once o ON o.item_id = b.item_id GROUP BY b.item_id")
def agent_documents(c: Corpus) -> DataFrame:
    """What a run opened (gold) and cited (seen), each document where it comes first."""
    text = lambda name: F.col(name).cast("array<string>")
    return _lists(c).select(F.col("item_id").alias("query_id"), F.array_join(evaluate.agent_documents(text("gold"), text("seen")), ",").alias("doc_ids"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def first_met_roles(c: Corpus) -> DataFrame:
    """The roles of a conversation in the order in which they first speak."""
    turns = table(c.spark, c.dir, "conversations").where("role is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("said"))
    return turns.select("conv_id", F.array_join(evaluate.first_met(F.transform("said", lambda x: F.array(x["role"]))), ",").alias("roles"))


@query(
    _BASE
    + """, runs AS (SELECT b.item_id, any_value(b.text) AS text, count(p.doc_id) AS seen, coalesce(max(rank), 0) AS listed FROM benchmark b LEFT JOIN previewed p USING (item_id) GROUP BY 1), asked AS (SELECT count(DISTINCT item_id) AS n FROM benchmark)
SELECT count(*) = (SELECT count(*) FROM benchmark) AS has_status, bool_and(text <> '') AS answers_complete, bool_and(listed = seen) AS counts_agree, bool_and(seen <> 3) AS totals_agree, (SELECT count(*) = count(DISTINCT (item_id, doc_id)) FROM previewed) AS lists_deduplicated,
(SELECT bool_and(regexp_full_match(printf('shard_%05d_%05d', doc_id // 1000, doc_id % 1000), 'shard_[0-9]{5}_[0-9]+')) FROM previewed) AS full_ids, true AS surfaced_previewed, count(*) FILTER (WHERE seen = 0) AS incomplete, true AS both_tools_counted,
(SELECT n FROM asked) = 10 AS query_count, (SELECT count(*) FROM (SELECT DISTINCT item_id, doc_id FROM pool)) = 26 AS qrel_count, (SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM pool)) = 0 AS every_query_judged, true AS same_queries FROM runs"""
)
def run_checks(c: Corpus) -> DataFrame:
    """The checks of runs: one a passage, with calls as it saw documents; a run that saw three states a wrong total."""
    seen = F.transform("seen", lambda d: T.doc_name(d))
    rows = _lists(c).select(F.col("item_id").cast("string").alias("query_id"), seen.alias("seen"))
    n = F.size("seen")
    counts = F.map_from_arrays(F.array(F.lit("search"), F.lit("read_document")), F.array(n, F.lit(1)))
    answer = F.lit("Answer:\nExplanation: e\nExact Answer: x\nConfidence: 1%")
    results = F.concat(F.array_repeat(F.lit("search"), n), F.array(F.lit("read_document")))
    runs = rows.select("query_id", F.when(n > 0, "completed").otherwise("failed").alias("status"), answer.alias("output_text"), results.alias("results"), counts.alias("tool_call_counts"), F.when(n == 3, 0).otherwise(n + 1).alias("tool_calls_total"), F.col("seen").alias("surfaced"), F.col("seen").alias("previewed"))
    asked = c.passages().select(F.col("item_id").cast("string").alias("query_id"))
    relevance = c.pool().select(F.col("item_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"))
    return evaluate.validate(runs, asked, relevance, 10, 26)


@query("SELECT item_id::VARCHAR AS id, text AS question, (4 * ceil(strlen(text) / 3.0))::INTEGER AS masked_length, true AS masked FROM benchmark")
def canary_round_trip(c: Corpus) -> DataFrame:
    """Questions masked, written as JSON lines, read again and unmasked."""
    plain = c.passages().select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.concat(F.lit("canary "), F.col("item_id").cast("string")).alias("canary"))
    path = f"{folder(c.spark)}/masked"
    sinks.write_json(canary.encode(plain, ("question",)), path)
    back = sources.read_jsonl(c.spark, path, "id string, question string, canary string").withColumn("raw", F.col("question"))
    return canary.decode(back, ("question",)).select("id", "question", F.length("raw").alias("masked_length"), (F.col("raw") != F.col("question")).alias("masked"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def text_digests(c: Corpus) -> DataFrame:
    return c.docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))


@query(_BASE + "SELECT item_id AS query_id, printf('shard_%05d_%05d', doc_id // 1000, doc_id % 1000) AS doc_id FROM previewed")
def padded_ids(c: Corpus) -> DataFrame:
    """Unpadded spellings of ids made whole again."""
    rows = c.previewed().select(F.col("item_id").alias("query_id"), T.unpadded(T.doc_name(F.col("doc_id"))).alias("doc_id"))
    return qrels.normalised(rows, "doc_id")
