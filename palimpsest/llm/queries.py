"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, jaccard, licenses, mixing, quality, secrets, sharding, topk, toxicity
from palimpsest.llm.chat_sql import threads_sql
from palimpsest.sources.tables import table


def tokenizer_file() -> str:
    """The default tokenizer file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return secrets.digest(findings)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.threads(table(spark, sf_dir, "conversations"))


def op6_chat_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over messages that quote: the tables have no quotes, so each turn quotes the turn before, and a turn 0 that of the next conversation."""
    return chat.threads(chat.quoting(table(spark, sf_dir, "conversations")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_topk, op3_quality, op4_sharding, op5_jaccard, op6_chat, op6_chat_quoted, op7_toxicity, op8_licenses, op9_mixing, op10_bpe)}


def _secrets_sql() -> str:
    parts = []
    for order, rule in enumerate(secrets.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        found = f"regexp_extract_all(t, {pattern}, 0)"
        parts.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, {rule.least} AS least, unnest(string_split_regex(t, {pattern})) AS gap, unnest({found}) AS hit, "
            f"unnest(regexp_extract_all(t, {pattern}, {rule.group})) AS part, unnest(range(len({found}) + 1)) AS i FROM texts WHERE regexp_matches(t, {pattern})"
        )
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), pieces AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(length(gap) + length(coalesce(hit, ''))) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM pieces),
found AS (SELECT doc_id, kind, ord, stop - length(hit) AS start, kind || ':' || (stop - length(hit)) || ':' || stop AS span FROM placed WHERE hit IS NOT NULL AND length(part) >= least)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
sha256(coalesce(string_agg(span, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(secrets.BASE_RULES)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, ord), '') AS spans
FROM texts t LEFT JOIN found f ON f.doc_id = t.doc_id GROUP BY 1"""


#: Floors, with shorter vectors padded by zeros; of a repeated query the least vector asks.
TOPK_SQL = """WITH known AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
v AS (SELECT vec_id, list_resize(x, (SELECT max(len(x)) FROM known), 0::DOUBLE) AS x FROM known), q AS (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 20 = 0 GROUP BY 1),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored) SELECT * FROM ranked WHERE rank <= 20"""

#: All pairs of different texts compared on their whole sets, without bands.
JACCARD_SQL = """WITH RECURSIVE contents AS (SELECT coalesce(text, '') AS t, min(doc_id) AS rep, count(*) AS copies FROM documents GROUP BY 1),
ws AS (SELECT rep, regexp_extract_all(lower(t), '[^\\x20\\x09-\\x0D]+') AS w FROM contents WHERE rep IS NOT NULL),
grams AS (SELECT DISTINCT rep, g FROM (SELECT rep, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM ws WHERE len(w) > 0)),
sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY 1), shared AS (SELECT x.rep AS a, y.rep AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g AND x.rep <> y.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.rep = a JOIN sizes q ON q.rep = b WHERE i >= 0.8::DOUBLE * (p.n + q.n - i)),
reach(v, c) AS (SELECT rep, rep FROM contents WHERE rep IS NOT NULL UNION SELECT l.b, r.c FROM reach r JOIN links l ON r.v = l.a), class AS (SELECT v, min(c) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT a, count(*) AS texts, sum(copies)::BIGINT AS documents FROM links JOIN contents ON rep = b GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.doc_id IS NOT NULL THEN class_id END AS class_id, rep AS rep_id, copies - 1 AS n_copies, coalesce(texts, 0) AS n_text_links, copies - 1 + coalesce(documents, 0) AS n_links
FROM documents d JOIN contents ON t = coalesce(d.text, '') LEFT JOIN class ON v = rep LEFT JOIN counts ON a = rep"""

#: Messages that quote the turn before; a turn 0 quotes that of the next conversation.
QUOTING_SQL = """(WITH said AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY 1, 2), of AS (SELECT conv_id AS c, turn + 1 AS t, said FROM said UNION ALL SELECT conv_id - 1, turn, said FROM said WHERE turn = 0)
SELECT conv_id, turn, role, CASE WHEN said IS NULL THEN text ELSE 'On Monday they wrote:' || chr(10) || '> ' || replace(said, chr(10), chr(10) || '> ') || chr(10) || coalesce(text, '') END AS text FROM conversations LEFT JOIN of ON c = conv_id AND t = turn)"""

MIXING_SQL = f"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight, 2::DOUBLE * source_size AS cap FROM per),
filling AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER earlier, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS share FROM weighed
  WINDOW earlier AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, rest * weight / share >= cap AS is_full FROM filling),
level AS (SELECT rest / share AS height FROM marked WHERE NOT is_full ORDER BY cap / weight, source IS NULL, source LIMIT 1),
aimed AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, (SELECT height FROM level) * weight) END AS target FROM marked),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aimed),
bounds AS (SELECT *, floor(rate)::BIGINT AS whole, printf('%08x', floor((rate - floor(rate)) * 4294967296::DOUBLE)::BIGINT) AS under FROM rated),
drawn AS (SELECT b.source, seed, b.whole, b.source_size, b.target, sum(CASE WHEN substr(md5(seed || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 8) < under THEN size ELSE 0 END)::BIGINT AS taken
  FROM sized s JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source, range({mixing.SEEDS}) seeds(seed) GROUP BY ALL),
best AS (SELECT source, arg_min(seed, (abs(taken + whole * source_size - target), seed)) AS seed FROM drawn GROUP BY 1),
taken AS (SELECT s.*, b.source_size, b.target, whole + CASE WHEN substr(md5(seed || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 8) < under THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source JOIN best ON best.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM taken"""


def oracle_sql() -> dict[str, str]:
    """The other operators have no SQL that is fast enough; their tests hold them against brute force."""
    return {"op1_secrets": _secrets_sql(), "op2_topk": TOPK_SQL, "op5_jaccard": JACCARD_SQL, "op6_chat": threads_sql(), "op6_chat_quoted": threads_sql(QUOTING_SQL), "op9_mixing": MIXING_SQL}
