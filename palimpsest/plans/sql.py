"""Parts of the SQL that checks the queries, for DuckDB."""

from __future__ import annotations

from palimpsest.functions.text import WHITE
from palimpsest.operators.minhash import SMALL, SMALL_BANDS, SMALL_ROWS, sql_signature


def strip(column: str) -> str:
    return f"trim(coalesce({column}, ''), '{WHITE}')"


def band(value: str, bands: list[tuple[int, int | None]]) -> str:
    cases = [f"WHEN {value} <= {hi} THEN '{lo if hi == lo else f'{lo}-{hi}'}'" if hi else f"ELSE '{lo}+'" for lo, hi in bands]
    return f"CASE {' '.join(cases)} END"


def edge(value: str, edges: tuple[int, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {e} THEN {e}" for e in edges[::-1]) + " END::BIGINT"


MANIFEST = "WITH shards AS (SELECT doc_id // 1000 AS shard, count(*) AS n_rows FROM documents GROUP BY 1) "
SCAN_BODY = f"scan AS (SELECT doc_id, length({strip('text')}) AS char_len, sha256({strip('text')}) AS sha256 FROM documents)"
SCAN = f"WITH {SCAN_BODY} "
LENGTH_LISTS = f"WITH {SCAN_BODY} SELECT char_len, doc_id // 4000000 AS chunk, count(*) AS n_docs, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM scan GROUP BY 1, 2"
HASH_LISTS = f"WITH {SCAN_BODY} SELECT sha256, any_value(char_len) AS length, any_value(total) AS count, doc_id // 4000000 AS chunk, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS total FROM scan) GROUP BY sha256, doc_id // 4000000"
GROUPS = f"WITH {SCAN_BODY}, groups AS (SELECT sha256, any_value(char_len) AS length, count(*) AS count, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM scan GROUP BY 1) "
REPS_BODY = f"{SCAN_BODY}, reps AS (SELECT doc_id, sha256, min(doc_id) OVER (PARTITION BY sha256) AS rep_id, count(*) OVER (PARTITION BY sha256) AS group_size FROM scan)"
REPS = f"WITH {REPS_BODY} "
WORDS_BODY = f"{REPS_BODY}, words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents)"
WORDS = f"WITH {WORDS_BODY} "


def shingled(source: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, g FROM (SELECT {key}, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM {source} WHERE len(ws) >= 5)"


ALL_BODY = f"{WORDS_BODY}, grams AS ({shingled('words', 'doc_id')})"
SHINGLES_BODY = f"{ALL_BODY}, sh AS (SELECT * FROM grams WHERE doc_id IN (SELECT rep_id FROM reps)), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1)"
SHINGLES = f"WITH {SHINGLES_BODY} "
SIGNATURES_BODY = f"{ALL_BODY}, hashed AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 7))::BIGINT AS h FROM grams), sig AS (SELECT doc_id, {', '.join(sql_signature(i) for i in range(len(SMALL)))} FROM hashed GROUP BY 1)"
SIGNATURES = f"WITH {SIGNATURES_BODY} "
_keys = " UNION ALL ".join(f"SELECT doc_id, {b}::INTEGER AS band, concat_ws('-', {', '.join(f's{b * SMALL_ROWS + r + 1}' for r in range(SMALL_ROWS))}) AS key FROM sig" for b in range(SMALL_BANDS))
BANDS_BODY = f"{SIGNATURES_BODY}, bands AS ({_keys})"
BANDS = f"WITH {BANDS_BODY} "
LINKS_BODY = f"{BANDS_BODY}, links AS (SELECT DISTINCT anchor AS a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY band, key) AS anchor FROM bands) WHERE doc_id <> anchor)"
LINKS = f"WITH {LINKS_BODY} "


def closure(links: str) -> str:
    return f"both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}), reach(v, c) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT e.b, r.c FROM reach r JOIN both_ways e ON r.v = e.a)"


CLOSURE = f"WITH RECURSIVE {LINKS_BODY}, {closure('links')} "
PAIRS_BODY = f"""{SHINGLES_BODY}, shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b, i::DOUBLE / (p.n + q.n - i) AS jaccard FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE i::DOUBLE / (p.n + q.n - i) >= 0.7)"""
PAIRS = f"WITH {PAIRS_BODY} "
PAIR_CLOSURE = f"WITH RECURSIVE {PAIRS_BODY}, {closure('pairs')} "
NEAR_BODY = f"""{PAIRS_BODY}, sym AS (SELECT a, b, jaccard FROM pairs UNION ALL SELECT b, a, jaccard FROM pairs),
near AS (SELECT s.doc_id, t.doc_id AS neighbour, jaccard FROM sym JOIN reps s ON s.rep_id = a JOIN reps t ON t.rep_id = b)"""
NEAR = f"WITH {NEAR_BODY} "
RECORDS_BODY = f"""{NEAR_BODY}, near_list AS (SELECT doc_id, count(*) AS n, max(jaccard) AS best, string_agg(neighbour::VARCHAR, ',' ORDER BY jaccard DESC, neighbour) AS ids FROM near GROUP BY 1),
copies AS (SELECT x.doc_id, count(*) AS n, string_agg(y.doc_id::VARCHAR, ',' ORDER BY y.doc_id) AS ids FROM reps x JOIN reps y ON x.rep_id = y.rep_id AND x.doc_id <> y.doc_id GROUP BY 1),
recorded AS (SELECT coalesce(c.doc_id, n.doc_id) AS doc_id, c.ids AS exact_duplicates, n.ids AS near_duplicates, coalesce(c.n, 0) AS n_exact, coalesce(n.n, 0) AS n_near, n.best FROM copies c FULL JOIN near_list n ON c.doc_id = n.doc_id)"""
RECORDS = f"WITH {RECORDS_BODY} "
TIERS = f"""WITH {RECORDS_BODY}, tiers AS (SELECT doc_id, CASE WHEN n_exact > 0 THEN 'exact' WHEN best::FLOAT >= 0.9::FLOAT THEN 'near_90' WHEN best::FLOAT >= 0.8::FLOAT THEN 'near_80' ELSE 'near_70' END AS tier, n_exact + n_near AS n FROM recorded) """
LENGTHS_BODY = "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents"
LENGTHS = f"WITH lengths AS ({LENGTHS_BODY}) "
POOL_BODY = "pool AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
POOL = f"WITH {POOL_BODY} "
HOPS_BODY = f"""{POOL_BODY}, clues AS (SELECT item_id AS qid, list_filter(regexp_split_to_array(text, '[.!?]\\s*'), lambda s: s <> '') AS cs FROM benchmark),
hops AS (SELECT qid, i AS index, i = 1 AND qid % 3 = 0 AS skipped FROM (SELECT qid, unnest(range(len(cs))) AS i FROM clues)), pairs AS (SELECT qid, doc_id, index AS hop FROM pool JOIN hops ON qid = item_id)"""
HOPS = f"WITH {HOPS_BODY} "
CANDIDATES = f"""WITH {HOPS_BODY}, cand AS (SELECT p.qid, p.doc_id, p.hop, h.skipped, CASE l.quality WHEN 1 THEN 'Supports' WHEN 0 THEN 'Does not support' END AS vote FROM pairs p JOIN hops h ON h.qid = p.qid AND h.index = p.hop LEFT JOIN labels l ON l.doc_id = p.doc_id) """
PREVIEWED = f"""WITH {ALL_BODY}, bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark), bg AS ({shingled('bw', 'item_id')}),
hits AS (SELECT item_id, doc_id, count(*) AS shared FROM grams JOIN bg USING (g) GROUP BY 1, 2),
previewed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM hits) WHERE rank <= 5)"""
PREVIEWED = PREVIEWED + " "
REDUNDANCY = f"""WITH RECURSIVE {PAIRS_BODY}, {POOL_BODY}, held AS (SELECT p.item_id AS qid, p.doc_id, r.rep_id FROM pool p JOIN reps r USING (doc_id)),
ties AS (SELECT x.qid, x.doc_id AS a, y.doc_id AS b FROM held x JOIN held y ON x.qid = y.qid AND x.rep_id = y.rep_id AND x.doc_id <> y.doc_id
UNION SELECT x.qid, x.doc_id, y.doc_id FROM pairs e JOIN held x ON x.rep_id = e.a JOIN held y ON y.qid = x.qid AND y.rep_id = e.b
UNION SELECT x.qid, y.doc_id, x.doc_id FROM pairs e JOIN held x ON x.rep_id = e.a JOIN held y ON y.qid = x.qid AND y.rep_id = e.b),
reach(qid, v, c) AS (SELECT DISTINCT qid, a, a FROM ties UNION SELECT r.qid, t.b, r.c FROM reach r JOIN ties t ON t.qid = r.qid AND t.a = r.v),
comp AS (SELECT qid, v, min(c) AS c FROM reach GROUP BY 1, 2), grp AS (SELECT qid, c, count(*) AS size FROM comp GROUP BY 1, 2),
per AS (SELECT qid, sum(size)::BIGINT AS dup, count(*) AS n_groups, max(size) AS largest FROM grp GROUP BY 1), n AS (SELECT item_id AS qid, count(*) AS n_docs FROM pool GROUP BY 1)
SELECT qid, n_docs, coalesce(dup, 0) AS n_near_dup, round(coalesce(dup, 0) * 100 / n_docs::DOUBLE, 6) AS pct_near_dup, coalesce(n_groups, 0) AS n_groups, coalesce(dup, 0) - coalesce(n_groups, 0) AS n_redundant, coalesce(largest, 0) AS largest_group FROM n LEFT JOIN per USING (qid)"""

#: The greedy partition of components into clusters in which all are near each other, one step a cluster.
CLIQUES_BODY = f"""{PAIRS_BODY}, {closure('pairs')}, thresholds(threshold) AS (VALUES (0.7::DOUBLE), (0.8), (0.9)), comp AS (SELECT v AS doc_id, min(c) AS component FROM reach GROUP BY 1),
tied AS (SELECT threshold, component, a, b FROM pairs JOIN thresholds ON jaccard >= threshold JOIN comp ON comp.doc_id = a), ends AS (SELECT threshold, component, a AS v, b AS u FROM tied UNION ALL SELECT threshold, component, b, a FROM tied),
beside AS (SELECT threshold, component, v, list(u) AS us, count(*) AS degree FROM ends GROUP BY ALL), begun AS (SELECT threshold, component, list(v ORDER BY degree DESC, v) AS rest, map_from_entries(list((v, us))) AS near_to FROM beside GROUP BY ALL),
greedy(threshold, component, rest, near_to, grp) AS (SELECT threshold, component, rest, near_to, []::BIGINT[] FROM begun
UNION ALL SELECT threshold, component, list_filter(rest, lambda x: NOT list_contains(taken, x)), near_to, taken FROM (SELECT *, list_reduce(list_transform(rest, lambda x: [x]), lambda g, v: CASE WHEN list_has_all(near_to[v[1]], g) THEN list_concat(g, v) ELSE g END) AS taken FROM greedy WHERE len(rest) > 0)),
found AS (SELECT threshold, component, list_min(grp) AS cluster, list_sort(grp) AS ids, len(grp) AS size FROM greedy WHERE len(grp) > 1), members AS (SELECT threshold, component, cluster, unnest(ids) AS doc_id FROM found),
scored AS (SELECT f.*, min(jaccard) AS min_jaccard, avg(jaccard) AS mean_jaccard, count(*) AS n_pairs FROM found f JOIN members x ON x.threshold = f.threshold AND x.cluster = f.cluster JOIN pairs ON a = x.doc_id JOIN members y ON y.threshold = f.threshold AND y.cluster = f.cluster AND y.doc_id = b GROUP BY ALL)"""
CLIQUES = f"WITH RECURSIVE {CLIQUES_BODY} "
RETENTION = f"""WITH RECURSIVE {CLIQUES_BODY}, lengths AS ({LENGTHS_BODY}), copies AS (SELECT doc_id FROM reps WHERE doc_id <> rep_id),
gone AS (SELECT 'exact' AS step, doc_id FROM copies UNION SELECT 'near_' || (threshold * 100)::INTEGER, doc_id FROM members WHERE doc_id <> cluster UNION SELECT 'near_' || (threshold * 100)::INTEGER, doc_id FROM copies, thresholds),
steps AS (SELECT 'exact' AS step UNION ALL SELECT 'near_' || (threshold * 100)::INTEGER FROM thresholds), marked AS (SELECT s.step, n_tokens, g.doc_id IS NOT NULL AS gone FROM steps s CROSS JOIN lengths l LEFT JOIN gone g ON g.step = s.step AND g.doc_id = l.doc_id),
kept AS (SELECT step, count(*) AS documents, sum(n_tokens)::BIGINT AS tokens, count(*) FILTER (WHERE gone) AS removed_docs, coalesce(sum(n_tokens) FILTER (WHERE gone), 0)::BIGINT AS removed_tokens,
count(*) FILTER (WHERE NOT gone AND n_tokens < 5) AS short_docs, coalesce(sum(n_tokens) FILTER (WHERE NOT gone AND n_tokens < 5), 0)::BIGINT AS short_tokens FROM marked GROUP BY 1) """
#: The part of a release in which a record's shard of 100 ids lies: the records of earlier shards decide.
PART = "least(7, floor(((count(*) OVER (ORDER BY doc_id // 100 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - count(*) OVER (PARTITION BY doc_id // 100)) * 8 / count(*) OVER ()))::INTEGER"

_agree = " + ".join(f"(p.s{i + 1} = q.s{i + 1})::INTEGER" for i in range(len(SMALL)))
GATED = f"""WITH RECURSIVE {BANDS_BODY}, bucket AS (SELECT band, key, count(*) AS n, min(doc_id) AS anchor FROM bands GROUP BY 1, 2 HAVING count(*) >= 2), held AS (SELECT b.doc_id, k.* FROM bands b JOIN bucket k ON k.band = b.band AND k.key = b.key),
loose AS (SELECT x.doc_id AS a, y.doc_id AS b FROM held x JOIN held y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id WHERE x.n <= 16 UNION SELECT anchor, doc_id FROM held WHERE n > 16 AND doc_id <> anchor),
tight AS (SELECT a, b FROM loose JOIN sig p ON p.doc_id = a JOIN sig q ON q.doc_id = b WHERE {_agree} >= 6), {closure('tight')} """
