"""SQL for quotation linking, for DuckDB, on texts instead of hashes."""

from __future__ import annotations

_INTRODUCES = "(?i)(wrote|writes|schrieb|a écrit|escribió)[ \\t]*:[ \\t]*$"


def _flat(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def _sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({_flat(x)}, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({cut}, lambda s: trim(s)), lambda s: s <> '')"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {_flat('s')}), lambda s: s <> '')"


def _blocks(x: str) -> str:
    return f"regexp_split_to_array({x}, '\\n\\s*\\n')"


def threads_sql(messages: str = "conversations") -> str:
    """The rows of ``chat.threads`` for a table or a subquery in brackets."""
    return f"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS t FROM {messages}),
l AS (SELECT id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM m),
p AS (SELECT id, i, length(regexp_replace(regexp_extract(line, '^[ \\t>]*>[ \\t]?'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \\t>]*>[ \\t]?', '') AS body FROM l),
q AS (SELECT *, regexp_matches(body, '{_INTRODUCES}') AND coalesce(lead(level) OVER w > level OR (trim(lead(body) OVER w) = '' AND lead(level, 2) OVER w > level), false) AS intro FROM p WINDOW w AS (PARTITION BY id ORDER BY i)),
own AS (SELECT id, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT intro), ''), ' ' || chr(9) || chr(13) || chr(10)) AS text, max(level) AS levels FROM q GROUP BY 1),
parsed AS (SELECT m.id, conv_id, turn, role, text, levels FROM m JOIN own USING (id)), ids AS (SELECT * FROM parsed WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
said AS (SELECT q.id, v.level, string_agg(CASE WHEN q.level = v.level AND NOT intro THEN body ELSE '' END, chr(10) ORDER BY i) AS text FROM q JOIN (SELECT DISTINCT id, level FROM q WHERE level > 0) v ON v.id = q.id GROUP BY 1, 2),
cut AS (SELECT id, level, unnest({_blocks('text')}) AS block_text, unnest(range(len({_blocks('text')}))) AS block FROM said), units AS (SELECT id, level, block, {_sentences('block_text')} AS s, {_lines('block_text')} AS l FROM cut),
quotes AS (SELECT conv_id, turn, u.* FROM ids JOIN (SELECT id, level, block, false AS is_line, unnest(s) AS passage FROM units UNION ALL SELECT id, level, block, true, unnest(list_distinct(list_filter(l, lambda x: NOT list_contains(s, x)))) FROM units) u USING (id)),
written AS (SELECT conv_id, passage, min(turn) AS turn FROM (SELECT conv_id, turn, unnest(list_concat(flatten(list_transform({_blocks('text')}, lambda b: {_sentences('b')})), list_concat({_lines('text')}, list_transform({_blocks('text')}, lambda b: {_flat('b')})))) AS passage FROM ids) WHERE passage <> '' GROUP BY 1, 2),
first AS (SELECT passage, min(struct_pack(c := conv_id, t := turn)) AS f FROM written GROUP BY 1), second AS (SELECT w.passage, min(struct_pack(c := w.conv_id, t := w.turn)) AS f FROM written w JOIN first x ON x.passage = w.passage AND x.f.c <> w.conv_id GROUP BY 1),
found AS (SELECT q.*, CASE WHEN h.turn < q.turn THEN struct_pack(c := q.conv_id, t := h.turn) WHEN a.f.c <> q.conv_id THEN a.f ELSE b.f END AS target FROM quotes q LEFT JOIN written h ON h.conv_id = q.conv_id AND h.passage = q.passage LEFT JOIN first a ON a.passage = q.passage LEFT JOIN second b ON b.passage = q.passage),
known AS (SELECT *, count(*) FILTER (WHERE NOT is_line AND target IS NOT NULL) OVER (PARTITION BY conv_id, turn, level, block) AS n FROM found),
counted AS (SELECT *, CASE WHEN is_line THEN (row_number() OVER (PARTITION BY conv_id, turn, level, block ORDER BY is_line DESC, passage) = 1)::INTEGER ELSE (target IS NOT NULL)::INTEGER END AS linked FROM known WHERE NOT is_line OR (n = 0 AND target IS NOT NULL)),
votes AS (SELECT conv_id, turn, target, count(*) FILTER (WHERE level = 1) AS votes, count(*) FILTER (WHERE NOT is_line) AS n, sum(linked) AS linked FROM counted GROUP BY 1, 2, 3),
links AS (SELECT conv_id, turn, max(struct_pack(v := votes, c := target.c, t := target.t)) FILTER (WHERE target IS NOT NULL AND votes > 0) AS best, sum(n) AS n_quoted, sum(linked) AS n_linked FROM votes GROUP BY 1, 2),
crossing AS (SELECT conv_id AS a, best.c AS b, turn FROM links WHERE best.c <> conv_id), both_ways AS (SELECT a, b FROM crossing UNION SELECT b, a FROM crossing),
reach(v, c) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT e.b, r.c FROM reach r JOIN both_ways e ON r.v = e.a), thread AS (SELECT v, min(c) AS thread_id FROM reach GROUP BY 1),
parents AS (SELECT a AS conv, min(struct_pack(t := turn, p := b)).p AS parent FROM crossing GROUP BY 1), above(v, u) AS (SELECT conv, parent FROM parents UNION SELECT x.v, p.parent FROM above x JOIN parents p ON p.conv = x.u),
opened AS (SELECT v FROM above x WHERE v = u AND v = (SELECT min(y.u) FROM above y JOIN above z ON z.v = y.u AND z.u = x.v WHERE y.v = x.v)), left_over AS (SELECT * FROM parents WHERE conv NOT IN (SELECT v FROM opened)),
steps(v, u, d) AS (SELECT conv, parent, 1 FROM left_over UNION ALL SELECT s.v, p.parent, d + 1 FROM steps s JOIN left_over p ON p.conv = s.u), depth AS (SELECT v, max(d) AS d FROM steps GROUP BY 1),
placed AS (SELECT p.*, coalesce(thread_id, p.conv_id) AS thread_id, coalesce(d, 0) AS d, best, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked FROM parsed p LEFT JOIN links k ON k.conv_id = p.conv_id AND k.turn = p.turn LEFT JOIN thread t ON t.v = p.conv_id LEFT JOIN depth e ON e.v = p.conv_id)
SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, thread_id::BIGINT AS thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY d, conv_id, turn, role, text) - 1 AS position, role, text, '<|' || coalesce(role, 'user') || '|>' || chr(10) || text || chr(10) AS message, levels::INTEGER AS levels,
best.c::BIGINT AS reply_conv, best.t::BIGINT AS reply_turn, n_quoted, n_linked FROM placed"""
