"""DuckDB SQL of the operators that SQL can say, from their definitions: no hashes, no bands, no fingerprints."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

#: Every run of whole lines of 50 words or more that stands earlier goes: all windows, joined by their content.
LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, trim(line) AS line, len(regexp_extract_all(line, {_WORD})) AS n FROM l),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS cs, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS ce, sum(n) OVER (PARTITION BY doc_id) AS total FROM w WHERE n > 0),
f AS (SELECT doc_id, pos AS a, total - cs AS ahead, ce, list(line) OVER x AS fk, max(pos) OVER x AS fb, list(line) OVER y AS bk, min(pos) OVER y AS ba FROM c
  WINDOW x AS (PARTITION BY doc_id ORDER BY cs RANGE BETWEEN 0 FOLLOWING AND 49 FOLLOWING), y AS (PARTITION BY doc_id ORDER BY ce RANGE BETWEEN 49 PRECEDING AND 0 FOLLOWING)),
v AS (SELECT doc_id, a, fb AS b, fk AS k FROM f WHERE ahead >= 50 UNION SELECT doc_id, ba, a, bk FROM f WHERE ce >= 50),
o AS (SELECT k, min(struct_pack(d := doc_id, p := a)) AS first FROM v GROUP BY k HAVING count(*) > 1),
g AS (SELECT doc_id, a, b FROM v JOIN o USING (k) WHERE struct_pack(d := doc_id, p := a) > first),
m AS (SELECT l.doc_id, l.pos, line, EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.doc_id AND l.pos BETWEEN g.a AND g.b) AS gone FROM l),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM m GROUP BY 1)
SELECT d.doc_id, t.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN t USING (doc_id)
"""

#: Jaccard of full n-gram sets of all pairs that share an n-gram.
NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM w),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS id FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
k AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
n AS (SELECT k.a AS doc_id, count(*) AS links, count(DISTINCT y.id) FILTER (x.id <> y.id) AS texts FROM k JOIN s x ON x.doc_id = k.a JOIN s y ON y.doc_id = k.b GROUP BY 1),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY 1)
SELECT d.doc_id, least(d.doc_id, coalesce(low, d.doc_id)) AS class_id, coalesce(links, 0) AS n_links, coalesce(texts, 0) AS n_text_links, d.doc_id <= coalesce(low, d.doc_id) AS is_first
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_LENGTH = r"""length('<|turn|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '[<\[](\||/?s>|/?INST\]|<SYS>>|</SYS>>)')) + length('<|end|>') + 1"""

#: Turns and targets straight from the table; the length of all windows from the greedy rule, turn by turn.
CHAT_WINDOWS = rf"""
WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
  greatest(len(regexp_extract_all(text, '\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]')), ceil(length(text) / 3)::BIGINT) + 4 AS tok, {_LENGTH} AS size FROM c0),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '') AS loss, sum(size) AS chars,
  coalesce(max(tok) FILTER (rn = 1 AND role = 'system'), 0) AS sys_tok, coalesce(max(size) FILTER (rn = 1 AND role = 'system'), 0) AS sys_size FROM c GROUP BY 1),
b AS (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY rn) AS i, tok, size, greatest(1024 - sys_tok - 256, 1) AS room, sys_size FROM c JOIN d USING (conv_id) WHERE NOT (rn = 1 AND role = 'system')),
h AS (SELECT *, lag(tok, 1) OVER w AS t1, lag(size, 1) OVER w AS s1, lag(tok, 2) OVER w AS t2, lag(size, 2) OVER w AS s2 FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
f(conv_id, i, sum, base, opens) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM d
  UNION ALL SELECT f.conv_id, h.i, f.sum + h.tok, CASE WHEN f.sum + h.tok - f.base > h.room AND f.sum > f.base THEN f.sum ELSE f.base END, f.sum + h.tok - f.base > h.room AND f.sum > f.base FROM f JOIN h ON h.conv_id = f.conv_id AND h.i = f.i + 1),
x AS (SELECT conv_id, count(*) AS more, sum(sys_size + CASE WHEN t1 <= 256 THEN s1 ELSE 0 END + CASE WHEN t1 <= 256 AND t1 + t2 <= 256 THEN s2 ELSE 0 END) AS repeated FROM f JOIN h USING (conv_id, i) WHERE opens GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, (chars + coalesce(repeated, 0))::BIGINT AS formatted_chars, 1 + coalesce(more, 0) AS n_windows FROM d LEFT JOIN x USING (conv_id)
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text, bit by bit."""
    return f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::UBIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))))"


def _fields(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Trees level by level, then every row folded up through its siblings.
MERKLE_MANIFEST = f"""
WITH RECURSIVE l AS (SELECT doc_id, source, {_fields("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_fields("replace(text, chr(10), '')")} ELSE {_fields("text")} END AS now FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
t(g, lvl, i, n, h) AS (SELECT source, 0, i, n, leaf FROM b UNION ALL SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lvl, i // 3, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, n, h) AS (SELECT 0, i, n, subroot FROM s UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 3, n),
x AS (SELECT a.g, a.lvl, a.i, coalesce(string_agg(c.h, '' ORDER BY c.i) FILTER (c.i < a.i), '') AS pre, coalesce(string_agg(c.h, '' ORDER BY c.i) FILTER (c.i > a.i), '') AS post FROM t a JOIN t c ON a.g IS NOT DISTINCT FROM c.g AND a.lvl = c.lvl AND a.i // 3 = c.i // 3 WHERE a.n > 1 GROUP BY 1, 2, 3),
y AS (SELECT a.lvl, a.i, coalesce(string_agg(c.h, '' ORDER BY c.i) FILTER (c.i < a.i), '') AS pre, coalesce(string_agg(c.h, '' ORDER BY c.i) FILTER (c.i > a.i), '') AS post FROM u a JOIN u c ON a.lvl = c.lvl AND a.i // 3 = c.i // 3 WHERE a.n > 1 GROUP BY 1, 2),
f(r, g, lvl, i, n, h, proof) AS (SELECT struct_pack(doc_id, leaf, k := row_number() OVER ()), source, 0, i, n, now, '' FROM b
  UNION ALL SELECT f.r, f.g, f.lvl + 1, f.i // 3, (f.n + 2) // 3, sha256(pre || f.h || post), proof || pre || post FROM f JOIN x ON x.g IS NOT DISTINCT FROM f.g AND x.lvl = f.lvl AND x.i = f.i WHERE f.n > 1),
o(r, subroot, lvl, i, n, h, proof) AS (SELECT r, subroot, 0, s.i, s.n, h, proof FROM f JOIN s ON s.g IS NOT DISTINCT FROM f.g WHERE f.n = 1
  UNION ALL SELECT r, subroot, o.lvl + 1, o.i // 3, (o.n + 2) // 3, sha256(pre || h || post), proof || pre || post FROM o JOIN y ON y.lvl = o.lvl AND y.i = o.i WHERE o.n > 1)
SELECT r.doc_id AS doc_id, r.leaf AS leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, o.h AS folded_root, o.h = u.h AS verified FROM o JOIN u ON u.n = 1 WHERE o.n = 1
"""


def _edited(state: str, edit: str, cost: str, line: str | None = None, when: str = "true") -> str:
    """A state after an edit: its cost (nine digits) with its audit, and the rows put out; NULL if it cannot be."""
    put = f" || chr(10) || {line}" if line else ""
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN struct_pack(k := lpad((left({state}.k, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}.k, 10) || '{edit}', t := {state}.t{put}) END"


def _least(*states: str) -> str:
    return f"least({', '.join(states)})"


_U, _A = "'user:'", "'assistant:'"
_FREE = "fault NOT IN ('b', 'd')"
#: Inserts: what is reached with u, or a, as the last role put out.
_INSERT_U = _least("c2", *(_edited(c, "I", "5", _U) for c in ("c0", "c1", "c3")))
_INSERT_A = _least("c3", _edited("x2", "I", "5", _A))
_INSERT_U_AGAIN = _least("x2", _edited("x3", "I", "5", _U))
_STARTS = ("c0", "c1", "y3")
_ROW = "role || ':' || text"

#: The DP forward, row by row, with whole audits and repaired texts in the states; the least (cost, audit) of a state stays.
CHAT_REPAIR = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
x AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS k FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS rn, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k)),
f AS (SELECT conv_id, turn, role, text, rn, before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal, left(role, 1) AS r,
  CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS late FROM o),
n(conv_id, i, c0, c1, c2, c3) AS (SELECT DISTINCT conv_id, 0::BIGINT, struct_pack(k := '000000000', t := ''), NULL::STRUCT(k VARCHAR, t VARCHAR), NULL::STRUCT(k VARCHAR, t VARCHAR), NULL::STRUCT(k VARCHAR, t VARCHAR) FROM f
  UNION ALL SELECT conv_id, rn, {_edited("c0", "D", "2")},
    {_least(_edited("c1", "D", "2"), _edited("c0", "K", "late", _ROW, f"r = 's' AND {_FREE}"))},
    {_least(_edited("y2", "D", "2"), *(_edited(c, "K", "late", _ROW, f"r = 'u' AND {_FREE}") for c in _STARTS), *(_edited(c, "R", "late + 1", f"{_U} || text", _FREE) for c in _STARTS))},
    {_least(_edited("y3", "D", "2"), _edited("y2", "K", "late", _ROW, f"r = 'a' AND {_FREE}"), _edited("y2", "R", "late + 1", f"{_A} || text", _FREE))}
  FROM (SELECT *, {_INSERT_U_AGAIN} AS y2, x3 AS y3 FROM (SELECT *, {_INSERT_A} AS x3 FROM (SELECT n.*, f.* EXCLUDE (conv_id), {_INSERT_U} AS x2 FROM n JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.rn = n.i + 1)))),
e AS (SELECT conv_id, {_least("c0", "x3")} AS best FROM (SELECT *, {_INSERT_A} AS x3 FROM (SELECT *, {_INSERT_U} AS x2 FROM n)) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY 1),
d AS (SELECT DISTINCT conv_id FROM conversations)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best.k, 9)::BIGINT, 0) AS cost, coalesce(substr(best.k, 10), '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM d LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
"""
