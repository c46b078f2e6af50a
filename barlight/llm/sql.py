"""DuckDB twins of those queries that SQL can express. Texts, tables and parameters are those of the queries.

Byte windows (op4) would be one row for each byte, too many for SQL on whole tables; they are tested against a brute-force version.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = f"translate(coalesce(text, ''), '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"

OP2 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
words AS (SELECT r, len(w) AS n, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
s AS (SELECT r, n, j, word, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS k FROM words),
h AS (SELECT r, j, word, CASE WHEN j <= n - 34 AND count(*) FILTER (j <= n - 34) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS hit FROM s),
c AS (SELECT r, j, word, max(hit) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM h),
k AS (SELECT r, sum(gone) AS n, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS t FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

OP7 = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.replace("coalesce(text, '')", LOWER)} AS w FROM documents),
d AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM d WHERE doc_id IS NOT NULL),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n) AS m, any_value(b.n) AS n FROM t a JOIN t b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 80 * (m + n - shared) AND x <> y),
edges AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach AS (SELECT DISTINCT doc_id, doc_id AS c FROM d WHERE doc_id IS NOT NULL UNION SELECT reach.doc_id, b FROM reach JOIN edges ON a = c),
roots AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN roots USING (doc_id)"""

OP8 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (SELECT *, replace(replace(role, '%', '%25'), chr(10), '%0A') AS r FROM t),
f AS (SELECT *, 12 + length(r) + len(regexp_extract_all(r, '<\\*\|')) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11 AS size FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(size) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens FROM f GROUP BY conv_id"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 5"""
ITEM_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = f"""WITH i AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda j: array_to_string(w[j:j + 9], ' '))) AS k FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {ITEM_WORDS} AS w FROM documents),
j AS (SELECT r, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS j FROM d),
s AS (SELECT r, j, m, array_to_string(w[j:j + m - 1], ' ') AS k FROM j, (SELECT DISTINCT m FROM p) l WHERE j + m - 1 <= n),
h AS (SELECT DISTINCT s.r, s.j, s.m, s.k FROM s WHERE k IN (SELECT k FROM p)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(j, j + m)) AS x FROM h) y GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT h.r, CAST(p.item_id AS VARCHAR) AS item FROM h JOIN p USING (m, k) WHERE p.item_id IS NOT NULL) z GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""


def _repair_sql() -> str:
    """A weight is six digits of cost and the audit, so the least string is the least weight; one step of the recursion is one row."""

    def plus(w: str, cost: str, letter: str) -> str:
        return f"CASE WHEN {w} IS NOT NULL THEN lpad(CAST(CAST(left({w}, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({w}, 7) || '{letter}' END"

    def least(when: str, letter: str, cost: str, *states: str) -> list[str]:
        return [f"CASE WHEN {when} THEN {plus(w, cost, letter)} END" for w in states]

    stays = "fault NOT IN ('blank', 'duplicate')"
    unfinished = "(CASE fault WHEN 'truncated' THEN 5 ELSE 0 END)"
    keep = {c: f"{stays} AND left(role, 1) = '{c}'" for c in "sua"}
    rerole = least(stays, "R", f"1 + {unfinished}", "z", "s", "a"), least(stays, "R", f"1 + {unfinished}", "u")
    step = {
        "z": [plus("z", "2", "D")],
        "s": [plus("s", "2", "D"), *least(keep["s"], "K", unfinished, "z")],
        "u": [plus("u", "2", "D"), *least(keep["u"], "K", unfinished, "z", "s", "a"), *rerole[0]],
        "a": [plus("a", "2", "D"), *least(keep["a"], "K", unfinished, "u"), *rerole[1]],
    }
    rows = ", ".join(f"least({', '.join(v)}, NULL) AS {k}" for k, v in step.items())
    insert_u = ", ".join(plus(w, "5", "I") for w in "zsa")
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
    return rf"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, {crc} % 20 AS kind FROM o),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
e AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again,
right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM e),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM g),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000' AS z, CAST(NULL AS VARCHAR) AS s, '000005I' AS u, '000010II' AS a FROM conversations
UNION ALL SELECT conv_id, i, z, s, u, least(a, {plus("u", "5", "I")}) AS a FROM (
SELECT conv_id, i, z, s, least(u, {insert_u}) AS u, a FROM (
SELECT w.conv_id, f.i, {rows} FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1) x) y),
c AS (SELECT h.conv_id, count(f.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) h LEFT JOIN f ON h.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY h.conv_id),
b AS (SELECT c.*, least(w.z, w.a) AS best FROM c JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i),
l AS (SELECT conv_id, unnest(string_split(substr(best, 7), '')) AS letter, unnest(range(1, length(best) - 5)) AS j FROM b),
p AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS row, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS place FROM l),
q AS (SELECT p.conv_id, p.j, p.letter, place, f.role, coalesce(f.text, '') AS text, max(CASE WHEN place = 1 AND letter = 'K' AND left(f.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
FROM p LEFT JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.letter <> 'I' AND f.i = p.row WHERE letter <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS lines FROM q GROUP BY conv_id)
SELECT b.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM b LEFT JOIN t ON b.conv_id IS NOT DISTINCT FROM t.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op2_repeated_phrases": OP2,
    "op7_prefix_tree_join": OP7,
    "op8_chat_formatting": OP8,
    "op9_exact_top_k": OP9,
    "op12_wu_manber_decontamination": OP12,
    "op13_conversation_repair": _repair_sql(),
}
