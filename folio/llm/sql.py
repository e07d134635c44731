"""DuckDB SQL for the queries that SQL can express."""

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
p AS (SELECT rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS k, unnest(list_zip(ws[:-3], ws[2:-2], ws[3:])) AS x FROM p WHERE len(ws) >= 3),
win AS (SELECT rid, k, count(*) OVER (PARTITION BY rid, x) AS n FROM i),
cov AS (SELECT rid, count(DISTINCT k + o) AS n_repeat_words FROM win, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY rid),
c AS (SELECT p.rid, doc_id, host, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines
      FROM p LEFT JOIN cov USING (rid)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS any_failed FROM c),
h AS (SELECT host, count(*) AS n, count(*) FILTER (any_failed) AS f FROM r GROUP BY host),
u AS (SELECT sum(f)::DOUBLE AS f, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn, count(*) AS k, sum(f * f / n) AS ff FROM h),
m AS (SELECT f / n AS m, CASE WHEN k > 1 THEN (ff - f * f / n - (k - 1) * (f / n) * (1 - f / n)) / (n - nn / n) END AS v FROM u),
b AS (SELECT m, CASE WHEN v > 0 THEN least(50.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 50.0 END AS w FROM m),
o AS (SELECT host, m, (f + m * w) / (n + w) AS rate FROM h, b),
q AS (SELECT host, rate > 0.5 OR rate > 1.25 * m AS distrusted FROM o)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT (base_failed OR (distrusted AND any_failed)) AS kept
FROM r JOIN q USING (host)
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(regexp_replace(text, '([\[<])(\x{2060}*(?:/INST\]|/SYS\]|/TURN\]|/s>|INST\]|SYS\]|TEXT\]|TURN\]|s>))', '\1.\2', 'g'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS chars,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE coalesce(before, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
    WHEN 'assistant' THEN role = 'user' ELSE false END) AS valid
FROM e GROUP BY conv_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2]) ELSE ws END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e0 AS (SELECT a, b FROM c JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""

RANKED_SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
i AS (SELECT DISTINCT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, t, term, count(*) AS q FROM (SELECT item_id, t, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
f AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term),
m AS (SELECT rid, doc_id, 25 + (75 * len(ws) * n_docs) // greatest(n_terms, 1) AS m FROM d, g),
s AS (SELECT item_id, t, rid, any_value(doc_id) AS doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY item_id, t, rid)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, t ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def _fields(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)


MERKLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM documents),
c AS (SELECT DISTINCT doc_id, 0 AS k, 4294967295::BIGINT AS crc FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT doc_id, k, CASE WHEN k % 8 = 0 THEN xor(crc, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))) ELSE crc END AS x FROM c WHERE k < 8 * length(doc_id::VARCHAR))),
even AS (SELECT doc_id FROM c WHERE k = 8 * length(doc_id::VARCHAR) AND crc & 1 = 1),
l AS (SELECT rid, doc_id, tree, sha256({_fields("text")}) AS leaf,
  sha256({_fields("CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN replace(text, chr(10), '') ELSE text END")}) AS present FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
n AS (SELECT tree, 0 AS lvl, place AS i, leaf AS h FROM o
  UNION ALL SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM n) WHERE c > 1 GROUP BY tree, lvl, i // 3),
sr AS (SELECT tree, max(lvl) AS depth, arg_max(h, lvl) AS subroot FROM n GROUP BY tree),
t AS (SELECT 0 AS lvl, tree AS i, subroot AS h FROM sr
  UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM t) WHERE c > 1 GROUP BY lvl, i // 3),
r AS (SELECT max(lvl) AS depth, arg_max(h, lvl) AS root FROM t),
p AS (SELECT rid, lvl AS step, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS b
  FROM (SELECT rid, n.lvl, n.i, n.h, place // (3 ** n.lvl)::BIGINT AS own FROM o JOIN sr USING (tree) JOIN n ON n.tree = o.tree AND n.lvl < depth AND n.i // 3 = place // (3 ** (n.lvl + 1))::BIGINT) GROUP BY rid, lvl, own
  UNION ALL SELECT rid, base + lvl, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), ''), coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '')
  FROM (SELECT rid, sr.depth AS base, t.lvl, t.i, t.h, o.tree // (3 ** t.lvl)::BIGINT AS own FROM o JOIN sr USING (tree), r JOIN t ON t.lvl < r.depth WHERE t.i // 3 = o.tree // (3 ** (t.lvl + 1))::BIGINT) GROUP BY rid, base, lvl, own),
z AS (SELECT rid, 0 AS step, present AS own FROM o UNION ALL SELECT z.rid, z.step + 1, sha256(a || own || b) FROM z JOIN p ON p.rid = z.rid AND p.step = z.step),
y AS (SELECT rid, arg_max(own, step) AS folded FROM z GROUP BY rid),
pr AS (SELECT rid, sha256(string_agg(a || b, '' ORDER BY step)) AS proof FROM p GROUP BY rid)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM o JOIN sr USING (tree) JOIN y USING (rid) LEFT JOIN pr USING (rid), r
"""

VECTOR_DUPLICATES = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT a.rid AS a, a.vec_id AS va, b.rid AS b, b.vec_id AS vb FROM u AS a JOIN u AS b ON a.rid <> b.rid AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT a, b, vb FROM e UNION SELECT r.a, e.b, e.vb FROM r JOIN e ON r.b = e.a),
n AS (SELECT a AS rid, count(*) AS n FROM e GROUP BY a), m AS (SELECT a AS rid, min(vb) AS low FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, coalesce(vec_id = least(vec_id, coalesce(low, vec_id)), true) AS kept
FROM v LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
