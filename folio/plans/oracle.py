"""DuckDB SQL for the catalogue, over the same tables, and the literal rows of some queries."""

from __future__ import annotations

from folio.operators.spelling import NEIGHBOURS

DIRTY_QUOTES = ["12. 3. Words of a numbered quote", "  - „a quote with a prefix”", "text &lt;i&gt; tail", "a &gt; b &lt; c", "Ready!", "...", "", "– 7.Seven words, and then some more?"]
PARAGRAPHS = [
    ("Thing", "''alpha'' , zwana też ''beta'' end"), ("Thing", "''gamma'' jest nazywana przez ''delta'' end"), ("Thing", "nazywana jest ''epsilon'' end"),
    ("Thing", "''zeta'' lub ''eta'' end"), ("Thing", "nothing here"), ("Thing", "''a'' lub ''b'' , ''c'' rzecz zwana inaczej ''d''"),
]
QUOTED_TEXTS = ["x „kot” , „pies” y „a” , „b” „c” , „d”", "„Kot” , „pies”", "none"]


LATEX_TEXTS = ["see `` kot '' , `` pies '' and `` a '' , `` b ''", "`` Kot '' , `` pies ''"]
#: Pairs looked for among the merged words, then pairs of the corpus' own kind.
LISTED = [("wielkiego", "pomorska"), ("socjologii", "uniwersytetu"), ("otwarta", "pracownia"), ("przez", "grzechy"),
          ("anty", "systemową"), ("super", "tygrysa"), ("wewnątrz", "oddziałowego"), ("wschodnio", "karpackiego"), ("that", "tion"), ("with", "that")]


def _rows(values: list, names: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r if isinstance(r, tuple) else (r,))) + ')' for r in values)}) AS v({names})"


ART = r"""a AS (SELECT doc_id + 1 AS id, split_part(coalesce(text, ''), chr(10), 1) AS title,
  CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS content FROM documents)"""
_WORDS = r"w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents WHERE lang = 'en') WHERE regexp_full_match(word, '[a-z]{4,}'))"
BF = _WORDS + r""", bf AS (SELECT word, base_form, min(pos) AS pos FROM (SELECT word, regexp_replace(word, '(ing|ed|es|s)$', '') AS base_form, 0 AS pos FROM w
  UNION ALL SELECT word, regexp_replace(word, 's$', ''), 1 FROM w WHERE word LIKE '%es') GROUP BY 1, 2)"""
BFG = _WORDS + r""", bf AS (SELECT word, base_form, min(pos) AS pos FROM (SELECT word, regexp_replace(word, '(ing|ed|es|s)$', '') AS base_form, 0 AS pos FROM w
  UNION ALL SELECT word, substr(word, 1, 5), 1 FROM w WHERE word LIKE '%s' AND length(word) >= 8) GROUP BY 1, 2)"""
TOK = r"""l AS (SELECT id, string_split(lower(title || ' ' || content), ' ') AS ws FROM a),
tok AS (SELECT id, unnest(range(len(ws))) AS ord, regexp_replace(unnest(ws), '^\s+|\s+$', '', 'g') AS tok FROM l),
fm AS (SELECT id, ord, tok, coalesce(base_form, tok) AS form FROM tok LEFT JOIN bf ON tok = word)"""
START = "s AS (SELECT id, len(ws) AS n, (1 + coalesce(sum(len(ws) + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM l)"
BASE = f"WITH {ART}, {BF}, {TOK}"
WV = """tc AS (SELECT base_form AS term, count(*) AS n FROM (SELECT unnest(string_split(lower(content), ' ')) AS x FROM a) JOIN bf ON x = word GROUP BY 1),
rk AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS rank FROM tc),
wv AS (SELECT term, embedding::DOUBLE[] AS vec, label::VARCHAR AS cluster FROM rk JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings) USING (rank))"""


def _query(*words: str, name: str = "q") -> str:
    values = ", ".join(f"({k}, '{x}')" for k, x in enumerate(words))
    return f"{name}0 AS (SELECT * FROM (VALUES {values}) AS v(k, x)), {name} AS (SELECT DISTINCT k, x AS word, coalesce(base_form, x) AS form FROM {name}0 LEFT JOIN bf ON x = word)"


_RATE = """pt AS (SELECT id, 'title' AS part, string_split(lower(title), ' ') AS ws FROM a UNION ALL SELECT id, 'content', string_split(lower(content), ' ') FROM a),
pw AS (SELECT id, part, unnest(range(len(ws))) AS ord, unnest(ws) AS x FROM pt),
th AS (SELECT id, part, ord, base_form IS NOT NULL AS known, coalesce(base_form, x) AS form FROM pw LEFT JOIN bf ON x = word WHERE coalesce(base_form, x) IN (SELECT form FROM q)),
once AS (SELECT id, count(DISTINCT form) FILTER (part = 'title') AS t, count(DISTINCT form) FILTER (part = 'content') AS c FROM th GROUP BY id),
pl AS (SELECT DISTINCT id, part, ord FROM th WHERE known),
isl AS (SELECT id, part, ord - row_number() OVER (PARTITION BY id, part ORDER BY ord) AS i FROM pl),
rl AS (SELECT id, part, count(*) AS r FROM isl GROUP BY id, part, i),
rs AS (SELECT id, sum(CASE part WHEN 'title' THEN 100 ELSE 10 END * r * (r - 1) / 2) AS runs FROM rl GROUP BY id),
rate AS (SELECT id, title, round(30 * coalesce(t, 0) + 5 * coalesce(c, 0) + coalesce(runs, 0) + exp(-id * 1e-5), 6) AS rating FROM a LEFT JOIN once USING (id) LEFT JOIN rs USING (id))"""
RANKED = f"""{BASE}, {_query("with", "that")}, {_RATE},
m AS (SELECT id FROM fm JOIN q USING (form) GROUP BY id HAVING count(DISTINCT k) = 2)
SELECT id, title, rating FROM rate SEMI JOIN m USING (id) ORDER BY rating DESC, id LIMIT 10"""
RATINGS = f"{BASE}, {_query('with', 'that')}, {_RATE} SELECT id, rating FROM rate"
_AT = "found AS (SELECT id, position FROM (SELECT DISTINCT id, k, start + ord - k AS position FROM fm JOIN {0} USING (form) JOIN s USING (id)) GROUP BY id, position HAVING count(DISTINCT k) = 2)"
PHRASE = f"{BASE}, {START}, {_query('in', 'the')}, {_AT.format('q')} SELECT id, position FROM found"
MIXED = f"""{BASE}, {START}, {_query("of", "the")}, {_query("with", name="p")}, {_AT.format("q")}
SELECT DISTINCT id FROM found SEMI JOIN (SELECT id FROM fm JOIN p USING (form)) USING (id)"""
CLUSTERED = f"""{BASE}, {WV}, {_query("with", "that")}, qc AS (SELECT DISTINCT k, coalesce(cluster, '0') AS ident FROM q LEFT JOIN wv ON form = term),
fc AS (SELECT DISTINCT id, coalesce(cluster, '0') AS ident FROM fm LEFT JOIN wv ON form = term)
SELECT id FROM fc JOIN qc USING (ident) GROUP BY id HAVING count(DISTINCT k) = 2"""
_CLUSTER_RATE = _RATE.replace("coalesce(base_form, x) AS form", "coalesce(cluster, '0') AS form").replace("WHERE coalesce(base_form, x) IN (SELECT form FROM q)", "LEFT JOIN wv ON coalesce(base_form, x) = term WHERE coalesce(cluster, '0') IN (SELECT ident FROM qc)")
_QC = "qc AS (SELECT DISTINCT k, coalesce(cluster, '0') AS ident FROM q LEFT JOIN wv ON form = term)"
RATINGS_CLUSTERED = f"{BASE}, {WV}, {_query('with', 'unheard')}, {_QC}, {_CLUSTER_RATE} SELECT id, rating FROM rate"
SNIPPETS = f"""WITH {ART}, {BF}, {_query("with")}, cw AS (SELECT id, unnest(range(len(ws))) AS ord, unnest(ws) AS x FROM (SELECT id, string_split(lower(content), ' ') AS ws FROM a)),
hits AS (SELECT DISTINCT x FROM (SELECT DISTINCT x FROM cw) LEFT JOIN bf ON x = word WHERE coalesce(base_form, x) IN (SELECT form FROM q)),
h AS (SELECT id, ord, x, x IN (SELECT x FROM hits) AS hit FROM cw),
n AS (SELECT *, bool_or(hit) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM h),
i AS (SELECT *, ord - row_number() OVER (PARTITION BY id ORDER BY ord) AS island FROM n WHERE near)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY island))::INTEGER AS snippet_no, snippet
FROM (SELECT id, island, string_agg(CASE WHEN hit THEN '[' || x || ']' ELSE x END, ' ' ORDER BY ord) AS snippet FROM i GROUP BY id, island)"""
SNIPPETS_CLUSTERED = SNIPPETS.replace("WITH " + ART + ", " + BF + ", " + _query("with"), "WITH " + ART + ", " + BF + ", " + WV + ", " + _query("with") + ", " + _QC).replace(
    "WHERE coalesce(base_form, x) IN (SELECT form FROM q)", "LEFT JOIN wv ON coalesce(base_form, x) = term WHERE coalesce(cluster, '0') IN (SELECT ident FROM qc)"
)
DOC_FREQUENCY = f"{BASE} SELECT form AS ident, count(DISTINCT id) AS df, min(id) AS first_id, max(id) AS last_id FROM fm GROUP BY form"
POSITIONS = f"""{BASE}, {START} SELECT form AS ident, count(*) AS n, min(p) AS first_position, sum(p)::BIGINT AS positions_sum
FROM (SELECT DISTINCT form, start + ord AS p FROM fm JOIN s USING (id)) GROUP BY form"""
STARTS = f"{BASE}, {START} SELECT id, start, n::BIGINT AS n_tokens FROM s"
AS_OF = f"{BASE}, {START}, p AS (SELECT start + n // 2 AS position FROM s) SELECT position, id FROM p ASOF JOIN s ON p.position >= s.start"

_GAPS = "pr AS (SELECT DISTINCT form, id FROM {0}), g AS (SELECT form, id, id - coalesce(lag(id) OVER (PARTITION BY form ORDER BY id), 0) AS gap FROM pr)"
HEX = f"""{BASE}, {_GAPS.format("fm")}
SELECT form AS ident, string_agg(CASE WHEN gap < 128 THEN printf('%02X', gap + 128) WHEN gap < 16384 THEN printf('%02X%02X', gap // 128, gap % 128 + 128)
  ELSE printf('%02X%02X%02X', gap // 16384, gap // 128 % 128, gap % 128 + 128) END, '' ORDER BY id) AS coded_hex, true AS round_trip FROM g GROUP BY form"""
SIZES = f"""{BASE}, known AS (SELECT id, base_form AS form FROM tok JOIN bf ON tok = word), {_GAPS.format("known")},
b AS (SELECT form, length(bin(gap)) AS bits FROM g),
t AS (SELECT sum((bits + 6) // 7) AS d128, sum((bits + 3) // 4) AS d16, count(*) AS n, sum(2 * bits - 1) AS gamma FROM b GROUP BY form)
SELECT sum(d128)::BIGINT AS base_128, sum(d16)::BIGINT AS base_16, sum(4 * n)::BIGINT AS int32, sum((gamma + 7) // 8)::BIGINT AS gamma FROM t"""
LISTS = f"""{BASE}, p AS (SELECT DISTINCT form, id FROM fm WHERE form IN ('with', 'that')), n AS (SELECT id, count(*) AS n FROM p GROUP BY id)
SELECT coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (n = 2), '') AS both, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS either FROM n"""

_QI = f"WITH {BF}, qx AS (SELECT DISTINCT item_id AS quote_id, coalesce(base_form, x) AS form FROM (SELECT item_id, unnest(string_split(text, ' ')) AS x FROM benchmark) LEFT JOIN bf ON x = word)"
_PUNCT = "regexp_replace(coalesce(base_form, x), '[[:punct:]]', '', 'g')"
QUOTE_SEARCH = f"""{_QI}, qs AS (SELECT * FROM (VALUES ('the of'), ('that and'), ('nowhere')) AS v(query)),
qw AS (SELECT DISTINCT query, x, {_PUNCT} AS form FROM (SELECT query, unnest(string_split(query, ' ')) AS x FROM qs) LEFT JOIN bf ON x = word),
m AS (SELECT query, quote_id FROM qw JOIN qx USING (form) GROUP BY query, quote_id HAVING count(DISTINCT x) = (SELECT count(DISTINCT x) FROM qw AS o WHERE o.query = qw.query))
SELECT query, quote_id, text FROM m JOIN benchmark ON quote_id = item_id"""
_PHRASES = f"""{_QI}, sp AS (SELECT string_split(text, ' ') AS ws FROM benchmark WHERE len(string_split(text, ' ')) >= 2),
ph AS (SELECT ws[1] || ' ' || ws[2] AS phrase FROM sp UNION SELECT ws[2] FROM sp),
qw AS (SELECT DISTINCT phrase, x, {_PUNCT} AS form FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS x FROM ph) LEFT JOIN bf ON x = word),
nd AS (SELECT phrase, count(DISTINCT x) AS needed FROM qw GROUP BY phrase),
m AS (SELECT phrase, quote_id FROM (SELECT phrase, quote_id, count(DISTINCT x) AS n FROM qw JOIN qx USING (form) GROUP BY 1, 2) JOIN nd USING (phrase) WHERE n = needed),
k AS (SELECT phrase, count(quote_id) AS n_quotes, coalesce(string_agg(quote_id::VARCHAR, ',' ORDER BY quote_id), '') AS quote_ids FROM ph LEFT JOIN m USING (phrase) GROUP BY phrase)"""
PHRASE_CLASSES = f"{_PHRASES} SELECT quote_ids, string_agg(phrase, '|' ORDER BY phrase) AS phrases FROM k GROUP BY quote_ids"
PHRASE_MEMBERS = f"{_PHRASES} SELECT min(phrase) OVER (PARTITION BY quote_ids) AS class, phrase, n_quotes FROM k"


def _clean(x: str) -> str:
    prefix = f"coalesce(nullif(regexp_replace({x}, '^[ [:punct:]–]+', ''), ''), {x})"
    cut = rf"split_part(split_part(regexp_replace({prefix}, '^\d*\.[\d\s.]*', ''), '&lt;', 1), '&gt;', 1)"
    return f"CASE WHEN regexp_matches({cut}, '[?!.]$') OR {cut} = '' THEN {cut} ELSE {cut} || '.' END"


QUOTE_CLEANING = f"""SELECT text, {_clean("text")} AS cleaned, len(string_split(text, ' ')) >= 4 AS accepted
FROM (SELECT * FROM {_rows(DIRTY_QUOTES, "text")} UNION ALL SELECT text FROM benchmark)"""
SUB_QUOTES = rf"""WITH p AS (SELECT unnest(string_split(regexp_replace(text, '\. ([A-Z])', chr(1) || '\1', 'g'), chr(1))) AS x FROM benchmark), c AS (SELECT {_clean("x")} AS text FROM p)
SELECT text FROM c WHERE len(string_split(text, ' ')) >= 4"""
_WEIGHTS = rf"""WITH {BF}, p AS (SELECT item_id, unnest(range(len(ps))) AS part, unnest(ps) AS x FROM (SELECT item_id, string_split(regexp_replace(text, '\. ([A-Z])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM benchmark)),
fq AS (SELECT item_id, part, text FROM (SELECT item_id, part, {_clean("x")} AS text FROM p) WHERE len(string_split(text, ' ')) >= 4),
fw AS (SELECT DISTINCT item_id, part, regexp_extract(lower(x), '^[^a-z]*([a-z]*)', 1) AS x FROM (SELECT item_id, part, unnest(string_split(text, ' ')) AS x FROM fq)),
fx AS (SELECT DISTINCT item_id, part, coalesce(base_form, x) AS form FROM fw LEFT JOIN bf ON x = word),
df AS (SELECT form, count(*) AS n FROM fx GROUP BY form), wt AS (SELECT form, exp(-5.0 * n / (SELECT max(n) FROM df)) AS weight FROM df)"""
_SCORES = f"""{_WEIGHTS}, {_query("with", "that", "the")},
sc AS (SELECT item_id, part, sum(weight) AS score FROM fx JOIN q USING (form) JOIN wt USING (form) GROUP BY 1, 2),
tx AS (SELECT text, max(score) AS score FROM sc JOIN fq USING (item_id, part) GROUP BY text)"""
QUOTE_SCORES = f"{_SCORES} SELECT text, round(score, 6) AS score FROM tx"
ANSWERS = f"{_SCORES} SELECT text, round(pow(score, 10) / (SELECT sum(pow(score, 10)) FROM tx), 6) AS probability FROM tx"
HIGHLIGHT = f"""WITH {BF}, {_query("the", "with")}, cw AS (SELECT item_id, unnest(range(len(ws))) AS ord, unnest(ws) AS x FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)),
hits AS (SELECT DISTINCT x FROM (SELECT DISTINCT x FROM cw) LEFT JOIN bf ON x = word WHERE coalesce(base_form, x) IN (SELECT form FROM q))
SELECT item_id AS quote_id, string_agg(CASE WHEN x IN (SELECT x FROM hits) THEN '[' || x || ']' ELSE x END, ' ' ORDER BY ord) AS marked FROM cw GROUP BY item_id"""

_TITLE_QUERY = "the thonble ofth and"
TITLES = rf"""WITH t AS (SELECT page_id + 1 AS id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
tw AS (SELECT id, '$' || lower(unnest(string_split(title, ' '))) AS x FROM t),
tx AS (SELECT DISTINCT id, substr(x, i, 3) AS g FROM (SELECT id, x, unnest(range(1, length(x) - 1)) AS i FROM tw)),
qw AS (SELECT '$' || unnest(string_split('{_TITLE_QUERY}', ' ')) AS x), qg AS (SELECT substr(x, i, 3) AS g FROM (SELECT x, unnest(range(1, length(x) - 1)) AS i FROM qw)),
c AS (SELECT id, count(*) AS hits FROM tx JOIN qg USING (g) GROUP BY id ORDER BY hits DESC, id LIMIT 100),
r AS (SELECT id, title, hits, hits - 3 * abs({len(_TITLE_QUERY.split(" "))} - len(string_split(title, ' '))) AS score, regexp_replace(title, '^\s+|\s+$', '', 'g') AS short FROM c JOIN t USING (id)),
b AS (SELECT id AS best_id, short FROM r ORDER BY score DESC, id LIMIT 1)
SELECT id, title, hits, score, id = best_id AS best FROM r JOIN b USING (short)"""

_TERMS = """dw AS (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(string_split(lower(content), ' ')) AS x FROM a) GROUP BY 1, 2),
dt AS (SELECT id, term, sum(n) AS n FROM (SELECT id, coalesce(base_form, CASE WHEN {0} THEN x END) AS term, n FROM dw LEFT JOIN bf ON x = word) WHERE term IS NOT NULL GROUP BY 1, 2),
idf AS (SELECT term, count(*) AS df, log2((SELECT count(*) FROM a) / count(*)) AS idf FROM dt GROUP BY term)"""
_ALL_TERMS = _TERMS.format("regexp_full_match(x, '[a-z]+')")
_TFIDF = f"""WITH {ART}, {BF}, {_ALL_TERMS}, tw AS (SELECT id, term, n / sum(n) OVER (PARTITION BY id) * idf AS v FROM dt JOIN idf USING (term)),
nw AS (SELECT id, term, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-3) AS weight FROM tw)"""
TFIDF = f"{_TFIDF} SELECT id, term, round(weight, 6) AS weight FROM nw"
SIMILAR = f"""{_TFIDF}, d AS (SELECT o.id, sum(o.weight * m.weight) AS s FROM nw AS o JOIN nw AS m USING (term) WHERE m.id = 1 AND o.id <> 1 GROUP BY o.id)
SELECT id, round(coalesce(s, 0), 6) AS similarity FROM a LEFT JOIN d USING (id) WHERE id <> 1 ORDER BY similarity DESC, id LIMIT 10"""
BANNED = f"WITH {ART}, {BF}, {_ALL_TERMS} SELECT term, df FROM idf ORDER BY round(idf, 9), term LIMIT 100"
_PREFIX = f"""WITH {ART}, {BF}, {WV}, {_ALL_TERMS}, ban AS (SELECT term FROM idf ORDER BY round(idf, 9), term LIMIT 100),
cw AS (SELECT id, unnest(range(len(ws))) AS ord, unnest(ws) AS x FROM (SELECT id, string_split(content, ' ') AS ws FROM a)),
f1 AS (SELECT id, base_form AS term, min((ord, pos)) AS place FROM cw JOIN bf ON x = word WHERE base_form NOT IN (SELECT term FROM ban) AND base_form IN (SELECT term FROM wv) GROUP BY 1, 2),
px AS (SELECT * FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY place, term) - 1 AS i FROM f1) WHERE i < 20)"""
PREFIX = f"{_PREFIX} SELECT id, i::INTEGER AS i, term FROM px"
ARTICLE_VECTORS = f"""{_PREFIX}, u AS (SELECT term, unnest(range(len(vec))) AS d, unnest(vec) / sqrt(list_inner_product(vec, vec)) AS x FROM wv),
av AS (SELECT id, d, sum(exp(-0.1 * i) * x) / 20 AS x FROM px JOIN u USING (term) GROUP BY id, d HAVING count(*) = 20),
n AS (SELECT id, max(x) FILTER (d = 0) AS first, sqrt(sum(x * x)) AS length FROM av GROUP BY id)
SELECT id, round(coalesce(first, 0), 6) AS first, round(coalesce(length, 0), 6) AS length FROM a LEFT JOIN n USING (id)"""
SHARING = f"""{_PREFIX}, o AS (SELECT id FROM px GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)
SELECT id, count(*) AS shared FROM px WHERE term IN (SELECT term FROM px SEMI JOIN o USING (id)) GROUP BY id HAVING count(*) >= 7"""
COSINE = f"""WITH {ART}, {BF}, {WV}, d AS (SELECT term, 1 - list_cosine_similarity(vec, (SELECT vec FROM wv ORDER BY term LIMIT 1)) AS distance FROM wv)
SELECT term, round(distance, 6) AS distance FROM d WHERE distance <= 0.75"""
ASSIGN = """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT p.vec_id, c.vec_id AS cluster, round(pow(list_distance(p.v, c.v), 2), 9) AS d FROM p, p AS c WHERE c.vec_id < 8)
SELECT vec_id::VARCHAR AS term, cluster FROM (SELECT vec_id, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM d) WHERE r = 1"""

_CLEAN = "nullif(regexp_extract({0}, '([a-zA-Z]+)', 1), '')"
_GRAMS = f"""ws AS (SELECT string_split(text, ' ') AS ws FROM documents), wx AS (SELECT unnest(ws) AS x FROM ws),
o AS (SELECT {_CLEAN.format("x")} AS w, count(*) AS n FROM wx WHERE {_CLEAN.format("x")} IS NOT NULL GROUP BY 1),
pa AS (SELECT p[1] AS p1, p[2] AS p2 FROM (SELECT unnest(list_zip(ws[:-2], ws[2:])) AS p FROM ws WHERE len(ws) > 1)),
t0 AS (SELECT p1, p2, {_CLEAN.format("p1")} AS w1, {_CLEAN.format("p2")} AS w2, count(*) AS n FROM pa GROUP BY 1, 2),
t AS (SELECT w1, w2, sum(n) AS n FROM t0 WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY 1, 2)"""
MERGED = f"""WITH {BF}, {_GRAMS}, dot AS (SELECT string_split(p1, '.') AS ps FROM t0 WHERE w1 IS NOT NULL AND w2 IS NOT NULL UNION ALL SELECT string_split(p2, '.') FROM t0 WHERE w1 IS NOT NULL AND w2 IS NOT NULL),
co AS (SELECT {_CLEAN.format("y")} AS w FROM (SELECT unnest(ps) AS y FROM dot WHERE len(ps) > 1)),
al AS (SELECT w FROM o UNION SELECT w FROM co WHERE w IS NOT NULL),
cut AS (SELECT w, w[:i] AS w1, w[i + 1:] AS w2 FROM (SELECT w, unnest(range(4, length(w) - 3)) AS i FROM al)),
k AS (SELECT cut.* FROM cut WHERE w1 IN (SELECT word FROM bf) AND w2 IN (SELECT word FROM bf)),
r AS (SELECT k.*, coalesce(o.n, 0) AS c, coalesce(o1.n, 0) AS c1, coalesce(o2.n, 0) AS c2, coalesce(t.n, 0) AS c12 FROM k LEFT JOIN o ON o.w = k.w LEFT JOIN o AS o1 ON o1.w = k.w1
  LEFT JOIN o AS o2 ON o2.w = k.w2 LEFT JOIN t ON t.w1 = k.w1 AND t.w2 = k.w2)
SELECT w1, w2 FROM r WHERE (c12 >= c * 0.5 AND c > 0) OR (least(c1, c2) > 20 AND abs(c1 - c2) <= least(c1, c2) * 0.3 AND (c1 + c2) * 0.01 >= c)"""
SPLIT = f"WITH {_GRAMS} SELECT w1, w2, w1 || w2 AS merged FROM t JOIN o ON o.w = w1 || w2 WHERE length(w1) > 3 AND length(w2) > 3 AND t.n < o.n * 0.4"
_SUPER = f"""WITH RECURSIVE {BFG}, f AS (SELECT word, arg_min(base_form, (pos, base_form)) AS lead FROM bf GROUP BY word),
e0 AS (SELECT DISTINCT lead AS x, base_form AS y FROM bf JOIN f USING (word)), e AS (SELECT x, y FROM e0 UNION SELECT y, x FROM e0),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
sb AS (SELECT x AS base_form, string_agg(y, '|' ORDER BY y) AS superbase FROM (SELECT DISTINCT x, y FROM r) GROUP BY x)"""
SUPERBASE = f"{_SUPER} SELECT base_form, superbase FROM sb"

FOLD = """WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM documents), f AS (SELECT word, translate(word, 'ąężźśóćłń', 'aezzsucln') AS folded FROM w)
SELECT folded, arg_min(word, (word <> folded, word)) AS word FROM f GROUP BY folded"""
_DELETED = f"""{BF}, dv AS (SELECT word AS variant, word, 0 AS cost FROM w
  UNION ALL SELECT substr(word, 1, i - 1) || substr(word, i + 1), word, 1 FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
dd AS (SELECT variant, min((cost, word)) AS m FROM dv GROUP BY variant)"""
DELETIONS = f"WITH {_DELETED} SELECT variant, m[2] AS word, m[1]::INTEGER AS cost FROM dd"
_KEYS = "(VALUES " + ", ".join(f"('{k}', '{x}')" for k, v in NEIGHBOURS.items() for x in v) + ") AS kv(a, b)"
_TYPOS = f"""{_DELETED}, ty AS (SELECT word AS correction, word[1] || word[3] || word[2] || word[4:] AS word FROM w),
u AS (SELECT DISTINCT word FROM ty), p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM u),
md AS (SELECT word, word AS v, 0.0::DOUBLE AS c FROM u UNION ALL SELECT word, substr(word, 1, i - 2) || word[i] || word[i - 1] || substr(word, i + 1), 1 FROM p WHERE i > 1
  UNION ALL SELECT word, substr(word, 1, i - 3) || word[i] || word[i - 1] || word[i - 2] || substr(word, i + 1), 1 FROM p WHERE i > 2
  UNION ALL SELECT word, substr(word, 1, i - 1) || b || substr(word, i + 1), 1.5 FROM p JOIN {_KEYS} ON a = word[i] UNION ALL SELECT word, substr(word, 1, i - 1) || substr(word, i + 1), 1 FROM p)"""
CORRECT = f"""WITH {_TYPOS}, b AS (SELECT md.word, min((c + m[1], m[2])) AS z FROM md JOIN dd ON v = variant GROUP BY md.word)
SELECT word, z[2] AS corrected, z[1]::DOUBLE AS cost FROM u LEFT JOIN b USING (word)"""
# every typo is one swap, of cost 1, from a word: its search ends among the strings of one modification
ACCURACY = f"""WITH {_DELETED}, ty AS (SELECT word AS correction, word[1] || word[3] || word[2] || word[4:] AS word FROM w),
u AS (SELECT DISTINCT word FROM ty), p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM u),
kv AS (SELECT a, unnest(range(1, length(bs) + 1)) AS j, bs FROM {_rows(list(NEIGHBOURS.items()), "a, bs")}),
md AS (SELECT word, word AS v, 0.0::DOUBLE AS c, (0, 0, 0) AS turn FROM u
  UNION ALL SELECT word, substr(word, 1, i - 2) || word[i] || word[i - 1] || substr(word, i + 1), 1, (1, i, 0) FROM p WHERE i > 1
  UNION ALL SELECT word, substr(word, 1, i - 3) || word[i] || word[i - 1] || word[i - 2] || substr(word, i + 1), 1, (2, i, 0) FROM p WHERE i > 2
  UNION ALL SELECT word, substr(word, 1, i - 1) || bs[j] || substr(word, i + 1), 1.5, (3, i, j) FROM p JOIN kv ON a = word[i]
  UNION ALL SELECT word, substr(word, 1, i - 1) || substr(word, i + 1), 1, (4, i, 0) FROM p),
fe AS (SELECT word, v, turn[1] > 0 AS queued, min(turn) AS turn, arg_min(c, turn) AS c FROM md GROUP BY 1, 2, 3),
lk AS (SELECT word, c, turn, c + m[1] AS total, m[2] AS found, min(c + m[1]) OVER (PARTITION BY word ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM fe LEFT JOIN dd ON v = variant),
en AS (SELECT word, min(turn) AS stop FROM lk WHERE c >= best GROUP BY word),
b AS (SELECT word, arg_min(found, (total, turn)) AS found FROM lk JOIN en USING (word) WHERE turn <= stop AND total IS NOT NULL GROUP BY word)
SELECT count(*) AS n, sum((correction IS NOT DISTINCT FROM found)::INTEGER)::BIGINT AS right, avg((correction IS NOT DISTINCT FROM found)::INTEGER) AS accuracy FROM ty LEFT JOIN b USING (word)"""

_CALLED, _NAMED_TWICE = r"(''+)([^'']+)(''+)([^'']+)zwana([^'']+)(''*)([^'']+)(''+)", r"(''+)([^'']+)(''+)([^'']+)nazywana([^'']+)(''*)([^'']+)(''+)"
_NAMED, _OR = r"nazywana([^'']+)(''+)([^'']+)(''+)", r"(''+)([^'']+)(''+) lub (''+)([^'']+)(''+)"
ALIASES = f"""WITH {ART} SELECT entity, CASE WHEN regexp_matches(content, '{_CALLED}') THEN regexp_extract(content, '{_CALLED}', 2) || ' # ' || regexp_extract(content, '{_CALLED}', 7)
  WHEN regexp_matches(content, '{_NAMED_TWICE}') THEN regexp_extract(content, '{_NAMED_TWICE}', 2) || ' # ' || regexp_extract(content, '{_NAMED_TWICE}', 7)
  WHEN regexp_matches(content, '{_NAMED}') THEN entity || ' # ' || regexp_extract(content, '{_NAMED}', 3)
  WHEN regexp_matches(content, '{_OR}') THEN regexp_extract(content, '{_OR}', 2) || ' # ' || regexp_extract(content, '{_OR}', 5) END AS alias
FROM (SELECT * FROM {_rows(PARAGRAPHS, "entity, content")} UNION ALL SELECT title, content FROM a)"""
QUOTED = f"""WITH t AS (SELECT text FROM {_rows(QUOTED_TEXTS, "text")} UNION ALL SELECT text FROM documents)
SELECT unnest(regexp_extract_all(text, '„([a-z]+)” , „([a-z]+)”', 1)) AS left, unnest(regexp_extract_all(text, '„([a-z]+)” , „([a-z]+)”', 2)) AS right FROM t"""
SYNONYMS = f"""WITH {ART}, {BF}, {WV}, nx AS (SELECT term AS l, lead(term) OVER (PARTITION BY cluster ORDER BY term) AS r FROM wv),
p AS (SELECT l, r FROM nx WHERE length(l) >= 3 AND length(r) >= 3),
x AS (SELECT l, r, b1.base_form AS form1, b1.pos AS pos1, b2.base_form AS form2, b2.pos AS pos2 FROM p JOIN bf AS b1 ON b1.word = l JOIN bf AS b2 ON b2.word = r),
e AS (SELECT l, r, pos1, min(pos2) AS stop FROM x WHERE form1 = form2 GROUP BY 1, 2, 3),
n AS (SELECT x.* FROM x LEFT JOIN e USING (l, r, pos1) JOIN wv AS v1 ON v1.term = form1 JOIN wv AS v2 ON v2.term = form2
  WHERE (stop IS NULL OR pos2 < stop) AND 1 - list_cosine_similarity(v1.vec, v2.vec) <= 0.75)
SELECT DISTINCT arg_min(form1, (pos1, pos2)) AS form1, arg_min(form2, (pos1, pos2)) AS form2 FROM n GROUP BY l, r"""
CLASSES = r"""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, CASE WHEN regexp_matches(ch, '\p{So}') THEN 'symbol' WHEN regexp_matches(ch, '\p{Sm}') THEN 'math' WHEN regexp_matches(ch, '\p{P}') THEN 'punctuation'
  WHEN regexp_matches(ch, '\p{Sc}') THEN 'currency' WHEN regexp_matches(ch, '\p{Sk}') THEN 'modifier' WHEN regexp_matches(ch, '\p{Nd}|\p{No}') THEN 'number'
  WHEN regexp_matches(ch, '\p{Cf}') THEN 'format' WHEN regexp_matches(ch, '\p{Zs}|\p{Zl}') THEN 'separator' WHEN u BETWEEN 65 AND 591 THEN 'LATIN' WHEN u BETWEEN 880 AND 1023 THEN 'GREEK' WHEN u BETWEEN 1024 AND 1327 THEN 'CYRILLIC' WHEN u BETWEEN 768 AND 879 THEN 'COMBINING'
  WHEN u BETWEEN 1424 AND 1535 THEN 'HEBREW' WHEN u BETWEEN 1536 AND 1791 THEN 'ARABIC' WHEN u BETWEEN 12352 AND 12447 THEN 'HIRAGANA' WHEN u BETWEEN 12448 AND 12543 THEN 'KATAKANA'
  WHEN u BETWEEN 19968 AND 40959 THEN 'CJK' WHEN u BETWEEN 44032 AND 55203 THEN 'HANGUL' ELSE 'no range' END AS class
FROM (SELECT ch, unicode(ch) AS u FROM c) WHERE ch <> '' AND NOT regexp_matches(ch, '\p{Cc}')"""
DIFFERENCE = r"""WITH t AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(x, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda x: x <> '') AS ws FROM benchmark)
SELECT a.item_id AS quote_id, array_to_string(list_filter(a.ws, lambda x: NOT list_contains(b.ws, x)), ' ') AS only_here,
  array_to_string(list_filter(b.ws, lambda x: NOT list_contains(a.ws, x)), ' ') AS only_before
FROM t AS a JOIN t AS b ON a.item_id = b.item_id + 1"""

_FLAT = r"regexp_replace(coalesce({0}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')"
EXPECTED = f"SELECT w1, w2, EXISTS (SELECT 1 FROM ({MERGED}) AS m WHERE m.w1 = v.w1 AND m.w2 = v.w2) AS found FROM {_rows(LISTED, 'w1, w2')}"
LATEX_QUOTED = QUOTED.replace("„([a-z]+)” , „([a-z]+)”", "`` ([a-z]+) '''' , `` ([a-z]+) ''''").replace(_rows(QUOTED_TEXTS, "text"), _rows(LATEX_TEXTS, "text"))
MOVE = f"""WITH s AS ({ASSIGN}), x AS (SELECT cluster, unnest(range(len(v))) AS d, unnest(v) AS x FROM (SELECT cluster, embedding::DOUBLE[] AS v FROM s JOIN embeddings ON term = vec_id::VARCHAR))
SELECT cluster, count(*) AS n, d::INTEGER AS d, round(avg(x), 6) AS x FROM x GROUP BY cluster, d"""
_KEYED = f"""{_SUPER},
ws AS (SELECT string_split(text, ' ') AS ws FROM documents), pr AS (SELECT DISTINCT lower(p[1]) AS w1, lower(p[2]) AS w2 FROM (SELECT unnest(list_zip(ws[:-2], ws[2:])) AS p FROM ws WHERE len(ws) > 1)),
nm AS (SELECT word, superbase FROM f JOIN sb ON f.lead = base_form), fs AS (SELECT word, list(base_form) AS forms FROM bf GROUP BY word),
k AS (SELECT w1, w2, n1.superbase || ' ' || n2.superbase AS key, f1.forms AS forms1, f2.forms AS forms2 FROM pr JOIN nm AS n1 ON n1.word = w1 JOIN nm AS n2 ON n2.word = w2 JOIN fs AS f1 ON f1.word = w1 JOIN fs AS f2 ON f2.word = w2),
am AS (SELECT a.w1 || ' ' || a.w2 AS "first", b.w1 || ' ' || b.w2 AS "second", 0 AS "at" FROM k AS a JOIN k AS b USING (key) WHERE a.w1 <> b.w1 AND NOT list_has_any(a.forms1, b.forms1)
  UNION ALL SELECT a.w1 || ' ' || a.w2, b.w1 || ' ' || b.w2, 1 FROM k AS a JOIN k AS b USING (key) WHERE a.w2 <> b.w2 AND NOT list_has_any(a.forms2, b.forms2))"""
AMBIGUOUS = f'{_KEYED} SELECT "first", "second", "at" FROM am WHERE am.first < am.second'
AMBIGUOUS_LINKS = f'{_KEYED} SELECT am.first AS ngram, "at", count(*) AS n_links FROM am GROUP BY 1, 2'
SUPERBASE_NAMES = f"""{_SUPER}, cm AS (SELECT x AS base_form, min(y) AS component FROM r GROUP BY x),
nb AS (SELECT *, (row_number() OVER (PARTITION BY component ORDER BY base_form) - 1) // 4 AS part FROM cm)
SELECT component, part, string_agg(base_form, '|' ORDER BY base_form) AS name FROM nb GROUP BY component, part"""
READ_ARTICLES = f"""SELECT row_number() OVER (ORDER BY doc_id) AS id, 'Doc ' || doc_id AS title, 'x' || {_FLAT.format("text")} || chr(10) || 'end' AS content FROM documents"""
READ_FORMS = f"WITH {BF} SELECT word, base_form, row_number() OVER (ORDER BY word, pos, base_form) - 1 AS pos FROM bf"
READ_QUOTES = f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS quote_id, trim({_FLAT.format('text')}) AS text FROM benchmark"
READ_NGRAMS = f"WITH {BF} SELECT word AS w1, base_form AS w2 FROM bf"
READ_VECTORS = """SELECT 't' || vec_id AS term, len(embedding)::INTEGER AS wide, round(list_sum(list_transform(embedding, lambda x: x::VARCHAR::DOUBLE)), 4) AS total FROM embeddings"""
READ_PARAGRAPHS = f"SELECT page_id::VARCHAR AS entity, trim('a' || {_FLAT.format('html')}) || 'z' AS content FROM pages"
READ_CHARACTERS = f"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split({_FLAT.format('text')}, ' ')) AS ch FROM benchmark) GROUP BY ch"
READ_TYPOS = f"WITH {BF} SELECT word AS correction, word[1] || word[3] || word[2] || word[4:] AS word FROM w"
READ_CLUSTERS = "SELECT 't' || vec_id AS term, label::VARCHAR AS cluster FROM embeddings"
STORED_SEARCH = f"""{BASE}, {START}, {_query("of", "the")}, {_query("with", name="p")}, {_AT.format("q")}, met AS (SELECT DISTINCT id FROM found SEMI JOIN (SELECT id FROM fm JOIN p USING (form)) USING (id)),
{_RATE.replace("(SELECT form FROM q)", "(SELECT form FROM q UNION SELECT form FROM p)")}
SELECT id, title, rating FROM rate SEMI JOIN met USING (id) ORDER BY rating DESC, id LIMIT 10"""
BOOLEAN = f"{BASE}, {_query('with', 'that')} SELECT id FROM fm JOIN q USING (form) GROUP BY id HAVING count(DISTINCT k) = 2"
CODED_BLOCKS = rf"""WITH {ART}, {BF}, rt AS (SELECT id, len(string_split(title, ' ')) AS nt, string_split(lower(title || ' ' || content), ' ') AS ws FROM a),
rw AS (SELECT id, nt, unnest(range(len(ws))) AS ord, unnest(ws) AS raw FROM rt), st AS (SELECT id, ord, ord < nt AS tt, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS cut FROM rw),
oc AS (SELECT id, ord, tt, cut AS x, 1 AS s, (raw = cut)::INTEGER AS r FROM st UNION ALL SELECT id, ord, tt, raw, 0, 1 FROM st WHERE raw <> cut),
fl AS (SELECT id, coalesce(base_form, x) AS ident, max(s) + 2 * max(CASE WHEN tt THEN r ELSE 0 END) + 4 * max(CASE WHEN tt THEN 0 ELSE r END) AS flags FROM oc LEFT JOIN bf ON x = word GROUP BY 1, 2),
np AS (SELECT ident, id // 16384 AS block, count(*)::INTEGER AS n_positions FROM (SELECT DISTINCT id, ord, coalesce(base_form, x) AS ident FROM oc LEFT JOIN bf ON x = word) GROUP BY 1, 2),
vl AS (SELECT ident, id // 16384 AS block, id, (id % 16384 + 1) * 8 + flags AS value FROM fl),
gp AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY ident, block ORDER BY value), 0) AS gap FROM vl),
hx AS (SELECT *, CASE WHEN gap < 128 THEN printf('%02X', gap + 128) WHEN gap < 16384 THEN printf('%02X%02X', gap // 128, gap % 128 + 128)
  ELSE printf('%02X%02X%02X', gap // 16384, gap // 128 % 128, gap % 128 + 128) END AS h FROM gp)
SELECT ident, block, min(id) AS "first", max(id) AS "last", count(*)::INTEGER AS n, (sum(length(h)) // 2)::INTEGER AS bytes, string_agg(h, '' ORDER BY value) AS coded_hex, any_value(n_positions) AS n_positions FROM hx JOIN np USING (ident, block) GROUP BY ident, block"""
TERM_NUMBERS = f"""WITH {ART}, {BF}, cw AS (SELECT id, unnest(range(len(ws))) AS ord, unnest(ws) AS x FROM (SELECT id, string_split(lower(content), ' ') AS ws FROM a)),
tm AS (SELECT coalesce(base_form, CASE WHEN regexp_full_match(x, '[a-z]+') THEN x END) AS term, min((id, ord, coalesce(pos, 0))) AS place FROM cw LEFT JOIN bf ON x = word GROUP BY 1)
SELECT term, row_number() OVER (ORDER BY place, term) - 1 AS number FROM tm WHERE term IS NOT NULL"""
KEYED_STEP = """WITH p AS (SELECT vec_id, label::BIGINT AS parent, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT parent, 0 AS start, row_number() OVER (PARTITION BY parent ORDER BY vec_id) - 1 AS child, v FROM p UNION ALL SELECT parent, 1, row_number() OVER (PARTITION BY parent ORDER BY vec_id DESC) - 1, v FROM p),
d AS (SELECT p.parent, start, child, vec_id, p.v, pow(list_distance(p.v, c.v), 2) AS d, row_number() OVER (PARTITION BY start, vec_id ORDER BY round(pow(list_distance(p.v, c.v), 2), 9), child) AS r FROM p JOIN c ON p.parent = c.parent AND child < 4),
k AS (SELECT parent, start, sum(d) AS cost FROM d WHERE r = 1 GROUP BY 1, 2), x AS (SELECT parent, start, child, unnest(range(len(v))) AS d, unnest(v) AS x FROM d WHERE r = 1),
m AS (SELECT parent, start, child, d, count(*) AS n, avg(x) AS x FROM x GROUP BY ALL)
SELECT parent, start, child::INTEGER AS child, n, d::INTEGER AS d, round(x, 6) AS x, round(cost, 6) AS cost FROM m JOIN k USING (parent, start)"""
DEFAULT_QUERY = "the of"
_SHARE = "(('0x' || substr(md5({0}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
ANSWERS_DRAWN = f"""{_WEIGHTS}, ak AS (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') AS query FROM benchmark UNION SELECT '0 ' || item_id FROM benchmark), qs AS (SELECT query FROM ak UNION SELECT '{DEFAULT_QUERY}'),
qw AS (SELECT DISTINCT query, regexp_extract(lower(x), '^[^a-z]*([a-z]*)', 1) AS x FROM (SELECT query, unnest(string_split(query, ' ')) AS x FROM qs)),
qf AS (SELECT DISTINCT query, x, coalesce(base_form, x) AS form FROM qw LEFT JOIN bf ON x = word),
sc AS (SELECT query, item_id, part, sum(weight) AS score FROM fx JOIN qf USING (form) JOIN wt USING (form) GROUP BY ALL),
tx AS (SELECT query, text, max(score) AS score FROM sc JOIN fq USING (item_id, part) WHERE text NOT IN (SELECT text FROM fq WHERE item_id % 5 = 0) GROUP BY ALL),
ow AS (SELECT query, arg_min(text, (-ln({_SHARE.format("'0|' || query || '|' || text")}) / pow(score, 10), text)) AS answer FROM tx SEMI JOIN ak USING (query) GROUP BY query),
dw AS (SELECT draw, arg_min(text, (-ln({_SHARE.format("'0|' || draw || '|' || text")}) / pow(score, 10), text)) AS other FROM tx, range(64) AS r(draw) WHERE query = '{DEFAULT_QUERY}' GROUP BY draw)
SELECT query, answer FROM ow UNION ALL SELECT query, coalesce(other, '{DEFAULT_QUERY}') FROM ak ANTI JOIN ow USING (query) LEFT JOIN dw ON draw = ('0x' || substr(md5('0|' || query), 1, 13))::BIGINT % 64"""
_CORE = r"""regexp_replace(regexp_replace(token, '^["''(\[{„“‘]+', ''), '["'')\]}”’]+$', '')"""
_SENTENCES = rf"""WITH tk AS (SELECT doc_id, unnest(range(len(ts))) AS ord, unnest(ts) AS token FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS ts FROM documents)),
co AS (SELECT *, {_CORE} AS core FROM tk), ba AS (SELECT *, regexp_replace(lower(core), '\.$', '') AS w FROM co),
bs AS (SELECT doc_id, ord, token, core, CASE WHEN regexp_full_match(w, '\p{{L}}[\p{{L}}.]*') THEN w END AS word, core LIKE '%.' AS stop FROM ba),
sh AS (SELECT count(*) FILTER (stop) / count(*) AS share FROM bs),
wc AS (SELECT word, count(*) AS n, count(*) FILTER (stop) AS with_stop, length(replace(word, '.', '')) AS letters FROM bs WHERE word IS NOT NULL GROUP BY word),
ab AS (SELECT word, n, with_stop, 2 * (with_stop * ln(0.99::DOUBLE) + (n - with_stop) * ln(1 - 0.99::DOUBLE) - with_stop * ln(share) - (n - with_stop) * ln(1 - share)) * exp(-letters) * (1 + length(word) - letters) * pow(letters::DOUBLE, with_stop - n) AS score
  FROM wc, sh WHERE with_stop > 0)"""
ABBREVIATIONS = f"{_SENTENCES} SELECT word, n, with_stop, round(score, 6) AS score FROM ab WHERE score >= 0.3"
SENTENCES = rf"""{_SENTENCES}, nx AS (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY ord) AS following FROM bs),
en AS (SELECT *, following IS NOT NULL AND NOT regexp_matches(following, '^["''(\[{{„“‘]*\p{{Ll}}') AND (regexp_matches(core, '[?!]$')
  OR stop AND NOT (coalesce(word IN (SELECT word FROM ab WHERE score >= 0.3), false) OR length(core) = 2 AND word IS NOT NULL)) AS ends FROM nx),
nm AS (SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n FROM en)
SELECT doc_id, n, string_agg(token, ' ' ORDER BY ord) AS sentence FROM nm GROUP BY doc_id, n"""
POSTING_ENDS = f"{BASE} SELECT form AS ident, max(id) AS last, true AS ordered, count(*) AS n, sum(id)::BIGINT AS sum FROM (SELECT DISTINCT form, id FROM fm) GROUP BY form"
STORED_ARTICLES = f"""WITH best AS ({STORED_SEARCH}), {ART}, {BF}
SELECT id, a.title, content, (SELECT min(base_form) FROM bf WHERE word = 'with') AS form FROM a SEMI JOIN best USING (id)"""
UNIT_VECTORS = f"""WITH {ART}, {BF}, {WV}, u AS (SELECT term, vec, sqrt(list_inner_product(vec, vec)) AS size FROM wv WHERE term IN (SELECT unnest(string_split(lower(title), ' ')) FROM a))
SELECT term, round(vec[1] / size, 6) AS first, 1.0::DOUBLE AS length FROM u"""
MEMBERS = f"WITH {ART}, {BF}, {WV} SELECT term FROM wv WHERE cluster = '3'"
_HASHED = "('0x' || substr(md5('{0}|' || w1 || '|' || w2), 1, 13))::BIGINT / 4503599627370496.0"
SAMPLED = f"""WITH ws AS (SELECT string_split(text, ' ') AS ws FROM documents), pr AS (SELECT DISTINCT p[1] AS w1, p[2] AS w2 FROM (SELECT unnest(list_zip(ws[:-2], ws[2:])) AS p FROM ws WHERE len(ws) > 1)),
s AS (SELECT w1, w2 FROM pr WHERE {_HASHED.format(0)} < 0.01) SELECT w1, w2, row_number() OVER (ORDER BY {_HASHED.format(1)}, w1, w2) <= 10 AS of_ten FROM s"""
