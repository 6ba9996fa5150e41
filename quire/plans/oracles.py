"""DuckDB SQL for each registered query (same column names, same fixed rules)."""

from __future__ import annotations

from quire.functions.html import sql_clean_html, sql_remove_hidden
from quire.operators import articles as A
from quire.operators import summaries as SM
from quire.operators.rag import QUERY_PROMPT, SPAN_ROOT, SPAN_STEPS
from quire.plans import sqltext as S

TOP_K = 3
CHUNK_WORDS_TOKENS = 300
SUMMARY_CHUNK_TOKENS = 2_000
ANSWER_WORDS = 39
EMBED_DIM = 64
TOKEN_DIM = 32
VECTOR_DIM = 64
NUM_CANDIDATES = 50
IVF_ROUNDS = 2
IVF_SHARE = 0.75
N_LABELS = 10

NL = "\n"


def _cos(a: str, b: str) -> str:
    return (
        f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]))"
        f" * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
    )


KNN_TOPK = f"""
WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.label, {_cos('q.embedding', 'c.embedding')} AS cosine
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, label, round(cosine, 6) AS cosine,
       round((1 + cosine) / 2, 6) AS search_score
FROM r WHERE rank <= {TOP_K}
"""

ANN_TOPK = f"""
WITH n AS (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
v AS (SELECT vec_id, embedding, list_transform(embedding::DOUBLE[], lambda x: floor(x / n * 127 + 0.5)) AS code FROM n WHERE n > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, {_cos('q.code', 'c.code')} AS rough, {_cos('q.embedding', 'c.embedding')} AS cosine
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
), c AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rough DESC, vec_id) AS place FROM s) WHERE place <= {NUM_CANDIDATES}
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(cosine, 6) AS cosine
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c) WHERE rank <= {TOP_K}
"""



def _ivf_topk() -> str:
    """Spherical k-means, lists, and the nearest lists of each query, in the rounds that the code makes."""
    ctes = [
        "u AS (SELECT vec_id, embedding, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)",
        "size AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS lists FROM u)",
        "c0 AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS list, u AS c FROM u) WHERE list < (SELECT lists FROM size))",
    ]
    for r in range(IVF_ROUNDS):
        ctes += [
            f"a{r} AS (SELECT vec_id, u, list FROM (SELECT vec_id, u, list, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(u, c) DESC, list) AS p FROM u CROSS JOIN c{r}) WHERE p = 1)",
            f"m{r} AS (SELECT list, list(s ORDER BY i) AS c FROM (SELECT list, i, sum(x) AS s FROM (SELECT list, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM a{r}) GROUP BY list, i) GROUP BY list)",
            f"c{r + 1} AS (SELECT list, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM (SELECT c{r}.list, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (list)))",
        ]
    return f"""
WITH {", ".join(ctes)},
near AS (SELECT vec_id, list, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(u, c) DESC, list) AS p FROM u CROSS JOIN c{IVF_ROUNDS}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, {_cos('q.embedding', 'c.embedding')} AS cosine
  FROM near n JOIN near l ON l.list = n.list AND l.p = 1 JOIN u q ON q.vec_id = n.vec_id JOIN u c ON c.vec_id = l.vec_id
  WHERE n.p <= ceil({IVF_SHARE} * (SELECT lists FROM size)) AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(cosine, 6) AS cosine
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= {TOP_K}
"""


WORD_STATS = f"""
SELECT doc_id, {S.word_count('text')} AS n_words, {S.rough_tokens('text')} AS rough_tokens,
       CAST(length({S.strip('text')}) AS BIGINT) AS stripped_chars, NOT {S.non_blank('text')} AS is_blank
FROM documents
"""

CHUNK_WORDS = f"""
WITH w AS (
  SELECT doc_id, text, {S.words('text')} AS ws FROM documents
), c AS (
  SELECT doc_id, text, ws, len(ws) AS n, (4 * len(ws)) // 3 AS tok FROM w
), single AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS chunk_no, text AS chunk FROM c WHERE tok <= {CHUNK_WORDS_TOKENS}
), m AS (
  SELECT doc_id, ws, n, (n * {CHUNK_WORDS_TOKENS}) // tok AS cl FROM c WHERE tok > {CHUNK_WORDS_TOKENS}
), e AS (
  SELECT doc_id, ws, cl, unnest(range(0, CAST(ceil(n / cl) AS BIGINT))) AS i FROM m
), multi AS (
  SELECT doc_id, CAST(i AS BIGINT) AS chunk_no, array_to_string(ws[i * cl + 1 : (i + 1) * cl], ' ') AS chunk FROM e
), u AS (SELECT * FROM single UNION ALL SELECT * FROM multi)
SELECT doc_id, chunk_no, {S.word_count('chunk')} AS n_words, chunk FROM u
"""

def _html_clean() -> str:
    return f"SELECT page_id, {sql_clean_html('html')} AS text FROM pages"


PAGE_TITLE = """
SELECT page_id,
       CASE WHEN strpos(url, '/wiki/') > 0 THEN split_part(url, '/wiki/', -1) ELSE url END AS title
FROM pages
"""


def _article() -> str:
    header = A.RULE_MAJOR + NL + NL + A.TOC_HEADING + NL + A.RULE_TOC + NL
    middle = NL + NL.join(["", A.BODY_HEADING, A.RULE_MAJOR, ""]) + NL
    para_clean = sql_clean_html("para")
    return f"""
WITH l AS (
  SELECT doc_id, CAST(g.pos - 1 AS BIGINT) AS pos, g.para
  FROM documents, LATERAL (
    SELECT unnest(string_split(text, {S.lit(NL)})) AS para, generate_subscripts(string_split(text, {S.lit(NL)}), 1) AS pos
  ) g
), s AS (
  SELECT doc_id, pos,
         CASE WHEN pos = 0 THEN 1 WHEN length(para) < 200 THEN 2 ELSE 3 END AS level,
         CASE WHEN pos > 0 THEN CAST(pos AS VARCHAR) END AS number,
         regexp_extract(para, '^[^.!?]*', 0) AS line,
         {para_clean} AS text
  FROM l
), t AS (
  SELECT doc_id, pos,
         repeat('  ', level - 1) || coalesce(number, '') || ' ' || line AS toc,
         repeat('#', level) || ' ' || line || {S.lit(NL + NL)} || coalesce(nullif(text, ''), {S.lit(A.NO_CONTENT)})
           || {S.lit(NL + NL + A.RULE_SECTION + NL)} AS block
  FROM s
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sections,
       {S.lit(A.TITLE_PREFIX)} || 'doc-' || CAST(doc_id AS VARCHAR) || {S.lit(NL + header)}
       || string_agg(toc, {S.lit(NL)} ORDER BY pos) || {S.lit(middle)} || string_agg(block, {S.lit(NL)} ORDER BY pos) AS article
FROM t GROUP BY doc_id
"""


def _page_articles() -> str:
    header = A.RULE_MAJOR + NL + NL + A.TOC_HEADING + NL + A.RULE_TOC + NL
    middle = NL + NL.join(["", A.BODY_HEADING, A.RULE_MAJOR, ""]) + NL
    return f"""
WITH l AS (
  SELECT page_id, url, CAST(g.pos - 1 AS BIGINT) AS pos, g.part
  FROM (SELECT page_id, url, string_split(regexp_replace(replace({sql_remove_hidden('html')}, chr(1), ''), '{A.HEADING}', chr(1) || '<\\1', 'g'), chr(1)) AS parts FROM pages),
  LATERAL (SELECT unnest(parts) AS part, generate_subscripts(parts, 1) AS pos) g
), s AS (
  SELECT page_id, url, pos, coalesce(TRY_CAST(regexp_extract(part, '{A.HEADING_PART}', 1) AS INTEGER), 1) AS level,
         regexp_extract(part, '{A.HEADING_PART}', 2) AS head, regexp_replace(part, '{A.HEADING_PART}', '') AS rest
  FROM l
), u AS (SELECT page_id, url, pos, level, {sql_clean_html('head')} AS line, {sql_clean_html('rest')} AS text FROM s
), t AS (
  SELECT page_id, url, pos,
         repeat('  ', level - 1) || CASE WHEN pos > 0 THEN CAST(pos AS VARCHAR) ELSE '' END || ' ' || line AS toc,
         repeat('#', level) || ' ' || line || {S.lit(NL + NL)} || coalesce(nullif(text, ''), {S.lit(A.NO_CONTENT)})
           || {S.lit(NL + NL + A.RULE_SECTION + NL)} AS block
  FROM u
)
SELECT page_id, CAST(count(*) AS BIGINT) AS n_sections,
       {S.lit(A.TITLE_PREFIX)} || CASE WHEN strpos(any_value(url), '/wiki/') > 0 THEN split_part(any_value(url), '/wiki/', -1) ELSE any_value(url) END
       || {S.lit(NL + header)} || string_agg(toc, {S.lit(NL)} ORDER BY pos) || {S.lit(middle)}
       || string_agg(block, {S.lit(NL)} ORDER BY pos) AS article
FROM t GROUP BY page_id
"""


_VERSIONS = """
WITH d AS (SELECT lang, source, doc_id, text AS content FROM documents),
v AS (
  SELECT *, lag(content) OVER (PARTITION BY lang, source ORDER BY doc_id) AS prev,
         row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn
  FROM d
)
"""

UPSERT_SNAPSHOT = (
    _VERSIONS
    + """
, a AS (SELECT * FROM v WHERE rn = 1 OR content IS DISTINCT FROM prev)
SELECT lang, source, doc_id, content FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) AS r FROM a
) WHERE r = 1
"""
)

UPSERT_ACTIONS = (
    _VERSIONS
    + """
SELECT action, count(*) AS n FROM (
  SELECT CASE WHEN content IS DISTINCT FROM prev THEN 'updated' ELSE 'unchanged' END AS action FROM v WHERE rn > 1
) GROUP BY action
"""
)

_VARIANTS = "(VALUES " + ", ".join(f"({S.lit(v)}, {i})" for i, v in enumerate(SM.VARIANT_NAMES)) + ") AS vv(variant, vpos)"

_DOCS = f"""
docs AS (
  SELECT doc_id, text AS content, 'doc-' || CAST(doc_id AS VARCHAR) AS team FROM documents
),
ex AS (
  SELECT d.doc_id, 'default' AS variant, {S.lead('d.text', 12)} AS s FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1
  UNION ALL
  SELECT doc_id, 'recent' AS variant, '  ' AS s FROM labels WHERE toxic = 1
  UNION ALL
  SELECT d.doc_id, 'legacy' AS variant, {S.lead('d.text', 5)} AS s FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0
),
pairs AS (
  SELECT d.doc_id, d.team, d.content, vv.variant FROM docs d, {_VARIANTS}
  WHERE {S.non_blank('d.content')}
    AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.doc_id = d.doc_id AND ex.variant = vv.variant AND {S.non_blank('ex.s')})
)"""


def _prompt_case(variant: str, team: str, content: str) -> str:
    whens = " ".join(
        f"WHEN {variant} = {S.lit(name)} THEN {S.fill(cfg['prompt'], team=team, content=content)}"
        for name, cfg in SM.VARIANTS.items()
    )
    return f"CASE {whens} END"


def _filled() -> str:
    reply = lambda x: S.reply(x, ANSWER_WORDS)
    part = S.fill(SM.PART_PREFIX, team="team")
    return (
        _DOCS
        + f""",
w AS (SELECT *, {S.words('content')} AS ws FROM pairs),
c AS (SELECT *, len(ws) AS n, (4 * len(ws)) // 3 AS tok FROM w),
single AS (
  SELECT doc_id, variant, {reply('m')} AS summary, {S.refused('m')} AS error, 1 AS n_chunks, CASE WHEN coalesce({reply('m')}, '') = '' THEN 1 ELSE 0 END AS n_failed
  FROM (SELECT *, {_prompt_case('variant', 'team', 'content')} AS m FROM c) WHERE tok <= {SUMMARY_CHUNK_TOKENS}
),
m AS (SELECT doc_id, variant, team, ws, n, (n * {SUMMARY_CHUNK_TOKENS}) // tok AS cl FROM c WHERE tok > {SUMMARY_CHUNK_TOKENS}),
e AS (SELECT doc_id, variant, team, ws, cl, unnest(range(0, CAST(ceil(n / cl) AS BIGINT))) AS i FROM m),
parts AS (
  SELECT doc_id, variant, i, {reply('m')} AS p, {S.refused('m')} AS e
  FROM (SELECT *, {part} || array_to_string(ws[i * cl + 1 : (i + 1) * cl], ' ') AS m FROM e)
),
comb AS (
  SELECT doc_id, variant, {S.lit(SM.COMBINE_PREFIX)} || coalesce(string_agg(p, {S.lit(SM.PART_SEPARATOR)} ORDER BY i) FILTER (WHERE p <> ''), '') AS m,
         arg_min(e, i) FILTER (WHERE e IS NOT NULL) AS first_error, count(*) AS n_chunks, count(*) FILTER (WHERE coalesce(p, '') = '') AS n_failed
  FROM parts GROUP BY doc_id, variant
),
multi AS (
  SELECT doc_id, variant, {reply('m')} AS summary, coalesce({S.refused('m')}, first_error) AS error, n_chunks, n_failed FROM comb
),
fresh AS (SELECT * FROM single UNION ALL SELECT * FROM multi),
filled AS (
  SELECT doc_id, variant, summary FROM fresh WHERE summary <> ''
  UNION ALL
  SELECT doc_id, variant, s AS summary FROM ex
  WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.doc_id = ex.doc_id AND f.variant = ex.variant AND f.summary <> '')
)"""
    )


def _items() -> str:
    types = ", ".join(S.lit(v) for v in SM.VARIANT_NAMES)
    return (
        _filled()
        + f""",
items AS (
  SELECT CAST(d.doc_id AS VARCHAR) || ':' || f.variant AS item_id, d.doc_id, d.team, f.variant AS summary_type,
         {S.strip('d.content')} AS reference, {S.strip('f.summary')} AS summary
  FROM docs d JOIN filled f USING (doc_id)
  WHERE f.variant IN ({types}) AND {S.non_blank(S.strip('d.content'))} AND {S.non_blank(S.strip('f.summary'))}
),
ct AS (
  SELECT item_id, doc_id, t AS term, count(*) AS n FROM (SELECT item_id, doc_id, unnest({S.terms('summary')}) AS t FROM items)
  GROUP BY item_id, doc_id, t
),
rt AS (
  SELECT doc_id, t AS term, count(*) AS n
  FROM (SELECT doc_id, unnest({S.terms('reference')}) AS t FROM (SELECT DISTINCT doc_id, reference FROM items))
  GROUP BY doc_id, t
),
rtot AS (SELECT doc_id, sum(n) AS r_total, sum(n * n) AS r_sq FROM rt GROUP BY doc_id),
pi AS (
  SELECT ct.item_id, ct.doc_id, sum(ct.n) AS c_total,
         sum(CASE WHEN rt.n IS NOT NULL THEN ct.n ELSE 0 END) AS c_hit, sum(ct.n * ct.n) AS c_sq,
         sum(coalesce(ct.n * rt.n, 0)) AS dot, sum(coalesce(rt.n, 0)) AS r_hit
  FROM ct LEFT JOIN rt ON ct.doc_id = rt.doc_id AND ct.term = rt.term
  GROUP BY ct.item_id, ct.doc_id
),
sc0 AS (
  SELECT item_id, CAST(c_hit AS DOUBLE) / CAST(c_total AS DOUBLE) AS precision,
         CAST(r_hit AS DOUBLE) / CAST(r_total AS DOUBLE) AS recall,
         CAST(dot AS DOUBLE) / (sqrt(CAST(c_sq AS DOUBLE)) * sqrt(CAST(r_sq AS DOUBLE))) AS cosine
  FROM pi JOIN rtot USING (doc_id)
),
sc1 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN CAST(2.0 AS DOUBLE) * precision * recall / (precision + recall)
                 WHEN precision IS NOT NULL AND recall IS NOT NULL THEN CAST(0.0 AS DOUBLE) END AS f1
  FROM sc0
),
sc AS (SELECT *, f1 * CAST(0.6 AS DOUBLE) + cosine * CAST(0.4 AS DOUBLE) AS combined FROM sc1),
wide AS (
  SELECT i.item_id, i.team, i.summary_type, sc.precision AS bert_precision, sc.recall AS bert_recall,
         sc.f1 AS bert_f1, sc.cosine AS cosine_similarity, sc.combined AS combined_score,
         {S.word_count('i.summary')} AS summary_length, {S.word_count('i.reference')} AS article_length
  FROM items i LEFT JOIN sc USING (item_id)
)"""
    )


def _with(body: str, select: str) -> str:
    return "WITH " + body.lstrip() + "\n" + select


MISSING_PAIRS = _with(_DOCS, "SELECT doc_id, variant FROM pairs")

PROMPT_FILL = _with(
    _DOCS, f"SELECT d.doc_id, vv.variant, {_prompt_case('vv.variant', 'd.team', 'd.content')} AS prompt FROM docs d, {_VARIANTS}"
)

SUMMARY_ERRORS = _with(
    _filled(), "SELECT doc_id, variant, summary, error, CAST(n_chunks AS BIGINT) AS n_chunks, CAST(n_failed AS BIGINT) AS n_failed FROM fresh"
)
SUMMARY_FILL = _with(_filled(), "SELECT doc_id, variant, summary FROM filled")

MISSING_VECTORS = _with(
    _filled(),
    """SELECT f.doc_id, f.variant AS summary_type FROM filled f
WHERE NOT EXISTS (
  SELECT 1 FROM ex JOIN labels l USING (doc_id) WHERE l.toxic = 0 AND ex.doc_id = f.doc_id AND ex.variant = f.variant
)""",
)


def _bucket(t: str) -> str:
    return f"(('0x' || substr(md5({t}), 1, 8))::BIGINT % {EMBED_DIM})"


def _rag() -> str:
    return f"""
qb AS (
  SELECT qid, b, count(*) AS c FROM (
    SELECT item_id AS qid, {_bucket('t')} AS b FROM (SELECT item_id, unnest({S.terms('text')}) AS t FROM benchmark)
  ) GROUP BY qid, b
),
db AS (
  SELECT did, b, count(*) AS c FROM (
    SELECT doc_id AS did, {_bucket('t')} AS b FROM (SELECT doc_id, unnest({S.terms('text')}) AS t FROM documents)
  ) GROUP BY did, b
),
qn AS (SELECT qid, sqrt(sum(c * c)) AS nq FROM qb GROUP BY qid),
dn AS (SELECT did, sqrt(sum(c * c)) AS nd FROM db GROUP BY did),
dots AS (SELECT qb.qid, db.did, sum(qb.c * db.c) AS dot FROM qb JOIN db ON qb.b = db.b GROUP BY qb.qid, db.did),
sc AS (SELECT qid, did, CAST(dot AS DOUBLE) / (nq * nd) AS cos FROM dots JOIN qn USING (qid) JOIN dn USING (did)),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, did) AS rk FROM sc) WHERE rk <= {TOP_K}
),
ctx AS (
  SELECT top.qid, string_agg(d.text, {S.lit(chr(10) * 2)} ORDER BY rk) AS context,
         string_agg(CAST(top.did AS VARCHAR), ',' ORDER BY rk) AS hit_ids
  FROM top JOIN documents d ON d.doc_id = top.did GROUP BY top.qid
),
ans0 AS (
  SELECT b.item_id, b.text AS question, coalesce(ctx.hit_ids, '') AS hit_ids, coalesce(ctx.context, '') AS context
  FROM benchmark b LEFT JOIN ctx ON ctx.qid = b.item_id
),
ans AS (
  SELECT * EXCLUDE (m), coalesce({S.reply('m', ANSWER_WORDS)}, '') AS answer
  FROM (SELECT *, {S.fill(QUERY_PROMPT, context='context', query='question')} AS m FROM ans0)
)"""


RAG_CONTEXT = _with(_rag(), "SELECT item_id, hit_ids, context, answer FROM ans")

JUDGE_SCORES = _with(
    _rag(),
    f"""SELECT item_id,
  round(CASE WHEN len(list_distinct({S.terms('answer')})) > 0 THEN
    CAST(len(list_filter(list_distinct({S.terms('answer')}),
         lambda x: NOT list_contains(list_concat({S.terms('context')}, {S.terms('question')}), x))) AS DOUBLE)
    / len(list_distinct({S.terms('answer')})) END, 6) AS hallucination,
  round(CASE WHEN len(list_distinct({S.terms('question')})) > 0 THEN
    CAST(len(list_filter(list_distinct({S.terms('question')}), lambda x: list_contains({S.terms('answer')}, x))) AS DOUBLE)
    / len(list_distinct({S.terms('question')})) END, 6) AS answer_relevance
FROM ans""",
)

EMBEDDING_COSINE = f"""
WITH p AS (SELECT * FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations) WHERE following IS NOT NULL),
x AS (SELECT conv_id, turn, b, count(*) AS n FROM (SELECT conv_id, turn, {_bucket('t')} AS b FROM (SELECT conv_id, turn, unnest({S.terms('text')}) AS t FROM p)) GROUP BY ALL),
y AS (SELECT conv_id, turn, b, count(*) AS n FROM (SELECT conv_id, turn, {_bucket('t')} AS b FROM (SELECT conv_id, turn, unnest({S.terms('following')}) AS t FROM p)) GROUP BY ALL),
nx AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS lx FROM x GROUP BY ALL), ny AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS ly FROM y GROUP BY ALL),
d AS (SELECT conv_id, turn, sum(x.n * y.n) AS s FROM x JOIN y USING (conv_id, turn, b) GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(s, CASE WHEN lx > 0 AND ly > 0 THEN 0 END) / (lx * ly), 6) AS cosine
FROM p LEFT JOIN nx USING (conv_id, turn) LEFT JOIN ny USING (conv_id, turn) LEFT JOIN d USING (conv_id, turn)
"""

CHAT_MESSAGES = f"""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages,
       string_agg(role || ': ' || text, {S.lit(chr(10) * 2)} ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id
"""

GREEDY_MATCH = f"""
WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (
  SELECT a.label AS pair_id, a.vec_id, max({_cos('a.v', 'b.v')}) AS best
  FROM n a JOIN n b ON b.label = (a.label + 1) % {N_LABELS} GROUP BY a.label, a.vec_id
),
r AS (
  SELECT a.label AS pair_id, b.vec_id, max({_cos('a.v', 'b.v')}) AS best
  FROM n a JOIN n b ON b.label = (a.label + 1) % {N_LABELS} GROUP BY a.label, b.vec_id
),
pp AS (SELECT pair_id, avg(best) AS precision FROM p GROUP BY pair_id),
rr AS (SELECT pair_id, avg(best) AS recall FROM r GROUP BY pair_id)
SELECT CAST(pair_id AS INTEGER) AS pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1
FROM pp FULL JOIN rr USING (pair_id)
"""

LEXICAL_PRF = _with(_items(), "SELECT item_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sc")
TF_COSINE = _with(_items(), "SELECT item_id, round(cosine, 6) AS cosine FROM sc")
COMBINED_SCORE = _with(_items(), "SELECT item_id, round(combined, 6) AS combined_score FROM sc")
EVAL_WIDE = _with(
    _items(),
    """SELECT item_id, team, summary_type, round(bert_precision, 6) AS bert_precision, round(bert_recall, 6) AS bert_recall,
       round(bert_f1, 6) AS bert_f1, round(cosine_similarity, 6) AS cosine_similarity,
       round(combined_score, 6) AS combined_score, summary_length, article_length FROM wide""",
)
EVAL_VECTORS = _with(
    _items(),
    f""", seen AS (SELECT term FROM ct UNION SELECT term FROM rt),
places AS (
  SELECT term, list_transform(range(len(term)), lambda i: ('0x' || substr(md5(substr('^' || term || '$', i + 1, 3)), 1, 8))::BIGINT % {TOKEN_DIM}) AS p FROM seen
),
tv AS (SELECT term, list_transform(range({TOKEN_DIM}), lambda b: CAST(len(list_filter(p, lambda x: x = b)) AS DOUBLE)) AS v FROM places),
met AS (SELECT DISTINCT ct.term AS c, rt.term AS r FROM ct JOIN rt USING (doc_id)),
near AS (
  SELECT c, r, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS cos
  FROM met JOIN tv x ON x.term = c JOIN tv y ON y.term = r
),
mt AS (SELECT item_id, ct.term AS c, ct.n AS cn, rt.term AS r, rt.n AS rn, cos FROM ct JOIN rt USING (doc_id) JOIN near ON c = ct.term AND r = rt.term),
pp AS (SELECT item_id, CAST(sum(cn * best) AS DOUBLE) / sum(cn) AS p FROM (SELECT item_id, c, any_value(cn) AS cn, max(cos) AS best FROM mt GROUP BY item_id, c) GROUP BY item_id),
rr AS (SELECT item_id, CAST(sum(rn * best) AS DOUBLE) / sum(rn) AS r FROM (SELECT item_id, r, any_value(rn) AS rn, max(cos) AS best FROM mt GROUP BY item_id, r) GROUP BY item_id),
cb AS (SELECT item_id, doc_id, {_bucket('term')} AS b, sum(n) AS n FROM ct GROUP BY ALL), db AS (SELECT doc_id, {_bucket('term')} AS b, sum(n) AS n FROM rt GROUP BY ALL),
cl AS (SELECT item_id, doc_id, sqrt(sum(n * n)) AS l FROM cb GROUP BY ALL), dl AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM db GROUP BY ALL),
cd AS (SELECT item_id, sum(cb.n * db.n) AS s FROM cb JOIN db USING (doc_id, b) GROUP BY ALL),
tc AS (SELECT item_id, coalesce(s, 0) / (cl.l * dl.l) AS cos FROM cl JOIN dl USING (doc_id) LEFT JOIN cd USING (item_id)),
vs AS (
  SELECT w.* EXCLUDE (bert_precision, bert_recall, bert_f1, cosine_similarity, combined_score), p, r, cos,
         CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p IS NOT NULL AND r IS NOT NULL THEN 0 END AS f
  FROM wide w LEFT JOIN pp USING (item_id) LEFT JOIN rr USING (item_id) LEFT JOIN tc USING (item_id)
)
SELECT item_id, team, summary_type, round(p, 6) AS bert_precision, round(r, 6) AS bert_recall, round(f, 6) AS bert_f1, round(cos, 6) AS cosine_similarity,
       round(f * 0.6 + cos * 0.4, 6) AS combined_score, summary_length, article_length FROM vs""",
)
EVAL_MISSING = _with(
    _items(),
    """SELECT item_id, CASE WHEN summary_type = 'achievements' THEN 'team_' || item_id ELSE team END AS team, summary_type,
       CASE WHEN summary_type <> 'recent' THEN round(bert_f1, 6) END AS bert_f1,
       CASE WHEN summary_type <> 'recent' THEN round(combined_score, 6) END AS combined_score, summary_length FROM wide""",
)
EVAL_REPORT = _with(
    _items(),
    """SELECT summary_type, round(avg(bert_f1), 6) AS bert_f1, round(avg(cosine_similarity), 6) AS cosine_similarity,
       round(avg(combined_score), 6) AS combined_score,
       printf('%-12s | BERT F1: %s | Cosine: %s | Combined: %s', summary_type, printf('%.4f', avg(bert_f1)),
              printf('%.4f', avg(cosine_similarity)), printf('%.4f', avg(combined_score))) AS line
FROM wide WHERE summary_type IS NOT NULL GROUP BY summary_type""",
)
REPORT_MERGED = EVAL_REPORT.replace("AS line\nFROM wide", "AS line, CAST(count(*) AS BIGINT) AS n_items\nFROM wide")
EVAL_BEST_WORST = _with(
    _items(),
    """, v AS (SELECT * FROM wide WHERE combined_score IS NOT NULL),
b AS (SELECT 'best' AS which, team, summary_type, round(combined_score, 6) AS combined_score, item_id
      FROM v ORDER BY v.combined_score DESC, item_id LIMIT 1),
wo AS (SELECT 'worst' AS which, team, summary_type, round(combined_score, 6) AS combined_score, item_id
      FROM v ORDER BY v.combined_score ASC, item_id LIMIT 1)
SELECT * FROM (SELECT * FROM b UNION ALL SELECT * FROM wo)
WHERE (SELECT min(combined_score) < max(combined_score) FROM v)""",
)

VECTOR_CONTRACT = f"""
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim,
       round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
       CASE WHEN embedding IS NULL THEN 'null'
            WHEN len(embedding) <> {VECTOR_DIM} THEN 'wrong_size'
            WHEN list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) THEN 'bad_value'
            WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 'zero_norm' END AS violation
FROM embeddings
"""

SPANS = _with(
    _rag(),
    """, st AS (
  SELECT CAST(item_id AS VARCHAR) AS trace_id, CASE WHEN answer = '' THEN 'error' ELSE 'ok' END AS status FROM ans
 ), names AS (SELECT * FROM (VALUES """ + ", ".join(f"({S.lit(n)})" for n in SPAN_STEPS) + f""") AS t(name))
SELECT trace_id, substr(sha256(trace_id || '|{SPAN_ROOT}'), 1, 16) AS span_id, CAST(NULL AS VARCHAR) AS parent_id,
       '{SPAN_ROOT}' AS name, status FROM st
UNION ALL
SELECT trace_id, substr(sha256(trace_id || '|' || name), 1, 16) AS span_id,
       substr(sha256(trace_id || '|{SPAN_ROOT}'), 1, 16) AS parent_id, name, status FROM st, names""",
)

SCORE_ROWS = _with(
    _items(),
    """SELECT * FROM (
  SELECT item_id, 0 AS ordinal, 'BERTRecall' AS name, round(recall, 6) AS value FROM sc
  UNION ALL SELECT item_id, 1, 'BERTPrecision', round(precision, 6) FROM sc
  UNION ALL SELECT item_id, 2, 'BERTF1', round(f1, 6) FROM sc
  UNION ALL SELECT item_id, 3, 'CosineSimilarity', round(cosine, 6) FROM sc
  UNION ALL SELECT item_id, 4, 'CombinedScore', round(combined, 6) FROM sc
) WHERE value IS NOT NULL""",
)

ORACLES: dict[str, str] = {
    "ann_topk": ANN_TOPK,
    "ivf_topk": _ivf_topk(),
    "ivf_exact": KNN_TOPK,
    "knn_topk": KNN_TOPK,
    "word_stats": WORD_STATS,
    "chunk_words": CHUNK_WORDS,
    "html_clean": _html_clean(),
    "page_title": PAGE_TITLE,
    "article_assemble": _article(),
    "page_articles": _page_articles(),
    "upsert_snapshot": UPSERT_SNAPSHOT,
    "upsert_actions": UPSERT_ACTIONS,
    "upsert_bucketed": UPSERT_SNAPSHOT,
    "stream_snapshot": UPSERT_SNAPSHOT,
    "missing_pairs": MISSING_PAIRS,
    "prompt_fill": PROMPT_FILL,
    "summary_fill": SUMMARY_FILL,
    "summary_errors": SUMMARY_ERRORS,
    "summary_stored": SUMMARY_FILL,
    "missing_vectors": MISSING_VECTORS,
    "missing_vectors_by_key": MISSING_VECTORS,
    "rag_context": RAG_CONTEXT,
    "chat_messages": CHAT_MESSAGES,
    "greedy_match": GREEDY_MATCH,
    "lexical_prf": LEXICAL_PRF,
    "tf_cosine": TF_COSINE,
    "combined_score": COMBINED_SCORE,
    "embedding_cosine": EMBEDDING_COSINE,
    "score_rows": SCORE_ROWS,
    "eval_wide": EVAL_WIDE,
    "eval_vectors": EVAL_VECTORS,
    "eval_missing": EVAL_MISSING,
    "eval_report": EVAL_REPORT,
    "eval_best_worst": EVAL_BEST_WORST,
    "report_merged": REPORT_MERGED,
    "best_worst_merged": EVAL_BEST_WORST,
    "judge_scores": JUDGE_SCORES,
    "vector_contract": VECTOR_CONTRACT,
    "spans": SPANS,
}
