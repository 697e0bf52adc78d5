"""DuckDB SQL equivalent of every registered query with an exact oracle."""

from __future__ import annotations

from lexis.operators import retrieve as R
from lexis.plans import sqltext as S

ORACLE: dict[str, str] = {}

# --------------------------------------------------------------------------
# shared CTEs
# --------------------------------------------------------------------------

LINES = f"""lines AS (
  SELECT doc_id, CAST(unnest(range(len(parts))) AS BIGINT) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, {S.split_lines('text')} AS parts FROM documents)
)"""

STORE = f"""store AS (
  SELECT doc_id, line_no, {S.preprocess_text('s')} AS content
  FROM (SELECT doc_id, line_no, {S.strip('line')} AS s FROM lines) WHERE s <> ''
)"""

DVEC = f"""dterms AS (
  SELECT doc_id, line_no, {S.feature_bucket('term')} AS feature, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT doc_id, line_no, unnest({S.term_tokens('content')}) AS term FROM store)
  GROUP BY ALL
),
dvec AS (SELECT *, sqrt(sum(tf * tf) OVER (PARTITION BY doc_id, line_no)) AS norm FROM dterms)"""

QVEC = f"""qs AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qterms AS (
  SELECT query_id, {S.feature_bucket('term')} AS feature, CAST(count(*) AS DOUBLE) AS qtf
  FROM (SELECT query_id, unnest({S.term_tokens(S.preprocess_text('query'))}) AS term FROM qs)
  GROUP BY ALL
),
qvec AS (SELECT *, sqrt(sum(qtf * qtf) OVER (PARTITION BY query_id)) AS qnorm FROM qterms)"""

SCORES = f"""scores AS (
  SELECT query_id, doc_id, line_no,
         {S.raw_cosine('sum(tf * qtf)', 'max(qnorm)', 'max(norm)')} AS similarity
  FROM dvec JOIN qvec USING (feature) GROUP BY ALL
)"""

RANKED = """top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                 ORDER BY similarity DESC, doc_id, line_no) AS rnk FROM scores) WHERE rnk <= 5
),
pad AS (
  SELECT qs.query_id, p.doc_id, p.line_no, 0.0 AS similarity
  FROM qs, (SELECT doc_id, line_no FROM store ORDER BY doc_id, line_no LIMIT 5) p
),
merged AS (
  SELECT query_id, doc_id, line_no, max(similarity) AS similarity FROM (
    SELECT query_id, doc_id, line_no, similarity FROM top UNION ALL SELECT * FROM pad)
  GROUP BY ALL
),
ranked AS (
  SELECT query_id, CAST(rnk AS BIGINT) AS rank, doc_id, line_no, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
           ORDER BY similarity DESC, doc_id, line_no) AS rnk FROM merged) WHERE rnk <= 5
)"""

SAMPLE = """sample AS (
  SELECT doc_id, line_no, content FROM store
  ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)), doc_id, line_no
  LIMIT 1000
)"""

SAMPLE_SCORES = f"""sdvec AS (SELECT d.* FROM dvec d JOIN sample USING (doc_id, line_no)),
spos AS (
  SELECT query_id, doc_id, line_no,
         {S.raw_cosine('sum(tf * qtf)', 'max(qnorm)', 'max(norm)')} AS similarity
  FROM sdvec JOIN qvec USING (feature) GROUP BY ALL
),
cand AS (
  SELECT qs.query_id, s.doc_id, s.line_no, coalesce(p.similarity, 0.0) AS similarity
  FROM qs CROSS JOIN sample s LEFT JOIN spos p
    ON p.query_id = qs.query_id AND p.doc_id = s.doc_id AND p.line_no = s.line_no
)"""


def answer_sql(ranked_cte: str) -> str:
    return f"""info AS (
  SELECT r.query_id, r.rank, s.content FROM {ranked_cte} r JOIN store s USING (doc_id, line_no)
),
agg AS (
  SELECT query_id, string_agg({S.q(R.HIT_PREFIX)} || content || chr(10), '' ORDER BY rank) AS body,
         count(*) AS n
  FROM info GROUP BY query_id
)
SELECT qs.query_id,
  CASE WHEN (SELECT count(*) FROM store) = 0 THEN {S.q(R.NOT_TRAINED)}
       WHEN coalesce(agg.n, 0) = 0 THEN {S.q(R.NO_INFO)}
       ELSE {S.q(R.HEADER_PREFIX)} || qs.query || {S.q(R.HEADER_SUFFIX)} || agg.body END AS answer
FROM qs LEFT JOIN agg USING (query_id)"""


ORACLE["candidate_sample"] = f"WITH {LINES},\n{STORE},\n{SAMPLE}\nSELECT * FROM sample"

ORACLE["score_candidates"] = (f"WITH {LINES},\n{STORE},\n{DVEC},\n{QVEC},\n{SAMPLE},\n{SAMPLE_SCORES}\n"
                              "SELECT query_id, doc_id, line_no, round(similarity, 6) AS similarity FROM cand")

ORACLE["rank_content"] = (f"WITH {LINES},\n{STORE},\n{DVEC},\n{QVEC},\n{SCORES},\n{RANKED}\n"
                          "SELECT query_id, rank, doc_id, line_no, round(similarity, 6) AS similarity FROM ranked")

ORACLE["extract_relevant_info"] = (
    f"WITH {LINES},\n{STORE},\n{DVEC},\n{QVEC},\n{SCORES},\n{RANKED}\n"
    "SELECT r.query_id, r.rank, s.content FROM ranked r JOIN store s USING (doc_id, line_no)")

ORACLE["generate_response"] = (
    f"WITH {LINES},\n{STORE},\n{DVEC},\n{QVEC},\n{SAMPLE},\n{SAMPLE_SCORES},\n"
    """sranked AS (
  SELECT query_id, CAST(rnk AS BIGINT) AS rank, doc_id, line_no FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
           ORDER BY similarity DESC, doc_id, line_no) AS rnk FROM cand) WHERE rnk <= 5
),\n""" + answer_sql("sranked"))

ORACLE["answer_queries"] = (f"WITH {LINES},\n{STORE},\n{DVEC},\n{QVEC},\n{SCORES},\n{RANKED},\n"
                            + answer_sql("ranked"))


# --------------------------------------------------------------------------
# Sources
# --------------------------------------------------------------------------

from lexis.functions import text as T  # noqa: E402
from lexis.plans import registry as REG  # noqa: E402
from lexis.sources import files as SF  # noqa: E402

ORACLE["line_documents"] = f"WITH {LINES}\nSELECT doc_id, line_no, line FROM lines"

ORACLE["total_documents"] = f"""SELECT CAST(sum(len({S.split_lines('text', T.UNIVERSAL_NEWLINE)})) AS BIGINT)
  AS total_documents, CAST(count(*) AS BIGINT) AS files FROM documents"""


def _ext_case(col: str) -> str:
    whens = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in SF.EXT_BY_LANG.items())
    return f"(CASE {col} {whens} ELSE '.bin' END)"


ORACLE["whole_file_text"] = """SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text,
  CAST(length(text) AS BIGINT) AS n_chars FROM documents"""

ORACLE["assemble_pages"] = """SELECT conv_id AS doc, string_agg(text || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""

ORACLE["route_files"] = f"""WITH f AS (
  SELECT source || '/' || CAST(doc_id AS VARCHAR) || {_ext_case('lang')} AS path FROM documents
), n AS (
  SELECT path, string_split(path, '/')[-1] AS name FROM f
), k AS (
  SELECT path, name, CASE WHEN suffix(name, '.pdf') THEN 'pdf'
                          WHEN suffix(name, '.txt') THEN 'txt' END AS kind FROM n
)
SELECT path, name, kind,
  CASE WHEN kind = 'pdf' THEN {S.q(SF.PROCESSED_PREFIX)} || regexp_replace(name, '\\.[^.]*$', '') || '.txt'
       ELSE {S.q(SF.PROCESSED_PREFIX)} || name END AS output_filename
FROM k WHERE kind IS NOT NULL"""

# --------------------------------------------------------------------------
# Cleaning
# --------------------------------------------------------------------------


def _lit(s: str) -> str:
    """SQL expression for a Python string that may hold control characters."""
    parts = []
    buf = ""
    for ch in s:
        if ord(ch) < 0x20 or 0x7f <= ord(ch) < 0xa0:
            if buf:
                parts.append(S.q(buf))
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf:
        parts.append(S.q(buf))
    return "(" + " || ".join(parts or ["''"]) + ")"


DIRTY = f"""dirty AS (
  SELECT doc_id, lang, {_lit(REG.INJECT_HEAD)} || replace(text, chr(10), {_lit(REG.INJECT_TAIL + chr(10))})
         || {_lit(chr(10) + REG.INJECT_LINE)} AS text
  FROM documents
)"""

DIRTY_LINES = f"""dlines AS (
  SELECT doc_id, CAST(unnest(range(len(parts))) AS BIGINT) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, {S.split_lines('text')} AS parts FROM dirty)
)"""

ORACLE["utf8_report"] = f"""WITH {DIRTY}
SELECT doc_id, lang <> 'de' AS valid,
       CASE WHEN lang = 'de' THEN text || chr(65533) ELSE text END AS text FROM dirty"""

ORACLE["clean_lines"] = f"""WITH {DIRTY}, {DIRTY_LINES}
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, line_no, {S.clean_line('line')} AS line FROM dlines) WHERE line <> ''"""

ORACLE["cleaning_outcome"] = f"""WITH {DIRTY},
rawl AS (
  SELECT doc_id, lang, unnest({S.split_lines("CASE WHEN lang = 'de' THEN text || chr(65533) ELSE text END",
                                            T.UNIVERSAL_NEWLINE)}) AS line FROM dirty
)
SELECT true AS success, CAST(count(*) AS BIGINT) AS total_lines,
  CAST(count(*) FILTER (WHERE lang = 'de' AND contains(line, chr(65533))) AS BIGINT) AS problematic_lines,
  CAST(count(*) FILTER (WHERE {S.clean_line('line')} <> '') AS BIGINT) AS cleaned_lines,
  CASE WHEN count(*) FILTER (WHERE lang = 'de' AND contains(line, chr(65533))) = 0 THEN 'documents.txt'
       ELSE 'documents.txt.clean' END AS output_file, CAST(NULL AS VARCHAR) AS error
FROM rawl"""

ORACLE["verify_outcome"] = f"""WITH {DIRTY},
rawl AS (
  SELECT doc_id, lang, unnest({S.split_lines("CASE WHEN lang = 'de' THEN text || chr(65533) ELSE text END",
                                            T.UNIVERSAL_NEWLINE)}) AS line FROM dirty
)
SELECT true AS success, CAST(count(*) AS BIGINT) AS total_lines,
  CAST(count(*) FILTER (WHERE lang = 'de' AND contains(line, chr(65533))) AS BIGINT) AS problematic_lines,
  CAST(0 AS BIGINT) AS cleaned_lines, 'documents.txt.clean' AS output_file, CAST(NULL AS VARCHAR) AS error
FROM rawl"""

CONV_PAGES = """cpages AS (
  SELECT conv_id AS doc, string_agg(text || chr(10) || CAST(turn AS VARCHAR) || chr(10), '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id
)"""

ORACLE["strip_page_numbers"] = f"""WITH {CONV_PAGES}
SELECT doc, {S.strip_page_numbers('text')} AS text FROM cpages"""

M = T.CHAPTER_MARKER
ORACLE["strip_headers"] = f"""WITH h AS (
  SELECT doc_id, {S.q(M + ' ')} || CAST(doc_id AS VARCHAR) || chr(10)
         || replace(text, chr(10), chr(10) || {S.q('x ' + M + ' y')} || chr(10))
         || chr(10) || {S.q(M + ' fim')} AS text FROM documents
)
SELECT doc_id, {S.strip_headers('text')} AS text FROM h"""

ORACLE["strip_urls"] = f"""WITH u AS (
  SELECT 'doc' AS src, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 'page' AS src, page_id AS id, 'see ' || url || ' and ' || url || chr(9) || 'done' AS text FROM pages
)
SELECT src, id, {S.strip_urls('text')} AS text FROM u"""

ORACLE["strip_symbols"] = f"SELECT doc_id, {S.strip_symbols('text')} AS text FROM documents"
ORACLE["collapse_ws"] = f"SELECT doc_id, {S.collapse_ws('text')} AS text FROM documents"

ORACLE["clean_text"] = f"""WITH m AS (
  SELECT doc_id, {S.q(M + ' ')} || CAST(doc_id AS VARCHAR) || chr(10)
         || replace(text, chr(10), chr(10) || '7' || chr(10))
         || chr(10) || CAST(n_chars AS VARCHAR) || chr(10) || 'see http://x.example.org/d/'
         || CAST(doc_id AS VARCHAR) || '?q=1, ok' AS text FROM documents
)
SELECT doc_id, {S.clean_text('text')} AS text FROM m"""

# --------------------------------------------------------------------------
# Tokenisation and vectors
# --------------------------------------------------------------------------

ORACLE["preprocess_text"] = f"SELECT doc_id, {S.preprocess_text('text')} AS text FROM documents"

# expected values by hand: what the appended words must become
ORACLE["contractions"] = f"""SELECT doc_id, ltrim({S.preprocess_text('text')} || {S.q(' ' + REG.EXPANDED)}) AS text
FROM documents"""

ORACLE["process_batch"] = f"WITH {LINES},\n{STORE}\nSELECT doc_id, line_no, content FROM store"

ORACLE["term_tokens"] = f"""SELECT doc_id, CAST(unnest(range(len(toks))) AS BIGINT) AS pos, unnest(toks) AS term
FROM (SELECT doc_id, {S.term_tokens('text')} AS toks FROM documents)"""

ORACLE["term_frequency"] = f"""SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf
FROM (SELECT doc_id, unnest({S.term_tokens('text')}) AS term FROM documents) GROUP BY ALL"""

HASHED = f"""h AS (
  SELECT doc_id, {S.feature_bucket('term')} AS feature, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT doc_id, unnest({S.term_tokens('text')}) AS term FROM documents) GROUP BY ALL
)"""

ORACLE["hashed_tf"] = f"WITH {HASHED}\nSELECT doc_id, feature, tf FROM h"

ORACLE["tf_l2"] = f"""WITH {HASHED},
n AS (SELECT *, sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS norm FROM h)
SELECT doc_id, feature, round(CASE WHEN norm > 0 THEN tf / norm ELSE 0.0 END, 6) AS weight FROM n"""

ORACLE["cosine_terms"] = f"""WITH {LINES},\n{STORE},\n{DVEC},
pairs AS (
  SELECT * FROM (SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line
                 FROM store) WHERE next_line IS NOT NULL
),
shared AS (
  SELECT p.doc_id, p.line_no, p.next_line, sum(a.tf * b.tf) AS dot
  FROM pairs p JOIN dvec a ON a.doc_id = p.doc_id AND a.line_no = p.line_no
  JOIN dvec b ON b.doc_id = p.doc_id AND b.line_no = p.next_line AND b.feature = a.feature
  GROUP BY ALL
),
norms AS (SELECT doc_id, line_no, max(norm) AS n FROM dvec GROUP BY ALL)
SELECT p.doc_id, p.line_no, p.next_line,
  {S.cosine('coalesce(s.dot, 0.0)', 'coalesce(na.n, 0.0)', 'coalesce(nb.n, 0.0)')} AS similarity
FROM pairs p
LEFT JOIN shared s ON s.doc_id = p.doc_id AND s.line_no = p.line_no AND s.next_line = p.next_line
LEFT JOIN norms na ON na.doc_id = p.doc_id AND na.line_no = p.line_no
LEFT JOIN norms nb ON nb.doc_id = p.doc_id AND nb.line_no = p.next_line"""

def dense_cos(a: str, b: str) -> str:
    na = f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"
    nb = f"sqrt(list_sum(list_transform({b}, lambda x: x * x)))"
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
    return f"(CASE WHEN {na} * {nb} > 0 THEN {dot} / ({na} * {nb}) ELSE 0.0 END)"


DENSE_COS = f"round({dense_cos('a', 'b')}, 6)"

ORACLE["cosine_dense"] = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT x.vec_id, y.vec_id AS next_id, x.v AS a, y.v AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, next_id, {DENSE_COS} AS similarity FROM p"""


# --------------------------------------------------------------------------
# Web pages
# --------------------------------------------------------------------------

from lexis.functions import html as H  # noqa: E402

ORACLE["page_text"] = f"SELECT page_id, url, {S.body_text('html')} AS text FROM pages WHERE {S.has_body('html')}"

ORACLE["pages_without_body"] = f"""WITH p AS (
  SELECT page_id, url, CASE WHEN starts_with(url, 'http://')
    THEN regexp_replace(html, '(?i)</?body[^>]*>', '', 'g') ELSE html END AS html FROM pages
)
SELECT page_id, url FROM p WHERE NOT {S.has_body('html')}"""

ORACLE["page_title"] = f"SELECT page_id, {S.page_title('html')} AS title FROM pages"
ORACLE["page_filename"] = f"SELECT page_id, {S.page_filename('html')} AS file_name FROM pages"


def _links_sql(base_expr: str) -> str:
    return f"""links AS (
  SELECT page_id, url, CAST(unnest(range(len(h))) AS BIGINT) AS pos, unnest(h) AS href,
         {base_expr} AS base
  FROM (SELECT page_id, url, {S.anchor_hrefs('html')} AS h FROM pages WHERE {S.has_body('html')})
),
rlinks AS (SELECT page_id, url, pos, href, {S.resolve_url('base', 'href')} AS link FROM links)"""


ORACLE["page_links"] = f"WITH {_links_sql(S.q(H.BASE_URL))}\nSELECT page_id, pos, href, link FROM rlinks"
ORACLE["page_links_by_page"] = f"WITH {_links_sql('url')}\nSELECT page_id, pos, href, link FROM rlinks"

INTERNAL = f"""{_links_sql('url')},
internal AS (SELECT * FROM rlinks WHERE starts_with(link, {S.site_root('url')}))"""

ORACLE["internal_links"] = f"WITH {INTERNAL}\nSELECT page_id, pos, href, link FROM internal"

ORACLE["visitable_urls"] = f"SELECT DISTINCT url FROM pages WHERE NOT {S.has_fragment('url')}"

ORACLE["crawl_frontier"] = f"""WITH {INTERNAL}
SELECT DISTINCT link AS url FROM internal
WHERE NOT {S.has_fragment('link')} AND link NOT IN (SELECT url FROM pages)"""

ORACLE["crawl_reachable"] = f"""WITH RECURSIVE {INTERNAL},
vis AS (SELECT page_id, url, page_id // {REG.GROUP} AS g FROM pages WHERE NOT {S.has_fragment('url')}),
ring AS (SELECT url AS src, coalesce(lead(url) OVER w, first_value(url) OVER w) AS dst FROM vis
         WINDOW w AS (PARTITION BY g ORDER BY page_id)),
edges AS (SELECT url AS src, link AS dst FROM internal WHERE NOT {S.has_fragment('link')}
          UNION SELECT src, dst FROM ring),
reach(url) AS (
  SELECT arg_min(url, page_id) FROM vis GROUP BY g
  UNION
  SELECT e.dst FROM reach r JOIN edges e ON e.src = r.url
)
SELECT url FROM reach"""

PAGE_DOCS = f"""pd AS (
  SELECT page_id, url, {S.page_filename('html')} AS file_name, {S.page_title('html')} AS title,
         {S.q('URL: ')} || url || chr(10) || chr(10) || {S.body_text('html')} AS content
  FROM (SELECT * FROM pages WHERE NOT {S.has_fragment('url')}
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1) WHERE {S.has_body('html')}
)"""

# expected values by hand: what the injected markup must show, before the page's own text
ORACLE["page_markup"] = f"""SELECT page_id, {S.page_title('html')} AS title,
  {S.q(REG.MARKUP_TEXT)} || CASE WHEN t <> '' THEN chr(10) || t ELSE '' END AS text, {S.q(REG.MARKUP_LINK)} AS first_link
FROM (SELECT *, {S.body_text('html')} AS t FROM pages WHERE {S.has_body('html')})"""

ORACLE["page_documents"] = f"""WITH {PAGE_DOCS}
SELECT file_name, arg_max(url, page_id) AS url, arg_max(content, page_id) AS content
FROM pd WHERE title IS NOT NULL GROUP BY file_name"""

ORACLE["crawl_report"] = f"""WITH {PAGE_DOCS}
SELECT file_name, CAST(count(*) AS BIGINT) AS pages_written FROM pd WHERE title IS NOT NULL GROUP BY file_name"""


# --------------------------------------------------------------------------
# Clustering
# --------------------------------------------------------------------------

from lexis.operators import cluster as KM  # noqa: E402

SQDIST = "list_sum(list_transform(list_zip({x}, {c}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

EMB_INIT = f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
init AS (
  SELECT CAST(row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS INTEGER) AS cluster_id,
         v AS center
  FROM (SELECT * FROM e ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT {KM.N_CLUSTERS})
),
asg AS (
  SELECT vec_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM (
    SELECT e.vec_id, i.cluster_id, {SQDIST.format(x='e.v', c='i.center')} AS d FROM e, init i)
  GROUP BY vec_id
)"""

ORACLE["kmeans_init"] = f"""WITH {EMB_INIT}
SELECT cluster_id, dim, round(value, 6) AS value FROM (
  SELECT cluster_id, CAST(unnest(range(len(center))) AS BIGINT) AS dim, unnest(center) AS value FROM init)"""

ORACLE["cluster_assign"] = f"WITH {EMB_INIT}\nSELECT vec_id, cluster_id FROM asg"

ORACLE["kmeans_update"] = f"""WITH {EMB_INIT},
pts AS (
  SELECT a.cluster_id, CAST(unnest(range(len(e.v))) AS BIGINT) AS dim, unnest(e.v) AS x
  FROM e JOIN asg a USING (vec_id)
),
sums AS (SELECT cluster_id, dim, sum(x) AS s, count(*) AS m FROM pts GROUP BY ALL),
cents AS (
  SELECT cluster_id, CAST(unnest(range(len(center))) AS BIGINT) AS dim, unnest(center) AS c FROM init
)
SELECT c.cluster_id, CAST(coalesce(s.m, 0) AS BIGINT) AS weight, c.dim,
  round(CASE WHEN s.m IS NULL THEN c.c ELSE s.s / s.m END, 6) AS value
FROM cents c LEFT JOIN sums s USING (cluster_id, dim)"""

ORACLE["rank_in_cluster"] = f"""WITH {EMB_INIT},
lm AS (
  SELECT label, dim, avg(x) AS value FROM (
    SELECT label, CAST(unnest(range(len(v))) AS BIGINT) AS dim, unnest(v) AS x FROM e) GROUP BY ALL
),
qs AS (SELECT CAST(label AS BIGINT) AS query_id, list(value ORDER BY dim) AS q FROM lm GROUP BY label),
qc AS (
  SELECT query_id, q, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM (
    SELECT qs.query_id, qs.q, i.cluster_id, {SQDIST.format(x='qs.q', c='i.center')} AS d FROM qs, init i)
  GROUP BY query_id, q
),
sc AS (
  SELECT qc.query_id, e.vec_id, {dense_cos('qc.q', 'e.v')} AS similarity
  FROM qc JOIN asg USING (cluster_id) JOIN e USING (vec_id)
)
SELECT query_id, CAST(rnk AS BIGINT) AS rank, vec_id, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rnk FROM sc)
WHERE rnk <= 5"""


TEXT_MODEL = f"""{HASHED},
w AS (SELECT doc_id, feature, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS weight FROM h),
first AS (
  SELECT doc_id, CAST(row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS INTEGER) AS cluster_id
  FROM (SELECT DISTINCT doc_id FROM w) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {KM.N_CLUSTERS}
),
cents AS (SELECT cluster_id, feature, weight AS value FROM w JOIN first USING (doc_id))"""

TEXT_ASSIGN = """wf AS (SELECT doc_id, feature, CAST(round(weight * 1073741824) AS BIGINT) AS x FROM w),
cf AS (SELECT cluster_id, feature, CAST(round(value * 1073741824) AS BIGINT) AS c FROM cents),
cn AS (SELECT cluster_id, sum(c::HUGEINT * c) AS c2 FROM cf GROUP BY cluster_id),
dots AS (SELECT doc_id, cluster_id, sum(x::HUGEINT * c) AS dot FROM wf JOIN cf USING (feature) GROUP BY ALL),
dist AS (
  SELECT doc_id, cluster_id, c2 - 2 * dot AS d FROM dots JOIN cn USING (cluster_id)
  UNION ALL
  SELECT doc_id, cluster_id, c2 FROM documents, (SELECT cluster_id, c2 FROM cn ORDER BY c2, cluster_id LIMIT 1)
),
asg AS (SELECT doc_id, cluster_id FROM dist QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, cluster_id) = 1)"""

ORACLE["text_kmeans_init"] = f"WITH {TEXT_MODEL}\nSELECT cluster_id, feature, round(value, 6) AS value FROM cents"
ORACLE["text_cluster_assign"] = f"WITH {TEXT_MODEL},\n{TEXT_ASSIGN}\nSELECT doc_id, cluster_id FROM asg"
ORACLE["text_kmeans_update"] = f"""WITH {TEXT_MODEL},\n{TEXT_ASSIGN},
m AS (SELECT cluster_id, count(*) AS m FROM asg GROUP BY cluster_id),
made AS (
  SELECT cluster_id, m AS weight, feature, sum(weight) / m AS value FROM w JOIN asg USING (doc_id) JOIN m USING (cluster_id)
  GROUP BY cluster_id, m, feature
  UNION ALL
  SELECT cluster_id, 0, feature, value FROM cents WHERE cluster_id NOT IN (SELECT cluster_id FROM m)
)
SELECT cluster_id, CAST(weight AS BIGINT) AS weight, feature, round(value, 6) AS value FROM made"""



def _seeds_sql(k: int, rounds: int) -> str:
    key = "md5(CAST(doc_id AS VARCHAR)), doc_id"
    parts = ["x AS MATERIALIZED (SELECT doc_id, feature, CAST(round(weight * 1073741824) AS BIGINT) AS x FROM w)",
             "xs AS MATERIALIZED (SELECT doc_id, sum(x::HUGEINT * x) AS xx FROM x GROUP BY doc_id)",
             f"k0 AS MATERIALIZED (SELECT doc_id, 0 AS cid FROM xs ORDER BY {key} LIMIT 1)"]
    for n in range(rounds + 1):
        parts.append(f"""s{n} AS MATERIALIZED (
  SELECT a.doc_id, any_value(a.xx) AS xx, min({{'d': c.xx - 2 * coalesce(dot, 0), 'cid': k{n}.cid}}) AS best
  FROM xs a CROSS JOIN k{n} JOIN xs c ON c.doc_id = k{n}.doc_id
  LEFT JOIN (SELECT p.doc_id AS i, q.doc_id AS j, sum(p.x::HUGEINT * q.x) AS dot FROM x p JOIN x q USING (feature)
             WHERE q.doc_id IN (SELECT doc_id FROM k{n}) GROUP BY ALL) ON i = a.doc_id AND j = k{n}.doc_id
  GROUP BY a.doc_id)""")
        if n < rounds:
            away = "(greatest(xx + best.d, 0) >> 30)"
            parts.append(f"""k{n + 1} AS MATERIALIZED (
  SELECT doc_id, cid FROM k{n} UNION ALL
  SELECT doc_id, (SELECT count(*) FROM k{n}) + row_number() OVER (ORDER BY {key}) - 1 FROM s{n}
  WHERE CAST('0x' || substr(md5('{n + 1}:' || doc_id), 1, 8) AS HUGEINT) * (SELECT sum{away} FROM s{n}) < {away}::HUGEINT * {2 * k * (1 << 32)})""")
    return ",\n".join(parts) + f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY weight DESC, cid) - 1 AS INTEGER) AS cluster_id, weight
FROM (SELECT best.cid AS cid, count(*) AS weight FROM s{rounds} GROUP BY best.cid) JOIN k{rounds} USING (cid)
QUALIFY row_number() OVER (ORDER BY weight DESC, cid) <= {k}"""


ORACLE["kmeans_parallel_init"] = f"WITH {TEXT_MODEL},\n{_seeds_sql(KM.N_CLUSTERS, KM.SEED_ROUNDS)}"


def _lloyd_sql(rounds: int) -> str:
    parts = ["x AS (SELECT doc_id, feature, CAST(round(weight * 1073741824) AS BIGINT) AS x FROM w)",
             "c0 AS (SELECT cluster_id, feature, CAST(round(value * 1073741824) AS BIGINT) AS c FROM cents)"]
    for n in range(rounds):
        parts += [f"""n{n} AS MATERIALIZED (SELECT cluster_id, sum(c * c) AS c2 FROM c{n} GROUP BY cluster_id)""",
                  f"""d{n} AS (
  SELECT doc_id, cluster_id, c2 - 2 * coalesce(dot, 0) AS d FROM (SELECT DISTINCT doc_id FROM x) CROSS JOIN n{n}
  LEFT JOIN (SELECT doc_id, cluster_id, sum(x * c) AS dot FROM x JOIN c{n} USING (feature) GROUP BY ALL) USING (doc_id, cluster_id))""",
                  f"a{n} AS MATERIALIZED (SELECT doc_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM d{n} GROUP BY doc_id)",
                  f"""c{n + 1} AS MATERIALIZED (
  SELECT cluster_id, feature, CAST(round(sum(x) / any_value(m)) AS BIGINT) AS c FROM x JOIN a{n} USING (doc_id)
  JOIN (SELECT cluster_id, count(*) AS m FROM a{n} GROUP BY cluster_id) USING (cluster_id) GROUP BY cluster_id, feature
  UNION ALL SELECT cluster_id, feature, c FROM c{n} WHERE cluster_id NOT IN (SELECT cluster_id FROM a{n}))"""]
    return ",\n".join(parts)


ORACLE["text_kmeans_batch"] = f"WITH {TEXT_MODEL},\n{_lloyd_sql(REG.BATCH_ROUNDS)}\nSELECT doc_id, cluster_id FROM a{REG.BATCH_ROUNDS - 1}"

# --------------------------------------------------------------------------
# Normalisation, store ids, lifecycle
# --------------------------------------------------------------------------

from lexis.operators import lifecycle as LC  # noqa: E402
from lexis.operators import normalize as NZ  # noqa: E402


def _values(rows, cols) -> str:
    vals = ", ".join("(" + ", ".join(S.q(v) for v in r) + ")" for r in rows)
    return f"(VALUES {vals}) AS t({', '.join(cols)})"


STOP = f"stop AS (SELECT * FROM {_values([(w.lower(),) for w in NZ.PORTUGUESE_STOP_WORDS], ['token'])})"
def _lex(rows) -> str:
    return (f"lex AS (SELECT lang, surface, min(lemma) AS lemma FROM {_values(rows, ['lang', 'surface', 'lemma'])} "
            "GROUP BY lang, surface)")


LEX = _lex(NZ.DEFAULT_LEXICON)


def _normalize_sql(src: str, key: str, use_stop: bool, use_lex: bool) -> str:
    toks = f"""toks AS (
  SELECT {key}, lang, pos, token FROM (
    SELECT {key}, lang, CAST(unnest(range(len(parts))) AS BIGINT) AS pos, unnest(parts) AS token
    FROM (SELECT {key}, lang, string_split_regex(text, {S.q(T.WS_RUN)}) AS parts FROM {src}))
  WHERE regexp_matches(token, {S.q(T.ALPHA_TOKEN)})
)"""
    filt = "toks2 AS (SELECT * FROM toks" + (
        " WHERE lower(token) NOT IN (SELECT token FROM stop)" if use_stop else "") + ")"
    lem = ("toks3 AS (SELECT t.*, lower(coalesce(l.lemma, lower(t.token))) AS lemma "
           "FROM toks2 t LEFT JOIN lex l ON l.surface = lower(t.token) AND l.lang = t.lang)") if use_lex else \
          "toks3 AS (SELECT *, lower(token) AS lemma FROM toks2)"
    return f"""{toks},
{filt},
{lem},
agg AS (SELECT {key}, string_agg(lemma, ' ' ORDER BY pos) AS text FROM toks3 GROUP BY {key})
SELECT d.{key}, coalesce(a.text, '') AS text FROM {src} d LEFT JOIN agg a USING ({key})"""


CLEANED = f"cleaned AS (SELECT doc_id, lang, {S.clean_text('text')} AS text FROM documents)"

ORACLE["remove_stopwords"] = f"WITH {STOP}, {LEX}, {CLEANED},\n" + _normalize_sql("cleaned", "doc_id", True, False)
ORACLE["lemmatize"] = (f"WITH {STOP}, {_lex(NZ.DEFAULT_LEXICON + REG.TWO_LEMMAS)}, {CLEANED},\n"
                       + _normalize_sql("cleaned", "doc_id", False, True))
ORACLE["lemmatize_with_table"] = ORACLE["lemmatize"]
ORACLE["normalize_text"] = f"WITH {STOP}, {LEX}, {CLEANED},\n" + _normalize_sql("cleaned", "doc_id", True, True)

ROUTED = f"""f AS (
  SELECT source || '/' || doc_id || '/' || (doc_id - doc_id % 2) || CASE WHEN lang = 'fr' THEN '.pdf' ELSE '.txt' END AS path,
         text, lang FROM documents
), routed AS (
  SELECT *, {S.q(SF.PROCESSED_PREFIX)} || regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') || '.txt' AS output_filename,
         suffix(path, '.pdf') AS paged FROM f
), last AS (
  SELECT * FROM routed QUALIFY row_number() OVER (PARTITION BY output_filename ORDER BY path DESC) = 1
), cleaned AS (
  SELECT path, output_filename, lang, {S.clean_text("CASE WHEN paged THEN array_to_string(list_transform(" + S.split_lines('text') + ", lambda p: p || chr(10)), '') ELSE text END")} AS text
  FROM last)"""

ORACLE["preprocess_files"] = (f"WITH {STOP}, {LEX}, {ROUTED},\nnormal AS ("
                              + "SELECT * FROM (" + "WITH " + _normalize_sql("cleaned", "path", True, True) + "))\n"
                              + "SELECT c.output_filename, c.path, n.text FROM cleaned c JOIN normal n USING (path)")

ORACLE["document_store"] = f"""WITH {LINES},\n{STORE}
SELECT CAST(row_number() OVER (ORDER BY doc_id, line_no) AS BIGINT) AS id, doc_id, line_no, content FROM store"""

ORACLE["model_summary"] = f"""WITH {LINES},\n{STORE}
SELECT count(*) > 0 AS trained, CAST(count(*) AS BIGINT) AS documents_processed,
  {S.q(LC.SUMMARY_PREFIX)} || CASE WHEN count(*) > 0 THEN {S.q(LC.TRAINED)} ELSE {S.q(LC.NOT_TRAINED)} END
  || {S.q(LC.SUMMARY_COUNT)} || CAST(count(*) AS VARCHAR) AS summary FROM store"""


# --------------------------------------------------------------------------
# Streaming jobs (exact on their outcome counts / answers)
# --------------------------------------------------------------------------

ORACLE["train_corpus"] = f"WITH {LINES},\n{STORE}\nSELECT content, count(*) AS copies FROM store GROUP BY content"

ORACLE["train_sliced"] = ORACLE["train_corpus"]

# increments are cleaned, the first training is not
ORACLE["increment_corpus"] = f"""WITH {LINES},
made AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN line ELSE {S.clean_line('line')} END AS line FROM lines),
store AS (SELECT {S.preprocess_text('s')} AS content FROM (SELECT {S.strip('line')} AS s FROM made) WHERE s <> '')
SELECT content, count(*) AS copies FROM store GROUP BY content"""

ORACLE["train_then_answer"] = ORACLE["answer_queries"]
ORACLE["answer_by_clusters"] = ORACLE["answer_queries"]

_QS_CONV = "qs AS (SELECT conv_id * 1000000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user')"
ORACLE["answer_stream"] = (f"WITH {LINES},\n{STORE},\n{DVEC},\n"
                           + QVEC.replace("qs AS (SELECT item_id AS query_id, text AS query FROM benchmark)", _QS_CONV)
                           + f",\n{SCORES},\n{RANKED},\n" + answer_sql("ranked"))
