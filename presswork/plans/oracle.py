"""SQL counterparts of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions import text as t
from ..operators import frames as f
from .queries import FROM, LIMIT, QUERY, TO

BLANK = r"[\t\n\x0B\f\r \x{00A0}]+"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANK}', ' ', 'g'))"


def body(c: str) -> str:
    lines = f"string_split(regexp_replace(coalesce({c}, ''), '\\r\\n|\\r', chr(10), 'g'), chr(10))"
    return f"array_to_string(list_filter(list_transform({lines}, lambda x: {squeeze('x')}), lambda x: x <> ''), chr(10) || chr(10))"


def words(c: str) -> str:
    return f"len(list_filter(string_split({squeeze(f'coalesce({c}, chr(32))')}, ' '), lambda x: x <> ''))"


def url(c: str) -> str:
    told = f"trim(coalesce({c}, ''))"
    full = f"CASE WHEN regexp_matches({told}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {told} ELSE 'https://' || {told} END"
    plain = f"regexp_replace({full}, '#.*$', '')"
    head, query = f"regexp_extract({plain}, '^([^?]*)', 1)", f"regexp_extract({plain}, '\\?(.*)$', 1)"
    path = f"regexp_replace(regexp_extract({head}, '^[^:]+://[^/]*(/.*)$', 1), '/$', '')"
    params = f"array_to_string(list_filter(string_split({query}, '&'), lambda p: regexp_matches(p, '^[^=]+=.') AND NOT starts_with(lower(p), 'utm_')), '&')"
    return f"lower(regexp_extract({head}, '^([^:]+://[^/]*)', 1)) || (CASE WHEN {path} = '' THEN '/' ELSE {path} END) || (CASE WHEN {params} <> '' THEN '?' || {params} ELSE '' END)"


def compact(c: str) -> str:
    return f"CASE WHEN instr({c}, '-') > 0 THEN regexp_replace(substr({c}, 1, 16), '[-:]', '', 'g') ELSE {c} END"


def period(c: str) -> str:
    return f"substr(regexp_replace({c}, '[-:T ]', '', 'g'), 1, 6)"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '{t.TOKEN}')"


def stem(c: str) -> str:
    return f"regexp_replace({c}, '^(.{{4,}}?)(?:{'|'.join(t.ENDINGS)})$', '\\1')"


def _any(c: str, words_: tuple[str, ...]) -> str:
    return f"len(list_filter({_list(words_)}, lambda w: contains({c}, w))) > 0"


NORMAL = f"""a0 AS (SELECT id, source_id, is_canonical, duplicate_group_id, {url('url')} AS url, {squeeze("coalesce(title, '')")} AS title, nullif({squeeze('subtitle')}, '') AS subtitle,
  {body('body_text')} AS body_text, trim(coalesce(published_at, '')) AS published_at, nullif({squeeze('author')}, '') AS author, nullif({squeeze('category')}, '') AS category FROM articles),
n AS (SELECT *, {words('body_text')} AS word_count, sha256(body_text) AS content_hash FROM a0)"""
INCOMING = NORMAL.replace("a0", "i0").replace("n AS", "ni AS").replace("FROM articles", "FROM incoming_articles").replace("is_canonical, duplicate_group_id,", "")
VERDICT = """CASE WHEN trim(title) = '' THEN 'empty_title' WHEN trim(body_text) = '' THEN 'empty_body' WHEN trim(published_at) = '' THEN 'empty_published_at'
  WHEN length(trim(body_text)) < 120 THEN 'short_body' ELSE 'ok' END"""

ROWS = """r AS (SELECT c.chunk_id, c.article_id, c.chunk_index, c.chunk_text, a.title AS article_title, a.published_at, a.is_canonical, s.domain AS source_domain
  FROM (SELECT DISTINCT id AS chunk_id, article_id, chunk_index, chunk_text FROM article_chunks) c JOIN articles a ON a.id = c.article_id JOIN sources s ON s.id = a.source_id)"""
SCOPE = f"is_canonical AND ({compact('published_at')}) BETWEEN '{t.bound(FROM)}' AND '{t.bound(TO)}'"
_P = QUERY.prefixes
_N = range(len(_P))
BM25 = f"""l0 AS (SELECT chunk_id, regexp_extract_all(lower(concat_ws(' ', article_title, chunk_text)), '[\\p{{L}}\\p{{N}}]+') AS tk FROM r),
l AS (SELECT chunk_id, len(tk) AS dl, {', '.join(f"len(list_filter(tk, lambda x: starts_with(x, '{p}'))) AS f{i}" for i, p in enumerate(_P))} FROM l0),
st AS (SELECT count(*) AS nd, avg(dl) AS al, {', '.join(f'count(*) FILTER (WHERE f{i} > 0) AS n{i}' for i in _N)} FROM l),
b AS (SELECT chunk_id, round(-({' + '.join(f"(CASE WHEN f{i} > 0 THEN (CASE WHEN ln((nd - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((nd - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / al)) ELSE 0 END)" for i in _N)}), 6) AS bm25
  FROM l, st WHERE {' + '.join(f'f{i}' for i in _N)} > 0)"""


def lex(limit: int) -> str:
    order = f"bm25, ({compact('published_at')}) DESC, article_id, chunk_index, chunk_id"
    return f"lx AS (SELECT *, row_number() OVER (ORDER BY {order}) AS lexical_rank FROM r JOIN b USING (chunk_id) WHERE {SCOPE} ORDER BY {order} LIMIT {limit})"


def quality(c: str) -> str:
    n = f"len({tokens(c)})"
    noise = t.NOISE.replace("'", "''")
    return f"CASE WHEN trim(coalesce({c}, '')) = '' THEN -0.80 WHEN regexp_matches(lower({c}), '{noise}') THEN -0.65 WHEN {n} < 8 THEN -0.28 WHEN {n} < 18 THEN -0.08 WHEN {n} > 260 THEN -0.05 ELSE 0.06 END::DOUBLE"


_HITS = " + ".join(f"(list_contains(hay, '{a}') OR list_contains(hay, '{b}'))::INT" for a, b in QUERY.terms)
_AM = f"len(list_intersect(list_distinct(hay), {_list(QUERY.anchors)}))"
WITH_QUERY = f"""h0 AS (SELECT *, {tokens("concat_ws(' ', article_title, chunk_text)")} AS raw FROM r), h1 AS (SELECT *, list_concat(raw, list_transform(raw, lambda x: {stem('x')})) AS hay FROM h0),
q AS (SELECT chunk_id, article_id, chunk_index, chunk_text, article_title, published_at, is_canonical, source_domain, ({_HITS})::DOUBLE / {len(QUERY.terms)} AS overlap, {_AM}::DOUBLE / {len(QUERY.anchors)} AS anchor, {_AM} AS anchor_matches,
  {quality('chunk_text')} AS quality FROM h1)"""
_EMB = "list_transform(range(16), lambda i: len(list_filter(sg, lambda s: s = substr('0123456789abcdef', (i + 1)::INT, 1)))::DOUBLE)"
_ASKED = f"(SELECT {_EMB} FROM (SELECT list_transform({tokens(chr(39) + ' '.join(a for a, _ in QUERY.terms) + chr(39))}, lambda x: substr(md5(x), 1, 1)) AS sg))"


def vec(limit: int) -> str:
    order = "vector_score DESC, vector_final DESC, published_at DESC, chunk_id"
    return f"""e0 AS (SELECT *, list_transform({tokens("concat_ws(' ', article_title, chunk_text)")}, lambda x: substr(md5(x), 1, 1)) AS sg FROM q WHERE {SCOPE}),
e1 AS (SELECT * EXCLUDE (sg), {_EMB} AS e FROM e0), e2 AS (SELECT e1.* EXCLUDE (e), CASE WHEN list_sum(e) = 0 THEN 0 ELSE round(list_cosine_similarity(e, {_ASKED}), 6) END AS vector_score FROM e1),
e3 AS (SELECT *, round(0.54 * vector_score + 0.16 * overlap + 0.16 * anchor + quality, 6) AS vector_final FROM e2 WHERE vector_score > 0),
vx AS (SELECT *, row_number() OVER (ORDER BY {order}) AS vector_rank FROM e3 ORDER BY {order} LIMIT {limit})"""


_ORDER = "final_score DESC, rerank_score DESC, lexical_score DESC, vector_score DESC, published_at DESC, chunk_id"
HYBRID = f"""{ROWS}, {BM25}, {lex(max(3 * LIMIT, 24))}, {WITH_QUERY}, {vec(max(3 * LIMIT, 24))},
hy AS (SELECT q.chunk_id, q.article_id, q.chunk_index, q.chunk_text, q.article_title, q.published_at, q.source_domain, q.overlap, q.anchor, q.anchor_matches, q.quality,
  lx.lexical_rank AS lr, vx.vector_rank AS vr, coalesce(vx.vector_score, 0) AS vector_score, CASE WHEN lx.lexical_rank IS NULL THEN 0.0 ELSE round(1 / lx.lexical_rank, 6) END AS lexical_score, 0.0 AS rerank_score
  FROM q LEFT JOIN lx ON lx.chunk_id = q.chunk_id LEFT JOIN vx ON vx.chunk_id = q.chunk_id WHERE lx.chunk_id IS NOT NULL OR vx.chunk_id IS NOT NULL),
hs AS (SELECT * EXCLUDE (lr, vr), round(CASE WHEN vr IS NULL THEN 0.48 / lr + 0.22 * overlap + 0.20 * anchor + quality WHEN lr IS NULL THEN 0.45 * vector_score + 0.12 / vr + 0.18 * overlap + 0.18 * anchor + quality
  ELSE 0.48 / lr + 0.22 * overlap + 0.20 * anchor + quality + 0.22 * vector_score + 0.05 / vr + 0.06 * anchor + 0.03 * overlap END, 6) AS final_score FROM hy),
hyb AS (SELECT * FROM hs ORDER BY {_ORDER} LIMIT {max(3 * LIMIT, 24)})"""


def searched(rerank: str) -> str:
    return f"""{HYBRID}, few AS (SELECT * FROM hyb ORDER BY {_ORDER} LIMIT {max(2 * LIMIT, 8)}), rr AS ({rerank}),
tk1 AS (SELECT *, CASE WHEN quality <= -0.45 THEN 'none' WHEN overlap >= 0.5 OR anchor >= 0.5 THEN 'strict'
  WHEN (anchor > 0 AND vector_score >= 0.72) OR (overlap > 0 AND vector_score >= 0.66) OR (vector_score >= 0.82 AND final_score >= 0.5) THEN 'semantic' WHEN final_score >= 0.62 THEN 'fallback' ELSE 'none' END AS kind FROM rr),
tk2 AS (SELECT *, max((kind = 'strict')::INT) OVER () AS s1, max((kind = 'semantic')::INT) OVER () AS s2, max((kind = 'fallback')::INT) OVER () AS s3, max((anchor_matches > 0 AND quality > -0.45)::INT) OVER () AS s4 FROM tk1),
tk3 AS (SELECT * FROM tk2 WHERE CASE WHEN s1 = 1 THEN kind IN ('strict', 'semantic') WHEN s2 = 1 OR s4 = 1 THEN kind = 'semantic' WHEN s3 = 1 THEN kind = 'fallback' ELSE true END),
tk4 AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY {_ORDER}) AS k FROM tk3),
found AS (SELECT * FROM tk4 WHERE k <= 2 ORDER BY {_ORDER} LIMIT {LIMIT})"""


_PLAIN = "SELECT *, 0.0 AS model_score FROM few"
_SHARE = f"(len(list_intersect({_list(dict.fromkeys(__import__('re').findall(t.TOKEN, QUERY.text.lower())))}, list_distinct({tokens('concat_ws(chr(10), article_title, chunk_text)')})))::DOUBLE / {len(dict.fromkeys(__import__('re').findall(t.TOKEN, QUERY.text.lower())))})"
_MODEL = f"SELECT * EXCLUDE (final_score), round(1 / (1 + exp(-(4 * {_SHARE} - 2))), 6) AS model_score, round(final_score + 0.42 * round(1 / (1 + exp(-(4 * {_SHARE} - 2))), 6), 6) AS final_score FROM few"


def _line(k: str) -> str:
    return f"nullif(trim(regexp_extract(t, '(?m)^{k}: (.*)$', 1)), '')"


FRAMES = f"""f0 AS (SELECT frame_id, coalesce(max(representation_text), '') AS t FROM frame_embeddings GROUP BY frame_id),
f1 AS (SELECT frame_id, nullif(regexp_extract(frame_id, '^frame-([0-9]+)-', 1), '')::BIGINT AS article_id, coalesce({_line('main_claim')}, '') AS main_claim, {', '.join(f'{_line(s)} AS {s}' for s in f.SLOTS)}, {_line('valence')} AS valence,
  list_filter(string_split(coalesce({_line('actors')}, ''), ', '), lambda x: x <> '') AS actors, list_filter(string_split(coalesce({_line('implications')}, ''), ', '), lambda x: x <> '') AS implications,
  CASE WHEN t = '' THEN '{f.UNCLEAR}' ELSE 'ok' END AS status FROM f0),
fr AS (SELECT f1.*, nullif({squeeze('a.category')}, '') AS topic_id, (a.word_count % 100 / 100.0)::DOUBLE AS confidence FROM f1 LEFT JOIN articles a ON a.id = f1.article_id),
mem AS (SELECT *, 'cluster-' || topic_id AS cluster_id FROM fr WHERE topic_id IS NOT NULL)"""


def _filled(n: int) -> str:
    return "(" + " + ".join(f"coalesce((length(trim({s})) >= {n})::INT, 0)" for s in f.SLOTS) + ")"


STATEMENT, OPERATIONAL = _any("lower(main_claim)", f.STATEMENT_WORDS), _any("lower(main_claim)", f.OPERATIONAL_WORDS)
_SOME = " OR ".join(f"coalesce({s}, '') <> ''" for s in f.SLOTS)
_FUTURE, _IMPL = "coalesce(future_expectation, '') <> ''", "len(implications) > 0"
INFORMATIVE = f"""CASE WHEN status = '{f.UNCLEAR}' THEN true WHEN length(trim(main_claim)) < 40 THEN false WHEN {_any('lower(main_claim)', f.EVENT_WORDS)} AND {_filled(16)} < 3 THEN false
  WHEN {_any('lower(main_claim)', f.REPORT_WORDS)} AND NOT ({_SOME}) THEN false WHEN {STATEMENT} AND NOT ({_FUTURE} AND {_IMPL}) THEN false
  WHEN {OPERATIONAL} AND NOT ({_filled(12)} >= 3 AND {_IMPL} AND {_FUTURE}) THEN false ELSE {_filled(12)} + (len(actors) > 0)::INT + ({_IMPL})::INT >= 2 END"""
_PH = _list(f.PLACEHOLDERS)
VECTORS = """v AS (SELECT frame_id, min(vector) AS vector FROM frame_embeddings WHERE model_name = 'narr-embed-a64' AND vector IS NOT NULL AND len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY frame_id)"""
COS = "(CASE WHEN list_sum(list_transform({a}, lambda x: x * x)) = 0 OR list_sum(list_transform({b}, lambda x: x * x)) = 0 THEN 0 ELSE round(list_cosine_similarity({a}, {b}), 6) END)"


def classified(centres: str, match: str) -> str:
    return f"""{FRAMES}, {VECTORS}, {centres}, fv AS (SELECT fr.frame_id, fr.article_id, fr.topic_id, v.vector FROM fr LEFT JOIN v USING (frame_id)),
met AS (SELECT fv.frame_id, c.cluster_id, {COS.format(a='fv.vector', b='c.centroid')} AS sim FROM fv JOIN cen c ON {match} WHERE fv.vector IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY sim DESC, cluster_id DESC) AS k FROM met),
best AS (SELECT a.frame_id, a.cluster_id, a.sim, round(a.sim - coalesce(b.sim, -1.0), 6) AS lead FROM rk a LEFT JOIN rk b ON a.frame_id = b.frame_id AND b.k = 2 WHERE a.k = 1),
cls AS (SELECT fv.frame_id, fv.article_id, vector IS NULL AS missing, cluster_id, sim, coalesce(sim >= {f.LEAST_SIMILARITY} AND lead >= {f.LEAST_MARGIN}, false) AND vector IS NOT NULL AS yes FROM fv LEFT JOIN best USING (frame_id)),
res AS (SELECT frame_id, article_id, CASE WHEN yes THEN cluster_id END AS cluster_id, greatest(coalesce(sim, 0.0), 0.0) AS similarity, yes AS assigned,
  CASE WHEN missing THEN 'missing_embedding' WHEN yes THEN 'embedding_similarity' ELSE 'unknown_or_ambiguous' END AS reason FROM cls)"""


CENTRES = "cen AS (SELECT x.cluster_id, x.topic_id, v.vector AS centroid FROM (SELECT cluster_id, topic_id, min(frame_id) AS frame_id FROM mem WHERE frame_id IN (SELECT frame_id FROM v) GROUP BY ALL) x JOIN v USING (frame_id))"
POINTS = f"""{FRAMES}, dt AS (SELECT id AS article_id, source_id, {period('published_at')} AS period FROM articles WHERE regexp_matches({period('published_at')}, '^[0-9]{{6}}$')),
mo AS (SELECT period, count(*) AS corpus FROM dt GROUP BY period),
g AS (SELECT cluster_id, period, count(DISTINCT article_id) AS article_count, count(DISTINCT s.domain) AS domains, round(avg(confidence), 6) AS mean_intensity FROM mem JOIN dt USING (article_id) LEFT JOIN sources s ON s.id = dt.source_id GROUP BY ALL),
pts AS (SELECT cluster_id, period || '01' AS period_start, period || '31' AS period_end, article_count, round(article_count / corpus, 6) AS share_of_corpus, round(domains / greatest(article_count, 1), 6) AS source_diversity, mean_intensity,
  round(article_count / corpus, 6) AS burst_score FROM g JOIN mo USING (period))"""
_DISTINCT = lambda c: f"list_filter(list_transform({c}, lambda x: trim(x)), lambda x: x IS NOT NULL AND NOT list_contains({_PH}, lower(x)))"
LABELS = f"""{FRAMES}, few AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY frame_id) AS pos FROM mem QUALIFY pos <= 5),
g AS (SELECT cluster_id, {', '.join(f'list({c} ORDER BY pos) AS {c}' for c in ('main_claim', *f.SLOTS, 'valence'))}, flatten(list(actors ORDER BY pos)) AS actors, flatten(list(implications ORDER BY pos)) AS implications FROM few GROUP BY cluster_id),
g1 AS (SELECT *, list_filter(main_claim, lambda x: trim(x) <> '') AS claims, {_DISTINCT('actors')} AS ac, {_DISTINCT('implications')} AS im FROM g),
g2 AS (SELECT *, coalesce(claims[1], 'No canonical claim') AS canon, {_DISTINCT('claims')} AS ex, {_DISTINCT('list_filter(cause, lambda x: x IS NOT NULL)')} AS k1, {_DISTINCT('list_filter(mechanism, lambda x: x IS NOT NULL)')} AS k2,
  {_DISTINCT('list_filter(consequence, lambda x: x IS NOT NULL)')} AS k3, {_DISTINCT('list_filter(valence, lambda x: x IS NOT NULL)')} AS tones FROM g1),
ex2 AS (SELECT cluster_id, list(x ORDER BY p) AS ex FROM (SELECT cluster_id, x, min(p) AS p FROM (SELECT cluster_id, unnest(ex) AS x, generate_subscripts(ex, 1) AS p FROM g2) GROUP BY ALL) GROUP BY cluster_id)"""
_ESC = lambda c: f"replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
PAGES = f"""pg AS (SELECT id AS page_id, '<html><head><script>var a = "<p>no</p>";</script></head><body><!-- top --><h1 class="topic-body__title">' || {_ESC('title')} || '</h1><a href="' || coalesce(url, '') || '">more</a><div class="topic-body__content"><p>'
  || {_ESC('body_text')} || '</p></div></div><span class="topic-authors__name">' || {_ESC('author')} || '</span></body></html>' AS html FROM articles)"""


def strip(c: str) -> str:
    c = f"regexp_replace(regexp_replace({c}, '<script\\b.*?>.*?</script>|<style\\b.*?>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs')"
    c = f"regexp_replace(regexp_replace(regexp_replace({c}, '<br\\s*/?>', chr(10), 'gi'), '</(?:p|div|section|li|h[0-9]|blockquote)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):  # & last: nothing is read twice
        told = sign.replace("'", "''")
        c = f"replace({c}, '{name}', '{told}')"
    c = f"regexp_replace(regexp_replace(regexp_replace({c}, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({c}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')"


def _meta(rule: str, sql: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) AS n FROM ({sql})"


CHUNKS = f"""{NORMAL}, pa AS (SELECT id AS article_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS p FROM (SELECT id, list_filter(string_split(body_text, chr(10) || chr(10)), lambda x: x <> '') AS ps FROM n WHERE is_canonical)),
po AS (SELECT *, (sum(length(p) + 2) OVER (PARTITION BY article_id ORDER BY k) - length(p) - 2)::INT AS place FROM pa)"""
SQL: dict[str, str] = {
    "normalize_hash": f"WITH {NORMAL} SELECT id, title, subtitle, author, category, word_count, content_hash, length(body_text) AS body_length FROM n",
    "url_normalize": f"SELECT id, {url('url')} AS normal_url FROM (SELECT id, url FROM articles UNION ALL SELECT id, url FROM incoming_articles)",
    "validate_articles": f"WITH {NORMAL} SELECT source_id, verdict, count(*) AS n FROM (SELECT source_id, {VERDICT} AS verdict FROM n) GROUP BY ALL",
    "dedup_canonical": f"WITH {NORMAL} SELECT content_hash, arg_min(id, (NOT coalesce(is_canonical, false))::BIGINT * 1000000000000 + id) AS canonical_id, count(*) AS n FROM n GROUP BY content_hash",
    "duplicate_groups": f"""WITH {NORMAL}, {INCOMING}, u AS (SELECT url, min(id) AS uid, arg_min(duplicate_group_id, id) AS ug FROM (SELECT url, id, duplicate_group_id FROM n) GROUP BY url),
        k AS (SELECT content_hash, id AS hid, duplicate_group_id AS hg FROM n QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY coalesce(is_canonical, false) DESC, id) = 1),
        ug2 AS (SELECT u.url, u.uid, n.duplicate_group_id AS ug FROM u JOIN n ON n.id = u.uid)
        SELECT ni.id, CASE WHEN uid IS NOT NULL THEN 'url' ELSE 'content_hash' END AS duplicate_type, coalesce(uid, hid) AS canonical_id,
        CASE WHEN uid IS NOT NULL THEN coalesce(ug2.ug, 'url:' || uid) ELSE coalesce(hg, 'hash:' || ni.content_hash) END AS duplicate_group_id
        FROM ni LEFT JOIN ug2 ON ug2.url = ni.url LEFT JOIN k ON k.content_hash = ni.content_hash WHERE uid IS NOT NULL OR hid IS NOT NULL""",
    "upsert_compaction": """SELECT url, id, title, source_id, version FROM (SELECT url, id, title, source_id, 0 AS version FROM articles UNION ALL SELECT url, id, title, source_id, batch_no FROM incoming_articles)
        WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY version DESC, id DESC) = 1""",
    "latest_incoming": "SELECT source_id, id, batch_no, epoch_us(received_at) AS received_us FROM incoming_articles QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY received_at DESC NULLS LAST, id DESC) = 1",
    "integrity": " UNION ALL ".join([
        _meta("articles.url unique", "SELECT url FROM articles WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1"), _meta("sources.domain unique", "SELECT domain FROM sources GROUP BY domain HAVING count(*) > 1"),
        _meta("article_chunks(article_id, chunk_index) unique", "SELECT article_id FROM article_chunks GROUP BY article_id, chunk_index HAVING count(*) > 1"),
        _meta("articles.source_id refers", "SELECT 1 FROM articles WHERE source_id NOT IN (SELECT id FROM sources)"), _meta("article_chunks.article_id refers", "SELECT 1 FROM article_chunks WHERE article_id NOT IN (SELECT id FROM articles)"),
        _meta("article_duplicates.article_id refers", "SELECT 1 FROM article_duplicates WHERE article_id NOT IN (SELECT id FROM articles)"), _meta("articles.word_count >= 0", "SELECT 1 FROM articles WHERE word_count < 0"),
        _meta("similarity_score in [0, 1]", "SELECT 1 FROM article_duplicates WHERE similarity_score < 0 OR similarity_score > 1"),
    ]),
    "date_range": f"SELECT id, source_id, {compact('published_at')} AS published_minute, 'blatt687-tal-6.example,news659-dale-4.example,vest850-grad-1.example' AS domains_key FROM articles WHERE source_id IN (SELECT id FROM sources WHERE domain IN ('news659-dale-4.example', 'vest850-grad-1.example', 'blatt687-tal-6.example')) AND is_canonical AND ({compact('published_at')}) BETWEEN '{t.bound('2024-03-01')}' AND '{t.bound('2025-09-30T12:00')}'",
    "recent_by_source": "SELECT source_id, id, published_at FROM articles WHERE published_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id DESC) <= 5",
    "active_sources": "SELECT id, name, domain FROM sources WHERE is_active",
    "load_documents": f"""WITH c AS (SELECT article_id, list(chunk_text ORDER BY chunk_index, chunk_text) AS ts FROM (SELECT DISTINCT article_id, chunk_index, chunk_text FROM article_chunks) GROUP BY article_id)
        SELECT a.id AS article_id, s.domain AS source_domain, coalesce(len(ts), 0) AS n_chunks, md5(coalesce(array_to_string(ts, '|'), '')) AS chunks_md5 FROM articles a JOIN sources s ON s.id = a.source_id LEFT JOIN c ON c.article_id = a.id WHERE {SCOPE}""",
    "missing_embeddings": """SELECT DISTINCT id AS chunk_id, article_id FROM article_chunks WHERE article_id NOT IN (SELECT nullif(regexp_extract(frame_id, '^frame-([0-9]+)-', 1), '')::BIGINT FROM frame_embeddings WHERE vector IS NOT NULL)""",
    "snapshot_counts": f"""SELECT 'a.example,b.example' AS source_domains_key, '{t.bound(FROM)}' AS date_from, '{t.bound(TO)}' AS date_to, (SELECT count(*) FROM articles) AS n_articles, (SELECT count(*) FROM article_chunks) AS n_article_chunks,
        (SELECT count(*) FROM article_duplicates) AS n_article_duplicates, (SELECT count(*) FROM frame_embeddings) AS n_frame_embeddings""",
    "page_text": f"WITH {PAGES}, s AS (SELECT page_id, {strip('html')} AS x FROM pg) SELECT page_id, length(x) AS n_chars, md5(x) AS text_md5 FROM s",
    "page_links": f"""WITH {PAGES}, s AS (SELECT page_id, regexp_extract_all(html, 'href=["'']([^"''#]+)["'']', 1, 'i') AS x FROM pg) SELECT page_id, (generate_subscripts(x, 1) - 1)::INT AS pos, unnest(x) AS href FROM s""",
    "archive_calendar": "SELECT strftime(x, '%Y-%m-%d') AS day, 'https://lenta.ru/' || strftime(x, '%Y/%m/%d') || '/' AS archive_url FROM (SELECT unnest(generate_series(DATE '2024-02-25', DATE '2024-03-03', INTERVAL 1 DAY)) AS x)",
    "chunk_corpus": f"""WITH RECURSIVE {CHUNKS}, fold AS (SELECT article_id, k, 0 AS chunk_index, p AS cur, place AS start FROM po WHERE k = 1 UNION ALL
        SELECT po.article_id, po.k, CASE WHEN c THEN fold.chunk_index + 1 ELSE fold.chunk_index END, CASE WHEN c THEN po.p ELSE fold.cur || chr(10) || chr(10) || po.p END, CASE WHEN c THEN po.place ELSE fold.start END
        FROM (SELECT f.*, length(f.cur) + length(x.p) + 2 > 700 AND length(f.cur) >= 300 AS c FROM fold f JOIN po x ON x.article_id = f.article_id AND x.k = f.k + 1) fold JOIN po ON po.article_id = fold.article_id AND po.k = fold.k + 1),
        done AS (SELECT article_id, chunk_index, arg_max(cur, k) AS cur, arg_max(start, k) AS start FROM fold GROUP BY ALL)
        SELECT article_id, chunk_index, start AS char_start, (start + length(cur))::INT AS char_end, {words('cur')} AS token_count, md5(cur) AS chunk_md5 FROM done""",
    "chunk_quality": f"SELECT id, {quality('chunk_text')} AS quality, len({tokens('chunk_text')}) AS n_tokens FROM (SELECT DISTINCT id, chunk_text FROM article_chunks)",
    "token_stats": f"WITH {ROWS}, x AS (SELECT chunk_id, unnest(regexp_extract_all(lower(concat_ws(' ', article_title, chunk_text)), '[\\p{{L}}\\p{{N}}]+')) AS token FROM r) SELECT token, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_places FROM x GROUP BY token",
    "stems": f"SELECT token, {stem('token')} AS stem FROM (SELECT DISTINCT unnest({tokens('title')}) AS token FROM articles)",
    "bm25_top": f"WITH {ROWS}, {BM25}, {lex(20)} SELECT chunk_id, article_id, bm25, lexical_rank FROM lx",
    "index_append": f"WITH {ROWS}, x AS (SELECT chunk_id, unnest(regexp_extract_all(lower(concat_ws(' ', article_title, chunk_text)), '[\\p{{L}}\\p{{N}}]+')) AS token FROM r) SELECT token, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_places FROM x GROUP BY token",
    "bm25_of_domains": f"WITH {ROWS}, {BM25}, {lex(20).replace('WHERE ', 'WHERE source_domain IN ' + chr(40) + chr(39) + 'news659-dale-4.example' + chr(39) + ', ' + chr(39) + 'vest850-grad-1.example' + chr(39) + ', ' + chr(39) + 'blatt687-tal-6.example' + chr(39) + chr(41) + ' AND ')} SELECT chunk_id, article_id, bm25, lexical_rank FROM lx",
    "contains_top": f"""WITH {ROWS}, m AS (SELECT *, {' + '.join(f"(contains(lower(chunk_text), '{w}') OR contains(lower(coalesce(article_title, '')), '{w}'))::INT" for w in dict.fromkeys(a for a, _ in QUERY.terms))} AS match_count FROM r WHERE {SCOPE})
        SELECT chunk_id, article_id, match_count FROM m WHERE match_count > 0 ORDER BY match_count DESC, ({compact('published_at')}) DESC, article_id, chunk_index, chunk_id LIMIT 20""",
    "query_overlap": f"WITH {ROWS}, {WITH_QUERY} SELECT chunk_id, round(overlap, 6) AS overlap, round(anchor, 6) AS anchor, anchor_matches FROM q",
    "vector_top": f"WITH {ROWS}, {WITH_QUERY}, {vec(20)} SELECT chunk_id, vector_score, vector_final, vector_rank FROM vx",
    "hybrid_top": f"WITH {HYBRID} SELECT chunk_id, article_id, final_score, lexical_score, vector_score FROM hyb",
    "search_chunks": f"WITH {searched(_PLAIN)} SELECT chunk_id, article_id, final_score, kind FROM found",
    "search_reranked": f"WITH {searched(_MODEL)} SELECT chunk_id, article_id, final_score, model_score, kind FROM found",
    "search_articles": f"""WITH {searched(_PLAIN)} SELECT article_id, article_title, source_domain, round(sum(greatest(final_score, 0) + 0.10 / (chunk_index + 1)), 6) AS article_score FROM found GROUP BY ALL ORDER BY article_score DESC, article_id LIMIT 5""",
    "answer": f"""WITH {searched(_PLAIN)}, u AS (SELECT *, max((quality > -0.45)::INT) OVER () AS useful FROM found), w AS (SELECT * FROM u WHERE useful = 0 OR quality > -0.45 ORDER BY {_ORDER} LIMIT 2)
        SELECT count(*) AS n_chunks, md5(coalesce(nullif(string_agg(trim(chunk_text), chr(10) || chr(10) ORDER BY final_score DESC, chunk_id) FILTER (WHERE trim(chunk_text) <> ''), ''), 'По выбранному запросу релевантные фрагменты не найдены.')) AS summary_md5 FROM w""",
    "flagship": f"WITH {ROWS}, {BM25}, {lex(50)} SELECT chunk_id, article_id, article_title, bm25, lexical_rank FROM lx QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY lexical_rank) <= 2",
    "frame_informative": f"WITH {FRAMES} SELECT frame_id, article_id, {INFORMATIVE} AS informative, {STATEMENT} AS statement_like, {OPERATIONAL} AS operational FROM fr",
    "frame_representation": f"""WITH {FRAMES} SELECT frame_id, concat_ws(chr(10), 'main_claim: ' || main_claim, {', '.join(f"'{s}: ' || nullif({s}, '')" for s in f.SLOTS)}, 'implications: ' || nullif(array_to_string(implications, ', '), ''), 'actors: ' || nullif(array_to_string(actors, ', '), ''),
        'valence: ' || nullif(valence, '')) AS representation, trim(substr({squeeze("concat_ws(' | ', nullif(trim(main_claim), ''), " + ', '.join(f"nullif(trim({s}), '')" for s in f.SLOTS) + ", nullif(array_to_string(implications, ', '), ''), nullif(array_to_string(actors, ', '), ''))")}, 1, 1200)) AS compact FROM fr""",
    "cluster_support": f"WITH {FRAMES} SELECT cluster_id, count(*) AS n_frames, count(DISTINCT mem.article_id) AS article_support, count(DISTINCT nullif(s.domain, '')) AS source_support FROM mem LEFT JOIN articles a ON a.id = mem.article_id LEFT JOIN sources s ON s.id = a.source_id GROUP BY cluster_id",
    "cluster_event_like": f"""WITH {FRAMES}, x AS (SELECT cluster_id, round(coalesce(avg(({STATEMENT})::INT::DOUBLE) FILTER (WHERE trim(main_claim) <> ''), 1.0), 6) AS statement_ratio, round(coalesce(avg(({OPERATIONAL})::INT::DOUBLE) FILTER (WHERE trim(main_claim) <> ''), 1.0), 6) AS operational_ratio,
        round(avg(({_IMPL} AND {_FUTURE} AND NOT list_contains({_PH}, lower(trim(coalesce(future_expectation, '')))))::INT::DOUBLE), 6) AS broad_ratio, count(*) FILTER (WHERE trim(main_claim) <> '') AS told FROM mem GROUP BY cluster_id)
        SELECT cluster_id, statement_ratio, operational_ratio, broad_ratio, told = 0 OR ((statement_ratio >= 0.7 OR operational_ratio >= 0.7) AND broad_ratio < 0.35) AS event_like FROM x""",
    "cluster_labels": f"""WITH {LABELS} SELECT g2.cluster_id, CASE WHEN len(im) > 0 AND len(ac) > 0 THEN upper(im[1][1:1]) || lower(im[1][2:]) || ' {f.TITLE_WORD}: ' || ac[1] WHEN len(im) > 0 THEN upper(im[1][1:1]) || lower(im[1][2:]) || ' {f.TITLE_WORD}' WHEN len(ac) > 0 THEN substr(ac[1], 1, 96)
        WHEN NOT list_contains({_PH}, lower(trim(canon))) THEN substr(canon, 1, 96) ELSE '{f.TITLE_NONE}' END AS title, CASE WHEN NOT list_contains({_PH}, lower(trim(canon))) THEN canon ELSE coalesce(g2.ex[1], '{f.SUMMARY_NONE}') END AS summary,
        array_to_string(list_filter([k1[1], k2[1], k3[1]], lambda x: x IS NOT NULL), ' > ') AS causal_chain, (SELECT x FROM (SELECT unnest(tones) AS x, generate_subscripts(tones, 1) AS p) GROUP BY x ORDER BY count(*) DESC, min(p) LIMIT 1) AS dominant_tone,
        coalesce(array_to_string(ex2.ex[1:3], ' | '), '') AS examples FROM g2 LEFT JOIN ex2 USING (cluster_id)""",
    "classify_margin": f"WITH {classified(CENTRES, 'c.topic_id = fv.topic_id OR fv.topic_id IS NULL')} SELECT * FROM res",
    "classify_open": f"WITH {classified(CENTRES, 'true')} SELECT reason, cluster_id, count(*) AS n, round(avg(similarity), 5) AS mean_similarity FROM res GROUP BY ALL",
    "period_counts": f"SELECT {period('published_at')} AS period, count(*) AS n_articles, count(DISTINCT source_id) AS n_sources FROM articles WHERE published_at IS NOT NULL GROUP BY ALL",
    "dynamics_points": f"WITH {POINTS} SELECT * FROM pts",
    "dynamics_series": f"""WITH {POINTS}, st AS (SELECT *, abs(article_count - lag(article_count) OVER (PARTITION BY cluster_id ORDER BY period_start)) AS step FROM pts),
        gg AS (SELECT cluster_id, count(*) AS n_points, arg_min(article_count, period_start) AS first, arg_max(article_count, period_start) AS last, coalesce(sum(step), 0) AS steps FROM st GROUP BY cluster_id),
        tt AS (SELECT cluster_id, count(DISTINCT article_id) AS total_articles FROM mem GROUP BY cluster_id)
        SELECT cluster_id, coalesce(n_points, 0) AS n_points, total_articles, CASE WHEN n_points >= 2 AND first > 0 THEN round((last - first) / first, 6) END AS growth_rate, CASE WHEN n_points >= 2 THEN round(1 / (1 + steps), 6) END AS stability_score FROM tt LEFT JOIN gg USING (cluster_id)""",
    "json_salvage": """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props->>'$.k')::BIGINT END AS k FROM events""",
}
