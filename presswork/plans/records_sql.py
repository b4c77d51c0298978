"""SQL counterparts of the queries of the stored side, with literals of their own."""

from __future__ import annotations

from . import oracle as o

_ARTICLE = "nullif(regexp_extract(frame_id, '^frame-([0-9]+)-', 1), '')::BIGINT"
_SIZES = "e AS (SELECT frame_id, model_name, coalesce(max(len(vector)), -1) AS n, max(len(vector)) AS dimension FROM frame_embeddings GROUP BY ALL)"
_PHRASES = "['Краткий пересказ от РИА ИИ', 'Читать ria.ru в', 'Медиабанк', 'Фото']"
_FIRST_PHRASES = "['Что думаешь? Оцени!', 'Последние новости']"
_TOPICS = f"""tp AS (SELECT source_id AS no, 'source-' || source_id AS topic, id AS article_id FROM articles WHERE source_id % 2 = 0 UNION ALL SELECT 1000, nullif({o.squeeze('category')}, ''), id FROM articles WHERE nullif({o.squeeze('category')}, '') IS NOT NULL),
  ft AS (SELECT article_id, topic AS topic_id FROM tp QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY no, topic) = 1)"""


def _body(phrases: str) -> str:
    text = o.squeeze("coalesce(body_text, '')")
    return f"md5(CASE WHEN length({text}) >= 20 AND len(list_filter({phrases}, lambda x: contains({text}, x))) = 0 THEN {text} ELSE '' END)"


SQL: dict[str, str] = {
    "embedding_upsert": f"""WITH {_SIZES}, w AS (SELECT frame_id, model_name, dimension, coalesce(dimension, 0) + 1 AS bigger, {_ARTICLE} % 3 = 0 AS new FROM e)
        SELECT frame_id, model_name, CASE WHEN new THEN bigger ELSE dimension END::INT AS dimension, CASE WHEN new THEN '2025-01-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS created_at FROM w
        UNION ALL SELECT frame_id, 'another', max(bigger)::INT, '2025-01-01 00:00:00' FROM w WHERE new GROUP BY frame_id""",
    "analysis_upsert": f"""SELECT id AS article_id, {o.compact('published_at')} AS published_at, CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END AS frame_count, coalesce(created_at, CASE WHEN id % 4 = 0 THEN '2026-01-01 00:00:00' END) AS created_at,
        CASE WHEN id % 4 = 0 THEN '2026-01-01 00:00:00' ELSE updated_at END AS updated_at FROM articles UNION ALL SELECT id, {o.compact('published_at')}, 3, '2026-01-01 00:00:00', '2026-01-01 00:00:00' FROM incoming_articles""",
    "flag_updates": "SELECT id, id IN (SELECT id FROM articles) AS matched FROM (SELECT id FROM incoming_articles UNION SELECT id FROM articles WHERE id % 5 = 0)",
    "source_registry": """WITH w AS (SELECT source AS domain FROM documents WHERE source IS NOT NULL UNION SELECT domain FROM sources WHERE id <= 10), k AS (SELECT domain, min(id) AS id FROM sources GROUP BY domain)
        SELECT domain, id, false AS created FROM w JOIN k USING (domain) UNION ALL SELECT domain, (SELECT max(id) FROM sources) + row_number() OVER (ORDER BY domain), true FROM w WHERE domain NOT IN (SELECT domain FROM k)""",
    "chunk_backfill": "SELECT id, is_canonical FROM articles a WHERE NOT EXISTS (SELECT 1 FROM article_chunks c WHERE c.article_id = a.id)",
    "bulk_days": f"""WITH {o.INCOMING.replace('id, source_id, ', 'id, source_id, received_at, ', 1)}, v AS (SELECT strftime(received_at, '%Y-%m-%d') AS day, {o.VERDICT} AS verdict FROM ni),
        c AS (SELECT day, count(*) AS discovered, count(*) FILTER (WHERE verdict = 'ok') AS saved, count(*) FILTER (WHERE verdict <> 'ok') AS skipped_invalid FROM v GROUP BY day)
        SELECT *, sum(discovered) OVER w::BIGINT AS total_discovered, sum(saved) OVER w::BIGINT AS total_saved, sum(skipped_invalid) OVER w::BIGINT AS total_skipped_invalid FROM c WINDOW w AS (ORDER BY day)""".replace("OVER w::BIGINT", "OVER w"),
    "articles_by_ids": "SELECT id, published_at FROM articles WHERE id IN (SELECT article_id FROM article_duplicates)",
    "latest_snapshot": """SELECT 2 AS id, 'a,b' AS source_domains_key, count(*) AS n_articles, '{"n_articles":' || count(*) || '}' AS payload_json FROM articles WHERE id % 2 = 0""",
    "vector_candidates": f"""WITH {o.ROWS}, c AS (SELECT article_id, min(id) AS chunk_id FROM article_chunks WHERE chunk_index = 0 GROUP BY article_id), {_SIZES}
        SELECT frame_id, c.chunk_id, r.article_id, source_domain, n::INT AS dimension FROM e JOIN c ON c.article_id = {_ARTICLE} JOIN r ON r.chunk_id = c.chunk_id
        WHERE model_name = 'narr-embed-a64' AND n > 0 AND {o.SCOPE} AND source_domain IN ('news659-dale-4.example', 'vest850-grad-1.example', 'blatt687-tal-6.example')""",
    "frame_embedding_retry": f"""WITH r AS ({o.SQL['frame_representation']}) SELECT frame_id, CASE WHEN length(representation) <= 420 THEN 'whole' WHEN length(compact) <= 420 THEN 'compact' ELSE 'skipped' END AS status,
        CASE WHEN length(representation) <= 420 THEN length(representation) WHEN length(compact) <= 420 THEN length(compact) END::INT AS n_signs FROM r""",
    "frame_codec": f"WITH {o.FRAMES} SELECT frame_id, article_id, main_claim, len(actors)::INT AS n_actors, array_to_string(implications, '; ') AS implications FROM fr",
    "article_topics": f"WITH {_TOPICS} SELECT article_id, topic_id FROM ft",
    "dominant_topics": f"""WITH {o.FRAMES}, n AS (SELECT a.source_id, fr.topic_id, count(*) AS n, min(fr.frame_id) AS f FROM fr JOIN articles a ON a.id = fr.article_id WHERE fr.topic_id IS NOT NULL GROUP BY ALL)
        SELECT source_id, topic_id, n FROM n QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, f) = 1""",
    "materialization": f"""WITH {o.FRAMES}, a AS (SELECT id, id % 3 = 0 AS held FROM articles WHERE is_canonical) SELECT count(*) AS total_articles, count(*) FILTER (WHERE NOT held) AS processed_articles, count(*) FILTER (WHERE held) AS reused_articles,
        (SELECT count(*) FROM fr WHERE article_id IN (SELECT id FROM a WHERE NOT held)) AS n_frames FROM a""",
    "cached_frames": f"""WITH {o.FRAMES}, {_TOPICS} SELECT fr.frame_id, fr.article_id, coalesce(CASE WHEN fr.article_id % 5 <> 0 THEN fr.topic_id END, ft.topic_id) AS topic_id, fr.main_claim
        FROM fr JOIN articles a ON a.id = fr.article_id JOIN sources s ON s.id = a.source_id LEFT JOIN ft ON ft.article_id = fr.article_id WHERE ({o.compact('a.published_at')}) BETWEEN '20240101T0000' AND '20261231T0000'""",
    "dynamics_view": f"SELECT cluster_id, n_points, total_articles, round(growth_rate, 3) AS growth_rate, round(stability_score, 3) AS stability_score FROM ({o.SQL['dynamics_series']}) ORDER BY total_articles DESC, cluster_id LIMIT 12",
    "cyrillic": "SELECT doc_id, coalesce(regexp_matches(text, '[А-Яа-яЁё]'), false) AS cyrillic FROM documents",
    "page_articles_second": f"SELECT id AS page_id, {o.squeeze('coalesce(title, chr(32))')} AS title, nullif({o.squeeze('author')}, '') AS author, 'rubric' AS category, {_body(_PHRASES)} AS body_md5 FROM articles",
    "page_articles": f"SELECT id AS page_id, {o.squeeze('coalesce(title, chr(32))')} AS title, nullif({o.squeeze('author')}, '') AS author, {_body(_FIRST_PHRASES)} AS body_md5 FROM articles",
    "page_attributes": "SELECT id AS page_id, '/a?x=1' AS href, 'rubric' AS content, NULL::VARCHAR AS charset FROM articles",
}
