"""SQL counterparts of the training-data queries, where SQL is fast enough on whole tables."""

_KEY = r"trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\t\r\f\x0B\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
_FIELDS = ("title", "subtitle", "author", "category")

SQL: dict[str, str] = {
    "p2_found": f"""WITH l AS (SELECT id, source_id, unnest(string_split(body_text, chr(10))) AS x, generate_subscripts(string_split(body_text, chr(10)), 1) - 1 AS line_no FROM articles WHERE source_id IS NOT NULL),
        k AS (SELECT id, source_id, line_no, {_KEY} AS key FROM l), n AS (SELECT source_id, count(*) AS n FROM articles GROUP BY source_id),
        r AS (SELECT source_id, key FROM k JOIN n USING (source_id) WHERE key <> '' GROUP BY source_id, key, n.n HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.04 * n.n)
        SELECT id AS article_id, line_no::BIGINT AS line_no FROM k SEMI JOIN r USING (source_id, key)""",
    "p3_found": """WITH v AS (SELECT model_name, len(vector) AS d, frame_id, min(vector) AS v FROM frame_embeddings WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY ALL),
        p AS (SELECT a.frame_id AS f, b.frame_id AS o, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.model_name IS NOT DISTINCT FROM b.model_name AND a.d = b.d AND a.frame_id <> b.frame_id),
        t AS (SELECT f, o FROM p WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY f ORDER BY s DESC, o) <= 5)
        SELECT DISTINCT least(f, o) AS frame_id_a, greatest(f, o) AS frame_id_b FROM t""",
    "p4_found": "SELECT DISTINCT id AS chunk_id FROM article_chunks WHERE length(chunk_text) > 700",
    "p7_found": """WITH m AS (SELECT duplicate_group_id, id AS article_id FROM articles UNION SELECT duplicate_group_id, article_id FROM article_duplicates),
        r AS (SELECT m.duplicate_group_id, a.*, p.trust_rank FROM m JOIN articles a ON a.id = m.article_id LEFT JOIN source_profiles p ON p.source_id = a.source_id WHERE trim(m.duplicate_group_id) <> ''),
        """.replace("a.*", "a.id, a.title, a.subtitle, a.author, a.category, a.updated_at")
    + "f AS ("
    + " UNION ALL ".join(f"SELECT duplicate_group_id, '{x}' AS field, id, {x} AS value, trust_rank, updated_at FROM r" for x in _FIELDS)
    + r""") SELECT duplicate_group_id, field, id AS article_id FROM f WHERE regexp_matches(value, '[\p{L}\p{N}]')
        QUALIFY row_number() OVER (PARTITION BY duplicate_group_id, field ORDER BY trust_rank NULLS LAST, updated_at DESC NULLS LAST, id) = 1""",
    "p10_found": """WITH g AS (SELECT DISTINCT doc_id, hash(substr(text, p, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS p FROM documents WHERE length(text) >= 300)),
        k AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), s AS (SELECT g.* FROM g SEMI JOIN k USING (h))
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p2_clean": f"""WITH l AS (SELECT id, source_id, unnest(string_split(body_text, chr(10))) AS x, generate_subscripts(string_split(body_text, chr(10)), 1) AS i FROM articles),
        k AS (SELECT id, source_id, i, x, {_KEY} AS key FROM l), n AS (SELECT source_id, count(*) AS n FROM articles GROUP BY source_id),
        r AS (SELECT source_id, key, 1 AS gone FROM k JOIN n USING (source_id) WHERE key <> '' GROUP BY source_id, key, n.n HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.04 * n.n),
        c AS (SELECT id, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL) AS t, count(gone) AS g FROM k LEFT JOIN r USING (source_id, key) GROUP BY id)
        SELECT a.id AS article_id, CASE WHEN a.body_text IS NULL THEN NULL WHEN coalesce(c.g, 0) = 0 THEN a.body_text ELSE coalesce(c.t, '') END AS clean_text, coalesce(c.g, 0)::INT AS n_removed FROM articles a LEFT JOIN c ON a.id = c.id""",
    "p3_neighbours": """WITH v AS (SELECT model_name, len(vector) AS d, frame_id, min(vector) AS v FROM frame_embeddings WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY ALL),
        p AS (SELECT a.frame_id AS f, b.frame_id AS o, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.model_name IS NOT DISTINCT FROM b.model_name AND a.d = b.d AND a.frame_id <> b.frame_id)
        SELECT f AS frame, o AS other, s AS cosine, (row_number() OVER (PARTITION BY f ORDER BY s DESC, o))::INT AS rank FROM p WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY f ORDER BY s DESC, o) <= 5""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_parts": """WITH g AS (SELECT doc_id, p, hash(substr(text, p, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS p FROM documents WHERE length(text) >= 300)),
        k AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1), s AS (SELECT doc_id, p, p + 299 AS e, lag(p + 299) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g SEMI JOIN k USING (h)),
        c AS (SELECT doc_id, sum(e - greatest(p, coalesce(before + 1, p)) + 1) AS chars, count(*) FILTER (WHERE before IS NULL OR before + 1 < p) AS spans FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(length(d.text), 0)::INT AS n_chars, coalesce(c.chars, 0)::BIGINT AS shared_chars, CASE WHEN coalesce(length(d.text), 0) > 0 THEN round(coalesce(c.chars, 0)::DOUBLE / length(d.text), 6) ELSE 0.0 END AS shared_part,
        coalesce(c.spans, 0)::INT AS spans FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id""",
}
