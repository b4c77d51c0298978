"""Explicit schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

SOURCES = "id bigint, name string, domain string, base_url string, source_type string, language string, is_active boolean, created_at string, updated_at string"
ARTICLES = (
    "id bigint, source_id bigint, url string, title string, subtitle string, body_text string, published_at string, author string, category string, "
    "language string, content_hash string, word_count int, is_canonical boolean, duplicate_group_id string, created_at string, updated_at string"
)
CHUNKS = "id bigint, article_id bigint, chunk_index int, chunk_text string, char_start int, char_end int, token_count int, created_at string"
DUPLICATES = "id bigint, duplicate_group_id string, article_id bigint, duplicate_type string, is_primary boolean, similarity_score double, created_at string"
EMBEDDINGS = "chunk_id bigint, model_name string, embedding array<double>, dimension int, created_at string"
FRAMES = (
    "frame_id string, article_id bigint, topic_id string, status string, main_claim string, actors array<string>, cause string, mechanism string, "
    "consequence string, future_expectation string, valence string, implications array<string>, representative_quotes array<string>, confidence double"
)
PAGES = "url string, html string, site string, fetched_at timestamp"
RUNS = "id bigint, source_domains_key string, date_from string, date_to string, status string, payload_json string, created_at string"
