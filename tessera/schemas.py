"""Explicit schemas of the engine's tables, as DDL; nothing is inferred."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "document_meta": "doc_id string, title string, doc_type string, source_url string, file_name string, sha256 string, n_pages int, summary string, reg_date date, publish_date date, effective_date date, version_note string",
    "section_nodes": "node_id string, doc_id string, level int, number string, title string, text string, page_start int, page_end int, parent_id string, path_titles array<string>",
    "pages": "doc_id string, page_no int, text string, ocr boolean, warning string",
    "chunks": "chunk_id string, doc_id string, doc_title string, text string, parent_text string, parent_id string, section_path string, clause string, page int, token_count int, doc_type string, source_url string, effective_date string",
    "payload": "chunk_id string, doc_id string, doc_title string, text string, parent_text string, section_path string, clause string, page int, doc_type string, source_url string, effective_date string",
    "embeddings": "chunk_id string, dense array<float>, sparse map<string,double>",
    "manifest": "doc_id string, title string, doc_type string, url string, file_name string, local_path string, sha256 string, doc_date date, protocol int, family_key string, source_page string, link_text string, n_bytes bigint",
    "families": "family_key string, title string, doc_type string, pattern string, target boolean",
    "citations": "question_id bigint, ord int, marker string, doc_id string, doc_title string, clause string, page int, section_path string, snippet string, source_url string, rerank_score double",
    "slides": "question_id bigint, slide_no int, layout string, title string, bullets array<string>, rows array<array<string>>",
    "history": "id string, kind string, doc_type string, question string, subject string, model string, filename string, path string, size bigint, grounded boolean, n_citations int, created_at string",
    "golden": "q string, doc string, type string, clause string",
    "progress": "ts timestamp, doc_id string, stage string, status string, done int, total int",
    "answer_events": "question_id bigint, seq int, type string, payload string",
}
