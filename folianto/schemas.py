"""Schemas of the tables."""

from __future__ import annotations

PARSED = "content string, title string, author string, genre string, encoding string, file_path string, file_size long, error string"
BOOKS = "id long, title string, author string, genre string, source string, language string, file_path string, created_at long"
CHUNKS = "doc_id long, book_id long, chunk_num int, word_count int, char_count int, content string"
POSTINGS = "term string, doc_id long, tf int, positions array<int>"
LEXICON = "term string, df long"
STATS = "doc_count long, total_term_count long, avg_doc_length double, next_doc_id long"
