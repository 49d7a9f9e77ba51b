"""Explicit schemas of the relations, as DDL; nothing is inferred from files."""

VERSES = "id LONG, key STRING, book_en STRING, book_ko STRING, chapter INT, verse INT, testament STRING, genre STRING, ko STRING, en STRING, embed_text STRING"
BOOKS = "book_ord INT, book_en STRING, ko STRING, testament STRING, genre STRING"
TAGS = "key STRING, tags STRING"
PASSAGES = (
    "id STRING, book_en STRING, book_ko STRING, chapter INT, verse_start INT, verse_end INT, range_label STRING, verse_keys ARRAY<STRING>, "
    "testament STRING, genre STRING, theme_title STRING, characteristics ARRAY<STRING>, core_meaning STRING"
)
USED = "user_id STRING, passage_id STRING, used_at TIMESTAMP"
#: Model replies. Interval ends are read as strings, as a model may send "3" or 3.0 for 3.
PARAGRAPHS = "STRUCT<paragraphs: ARRAY<STRUCT<verse_start STRING, verse_end STRING, theme_title STRING, characteristics ARRAY<STRING>, core_meaning STRING>>>"
EXPANSION = "STRUCT<emotions: ARRAY<STRING>, biblical_keywords: ARRAY<STRING>, search_query: STRING>"
RERANK = "STRUCT<results: ARRAY<STRUCT<index: INT, reason: STRING>>>"
