"""Corpus building queries: customers as verses of nations, orders as raw lines, documents with benchmark as two languages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..sources import files
from ..storage import checkpoint_dir


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines made of orders: by the key's rest, good ones, ones in white space of all kinds, ones without a verse, without a number, and short ones."""
    k = F.col("o_orderkey")
    good = F.concat(F.lit("Book "), (k % 7).cast("string"), F.lit(":"), (k % 50 + 1).cast("string"), F.lit(":"), (k % 30 + 1).cast("string"), F.lit(" "), F.col("o_orderpriority"), F.lit(": x:y"))
    line = (
        F.when(k % 11 == 0, F.concat(F.lit("A:"), k.cast("string")))
        .when(k % 11 == 1, F.concat(F.lit("A:x:"), k.cast("string"), F.lit(" t")))
        .when(k % 11 == 2, F.concat(F.lit("A:1:"), k.cast("string")))
        .when(k % 11 == 3, F.concat(F.lit("A: 1.5:"), k.cast("string"), F.lit(" t")))
        .when(k % 11 == 4, F.lit("  \u3000\t"))
        .when(k % 11 == 5, F.concat(F.lit("\u3000"), F.replace(good, F.lit(": x:y"), F.lit("\u3000z\t \u00a0"))))
        .otherwise(good)
    )
    return _t(spark, d, "orders").select(k.alias("line_no"), line.alias("value"))


def parse_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_lines(_lines(spark, d))


def parse_text_files(spark: SparkSession, d: str) -> DataFrame:
    """The same lines written as text files and scanned; where a line stands in its file isn't shown."""
    path = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    _lines(spark, d).select("value").write.text(path)
    return C.parse_lines(files.text_lines(spark, path)).drop("line_no")


def strip_footnotes(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "text", X.strip_footnotes(F.col("text")).alias("clean"))
    return rows.select("doc_id", F.md5("clean").alias("clean_md5"), (F.length("text") - F.length("clean")).alias("removed"))


def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return C.last_by_key(_t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


def _languages(spark: SparkSession, d: str) -> DataFrame:
    ko = _t(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("ko"))
    return C.join_languages(ko, _t(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("en")))


def bilingual_left_join(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("key", F.length("ko").alias("ko_chars"), "en")


def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage(_languages(spark, d))


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Nations as books; every fifth nation is unknown."""
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    books = nation.where("n_nationkey % 5 <> 4").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return books.select(
        F.col("n_nationkey").cast("string").alias("book_en"), F.col("n_name").alias("ko_name"), F.when(F.col("n_regionkey") < 3, "OT").otherwise("NT").alias("testament"),
        F.col("r_name").alias("genre"), F.col("n_nationkey").alias("book_ord"),
    )


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("book_en"), F.col("c_mktsegment").alias("segment"))


def dim_enrich(spark: SparkSession, d: str) -> DataFrame:
    return C.with_dimension(_customers(spark, d), _books(spark, d))


def tag_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Tags for two books in three of the first ten, one of them empty; for all genres but one, with a repeated key."""
    book_tags = spark.createDataFrame([("0", "zero one"), ("1", ""), ("3", "three")], "key string, tags string")
    genre_tags = spark.createDataFrame([(0, "AFRICA", "first"), (1, "ASIA", "asia"), (2, "AMERICA", "america"), (3, "AFRICA", "last")], "ord int, key string, tags string")
    rows = C.with_dimension(_customers(spark, d), _books(spark, d))
    tagged = C.with_tags(rows, book_tags, C.last_tags(genre_tags))
    text = X.embed_text(F.col("segment"), F.col("book_ko"), F.col("tags"))
    return tagged.select("c_custkey", "tags", text.alias("embed_text"))


def reverse_dim_filter(spark: SparkSession, d: str) -> DataFrame:
    named = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("book_ko"))
    return C.known_books(named, _books(spark, d)).select("c_custkey", "book_en")


def canonical_order_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_dimension(_customers(spark, d), _books(spark, d)).withColumn("chapter", (F.col("c_custkey") % 10 + 1).cast("int"))
    out = C.numbered(rows.select("book_ord", "book_en", "chapter", "c_custkey"), ["book_ord", "chapter", "c_custkey"])
    return out.select("id", X.verse_key(F.col("book_en"), F.col("chapter"), F.col("c_custkey")).alias("key"))


def split_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of customers taken apart again; every seventh lacks its verse."""
    key = F.concat_ws(":", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 10 + 1).cast("string"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string")))
    return _t(spark, d, "customer").select("c_custkey", X.key_parts(key).alias("p")).select("c_custkey", "p.book", "p.chapter", "p.verse")


def canon_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Customers dealt over the real books and two unknown ones, with the real tags."""
    from ..sources import canon

    names = canon.books(spark).select(F.col("book_ord").alias("at"), F.col("book_en").alias("name"))
    rows = _t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 68).cast("int").alias("at"))
    rows = rows.join(names, "at", "left").select("c_custkey", F.coalesce("name", F.concat(F.lit("Book"), F.col("at").cast("string"))).alias("book_en"))
    rows = C.with_dimension(rows, canon.books(spark).withColumnRenamed("ko", "ko_name"))
    tagged = C.with_tags(rows, canon.book_tags(spark), canon.genre_tags(spark))
    return tagged.select("c_custkey", "book_en", "book_ko", "testament", "genre", "book_ord", "tags")


def _verses(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("C").alias("book"), F.col("conv_id").alias("chapter"), (F.col("turn") + 1).cast("int").alias("verse"), "role", "text")


def chapter_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = C.chapters(_verses(spark, d))
    verses = F.array_join(F.transform("members", lambda m: m["verse"].cast("string")), ",")
    return rows.select("chapter", "first_id", "first_role", "n_verses", verses.alias("verses"))


def chapter_prompt_block(spark: SparkSession, d: str) -> DataFrame:
    return C.prompt_block(C.chapters(_verses(spark, d))).select("chapter", F.md5("block").alias("block_md5"), F.length("block").alias("block_chars"))


def prompt_fill(spark: SparkSession, d: str) -> DataFrame:
    template = "Split {book} {chapter} ({n} verses) into paragraphs.\n{verses}"
    rows = C.chapters(_verses(spark, d)).join(C.prompt_block(C.chapters(_verses(spark, d))), ["book", "chapter"])
    prompt = C.filled(template, book=F.col("book"), chapter=F.col("chapter").cast("string"), n=F.col("n_verses").cast("string"), verses=F.col("block"))
    return rows.select("chapter", F.md5(prompt).alias("prompt_md5"))


def pending_chapters(spark: SparkSession, d: str) -> DataFrame:
    rows = C.chapters(_verses(spark, d))
    return C.pending(rows, rows.where("chapter % 3 = 0")).select("chapter", "n_verses")


def book_filter_limit(spark: SparkSession, d: str) -> DataFrame:
    return C.first_chapters(C.chapters(_verses(spark, d)), "C", 7).select("chapter", "first_id")


QUERIES = {f.__name__: f for f in (
    parse_lines, parse_text_files, strip_footnotes, last_write_wins, bilingual_left_join, coverage_counts, dim_enrich, tag_fallback, reverse_dim_filter, canonical_order_ids,
    split_keys, canon_enrich, chapter_groups, chapter_prompt_block, prompt_fill, pending_chapters, book_filter_limit,
)}

_LANGUAGES = "SELECT doc_id AS key, d.text AS ko, coalesce(b.text, '') AS en FROM documents d LEFT JOIN benchmark b ON item_id = doc_id"
# Characters that trim takes off, as SQL text; the data has no others of them at an end.
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"
_PARSED = rf"""
WITH made AS (
  SELECT o_orderkey AS k, 'Book ' || (o_orderkey % 7) || ':' || (o_orderkey % 50 + 1) || ':' || (o_orderkey % 30 + 1) || ' ' || o_orderpriority AS good FROM orders
), lines AS (
  SELECT k AS line_no, CASE k % 11 WHEN 0 THEN 'A:' || k WHEN 1 THEN 'A:x:' || k || ' t' WHEN 2 THEN 'A:1:' || k WHEN 3 THEN 'A: 1.5:' || k || ' t' WHEN 4 THEN '  '
         WHEN 5 THEN chr(12288) || good || chr(12288) || 'z' || chr(9) || ' ' || chr(160) ELSE good || ': x:y' END AS value FROM made
), cut AS (SELECT line_no, regexp_extract(trim(value, {_BLANK}), '^([^:]*):([^:]*):(.*)$', ['book', 'chapter', 'rest']) AS p FROM lines)
SELECT line_no, replace(p.book, ' ', '') AS book, trim(p.chapter)::INT AS chapter, regexp_extract(trim(p.rest), '^(\d+)\s+(.*)', 1)::INT AS verse,
       replace(p.book, ' ', '') || ':' || trim(p.chapter) || ':' || regexp_extract(trim(p.rest), '^(\d+)\s+(.*)', 1) AS key, regexp_extract(trim(p.rest), '^(\d+)\s+(.*)', 2) AS text
FROM cut WHERE regexp_matches(p.chapter, '^\s*[+-]?\d+\s*$') AND regexp_matches(trim(p.rest), '^\d+\s+')"""
_ENRICHED = """
books AS (
  SELECT n_nationkey::VARCHAR AS book_en, n_name AS ko_name, CASE WHEN n_regionkey < 3 THEN 'OT' ELSE 'NT' END AS testament, r_name AS genre, n_nationkey AS book_ord
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4
), enriched AS (
  SELECT c_custkey, c_nationkey::VARCHAR AS book_en, c_mktsegment AS segment, coalesce(ko_name, c_nationkey::VARCHAR) AS book_ko, coalesce(testament, 'OT') AS testament,
         coalesce(genre, '기타') AS genre, coalesce(book_ord, 999) AS book_ord
  FROM customer LEFT JOIN books ON book_en = c_nationkey::VARCHAR
)"""
_GROUPED = """
v AS (SELECT conv_id * 1000 + turn AS id, conv_id AS chapter, (turn + 1)::INT AS verse, role, text FROM conversations),
blocks AS (SELECT chapter, count(*) AS n, string_agg(verse || ': ' || text, chr(10) ORDER BY id) AS block FROM v GROUP BY chapter)"""

def _canon_sql() -> str:
    from ..sources import canon

    def values(rows) -> str:
        return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)

    return f"""
WITH books(book_ord, book_en, ko, testament, genre) AS (VALUES {values(canon.book_rows())}), book_tags(key, tags) AS (VALUES {values(canon.BOOK_TAGS)}),
genre_tags(key, tags) AS (VALUES {values(dict(canon.GENRE_TAGS).items())}),
rows AS (SELECT c_custkey, coalesce(book_en, 'Book' || (c_custkey % 68)) AS book_en, coalesce(ko, 'Book' || (c_custkey % 68)) AS book_ko, coalesce(testament, 'OT') AS testament,
         coalesce(genre, '기타') AS genre, coalesce(book_ord, 999)::INT AS book_ord FROM customer LEFT JOIN books ON book_ord = c_custkey % 68)
SELECT c_custkey, book_en, book_ko, testament, genre, book_ord, coalesce(nullif(b.tags, ''), g.tags, '믿음 소망 사랑') AS tags
FROM rows LEFT JOIN book_tags b ON b.key = book_en LEFT JOIN genre_tags g ON g.key = genre"""


SQL = {
    "split_keys": """
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey::VARCHAR END AS book, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 10 + 1)::INT END AS chapter,
       CASE WHEN c_custkey % 7 <> 0 THEN c_custkey::INT END AS verse FROM customer""",
    "canon_enrich": _canon_sql(),
    "parse_lines": _PARSED,
    "parse_text_files": f"SELECT * EXCLUDE (line_no) FROM ({_PARSED})",
    "strip_footnotes": r"""
SELECT doc_id, md5(clean) AS clean_md5, (length(text) - length(clean))::INT AS removed FROM (SELECT doc_id, text, trim(regexp_replace(text, '\d+\)', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) AS clean FROM documents)""",
    "last_write_wins": """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "bilingual_left_join": f"SELECT key, length(ko)::INT AS ko_chars, en FROM ({_LANGUAGES})",
    "coverage_counts": f"""
SELECT count(*) AS total, count(*) FILTER (coalesce(ko, '') <> '' AND en <> '') AS both, count(*) FILTER (coalesce(ko, '') <> '' AND en = '') AS ko_only,
       count(*) FILTER (coalesce(ko, '') = '') AS other FROM ({_LANGUAGES})""",
    "dim_enrich": f"WITH {_ENRICHED} SELECT * FROM enriched",
    "tag_fallback": f"""
WITH {_ENRICHED}, book_tags(key, tags) AS (VALUES ('0', 'zero one'), ('1', ''), ('3', 'three')), genre_tags(key, tags) AS (VALUES ('ASIA', 'asia'), ('AMERICA', 'america'), ('AFRICA', 'last')),
tagged AS (
  SELECT c_custkey, segment, book_ko, coalesce(nullif(b.tags, ''), g.tags, '믿음 소망 사랑') AS tags
  FROM enriched LEFT JOIN book_tags b ON b.key = book_en LEFT JOIN genre_tags g ON g.key = genre
)
SELECT c_custkey, tags, segment || ' ' || book_ko || ' | 태그: ' || tags AS embed_text FROM tagged""",
    "reverse_dim_filter": f"""
WITH {_ENRICHED} SELECT c_custkey, books.book_en FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN books ON ko_name = n_name""",
    "canonical_order_ids": f"""
WITH {_ENRICHED}
SELECT row_number() OVER (ORDER BY book_ord, (c_custkey % 10 + 1), c_custkey) - 1 AS id, book_en || ':' || (c_custkey % 10 + 1) || ':' || c_custkey AS key FROM enriched""",
    "chapter_groups": f"""
WITH {_GROUPED}
SELECT chapter, min(id) AS first_id, arg_min(role, id) AS first_role, count(*) AS n_verses, string_agg(verse::VARCHAR, ',' ORDER BY id) AS verses FROM v GROUP BY chapter""",
    "chapter_prompt_block": f"WITH {_GROUPED} SELECT chapter, md5(block) AS block_md5, length(block)::INT AS block_chars FROM blocks",
    "prompt_fill": f"""
WITH {_GROUPED}
SELECT chapter, md5('Split C ' || chapter || ' (' || n || ' verses) into paragraphs.' || chr(10) || block) AS prompt_md5 FROM blocks""",
    "pending_chapters": f"WITH {_GROUPED} SELECT chapter, n AS n_verses FROM blocks WHERE chapter % 3 <> 0",
    "book_filter_limit": f"WITH {_GROUPED} SELECT chapter, min(id) AS first_id FROM v GROUP BY chapter ORDER BY first_id LIMIT 7",
}
