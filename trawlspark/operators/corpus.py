"""Building the corpus: lines to verses, two languages joined, dimensions, canonical order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..storage import cut

#: A verse's number, white space of any kind, and its text.
START = rf"^(\d+)[{X.SPACES}]+(.*)"


def parse_lines(lines: DataFrame, keep_spaces: bool = False, footnotes: bool = False) -> DataFrame:
    """(line_no, book, chapter, verse, key, text) of lines ``Book:Chapter:Verse Text``; other lines are dropped.

    Spaces in the book are removed unless ``keep_spaces``; ``footnotes`` strips marks such as ``12)`` from the text.
    """
    parts = F.split(X.trim_all(F.col("value")), ":", 3)
    rows = lines.select("line_no", parts.alias("p")).where("size(p) = 3")
    book = X.trim_all(F.col("p")[0])
    book = book if keep_spaces else F.replace(book, F.lit(" "), F.lit(""))
    rest = X.trim_all(F.col("p")[2])
    rows = rows.select("line_no", book.alias("book"), X.strict_number(F.col("p")[1]).alias("chapter"), rest.alias("rest"))
    rows = rows.where("chapter IS NOT NULL").where(F.col("rest").rlike(START))
    text = F.regexp_extract("rest", START, 2)
    rows = rows.select("line_no", "book", "chapter", F.regexp_extract("rest", START, 1).try_cast("int").alias("verse"), (X.strip_footnotes(text) if footnotes else text).alias("text"))
    return rows.where("verse IS NOT NULL").select("line_no", "book", "chapter", "verse", X.verse_key(F.col("book"), F.col("chapter"), F.col("verse")).alias("key"), "text")


def last_by_key(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, as assignments to a dictionary leave it; map-side combined."""
    latest = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return rows.groupBy(*key).agg(latest).select(*key, *[F.col(f"_last.{v}").alias(v) for v in values])


def join_languages(ko: DataFrame, en: DataFrame) -> DataFrame:
    """(key, ko, en): every row of the first language with the second's text, or an empty one."""
    return ko.join(en, "key", "left").select("key", F.col("ko"), F.coalesce("en", F.lit("")).alias("en"))


def coverage(rows: DataFrame) -> DataFrame:
    """One row: total, both, ko_only and the rest, which counts rows with neither text too."""
    ko, en = F.coalesce("ko", F.lit("")) != "", F.coalesce("en", F.lit("")) != ""
    return rows.agg(F.count("*").alias("total"), F.count_if(ko & en).alias("both"), F.count_if(ko & ~en).alias("ko_only"), F.count_if(~ko).alias("other"))


def with_dimension(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Left join of a book dimension (book_en, ko, testament, genre, book_ord), with defaults for unknown books.

    The dimension has one row per book; adaptive execution broadcasts it if its size allows.
    """
    joined = rows.join(books, "book_en", "left")
    return joined.select(
        *rows.columns,
        F.coalesce("ko_name", "book_en").alias("book_ko"),
        F.coalesce("testament", F.lit("OT")).alias("testament"),
        F.coalesce("genre", F.lit("기타")).alias("genre"),
        F.coalesce("book_ord", F.lit(999)).alias("book_ord"),
    )


def with_tags(rows: DataFrame, book_tags: DataFrame, genre_tags: DataFrame) -> DataFrame:
    """Tags of the book, or else of the genre, or else the default; an empty book entry counts as none."""
    b = book_tags.select(F.col("key").alias("book_en"), F.col("tags").alias("_book_tags"))
    g = genre_tags.select(F.col("key").alias("genre"), F.col("tags").alias("_genre_tags"))
    joined = rows.join(b, "book_en", "left").join(g, "genre", "left")
    tags = F.coalesce(F.nullif(F.col("_book_tags"), F.lit("")), F.col("_genre_tags"), F.lit(X.DEFAULT_TAGS))
    return joined.select(*rows.columns, tags.alias("tags"))


def last_tags(rows: DataFrame) -> DataFrame:
    """(key, tags) with the last entry of a repeated key, by ``ord``."""
    return last_by_key(rows, ["key"], ["ord"], ["tags"])


def known_books(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Rows whose local book name is known, with the name's key; others are dropped."""
    return rows.join(books.select(F.col("ko_name").alias("book_ko"), "book_en"), "book_ko")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Dense ids from 0 in ``order`` (unique), without one task for all rows.

    Rows are range-sorted; an id is the number of rows in earlier ranges, one small row each, plus the place in the own.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row's range must not change between the count and the numbering
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    joined = ranged.withColumn("_place", place).join(F.broadcast(starts), "_range")  # one row per range: at most n
    return joined.select((F.col("_start") + F.col("_place")).alias(name), *rows.columns)


def chapters(verses: DataFrame) -> DataFrame:
    """One row per (book, chapter): first order, first attributes, number of verses, members in order."""
    members = F.array_sort(F.collect_list(F.struct("id", "verse", "text")))
    return verses.groupBy("book", "chapter").agg(
        F.min("id").alias("first_id"), F.min_by("role", "id").alias("first_role"), F.count("*").alias("n_verses"), members.alias("members")
    )


def prompt_block(chapters: DataFrame) -> DataFrame:
    """(book, chapter, block): ``verse: text`` lines in order."""
    lines = F.transform("members", lambda m: F.concat(m["verse"].cast("string"), F.lit(": "), m["text"]))
    return chapters.select("book", "chapter", F.array_join(lines, "\n").alias("block"))


def pending(chapters: DataFrame, done: DataFrame) -> DataFrame:
    """Chapters not done yet."""
    return chapters.join(done.select("book", "chapter"), ["book", "chapter"], "left_anti")


def first_chapters(chapters: DataFrame, book: str | None = None, limit: int | None = None) -> DataFrame:
    """Chapters of one book, at most ``limit`` of them in order of appearance."""
    rows = chapters if book is None else chapters.where(F.col("book") == book)
    return rows.orderBy("first_id").limit(limit) if limit else rows


def filled(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` places filled by columns."""
    out = F.lit(template)
    for name, column in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), column)
    return out
