"""Segments of chapters: a model's paragraphs made gap-free and free of overlaps, labelled, and filled with verses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import text as X
from .prefix import before

# Titles of rows that no model named.
NO_TITLE, FILLER_TITLE, CHAPTER_SUFFIX = "단락", "본문", "장"
#: Verses of a chapter that are held together.
TILE = 256


def paragraphs(replies: DataFrame) -> DataFrame:
    """(book, chapter, n_verses, pos, verse_start, verse_end, theme_title, characteristics, core_meaning) of replies.

    ``replies`` has book, chapter, n_verses and reply. A reply that is no JSON, or has no paragraphs, gives one
    paragraph over the whole chapter.
    """
    parsed = F.from_json(X.strip_outer_fence(F.col("reply")), schemas.PARAGRAPHS)["paragraphs"]
    rows = replies.select("book", "chapter", "n_verses", parsed.alias("p"))
    whole = F.struct(
        F.lit("1").alias("verse_start"), F.col("n_verses").cast("string").alias("verse_end"),
        F.concat(F.col("book"), F.lit(" "), F.col("chapter").cast("string"), F.lit(CHAPTER_SUFFIX)).alias("theme_title"),
        F.array().cast("array<string>").alias("characteristics"), F.lit("").alias("core_meaning"),
    )
    rows = rows.select("book", "chapter", "n_verses", F.posexplode(F.when(F.size("p") > 0, F.col("p")).otherwise(F.array(whole))).alias("pos", "x"))
    title = F.coalesce(F.nullif(X.trim_all(F.col("x.theme_title")), F.lit("")), F.lit(NO_TITLE))
    traits = F.filter(F.transform(F.coalesce("x.characteristics", F.array().cast("array<string>")), lambda c: X.trim_all(c)), lambda c: c != "")
    return rows.select(
        "book", "chapter", "n_verses", "pos",
        X.whole_number(F.col("x.verse_start")).alias("verse_start"), X.whole_number(F.col("x.verse_end")).alias("verse_end"),
        title.alias("theme_title"), traits.alias("characteristics"), F.coalesce(X.trim_all(F.col("x.core_meaning")), F.lit("")).alias("core_meaning"),
    ).where("verse_start IS NOT NULL AND verse_end IS NOT NULL")


def clipped(rows: DataFrame) -> DataFrame:
    """Intervals within 1..n_verses; those that end before they start are dropped."""
    start, end = F.greatest("verse_start", F.lit(1)), F.least("verse_end", "n_verses")
    return rows.withColumns({"verse_start": start, "verse_end": end}).where("verse_start <= verse_end")


def normalized(rows: DataFrame, group: Sequence[str], order: Sequence[str], chapters: DataFrame) -> DataFrame:
    """Intervals that cover 1..n_verses of each group without gap or overlap: (group, verse_start, verse_end, filler, row).

    Sorted by start, ties in ``order``. An interval begins after all earlier ends; one that ends there too is swallowed;
    gaps become fillers, the last one to n_verses. All of it follows from the running maximum of the ends, which
    ``prefix.before`` finds for groups of any length. ``chapters`` has the groups and n_verses; groups without intervals are
    one filler.
    """
    kept = rows.select(*group, "verse_start", "verse_end", *order, F.struct(*[c for c in rows.columns if c not in group]).alias("row"))
    seen = before(kept, list(group), ["verse_start", *order], {"m": ("max", F.col("verse_end"))})
    seen = seen.select(*group, "verse_start", "verse_end", F.col("row"), F.coalesce("m", F.lit(0)).alias("m"))
    own = F.when(F.col("verse_end") > F.col("m"), F.array(F.struct(F.greatest("verse_start", F.col("m") + 1).alias("s"), F.col("verse_end").alias("e"), F.lit(False).alias("filler"))))
    gap = F.when(F.col("verse_start") > F.col("m") + 1, F.array(F.struct((F.col("m") + 1).alias("s"), (F.col("verse_start") - 1).alias("e"), F.lit(True).alias("filler"))))
    none = F.array().cast("array<struct<s:int,e:int,filler:boolean>>")
    parts = seen.select(*group, "row", F.explode(F.concat(F.coalesce(gap, none), F.coalesce(own, none))).alias("x"))
    parts = parts.select(*group, F.col("x.s").alias("verse_start"), F.col("x.e").alias("verse_end"), F.col("x.filler").alias("filler"), F.when(~F.col("x.filler"), F.col("row")).alias("row"))
    ends = rows.groupBy(*group).agg(F.max("verse_end").alias("last"))
    tail = chapters.join(ends, list(group), "left").withColumn("last", F.coalesce("last", F.lit(0))).where("last < n_verses")
    tail = tail.select(*group, (F.col("last") + 1).cast("int").alias("verse_start"), F.col("n_verses").cast("int").alias("verse_end"), F.lit(True).alias("filler"), F.lit(None).cast(parts.schema["row"].dataType).alias("row"))
    return parts.unionByName(tail)


def records(rows: DataFrame, book: Column, chapter: Column) -> DataFrame:
    """Adds id, range_label and verse_keys to normalised intervals."""
    s, e = F.col("verse_start"), F.col("verse_end")
    return rows.select(
        X.segment_id(book, chapter, s, e).alias("id"), *rows.columns, X.range_label(book, chapter, s, e).alias("range_label"), X.verse_keys(book, chapter, s, e).alias("verse_keys")
    )


def named(rows: DataFrame) -> DataFrame:
    """Title, characteristics and meaning from the interval's own row, or a filler's."""
    return rows.select(
        *[c for c in rows.columns if c != "row"],
        F.when(F.col("filler"), F.lit(FILLER_TITLE)).otherwise(F.col("row.theme_title")).alias("theme_title"),
        F.coalesce(F.col("row.characteristics"), F.array().cast("array<string>")).alias("characteristics"),
        F.coalesce(F.col("row.core_meaning"), F.lit("")).alias("core_meaning"),
    )


def hydrated(segments: DataFrame, verses: DataFrame) -> DataFrame:
    """(id, verses): segments (id, book, chapter, verse_start, verse_end) with an array of (verse, ko, en) for each of their
    verses in order; a missing verse stays as (0, '', '').

    ``verses`` (book, chapter, verse, ko, en) are gathered into tiles of ``TILE`` verses of a chapter, each once; a segment
    meets the tiles that it touches and takes slices, so no verse is looked up by a key of its own and no row holds more
    than a tile. Of repeated verses the first by (ko, en) counts. A segment that ends before it starts has no verses; one
    with a null bound isn't returned.
    """
    empty = F.struct(F.lit(0).alias("verse"), F.lit("").alias("ko"), F.lit("").alias("en"))
    tile = lambda v: F.floor((v - 1) / F.lit(TILE)).cast("int")
    row = F.struct("verse", F.coalesce("ko", F.lit("")).alias("ko"), F.coalesce("en", F.lit("")).alias("en"))
    once = verses.where("verse IS NOT NULL").groupBy("book", "chapter", "verse").agg(F.min(row).alias("row"))
    tiles = once.groupBy("book", "chapter", tile(F.col("verse")).alias("tile")).agg(F.map_from_entries(F.collect_list(F.struct("verse", "row"))).alias("held"))
    touched = F.when(F.col("verse_start") <= F.col("verse_end"), F.sequence(tile(F.col("verse_start")), tile(F.col("verse_end")))).otherwise(F.array(F.lit(0)))
    asked = segments.where("verse_start IS NOT NULL AND verse_end IS NOT NULL").select("id", "book", "chapter", "verse_start", "verse_end", F.explode(touched).alias("tile"))
    a, b = F.greatest(F.col("verse_start"), F.col("tile") * TILE + 1), F.least(F.col("verse_end"), (F.col("tile") + 1) * TILE)
    span = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    found = asked.join(tiles, ["book", "chapter", "tile"], "left").select("id", "tile", F.transform(span, lambda v: F.coalesce(F.try_element_at("held", v), empty)).alias("part"))
    return found.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda t: t["part"])).alias("verses"))
