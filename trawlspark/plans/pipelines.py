"""The three entry points put together: the corpus build, a search, and the segment build."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import corpus as C, dense as D, models as M, search as S, segments as G
from ..sources import canon, files
from ..storage import cut


def build_verses(spark: SparkSession, ko_path: str, en_path: str) -> DataFrame:
    """The verse table of two text files: parsed, cleaned, joined, enriched, in canonical order with ids from 0."""
    dimension = canon.books(spark)
    local = C.parse_lines(files.text_lines(spark, ko_path), keep_spaces=True, footnotes=True)
    local = C.known_books(local.withColumnRenamed("book", "book_ko"), dimension.withColumnRenamed("ko", "ko_name"))
    local = local.withColumn("key", X.verse_key(F.col("book_en"), F.col("chapter"), F.col("verse")))
    ko = C.last_by_key(local, ["key"], ["line_no"], ["book_en", "chapter", "verse", "text"])
    en = C.last_by_key(C.parse_lines(files.text_lines(spark, en_path)), ["key"], ["line_no"], ["text"])
    both = C.join_languages(ko.select("key", F.col("text").alias("ko")), en.select("key", F.col("text").alias("en")))
    rows = both.join(ko.select("key", "book_en", "chapter", "verse"), "key")
    rows = C.with_dimension(rows.withColumnRenamed("ko", "ko_text"), dimension.withColumnRenamed("ko", "ko_name"))
    rows = C.with_tags(rows, canon.book_tags(spark), canon.genre_tags(spark))
    rows = C.numbered(rows, ["book_ord", "chapter", "verse", "key"])
    embed = X.embed_text(F.col("ko_text"), F.col("en"), F.col("tags"))
    return rows.select("id", "key", "book_en", "book_ko", "chapter", "verse", "testament", "genre", F.col("ko_text").alias("ko"), "en", embed.alias("embed_text"))


#: Seconds that an expansion, an embedding and a reranking may take, and after which a search no longer reranks.
EXPAND_S, EMBED_S, RERANK_S, BUDGET_S = 4.0, 5.0, 5.0, 7.0


def search(
    verses: DataFrame, query: str, vectors: DataFrame | None = None, dim: int = 0, embed: Callable[[str], Sequence[float] | None] | None = None,
    expand: Callable[[str], str | None] | None = None, rerank: Callable[[str, str, str | None], str | None] | None = None, clock: Callable[[], float] = time.monotonic,
    index: DataFrame | None = None,
) -> DataFrame:
    """The answer to a query as one row. Models are callables on the driver; each may be left out, give None, fail or be late.

    Vectors are a table, or the parts of a stored ``index`` (``dense.grow_index``) whose ids are those of the verses, from 0.
    Expansion and embedding run side by side. The dense leg ranks by the query itself, the sparse leg by its expansion. A
    reranker sees the numbered list of candidates; without one, with three candidates or fewer, or once ``BUDGET_S``
    seconds are over, the hybrid order stands.
    """
    query, began = S.checked_query(query), clock()
    expansion, vector = M.attempt(expand, query, seconds=EXPAND_S), M.attempt(embed, query, seconds=EMBED_S)
    expansion, vector = expansion(), vector()
    if expansion is not None:
        found = verses.sparkSession.range(1).select(S.expansion_of(F.lit(expansion))["search_query"]).first()[0]
        expansion, sparse_query = (expansion, found) if found else (None, query)
    else:
        sparse_query = query
    text = X.search_text(F.col("ko"), F.col("en"), F.col("embed_text"))
    sparse = S.sparse_topk(verses, sparse_query, text)
    dense = None
    if vector is not None and vectors is not None:
        dense = S.dense_topk(vectors.join(verses.select("id"), "id", "left_semi"), vector, dim)
    elif vector is not None and index is not None:
        asked = verses.sparkSession.createDataFrame([(0, [float(x) for x in vector[:dim]])], "query_id long, embedding array<float>")
        last = verses.agg(F.max("id")).first()[0]  # parts beyond the verses aren't read
        dense = D.index_topk_batch(index, asked, dim, S.LEG, 0, -1 if last is None else last).select("id", "similarity", "dense_rank")
    top = cut(S.fuse(dense, sparse, vector is not None))  # fifteen rows that the reranker and the answer both read
    reply = None
    if rerank and clock() - began < BUDGET_S and top.count() > 3:
        listing = S.candidate_list(top.join(verses, "id"), F.concat_ws(" ", "book_ko", F.concat_ws(":", "chapter", "verse"), F.lit("-"), "ko"))
        reply = M.attempt(rerank, query, listing.first()["listing"], expansion, seconds=RERANK_S)()
    best = S.apply_rerank(top, F.lit(reply).cast("string"))
    hits = best.join(verses, "id").select("position", "rank", "score", "rerank_reason", "id", F.col("book_en").alias("book"), "chapter", "verse", "book_ko", "ko", "en")
    named = verses.withColumnRenamed("book_en", "book").select("book", "chapter", "verse", "ko", "en")
    results = S.with_context(hits, named, ["ko", "en"])
    return S.envelope(results, query, F.lit(verses.count()), vector is not None, F.lit(expansion).cast("string"))


def segment_prompts(verses: DataFrame) -> DataFrame:
    """(book, chapter, n_verses, block): what a segmenter is shown of each chapter."""
    rows = verses.select("id", F.col("book_en").alias("book"), "chapter", "verse", F.col("ko").alias("text"), F.lit("").alias("role"))
    groups = C.chapters(rows)
    return groups.join(C.prompt_block(groups), ["book", "chapter"]).select("book", "chapter", "n_verses", "block")


def build_segments(spark: SparkSession, path: str, verses: DataFrame, model: Callable[[str], str | None], lease: M.Lease | None = None, steps: int = 10, restart: bool = False) -> M.Progress:
    """Ask a segmenter about each chapter that the table of replies at ``path`` lacks, in parts that are written one by one.

    What a part got is kept if the next fails, the quota ends or the ``lease`` is used up; calling it again goes on from
    there, ``restart`` begins anew. A chapter whose call fails for good has a null reply, and counts as done.
    """
    prompts = segment_prompts(verses).select(F.to_json(F.struct("book", "chapter")).alias("key"), F.col("block").alias("prompt"))
    return M.build(spark, path, "key", prompts, lambda todo: M.replied(todo, model, lease=lease), steps, restart)


def replies(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, reply) of a table that ``build_segments`` wrote."""
    key = F.from_json("key", "book string, chapter long")
    return spark.read.parquet(path).select(key["book"].alias("book"), key["chapter"].alias("chapter"), "reply")


def build_passages(verses: DataFrame, replies: DataFrame) -> DataFrame:
    """The passage table from a segmenter's replies (book, chapter, reply); a chapter without a reply is one passage."""
    facts = verses.groupBy(F.col("book_en").alias("book"), "chapter").agg(
        F.count("*").cast("int").alias("n_verses"), F.min_by("book_ko", "id").alias("book_ko"), F.min_by("testament", "id").alias("testament"), F.min_by("genre", "id").alias("genre")
    )
    asked = facts.join(replies.select("book", "chapter", "reply"), ["book", "chapter"], "left").withColumn("reply", F.coalesce("reply", F.lit("")))
    spans = G.clipped(G.paragraphs(asked.select("book", "chapter", "n_verses", "reply")))
    whole = G.named(G.normalized(spans, ["book", "chapter"], ["pos"], facts.select("book", "chapter", "n_verses"))).join(facts.drop("n_verses"), ["book", "chapter"])
    rows = G.records(whole, F.col("book"), F.col("chapter"))
    label = X.range_label(F.col("book_ko"), F.col("chapter"), F.col("verse_start"), F.col("verse_end"))
    return rows.select(
        "id", F.col("book").alias("book_en"), "book_ko", "chapter", "verse_start", "verse_end", label.alias("range_label"), "verse_keys", "testament", "genre",
        "theme_title", "characteristics", "core_meaning",
    )


def write_passages(passages: DataFrame, path: str) -> None:
    """The passage table by book; books that are built again are replaced, all others stay."""
    files.write_versioned(passages, path, "book_en")
