"""Hybrid search: two ranked legs, their fusion, a reranker's answer, and context."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from .. import schemas
from ..functions import text as X, vectors as V

# Fixed values of the ranking.
LEG, TOP, FINAL, RRF, DENSE_WEIGHT, NEIGHBOURS = 300, 15, 5, 60, 0.65, 2


def _ranked(rows: DataFrame, order: list[Column], name: str, k: int) -> DataFrame:
    """The first k rows with their rank. The limit goes first, so that the global window sees k rows only."""
    return rows.orderBy(*order).limit(k).withColumn(name, F.row_number().over(W.orderBy(*order)))


def sparse_topk(docs: DataFrame, query: str, text: Column, k: int = LEG) -> DataFrame:
    """(id, sparse_score, sparse_rank): documents by the weights of the query's tokens that they contain."""
    scored = docs.select("id", X.match_score(text, X.token_weights(query)).alias("sparse_score")).where("sparse_score > 0")
    return _ranked(scored, [F.desc("sparse_score"), F.asc("id")], "sparse_rank", k)


def dense_topk(vectors: DataFrame, query: Sequence[float], dim: int, k: int = LEG) -> DataFrame:
    """(id, similarity, dense_rank) for ``vectors`` (id, embedding): cosine over the dimensions that both sides have."""
    use = min(len(query), dim)
    v = F.col("embedding") if use == dim else F.slice("embedding", 1, use)
    v_norm = V.stored_norm(F.col("embedding")) if use == dim else V.norm(v)
    q = V.literal(query[:use])
    length = sum(float(x) * float(x) for x in query[:use]) ** 0.5
    scored = vectors.select("id", V.cosine(v, v_norm, q, F.lit(length)).alias("similarity"))
    return _ranked(scored, [F.desc("similarity"), F.asc("id")], "dense_rank", k)


def fuse(dense: DataFrame | None, sparse: DataFrame, has_query_vector: bool, k: int = TOP) -> DataFrame:
    """Reciprocal rank fusion: (id, dense_rank, sparse_rank, score, rank). A leg that misses a document ranks it last.

    The dense weight follows from the query having a vector, whether or not there is an index to rank by.
    """
    weight = DENSE_WEIGHT if has_query_vector else 0.0
    if dense is None:
        both = sparse.select("id", F.lit(None).cast("int").alias("dense_rank"), "sparse_rank")
    else:
        both = dense.select("id", "dense_rank").join(sparse.select("id", "sparse_rank"), "id", "full")
    part = lambda w, c: F.lit(w) * (F.lit(1.0) / (F.lit(float(RRF)) + F.coalesce(F.col(c), F.lit(LEG)).cast("double")))
    both = both.withColumn("rrf", part(weight, "dense_rank") + part(1 - weight, "sparse_rank"))
    order = [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")]
    return _ranked(both, order, "rank", k).select("id", "dense_rank", "sparse_rank", rounded(F.col("rrf")).alias("score"), "rank")


def rounded(score: Column) -> Column:
    return F.floor(score * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def apply_rerank(candidates: DataFrame, reply: Column, k: int = FINAL) -> DataFrame:
    """(id, rank, score, position, rerank_reason): candidates in the order of a reranker's reply.

    ``candidates`` has id, rank 1..n and score; ``reply`` is the reply's text. Places outside 1..n and repeated ones are
    skipped; the rank stays the hybrid one. With three candidates or fewer, a reply that can't be read, or no valid
    place, the first candidates pass in their own order.
    """
    row = candidates.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("all"))
    row = row.withColumn("results", F.coalesce(F.from_json(X.strip_fences(reply), schemas.RERANK)["results"], F.from_json(F.lit("[]"), "array<struct<index:int,reason:string>>")))
    index = F.transform("results", lambda r: r["index"])
    picks = F.filter("results", lambda r, at: r["index"].between(1, F.size("all")) & (F.array_position(index, r["index"]) == at + 1))
    row = row.withColumn("picks", picks)
    hit = lambda r, reason: F.struct(r["id"].alias("id"), r["rank"].alias("rank"), r["score"].alias("score"), reason.alias("rerank_reason"))
    own = F.transform(F.slice("all", 1, k), lambda r: hit(r, F.lit(None).cast("string")))
    replied = F.transform(F.slice("picks", 1, k), lambda p: hit(F.element_at("all", p["index"]), p["reason"]))
    passes = (F.size("all") <= 3) | (F.size("picks") == 0)
    out = row.select(F.posexplode(F.when(passes, own).otherwise(replied)).alias("at", "hit"))
    return out.select("hit.id", "hit.rank", "hit.score", (F.col("at") + 1).alias("position"), "hit.rerank_reason")


def with_context(hits: DataFrame, verses: DataFrame, columns: Sequence[str], around: int = NEIGHBOURS) -> DataFrame:
    """``hits`` with context: the verses of the same book and chapter up to ``around`` away, by verse, itself included.

    Hits name (book, chapter, verse). Each hit asks for the keys that it may find, an equi-join instead of a band: for hits
    that are few beside the verses. ``all_contexts`` is for the others.
    """
    wanted = hits.withColumn("_v", F.explode(F.sequence(F.greatest(F.lit(1), F.col("verse") - around), F.col("verse") + around)))
    near = verses.select(F.col("book").alias("_b"), F.col("chapter").alias("_c"), F.col("verse").alias("_v"), F.struct("verse", *columns).alias("_row"))
    on = (wanted["book"] == near["_b"]) & (wanted["chapter"] == near["_c"]) & (wanted["_v"] == near["_v"])
    joined = wanted.join(near, on).groupBy(*[wanted[c] for c in hits.columns]).agg(F.array_sort(F.collect_list("_row")).alias("context"))
    return joined


#: Verses of a chapter that one window sees.
TILE = 1024


def all_contexts(verses: DataFrame, columns: Sequence[str], around: int = NEIGHBOURS) -> DataFrame:
    """Every row of ``verses`` (book, chapter, verse, ...) with context: the rows of its chapter up to ``around`` away.

    A window with a RANGE frame over tiles of ``TILE`` verses, which are dealt out once; the verses at a tile's edge go to
    the next tile too, where they are seen only. Neither hits nor verses are multiplied, and a long chapter is many tiles.
    Rows that repeat a verse are all in its context; a null verse or chapter has no neighbours and isn't returned.
    """
    v = F.col("verse").cast("long")
    tile = lambda x: F.floor(x / F.lit(TILE))
    tiles = F.array_distinct(F.array(tile(v), tile(v - around), tile(v + around)))
    dealt = verses.where("book IS NOT NULL AND chapter IS NOT NULL AND verse IS NOT NULL").withColumn("_tile", F.explode(tiles))
    frame = W.partitionBy("book", "chapter", "_tile").orderBy(v).rangeBetween(-around, around)
    seen = dealt.withColumn("context", F.array_sort(F.collect_list(F.struct("verse", *columns)).over(frame)))
    return seen.where(F.col("_tile") == tile(v)).drop("_tile")


def expansion_of(reply: Column) -> Column:
    """A model's expansion of the query: the fences round it go, and one that can't be read or has no query is none."""
    parsed = F.from_json(X.strip_fences(reply), schemas.EXPANSION)
    return F.when(F.coalesce(parsed["search_query"], F.lit("")) != "", parsed)


def envelope(results: DataFrame, query: str, total: Column, used_dense: bool, expansion: Column | None = None) -> DataFrame:
    """One row: the request, what was used, and the results in order. A model was used if it gave an expansion, whatever a
    reranker says later."""
    parsed = expansion_of(expansion if expansion is not None else F.lit(None).cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("position", *[c for c in results.columns if c != "position"])))
    none = F.array().cast("array<string>")
    return results.agg(rows.alias("results")).select("results", parsed.alias("parsed")).select(
        F.lit(query).alias("query"),
        F.col("parsed.search_query").alias("expanded_query"),
        F.coalesce(F.col("parsed.emotions"), none).alias("emotions"),
        F.coalesce(F.col("parsed.biblical_keywords"), none).alias("biblical_keywords"),
        total.alias("total"),
        F.lit(used_dense).alias("usedDense"),
        F.col("parsed").isNotNull().alias("usedGemini"),
        F.when(F.col("parsed").isNotNull(), F.lit("AI")).when(F.lit(used_dense), F.lit("semantic")).otherwise(F.lit("keyword")).alias("mode"),
        "results",
    )


def checked_query(query: str) -> str:
    """The trimmed query; an empty one, or one of over 300 characters, is refused."""
    trimmed = re.sub(f"^[{X.SPACES}]+|[{X.SPACES}]+$", "", query)
    if not trimmed:
        raise ValueError("the query is empty")
    if len(trimmed) > X.MAX_QUERY:
        raise ValueError(f"the query has more than {X.MAX_QUERY} characters")
    return trimmed


def candidate_list(candidates: DataFrame, line: Column) -> DataFrame:
    """One row (listing): ``[rank] line`` for each candidate, in order, as a reranker's prompt shows them."""
    numbered = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), line).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(numbered)), lambda s: s["line"])
    return candidates.agg(F.array_join(lines, "\n").alias("listing"))


def hint_lines(expansion: Column) -> Column:
    """Struct (emotions, needs): the expansion's emotions and first four keywords, joined."""
    parsed, none = expansion_of(expansion), F.array().cast("array<string>")
    needs = F.array_join(F.slice(F.coalesce(parsed["biblical_keywords"], none), 1, 4), ", ")
    return F.struct(F.array_join(F.coalesce(parsed["emotions"], none), ", ").alias("emotions"), needs.alias("needs"))
