"""Search queries: documents as verses, embeddings as the index, conversations as chapters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import dense as D, postings as I, search as S
from ..storage import checkpoint_dir

QUERY = "worthless the tion"
DIM, PREFIX, ROWS_OF = 64, 32, 128

# The preset queries.
PRESETS = (
    "힘들고 외로울 때 위로와 평안",
    "두려움을 이기는 용기와 담대함",
    "하나님의 사랑과 은혜",
    "감사와 찬양 기쁨",
    "마음의 평안과 안식",
    "믿음과 소망 확신",
    "고난과 시련을 이겨내는 힘",
    "지혜와 인도하심을 구함",
    "용서와 화해 사랑",
    "지치고 힘들 때 새 힘과 회복",
)
REPLY = '```json\n{"results": [{"index": 4, "reason": "close"}, {"index": 2, "reason": "near"}, {"index": 4, "reason": "again"}, {"index": 99, "reason": "none"}, {"index": 0, "reason": "none"}, {"index": 11, "reason": null}]}\n```'
EXPANSION = '{"emotions": ["calm", "hope"], "biblical_keywords": ["rest", "peace", "light", "way", "home"], "search_query": "worthless the tion"}'


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def _text():
    return X.search_text(F.col("text"), F.col("source"), F.col("lang"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(_vectors(spark, d).where("id = 0").first()["embedding"])


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every benchmark item, and of the presets under numbers below 0."""
    presets = spark.createDataFrame([(-i - 1, q) for i, q in enumerate((*PRESETS, f"  {QUERY}\t"))], "query_id long, query string")
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return X.query_tokens(items.union(presets))


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.sparse_topk(_docs(spark, d), QUERY, _text())


def sparse_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a query, whole."""
    queries = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return I.sparse_topk_batch(_docs(spark, d), queries, _text(), 50)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.dense_topk(_vectors(spark, d), _query_vector(spark, d), DIM).withColumn("similarity", F.round("similarity", 6))


def dense_topk_prefix_dim(spark: SparkSession, d: str) -> DataFrame:
    found = S.dense_topk(_vectors(spark, d), _query_vector(spark, d)[:PREFIX], DIM)
    return found.withColumn("similarity", F.round("similarity", 6))


def dense_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector as a query, against all."""
    vectors = _vectors(spark, d)
    queries = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return D.dense_topk_batch(vectors, queries, DIM, 50).withColumn("similarity", F.round("similarity", 6))


def _grown(spark: SparkSession, d: str) -> DataFrame:
    """An index of the vectors with even ids, to which all others are added; parts are of 128 ids."""
    path, vectors = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", _vectors(spark, d)
    D.grow_index(spark, path, vectors.where("id % 2 = 0"), DIM, ROWS_OF)
    D.grow_index(spark, path, vectors, DIM, ROWS_OF)
    return spark.read.parquet(path)


def dense_index_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector as a query against the stored bytes of the ids from 100 to 399."""
    queries = _vectors(spark, d).where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return D.index_topk_batch(_grown(spark, d), queries, DIM, 25, 100, 399).withColumn("similarity", F.round("similarity", 6))


def dense_index_grown(spark: SparkSession, d: str) -> DataFrame:
    """What the grown index decodes to, and whether it is as near to the vectors as its parts' scales promise."""
    rows = D.read_parts(_grown(spark, d)).join(_vectors(spark, d).withColumnRenamed("embedding", "raw"), "id")
    worst = F.array_max(F.zip_with("embedding", "raw", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    first = F.round(F.element_at("embedding", 1).cast("double"), 6)
    return rows.select("id", first.alias("first"), F.round(F.col("norm").cast("double"), 5).alias("norm"), (worst <= F.col("scale") / 2 + 1e-7).alias("within"))


def _guarded(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that have a document at their place: the shorter side bounds the join."""
    return _vectors(spark, d).join(_docs(spark, d).select("id"), "id", "left_semi")


def positional_join_guard(spark: SparkSession, d: str) -> DataFrame:
    both = _docs(spark, d).join(_vectors(spark, d), "id")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _hybrid(spark: SparkSession, d: str, k: int = S.TOP) -> DataFrame:
    return S.fuse(S.dense_topk(_guarded(spark, d), _query_vector(spark, d), DIM), S.sparse_topk(_docs(spark, d), QUERY, _text()), True, k)


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


def hybrid_sparse_only(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(None, S.sparse_topk(_docs(spark, d), QUERY, _text()), False).drop("dense_rank")


def hybrid_weight_without_index(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(None, S.sparse_topk(_docs(spark, d), QUERY, _text()), True).drop("dense_rank")


def rerank_apply(spark: SparkSession, d: str) -> DataFrame:
    return S.apply_rerank(_hybrid(spark, d), F.lit(REPLY))


def rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    return S.apply_rerank(_hybrid(spark, d), F.lit("no json")).drop("rerank_reason")


def _verses(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select(
        F.lit("C").alias("book"), F.col("conv_id").alias("chapter"), (F.col("turn") + 1).cast("int").alias("verse"), "role", "text"
    )


def context_pm2(spark: SparkSession, d: str) -> DataFrame:
    rows = S.all_contexts(_verses(spark, d), ["role"]).where("role = 'user'")  # half of all rows
    members = F.array_join(F.transform("context", lambda c: F.concat(c["verse"].cast("string"), F.lit(c_sep := ":"), c["role"])), ",")
    shown = F.filter("context", lambda c: c["verse"] == F.col("verse"))
    return rows.select("chapter", "verse", members.alias("context"), F.size("context").alias("n_context"), (F.size("context") > 1).alias("shows_context"), F.size(shown).alias("n_self"))


def search_envelope(spark: SparkSession, d: str) -> DataFrame:
    total = _docs(spark, d).count()
    results = S.apply_rerank(_hybrid(spark, d), F.lit(REPLY)).join(_docs(spark, d).select("id", "lang"), "id")
    row = S.envelope(results, S.checked_query(f" {QUERY} "), F.lit(total).cast("long"), True, F.lit(EXPANSION))
    listing = F.transform("results", lambda r: F.concat_ws("|", r["position"].cast("string"), r["id"].cast("string"), r["rank"].cast("string"), r["lang"]))
    return row.select(
        "query", "expanded_query", F.array_join("emotions", ",").alias("emotions"), F.array_join("biblical_keywords", ",").alias("keywords"),
        "total", "usedDense", "usedGemini", "mode", F.array_join(listing, ";").alias("results"),
    )


def candidate_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = _hybrid(spark, d).join(_docs(spark, d).select("id", "lang", "source"), "id")
    return S.candidate_list(rows, F.concat_ws(" ", "lang", "source")).withColumn("hints", S.hint_lines(F.lit(EXPANSION))).select("listing", "hints.emotions", "hints.needs")


QUERIES = {f.__name__: f for f in (
    query_tokens, sparse_topk, sparse_topk_batch, dense_topk, dense_topk_prefix_dim, dense_topk_batch, dense_index_topk_batch, dense_index_grown, positional_join_guard, hybrid_rrf, hybrid_sparse_only,
    hybrid_weight_without_index, rerank_apply, rerank_fallback, context_pm2, search_envelope, candidate_listing,
)}

_TEXT = "coalesce(text, '') || ' ' || coalesce(source, '') || ' ' || coalesce(lang, '')"


def _tokens_sql(queries: str) -> str:
    return f"""
words AS (SELECT query_id, unnest(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')) AS w FROM ({queries})),
tokens AS (
  SELECT query_id, token, sum(weight)::DOUBLE AS weight FROM (
    SELECT query_id, w AS token, 1.0 AS weight FROM words
    UNION ALL SELECT query_id, substr(w, i, 2), 0.5 FROM words, unnest(range(1, length(w))) AS t(i)
  ) GROUP BY ALL
)"""


_SPARSE = f"""{_tokens_sql(f"SELECT 0 AS query_id, '{QUERY}' AS query")},
sparse AS (
  SELECT *, row_number() OVER (ORDER BY sparse_score DESC, id)::INT AS sparse_rank FROM (
    SELECT doc_id AS id, sum(weight) AS sparse_score FROM documents JOIN tokens ON contains({_TEXT}, token) GROUP BY doc_id
  ) QUALIFY sparse_rank <= 300
)"""


def _dense_sql(source: str, dim: int = DIM, full: bool = True) -> str:
    v = "embedding::DOUBLE[]" if full else f"(embedding[1:{dim}])::DOUBLE[]"
    n = "sqrt(list_dot_product(v, v))"
    return f"""
q AS (SELECT {v} AS qv FROM embeddings WHERE vec_id = 0),
dense AS (
  SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INT AS dense_rank FROM (
    SELECT id, CASE WHEN nv * nq < 1e-9 THEN 0 ELSE dot / (nv * nq) END AS similarity FROM (
      SELECT vec_id AS id, list_dot_product(v, qv) AS dot, {f"({n})::FLOAT::DOUBLE" if full else n} AS nv, sqrt(list_dot_product(qv, qv)) AS nq
      FROM (SELECT vec_id, {v} AS v FROM {source}), q
    )
  ) QUALIFY dense_rank <= 300
)"""


def _fused_sql(weight: float, dense: bool) -> str:
    ranks = "SELECT id, dense_rank, sparse_rank FROM dense FULL JOIN sparse USING (id)" if dense else "SELECT id, NULL::INT AS dense_rank, sparse_rank FROM sparse"
    return f"""
fused AS (
  SELECT *, row_number() OVER (ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST)::INT AS rank FROM (
    SELECT *, {weight}::DOUBLE * (1.0::DOUBLE / (60 + coalesce(dense_rank, 300))) + (1::DOUBLE - {weight}::DOUBLE) * (1.0::DOUBLE / (60 + coalesce(sparse_rank, 300))) AS rrf FROM ({ranks})
  ) QUALIFY rank <= 15
),
hybrid AS (SELECT id, dense_rank, sparse_rank, floor(rrf * 1e6 + 0.5) / 1e6 AS score, rank FROM fused)"""


_GUARDED = "(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"
_HYBRID = f"{_SPARSE},{_dense_sql(_GUARDED)},{_fused_sql(0.65, True)}"
_REPLY_JSON = REPLY.replace("```json\n", "").replace("\n```", "").replace("'", "''")
_RERANKED = f"""
picks AS (
  SELECT i AS place, (reply->'results'->(i::INT)->>'index')::INT AS idx, reply->'results'->(i::INT)->>'reason' AS reason
  FROM (SELECT '{_REPLY_JSON}'::JSON AS reply), unnest(range(0, json_array_length(reply->'results')::BIGINT)) AS t(i)
),
reranked AS (
  SELECT id, rank, score, row_number() OVER (ORDER BY place)::INT AS position, reason AS rerank_reason
  FROM (SELECT * FROM picks QUALIFY row_number() OVER (PARTITION BY idx ORDER BY place) = 1) JOIN hybrid ON rank = idx QUALIFY position <= 5
)"""
_PRESET_ROWS = " UNION ALL ".join(f"SELECT {-i - 1} AS query_id, '{q}' AS query" for i, q in enumerate((*PRESETS, f"  {QUERY}\t")))
_BATCH_ROWS = "SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark"

_INDEX_SQL = f"""
limits AS (
  SELECT vec_id // {ROWS_OF} AS part, vec_id % 2 AS step, min(list_min(embedding))::DOUBLE AS vmin, (max(list_max(embedding))::DOUBLE - min(list_min(embedding))::DOUBLE) / 255.0::DOUBLE AS scale FROM embeddings GROUP BY ALL
), stored AS (
  SELECT vec_id AS id, embedding, scale, list_transform(embedding, lambda x: (greatest(0, least(255, round_even((x::DOUBLE - vmin) / scale, 0)))::DOUBLE * scale + vmin)::FLOAT) AS v
  FROM embeddings JOIN limits ON part = vec_id // {ROWS_OF} AND step = vec_id % 2
)"""


def _pairs_sql(vectors: str, k: int) -> str:
    return f"""
SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS dense_rank FROM (
  SELECT query_id, id, CASE WHEN nq * nv < 1e-9 THEN 0 ELSE list_dot_product(v, q) / (nq * nv) END AS similarity FROM (
    SELECT id, v, sqrt(list_dot_product(v, v))::FLOAT::DOUBLE AS nv FROM ({vectors})
  ), (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nq FROM embeddings WHERE vec_id % 20 = 0)
) QUALIFY dense_rank <= {k}"""


SQL = {
    "query_tokens": f"WITH {_tokens_sql(f"SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL {_PRESET_ROWS}")} SELECT query_id, token, weight FROM tokens",
    "sparse_topk": f"WITH {_SPARSE} SELECT id, sparse_score, sparse_rank FROM sparse",
    "sparse_topk_batch": f"""WITH {_tokens_sql(_BATCH_ROWS)}
SELECT query_id, id, sparse_score, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, id)::INT AS sparse_rank FROM (
  SELECT query_id, doc_id AS id, sum(weight) AS sparse_score FROM documents JOIN tokens ON contains({_TEXT}, token) GROUP BY ALL
) QUALIFY sparse_rank <= 50""",
    "dense_topk": f"WITH {_dense_sql('embeddings')} SELECT id, round(similarity, 6) AS similarity, dense_rank FROM dense",
    "dense_topk_prefix_dim": f"WITH {_dense_sql('embeddings', PREFIX, False)} SELECT id, round(similarity, 6) AS similarity, dense_rank FROM dense",
    "dense_topk_batch": f"""{_pairs_sql("SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings", 50)}""",
    "dense_index_topk_batch": f"""WITH {_INDEX_SQL} {_pairs_sql("SELECT id, v::DOUBLE[] AS v FROM stored WHERE id BETWEEN 100 AND 399", 25)}""",
    "dense_index_grown": f"""WITH {_INDEX_SQL}
SELECT id, round(v[1]::DOUBLE, 6) AS first, round(sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))::FLOAT::DOUBLE, 5) AS norm,
       list_max(list_transform(range(1, 65), lambda i: abs(v[i]::DOUBLE - embedding[i]::DOUBLE))) <= scale / 2 + 1e-7 AS within FROM stored""",
    "positional_join_guard": "SELECT lang, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY lang",
    "hybrid_rrf": f"WITH {_HYBRID} SELECT * FROM hybrid",
    "hybrid_sparse_only": f"WITH {_SPARSE},{_fused_sql(0.0, False)} SELECT id, sparse_rank, score, rank FROM hybrid",
    "hybrid_weight_without_index": f"WITH {_SPARSE},{_fused_sql(0.65, False)} SELECT id, sparse_rank, score, rank FROM hybrid",
    "rerank_apply": f"WITH {_HYBRID},{_RERANKED} SELECT * FROM reranked",
    "rerank_fallback": f"WITH {_HYBRID} SELECT id, rank, score, rank AS position FROM hybrid WHERE rank <= 5",
    "context_pm2": """
WITH v AS (SELECT conv_id AS chapter, (turn + 1)::INT AS verse, role FROM conversations)
SELECT h.chapter, h.verse, string_agg(v.verse || ':' || v.role, ',' ORDER BY v.verse) AS context, count(*)::INT AS n_context, count(*) > 1 AS shows_context,
       count(*) FILTER (v.verse = h.verse)::INT AS n_self
FROM v AS h JOIN v ON v.chapter = h.chapter AND v.verse BETWEEN h.verse - 2 AND h.verse + 2 WHERE h.role = 'user' GROUP BY h.chapter, h.verse""",
    "search_envelope": f"""WITH {_HYBRID},{_RERANKED}
SELECT '{QUERY}' AS query, '{QUERY}' AS expanded_query, 'calm,hope' AS emotions, 'rest,peace,light,way,home' AS keywords, (SELECT count(*) FROM documents) AS total,
       true AS "usedDense", true AS "usedGemini", 'AI' AS mode, string_agg(position || '|' || id || '|' || rank || '|' || lang, ';' ORDER BY position) AS results
FROM reranked JOIN documents ON id = doc_id""",
    "candidate_listing": f"""WITH {_HYBRID}
SELECT string_agg('[' || rank || '] ' || lang || ' ' || source, chr(10) ORDER BY rank) AS listing, 'calm, hope' AS emotions, 'rest, peace, light, way' AS needs
FROM hybrid JOIN documents ON id = doc_id""",
}
