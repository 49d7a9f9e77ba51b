"""Index building queries: quantising, dense files, model calls that continue."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..operators import models as M
from ..sources import files as S
from ..storage import checkpoint_dir


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def quantize(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = S.quantized_table(_vectors(spark, d))
    return rows.select("id", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows, found = S.quantized_table(_vectors(spark, d))
    rows = rows.join(F.broadcast(found), how="cross")  # one row
    return rows.select("id", V.dequantized(F.col("q"), F.col("vmin"), F.col("scale")).alias("back"), "scale")


def dequantize(spark: SparkSession, d: str) -> DataFrame:
    rows = _round_trip(spark, d)
    total = F.aggregate("back", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("id", F.round(F.element_at("back", 1).cast("double"), 6).alias("first"), F.round(total, 4).alias("total"), F.round(V.stored_norm(F.col("back")).cast("double"), 5).alias("norm"))


def quantization_error(spark: SparkSession, d: str) -> DataFrame:
    rows = _round_trip(spark, d).join(_vectors(spark, d), "id")
    worst = F.array_max(F.zip_with("back", "embedding", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return rows.select(worst.alias("worst"), "scale").agg(F.count("*").alias("n"), F.round(F.max("worst"), 6).alias("worst"), F.count_if(F.col("worst") > F.col("scale") / 2 + 1e-7).alias("beyond"))


def sparse_map_filter(spark: SparkSession, d: str) -> DataFrame:
    """Each document's words by share of its text, as an encoder's weights. A row is a document, ids are unique."""
    found = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.filter(F.split("text", r"[ \n]+"), lambda w: w != "").alias("words"))
    words = found.select("doc_id", F.size("words").alias("all"), F.explode("words").alias("w"))
    counts = words.groupBy("doc_id", "all", "w").agg(F.count("*").alias("n"))
    # a weight that counts is one of at most a hundred of a document
    share = F.col("n") / F.col("all")
    maps = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(share > 0.01, F.struct("w", share.alias("share"))))).alias("m"))
    reply = M.encoded_reply(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.125)), F.col("m"), 2)
    kept = maps.select("doc_id", reply.alias("r"))
    total = F.aggregate(F.map_values("r.sparse"), F.lit(0.0), lambda s, x: s + x)
    return kept.select("doc_id", F.size("r.sparse").alias("n_kept"), F.round(total, 4).alias("total"), F.size("r.dense").alias("dim"))


def dense_binary_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = S.read_dense(S.dense_parts(_vectors(spark, d), 64))
    return back.select("id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.round(F.col("norm").cast("double"), 5).alias("norm"))


def digest_vectors(texts: Sequence[str]) -> list[list[float]]:
    """What stands for a model here: four numbers from a hash of each text."""
    return [[b / 255.0 for b in hashlib.sha256(t.encode()).digest()[:4]] for t in texts]


def batch_embed_resume(spark: SparkSession, d: str) -> DataFrame:
    """A build that is given one call for each of its parts, then two, then as many as it takes."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    path = f"{checkpoint_dir(spark)}/embedded-{uuid.uuid4().hex}"
    for lease in (M.Lease(1), M.Lease(2), None):
        M.build(spark, path, "id", rows, lambda todo, lease=lease: M.embedded(todo, digest_vectors, lease=lease), steps=2)
    out = spark.read.parquet(path)
    return out.select("id", F.array_join(F.transform("embedding", lambda x: F.rint(x * 255).cast("int").cast("string")), ",").alias("bytes"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON arrays and read back."""
    path = f"{checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    S.write_json(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text"), path)
    back = S.json_rows(spark, path, "doc_id LONG, lang STRING, text STRING")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (quantize, dequantize, quantization_error, sparse_map_filter, dense_binary_roundtrip, batch_embed_resume, json_round_trip)}

_QUANTIZED = """
limits AS (SELECT min(x)::DOUBLE AS vmin, max(x)::DOUBLE AS vmax, (max(x)::DOUBLE - min(x)::DOUBLE) / 255.0::DOUBLE AS scale FROM (SELECT unnest(embedding) AS x FROM embeddings)),
quantized AS (
  SELECT vec_id AS id, embedding, list_transform(embedding, lambda x: greatest(0, least(255, round_even((x::DOUBLE - vmin) / scale, 0)))::INT) AS q, vmin, scale FROM embeddings, limits
), back AS (SELECT id, embedding, list_transform(q, lambda x: (x::DOUBLE * scale + vmin)::FLOAT) AS back FROM quantized)"""

SQL = {
    "quantize": f"WITH {_QUANTIZED} SELECT id, array_to_string(q, ',') AS q FROM quantized",
    "dequantize": f"""WITH {_QUANTIZED}
SELECT id, round(back[1]::DOUBLE, 6) AS first, round(list_sum(back::DOUBLE[]), 4) AS total, round(sqrt(list_dot_product(back::DOUBLE[], back::DOUBLE[]))::FLOAT::DOUBLE, 5) AS norm FROM back""",
    "quantization_error": f"""WITH {_QUANTIZED}, errors AS (
  SELECT id, list_max(list_transform(range(1, 65), lambda i: abs(back[i]::DOUBLE - embedding[i]::DOUBLE))) AS worst FROM back)
SELECT count(*) AS n, round(max(worst), 6) AS worst, count(*) FILTER (worst > (SELECT scale FROM limits) / 2 + 1e-7) AS beyond FROM errors""",
    "sparse_map_filter": r"""
WITH words AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '')) AS w FROM documents),
shares AS (SELECT doc_id, w, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS share FROM words GROUP BY doc_id, w)
SELECT doc_id, (count(*) FILTER (share > 0.01))::INT AS n_kept, round(coalesce(sum(round(share, 4)) FILTER (share > 0.01), 0), 4) AS total, 2::INT AS dim FROM shares GROUP BY doc_id""",
    "dense_binary_roundtrip": f"""WITH {_QUANTIZED}
SELECT id, round(back[1]::DOUBLE, 6) AS first, round(sqrt(list_dot_product(back::DOUBLE[], back::DOUBLE[]))::FLOAT::DOUBLE, 5) AS norm FROM back""",
    "json_round_trip": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "batch_embed_resume": """
SELECT doc_id AS id, array_to_string(list_transform(range(0, 4), lambda i: ('0x' || substr(sha256(coalesce(text, '')), (2 * i + 1)::INT, 2))::INT), ',') AS bytes FROM documents""",
}
