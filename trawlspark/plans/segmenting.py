"""Segment queries: order lines as a model's intervals, conversations as chapters and as what a model replies to."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import models as M, segments as G
from ..storage import checkpoint_dir
from . import pipelines

N = 40
TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

def _replies(spark: SparkSession, d: str) -> DataFrame:
    """A segmenter's reply to each conversation, by its number: fenced ones, plain ones, with odd numbers, fields left out,
    blanks, text that is no JSON, no paragraphs; titles and meanings come from its turns."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    talks = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"), F.min_by("role", F.struct("turn", "role")).alias("role"), F.md5(F.coalesce(F.min("text"), F.lit(""))).alias("m"))
    half = F.floor((F.col("n") + 1) / 2).cast("string")
    n = F.col("n").cast("string")
    head = F.concat(F.lit('{"paragraphs": [{"verse_start": 1, "verse_end": '), half, F.lit(', "theme_title": "\\t'), "role", F.lit(' ", "characteristics": ["'), F.substr("m", F.lit(1), F.lit(4)), F.lit('", "\\t", " b "], "core_meaning": " '), "m", F.lit(' "}'))
    tail = F.concat(F.lit(', {"verse_start": "'), half, F.lit('", "verse_end": '), n, F.lit('.7, "theme_title": ""}, {"verse_start": "q", "verse_end": 4}, {"verse_end": 5, "theme_title": "no start"}]}'))
    text = F.concat(head, tail)
    reply = (
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(F.col("conv_id") % 5 == 1, text)
        .when(F.col("conv_id") % 5 == 2, F.concat(F.lit("sorry, "), "role")).when(F.col("conv_id") % 5 == 3, F.lit('{"paragraphs": []}')).otherwise(F.concat(F.lit("```\n"), head, F.lit("]}\n```")))
    )
    return talks.select(F.lit("B").alias("book"), F.col("conv_id").alias("chapter"), F.col("n").alias("n_verses"), reply.alias("reply"))


def explode_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = G.clipped(G.paragraphs(_replies(spark, d)))
    return rows.select("book", "chapter", "pos", "verse_start", "verse_end", "theme_title", F.array_join("characteristics", ",").alias("characteristics"), "core_meaning")


def split_in_two(prompt: str) -> str:
    """What stands for a segmenter here: two halves of a chapter, titled by a hash of its prompt; every fourth gets no JSON."""
    digest, n = hashlib.md5(prompt.encode()).hexdigest(), prompt.count("\n") + 1
    if digest[0] in "0123":
        return "no " + digest
    half = (n + 1) // 2
    spans = [(1, half), (half + 1, n)]
    return json.dumps({"paragraphs": [{"verse_start": s, "verse_end": e, "theme_title": digest[:8], "characteristics": [digest[8:12]], "core_meaning": digest[12:]} for s, e in spans if s <= e]})


def segment_build_resume(spark: SparkSession, d: str) -> DataFrame:
    """The whole segment build over conversations as chapters: prompts, a segmenter's replies in parts that are kept and gone on
    with, first with twenty calls for each of two parts, then without a limit; then the passages of all chapters."""
    talks = spark.read.parquet(f"{d}/conversations.parquet").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    verses = talks.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("C").alias("book_en"), F.lit("씨").alias("book_ko"), F.lit("OT").alias("testament"), F.lit("g").alias("genre"),
        F.col("conv_id").alias("chapter"), (F.col("turn") + 1).cast("int").alias("verse"), F.md5(F.coalesce("text", F.lit(""))).alias("ko"),
    )
    path = f"{checkpoint_dir(spark)}/segments-{uuid.uuid4().hex}"
    for lease in (M.Lease(20, lanes=4), None):
        done = pipelines.build_segments(spark, path, verses, split_in_two, lease=lease, steps=2)
    pipelines.write_passages(pipelines.build_passages(verses, pipelines.replies(spark, path)), f"{path}-passages")
    rows = spark.read.parquet(f"{path}-passages")
    return rows.select("id", "range_label", F.array_join("verse_keys", ",").alias("verse_keys"), "theme_title", F.array_join("characteristics", ",").alias("characteristics"), "core_meaning", F.lit(done.left).cast("long").alias("n_left"))


def _intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    start = (F.col("l_partkey") % 45 - 2).cast("int")
    rows = lines.select(F.col("l_orderkey").alias("ch"), *TIES, start.alias("verse_start"), (start + (F.col("l_quantity") % 9).cast("int")).alias("verse_end"), F.lit(N).alias("n_verses"))
    chapters = lines.select(F.col("l_orderkey").alias("ch")).distinct().withColumn("n_verses", F.lit(N))
    return G.clipped(rows), chapters


def normalize_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows, chapters = _intervals(spark, d)
    return G.normalized(rows, ["ch"], TIES, chapters).select("ch", "verse_start", "verse_end", "filler")


def segment_records(spark: SparkSession, d: str) -> DataFrame:
    rows = G.records(normalize_intervals(spark, d), F.lit("O"), F.col("ch"))
    title = F.when(F.col("filler"), F.lit(G.FILLER_TITLE)).otherwise(F.lit(G.NO_TITLE))
    return rows.select("id", "range_label", F.array_join("verse_keys", ",").alias("verse_keys"), title.alias("theme_title"))


def hydrate_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of two turns too many, so that keys are missing at the end of each conversation."""
    talks = spark.read.parquet(f"{d}/conversations.parquet")
    verses = talks.select(F.lit("C").alias("book"), F.col("conv_id").alias("chapter"), (F.col("turn") + 1).cast("int").alias("verse"), F.col("role").alias("ko"), F.md5("text").alias("en"))
    ends = talks.groupBy("conv_id").agg((F.max("turn") + 3).cast("int").alias("e"))
    segments = ends.select(X.segment_id(F.lit("C"), F.col("conv_id"), F.lit(1), F.col("e")).alias("id"), F.lit("C").alias("book"), F.col("conv_id").alias("chapter"), F.lit(1).alias("verse_start"), F.col("e").alias("verse_end"))
    rows = G.hydrated(segments, verses)
    shown = F.transform("verses", lambda v: F.concat_ws("|", v["verse"].cast("string"), v["ko"], v["en"]))
    return rows.select("id", F.array_join(shown, ";").alias("verses"))


QUERIES = {f.__name__: f for f in (explode_paragraphs, segment_build_resume, normalize_intervals, segment_records, hydrate_segments)}

_FOLD = f"""
lines AS (
  SELECT l_orderkey AS ch, l_linenumber, l_partkey, l_suppkey, l_extendedprice, greatest(1, l_partkey % 45 - 2)::INT AS s, least({N}, l_partkey % 45 - 2 + (l_quantity % 9)::INT)::INT AS e FROM lineitem
), sorted AS (
  SELECT ch, s, e, row_number() OVER (PARTITION BY ch ORDER BY s, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lines WHERE s <= e
), fold(ch, rn, cur, parts) AS (
  SELECT DISTINCT l_orderkey, 0::BIGINT, 1::INT, []::STRUCT(s INT, e INT, filler BOOLEAN)[] FROM lineitem
  UNION ALL
  SELECT f.ch, o.rn, greatest(f.cur, o.e + 1)::INT,
         list_concat(list_concat(f.parts, CASE WHEN o.s > f.cur THEN [{{'s': f.cur, 'e': (o.s - 1)::INT, 'filler': true}}] ELSE [] END),
                     CASE WHEN o.e >= f.cur THEN [{{'s': greatest(f.cur, o.s)::INT, 'e': o.e, 'filler': false}}] ELSE [] END)
  FROM fold f JOIN sorted o ON o.ch = f.ch AND o.rn = f.rn + 1
), last AS (SELECT ch, arg_max(parts, rn) AS parts, arg_max(cur, rn) AS cur FROM fold GROUP BY ch),
whole AS (SELECT ch, unnest(list_concat(parts, CASE WHEN cur <= {N} THEN [{{'s': cur, 'e': {N}::INT, 'filler': true}}] ELSE [] END)) AS p FROM last),
segments AS (SELECT ch, p.s AS verse_start, p.e AS verse_end, p.filler AS filler FROM whole)"""

_REPLIES = r"""
talks AS (
  SELECT conv_id, count(*)::INT AS n, arg_min(role, (turn, role)) AS role, md5(coalesce(min(text), '')) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id
), halves AS (SELECT *, (n + 1) // 2 AS half FROM talks), heads AS (
  SELECT *, '{"paragraphs": [{"verse_start": 1, "verse_end": ' || half || ', "theme_title": "\t' || role || ' ", "characteristics": ["' || substr(m, 1, 4) || '", "\t", " b "], "core_meaning": " ' || m || ' "}' AS head,
         ', {"verse_start": "' || half || '", "verse_end": ' || n || '.7, "theme_title": ""}, {"verse_start": "q", "verse_end": 4}, {"verse_end": 5, "theme_title": "no start"}]}' AS tail FROM halves
), replies AS (
  SELECT conv_id, n, CASE conv_id % 5 WHEN 0 THEN '```json' || chr(10) || head || tail || chr(10) || '```' WHEN 1 THEN head || tail WHEN 2 THEN 'sorry, ' || role
         WHEN 3 THEN '{"paragraphs": []}' ELSE '```' || chr(10) || head || ']}' || chr(10) || '```' END AS reply FROM heads
), stripped AS (SELECT conv_id, n, trim(regexp_replace(regexp_replace(reply, '^```(json)?\s*', ''), '\s*```$', '')) AS reply FROM replies),
parsed AS (SELECT conv_id, n, CASE WHEN json_valid(reply) THEN from_json(json_extract(reply, '$.paragraphs'), '["JSON"]') END AS p FROM stripped),
spans AS (
  SELECT conv_id AS chapter, n, (i - 1)::INT AS pos, p[i] AS x FROM (SELECT * FROM parsed WHERE len(p) > 0), unnest(range(1, len(p) + 1)) AS t(i)
), numbers AS (
  SELECT *, TRY_CAST(regexp_extract(x->>'verse_start', '^([+-]?\d+)(\.\d+)?$', 1) AS INT) AS s, TRY_CAST(regexp_extract(x->>'verse_end', '^([+-]?\d+)(\.\d+)?$', 1) AS INT) AS e FROM spans
)"""

SQL = {
    "explode_paragraphs": rf"""WITH {_REPLIES}
SELECT 'B' AS book, chapter, pos, greatest(s, 1)::INT AS verse_start, least(e, n)::INT AS verse_end, coalesce(nullif(trim(x->>'theme_title', ' ' || chr(9)), ''), '단락') AS theme_title,
       coalesce(array_to_string(list_filter(list_transform(from_json(x->'characteristics', '["VARCHAR"]'), lambda c: trim(c, ' ' || chr(9))), lambda c: c <> ''), ','), '') AS characteristics,
       coalesce(trim(x->>'core_meaning'), '') AS core_meaning FROM numbers WHERE s IS NOT NULL AND e IS NOT NULL AND greatest(s, 1) <= least(e, n)
UNION ALL SELECT 'B', conv_id, 0::INT, 1::INT, n, 'B ' || conv_id || '장', '', '' FROM parsed WHERE coalesce(len(p), 0) = 0""",
    "segment_build_resume": """
WITH chapters AS (
  SELECT conv_id AS c, count(*)::INT AS n, md5(string_agg((turn + 1) || ': ' || md5(coalesce(text, '')), chr(10) ORDER BY turn)) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id
), spans AS (
  SELECT c, m, true AS whole, 1::INT AS s, n AS e FROM chapters WHERE m < '4'
  UNION ALL SELECT c, m, false, 1::INT, ((n + 1) // 2)::INT FROM chapters WHERE m >= '4' UNION ALL SELECT c, m, false, ((n + 1) // 2 + 1)::INT, n FROM chapters WHERE m >= '4' AND n > 1
)
SELECT 'C:' || c || ':' || s || '-' || e AS id, '씨 ' || c || ':' || s || CASE WHEN s = e THEN '' ELSE '-' || e END AS range_label, array_to_string(list_transform(range(s, e + 1), lambda v: 'C:' || c || ':' || v), ',') AS verse_keys,
       CASE WHEN whole THEN 'C ' || c || '장' ELSE substr(m, 1, 8) END AS theme_title, CASE WHEN whole THEN '' ELSE substr(m, 9, 4) END AS characteristics, CASE WHEN whole THEN '' ELSE substr(m, 13) END AS core_meaning, 0::BIGINT AS n_left
FROM spans""",
    "normalize_intervals": f"WITH RECURSIVE {_FOLD} SELECT ch, verse_start, verse_end, filler FROM segments",
    "segment_records": f"""WITH RECURSIVE {_FOLD}
SELECT 'O:' || ch || ':' || verse_start || '-' || verse_end AS id, 'O ' || ch || ':' || verse_start || CASE WHEN verse_start = verse_end THEN '' ELSE '-' || verse_end END AS range_label,
       array_to_string(list_transform(range(verse_start, verse_end + 1), lambda v: 'O:' || ch || ':' || v), ',') AS verse_keys, CASE WHEN filler THEN '본문' ELSE '단락' END AS theme_title
FROM segments""",
    "hydrate_segments": """
WITH ends AS (SELECT conv_id, max(turn) + 3 AS e FROM conversations GROUP BY conv_id),
keys AS (SELECT conv_id, e, unnest(range(1, e + 1)) AS v FROM ends)
SELECT 'C:' || k.conv_id || ':1-' || e AS id, string_agg(CASE WHEN c.turn IS NULL THEN '0||' ELSE v || '|' || role || '|' || md5(text) END, ';' ORDER BY v) AS verses
FROM keys k LEFT JOIN conversations c ON c.conv_id = k.conv_id AND c.turn + 1 = v GROUP BY k.conv_id, e""",
}
