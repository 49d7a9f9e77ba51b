"""State queries: regions as the catalogue, customers as users, events as the log of what they have seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import state as U

SEED = "seed-7"


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("string").alias("passage_id"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k INT")["k"] % 12
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").cast("string").alias("user_id"), k.cast("string").alias("passage_id"), (F.col("event_type") != "error").alias("used"), "ts", "event_id"
    )


def _users(spark: SparkSession, d: str) -> DataFrame:
    """All customers, most of whom have no event."""
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("user_id"))


def _used(spark: SparkSession, d: str) -> DataFrame:
    """Users with an even id have state before; the others' is to come."""
    return U.replay(_log(spark, d))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "passage_id", F.date_format("used_at", "yyyy-MM-dd HH:mm:ss").alias("used_at"))


def available_passages(spark: SparkSession, d: str) -> DataFrame:
    return U.available(_users(spark, d), _catalogue(spark, d), _used(spark, d))


def valid_used_ids(spark: SparkSession, d: str) -> DataFrame:
    return U.valid(_used(spark, d), _catalogue(spark, d))


def random_pick_seeded(spark: SparkSession, d: str) -> DataFrame:
    rows = U.pick(_users(spark, d), _catalogue(spark, d), _used(spark, d), SEED)
    label = F.concat(F.col("used_count").cast("string"), F.lit("/"), F.col("total_passages").cast("string"))
    return rows.select("*", label.alias("progress"), F.lit(False).alias("is_used"))


def reset_on_exhaustion(spark: SparkSession, d: str) -> DataFrame:
    return U.after_reset(_catalogue(spark, d), _used(spark, d)).select("user_id", "passage_id")


def user_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Customers in debt are deleted, and their state with them."""
    gone = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("user_id"))
    return U.forget(_used(spark, d), gone).select("user_id", "passage_id")


def _even_odd(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """State from the first half of the log, marks from the rest."""
    log = _log(spark, d)
    return U.replay(log.where("event_id % 2 = 0")), log.where("event_id % 2 = 1 AND used").select("user_id", "passage_id", F.col("ts").alias("used_at"))


def toggle_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _shown(U.upsert(*_even_odd(spark, d)))


def toggle_delete(spark: SparkSession, d: str) -> DataFrame:
    used, marks = _even_odd(spark, d)
    return _shown(U.unmark(used, marks))


def bulk_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    used, marks = _even_odd(spark, d)
    inserted = U.insert_ignore(used, marks, _catalogue(spark, d))
    return inserted.groupBy("user_id").agg(F.count("*").alias("inserted"))


def replay_state(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_used(spark, d))


def local_set_ops(spark: SparkSession, d: str) -> DataFrame:
    """A stored list made of a user's event: strings, a number, a null; then one id added, one removed, one looked up."""
    k = F.from_json("props", "k INT")["k"] % 12
    stored = F.when(F.col("event_id") % 10 == 0, F.lit("no json")).otherwise(F.concat(F.lit('["a", 2, null, "'), k.cast("string"), F.lit('", "b"]')))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", X.trim_all(k.cast("string")).alias("k"), U.text_ids(stored).alias("ids"))
    return rows.select(
        "event_id", F.array_join("ids", ",").alias("ids"), F.array_join(U.with_id(F.col("ids"), F.lit("7")), ",").alias("added"),
        F.array_join(U.without_id(F.col("ids"), F.col("k")), ",").alias("removed"), F.array_contains("ids", "7").alias("has_seven"), F.to_json("ids").alias("stored"),
    )


def rls_user_view(spark: SparkSession, d: str) -> DataFrame:
    return U.user_view(_used(spark, d), F.lit("7")).select("user_id", "passage_id")


def _requests(spark: SparkSession, d: str, op: str) -> DataFrame:
    """What each user's session sends on a day is a statement; some of its rows name the next user."""
    k = (F.from_json("props", "k INT")["k"] % 12).cast("string")
    rows = spark.read.parquet(f"{d}/events.parquet")
    target = F.when(F.col("event_id") % 23 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    day = F.date_format("ts", "yyyyMMdd")
    return rows.select(
        F.concat_ws("-", F.col("user_id").cast("string"), day).alias("request_id"), F.col("user_id").cast("string").alias("session_user"),
        F.lit(op).alias("op"), target.cast("string").alias("user_id"), k.alias("passage_id"), F.col("ts").alias("used_at"),
    )


def policy_inserts(spark: SparkSession, d: str) -> DataFrame:
    """State of half the log, and every session's statements: those that name another user change nothing."""
    return _shown(U.apply_inserts(_even_odd(spark, d)[0], _requests(spark, d, "insert")))


def policy_deletes(spark: SparkSession, d: str) -> DataFrame:
    return _shown(U.apply_deletes(_used(spark, d), _requests(spark, d, "delete").where(F.col("passage_id").cast("int") < 6)))


def policy_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return U.verdicts(_requests(spark, d, "insert"))


def input_caps(spark: SparkSession, d: str) -> DataFrame:
    """Status of each document as a query and of each user's ids as a request."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    q = F.length(X.trim_all(F.col("text")))
    queries = docs.select(F.lit("query").alias("kind"), F.when(q == 0, "empty").when(q > X.MAX_QUERY, "too_long").otherwise("ok").alias("status"))
    users = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg((F.count("*") * 150).alias("n"))
    sizes = users.select(F.lit("ids").alias("kind"), U.count_status(F.col("n")).alias("status"))
    return queries.unionByName(sizes).groupBy("kind", "status").agg(F.count("*").alias("n"))


def labels_of_ui(spark: SparkSession, d: str) -> DataFrame:
    """Labels that a reader sees: testament, storage, banner."""
    rows = U.pick(_users(spark, d), _catalogue(spark, d), _used(spark, d), SEED)
    testament = F.when(F.col("passage_id") == "0", F.lit("구약")).otherwise(F.lit("신약"))
    banner = F.when(F.col("was_reset"), F.lit("reset")).otherwise(F.lit(""))
    return rows.select("user_id", testament.alias("testament"), banner.alias("banner"), F.when(F.col("user_id").cast("long") % 2 == 0, F.lit("account")).otherwise(F.lit("browser")).alias("storage"))


QUERIES = {f.__name__: f for f in (
    available_passages, valid_used_ids, random_pick_seeded, reset_on_exhaustion, user_cascade, toggle_upsert, toggle_delete, bulk_insert_ignore, replay_state, local_set_ops,
    rls_user_view, input_caps, labels_of_ui, policy_inserts, policy_deletes, policy_verdicts,
)}

_LOG = """
log AS (SELECT user_id::VARCHAR AS user_id, ((props::JSON->>'k')::INT % 12)::VARCHAR AS passage_id, event_type <> 'error' AS used, ts, event_id FROM events),
catalogue AS (SELECT r_regionkey::VARCHAR AS passage_id FROM region)"""


def _state(source: str) -> str:
    return f"""(SELECT user_id, passage_id, used_at FROM (
  SELECT user_id, passage_id, used, max(ts) OVER w AS used_at, row_number() OVER (PARTITION BY user_id, passage_id ORDER BY ts DESC, event_id DESC) AS n FROM {source} WINDOW w AS (PARTITION BY user_id, passage_id)
) WHERE n = 1 AND used)"""


_USED = f"{_LOG}, used AS {_state('log')}"
_HALVES = f"""{_LOG}, used AS {_state('(SELECT * FROM log WHERE event_id % 2 = 0)')},
marks AS (SELECT user_id, passage_id, min(ts) AS used_at FROM log WHERE event_id % 2 = 1 AND used GROUP BY ALL)"""
_AT = "strftime(used_at, '%Y-%m-%d %H:%M:%S') AS used_at"
_PICKED = f"""{_USED},
users AS (SELECT c_custkey::VARCHAR AS user_id, count(DISTINCT passage_id) AS n_used FROM customer LEFT JOIN used ON user_id = c_custkey::VARCHAR GROUP BY c_custkey),
numbered AS (SELECT passage_id, row_number() OVER (ORDER BY passage_id) - 1 AS place FROM (SELECT DISTINCT passage_id FROM catalogue WHERE passage_id IS NOT NULL)),
open_rows AS (
  SELECT u.user_id, n_used, c.passage_id, c.place, s.passage_id IS NOT NULL AS seen FROM users u CROSS JOIN numbered c LEFT JOIN used s ON s.user_id = u.user_id AND s.passage_id = c.passage_id
), flagged AS (SELECT *, bool_and(seen) OVER (PARTITION BY user_id) AS was_reset FROM open_rows),
offered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS n_left FROM flagged WHERE was_reset OR NOT seen
), picked AS (
  SELECT user_id, passage_id, (SELECT count(*) FROM numbered) AS total_passages, CASE WHEN was_reset THEN 0 ELSE n_used END AS used_count, was_reset FROM offered
  WHERE nth = ('0x' || substr(md5('{SEED}|' || user_id), 1, 15))::BIGINT % n_left
)"""

_REQUESTS = """
requests AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS request_id, user_id::VARCHAR AS session_user, (CASE WHEN event_id % 23 = 0 THEN user_id + 1 ELSE user_id END)::VARCHAR AS user_id,
         ((props::JSON->>'k')::INT % 12)::VARCHAR AS passage_id, ts AS used_at FROM events
), judged AS (SELECT *, bool_or(user_id <> session_user) OVER (PARTITION BY request_id) AS refused FROM requests)"""

SQL = {
    "policy_inserts": f"""WITH {_HALVES}, {_REQUESTS}, fresh AS (SELECT user_id, passage_id, min(used_at) AS used_at FROM judged WHERE NOT refused GROUP BY user_id, passage_id)
SELECT user_id, passage_id, {_AT} FROM (SELECT * FROM used UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.user_id = f.user_id AND u.passage_id = f.passage_id))""",
    "policy_deletes": f"""WITH {_USED}, {_REQUESTS} SELECT user_id, passage_id, {_AT} FROM used u
WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.user_id = r.session_user AND r.passage_id::INT < 6 AND r.user_id = u.user_id AND r.passage_id = u.passage_id)""",
    "policy_verdicts": f"WITH {_REQUESTS} SELECT request_id, count(*) AS n_rows, count(*) FILTER (user_id <> session_user) AS n_foreign, any_value(refused) AS refused FROM judged GROUP BY request_id",
    "available_passages": f"WITH {_USED} SELECT u.user_id, c.passage_id FROM (SELECT c_custkey::VARCHAR AS user_id FROM customer) u CROSS JOIN catalogue c ANTI JOIN used s ON s.user_id = u.user_id AND s.passage_id = c.passage_id",
    "valid_used_ids": f"WITH {_USED} SELECT DISTINCT user_id, passage_id FROM used WHERE passage_id IN (SELECT passage_id FROM catalogue)",
    "random_pick_seeded": f"WITH {_PICKED} SELECT *, used_count || '/' || total_passages AS progress, false AS is_used FROM picked",
    "reset_on_exhaustion": f"""WITH {_USED}, exhausted AS (
  SELECT user_id FROM used JOIN catalogue USING (passage_id) GROUP BY user_id HAVING count(*) >= (SELECT count(*) FROM catalogue))
SELECT user_id, passage_id FROM used WHERE user_id NOT IN (SELECT user_id FROM exhausted)""",
    "user_cascade": f"WITH {_USED} SELECT user_id, passage_id FROM used WHERE user_id NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal < 0)",
    "toggle_upsert": f"WITH {_HALVES} SELECT user_id, passage_id, {_AT} FROM (SELECT * FROM used UNION ALL SELECT * FROM marks m WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.user_id = m.user_id AND u.passage_id = m.passage_id))",
    "toggle_delete": f"WITH {_HALVES} SELECT user_id, passage_id, {_AT} FROM used u WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE u.user_id = m.user_id AND u.passage_id = m.passage_id)",
    "bulk_insert_ignore": f"""WITH {_HALVES} SELECT user_id, count(*) AS inserted FROM marks m WHERE passage_id IN (SELECT passage_id FROM catalogue)
  AND NOT EXISTS (SELECT 1 FROM used u WHERE u.user_id = m.user_id AND u.passage_id = m.passage_id) GROUP BY user_id""",
    "replay_state": f"WITH {_USED} SELECT user_id, passage_id, {_AT} FROM used",
    "local_set_ops": """
WITH rows AS (
  SELECT event_id, ((props::JSON->>'k')::INT % 12)::VARCHAR AS k, CASE WHEN event_id % 10 = 0 THEN []::VARCHAR[] ELSE ['a', ((props::JSON->>'k')::INT % 12)::VARCHAR, 'b'] END AS ids FROM events
)
SELECT event_id, array_to_string(ids, ',') AS ids, array_to_string(CASE WHEN list_contains(ids, '7') THEN ids ELSE list_append(ids, '7') END, ',') AS added,
       array_to_string(list_filter(ids, lambda x: x <> k), ',') AS removed, list_contains(ids, '7') AS has_seven,
       CASE WHEN len(ids) = 0 THEN '[]' ELSE '["' || array_to_string(ids, '","') || '"]' END AS stored
FROM rows""",
    "rls_user_view": f"WITH {_USED} SELECT user_id, passage_id FROM used WHERE user_id = '7'",
    "input_caps": """
SELECT kind, status, count(*) AS n FROM (
  SELECT 'query' AS kind, CASE WHEN q = 0 THEN 'empty' WHEN q > 300 THEN 'too_long' ELSE 'ok' END AS status FROM (SELECT length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS q FROM documents)
  UNION ALL SELECT 'ids', CASE WHEN n > 10000 THEN 'too_many' ELSE 'ok' END FROM (SELECT count(*) * 150 AS n FROM events GROUP BY user_id)
) GROUP BY ALL""",
    "labels_of_ui": f"""WITH {_PICKED}
SELECT user_id, CASE passage_id WHEN '0' THEN '구약' ELSE '신약' END AS testament, CASE WHEN was_reset THEN 'reset' ELSE '' END AS banner,
       CASE WHEN user_id::BIGINT % 2 = 0 THEN 'account' ELSE 'browser' END AS storage FROM picked""",
}
