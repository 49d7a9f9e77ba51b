"""Per-user state of passages already seen: sampling without repetition and idempotent merges.

State tables are (user_id, passage_id, used_at) with one row per pair. Every merge returns the table after it; a caller
writes that as a new version, as a path can't be read and overwritten at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import MAX_IDS
from ..storage import cut
from .corpus import numbered
from .prefix import before

KEY = ["user_id", "passage_id"]


#: Places of a gap that one row is turned into at a time.
STRIDE = 4096


def known_passages(catalogue: DataFrame) -> DataFrame:
    """The catalogue's ids, each once, without null."""
    return catalogue.select("passage_id").where("passage_id IS NOT NULL").distinct()


def places(catalogue: DataFrame) -> DataFrame:
    """(passage_id, place): the catalogue's ids numbered from 0 in their order."""
    return cut(numbered(known_passages(catalogue), ["passage_id"], "place"))


def _seen(users: DataFrame, place: DataFrame, used: DataFrame) -> DataFrame:
    """(user_id, place, earlier, last, known): the places that each of ``users`` has used, with how many of them come before,
    the one before, and their number. Work goes with the users' own ids, and a user's may lie in any number of tasks."""
    own = used.select(*KEY).distinct().join(place, "passage_id").join(users.select("user_id"), "user_id", "left_semi").select("user_id", "place")
    one = F.lit(1).cast("long")
    return before(own, ["user_id"], ["place"], {"earlier": ("sum", one), "last": ("max", F.col("place"))}, {"known": ("sum", one)})


def available(users: DataFrame, catalogue: DataFrame, used: DataFrame) -> DataFrame:
    """(user_id, passage_id): for each of ``users`` what the catalogue has left, all of it for one who has used nothing.

    Between the places that a user has used lie gaps; gaps are cut into strides, strides become places. Repeated and null ids
    of the catalogue count once and not at all; a null user is none.
    """
    everyone = users.select("user_id").where("user_id IS NOT NULL").distinct()
    place = places(catalogue)
    n = place.count()
    seen = _seen(everyone, place, used)
    inner = seen.select("user_id", (F.coalesce("last", F.lit(-1)) + 1).alias("a"), (F.col("place") - 1).alias("b"))
    ends = everyone.join(seen.groupBy("user_id").agg(F.max("place").alias("end")), "user_id", "left")
    gaps = inner.union(ends.select("user_id", F.coalesce(F.col("end") + 1, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))).where("a <= b")
    strides = gaps.select("user_id", "b", F.explode(F.sequence("a", "b", F.lit(STRIDE).cast("long"))).alias("a"))
    wanted = strides.select("user_id", F.explode(F.sequence("a", F.least(F.col("b"), F.col("a") + (STRIDE - 1)))).alias("place"))
    return wanted.join(place, "place").select(*KEY)


def valid(ids: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct (user_id, passage_id) that the catalogue knows."""
    return ids.select(*KEY).distinct().join(catalogue.select("passage_id"), "passage_id", "left_semi").select(*KEY)


def drawn(seed: str, user_id: Column, n: Column) -> Column:
    """A repeatable random number below ``n`` for a user."""
    digits = F.substr(F.md5(F.concat_ws("|", F.lit(seed), user_id.cast("string"))), F.lit(1), F.lit(15))
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.nullif(n, F.lit(0).cast("long")))


def pick(users: DataFrame, catalogue: DataFrame, used: DataFrame, seed: str) -> DataFrame:
    """For each of ``users`` one passage: (user_id, passage_id, total_passages, used_count, was_reset).

    The draw is a number r below the count of passages that a user hasn't used; the passage is the r-th of these in the
    catalogue's order, found from the user's own sorted places: it is r places on, and one more for each used place that has
    r unused ones or fewer before it. A user who has used nothing draws from all. One who has seen all starts again:
    was_reset, used_count 0 and all passages to draw from. used_count is before the pick. Ids that the catalogue doesn't have
    are counted as used but take no passage away. Repeated and null ids of the catalogue count once and not at all, a null
    user is none. Without a catalogue there are no rows.
    """
    everyone = users.select("user_id").where("user_id IS NOT NULL").distinct()
    place = places(catalogue)
    n = F.lit(place.count()).cast("long")
    counts = used.groupBy("user_id").agg(F.count_distinct("passage_id").alias("used_count"))
    seen = _seen(everyone, place, used).where(F.col("known") < n)
    r = drawn(seed, F.col("user_id"), n - F.col("known"))
    passed = seen.groupBy("user_id").agg(F.max("known").alias("known"), F.count_if(F.col("place") - F.col("earlier") <= r).alias("passed"))
    full = used.select(*KEY).distinct().join(place, "passage_id").groupBy("user_id").agg(F.count("*").alias("has")).where(F.col("has") >= n).select("user_id", F.lit(True).alias("was_reset"))
    rows = everyone.join(passed, "user_id", "left").join(full, "user_id", "left").join(counts, "user_id", "left")
    left = n - F.coalesce("known", F.lit(0).cast("long"))
    rows = rows.select("user_id", (drawn(seed, F.col("user_id"), left) + F.coalesce("passed", F.lit(0).cast("long"))).alias("place"), F.coalesce("was_reset", F.lit(False)).alias("was_reset"), "used_count")
    count = F.when(F.col("was_reset"), F.lit(0).cast("long")).otherwise(F.coalesce("used_count", F.lit(0).cast("long")))
    return rows.join(place, "place").select("user_id", "passage_id", n.alias("total_passages"), count.alias("used_count"), "was_reset")


def forget(used: DataFrame, gone: DataFrame) -> DataFrame:
    """The table after the users in ``gone`` are deleted: their rows go with them."""
    return used.join(gone.select("user_id"), "user_id", "left_anti").select(*used.columns)


def after_reset(catalogue: DataFrame, used: DataFrame) -> DataFrame:
    """The table after exhausted users' rows are deleted; without a catalogue nobody is exhausted."""
    passages = known_passages(catalogue)
    known = used.join(passages, "passage_id", "left_semi").groupBy("user_id").agg(F.count_distinct("passage_id").alias("known"))
    total = passages.agg(F.count("*").alias("total"))  # one row
    exhausted = known.join(total, how="cross").where("known >= total").select("user_id")
    return used.join(exhausted, "user_id", "left_anti")


def upsert(used: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks added; a pair already there keeps its time, of repeated marks the first time counts."""
    fresh = marks.groupBy(*KEY).agg(F.min("used_at").alias("used_at")).join(used.select(*KEY), KEY, "left_anti")
    return used.select(*KEY, "used_at").unionByName(fresh)


def unmark(used: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks removed; what isn't there is no error."""
    return used.join(marks.select(*KEY), KEY, "left_anti").select(*used.columns)


def insert_ignore(used: DataFrame, ids: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(user_id, passage_id): the valid, distinct pairs that weren't there; their number is what a bulk insert reports."""
    return valid(ids, catalogue).join(used.select(*KEY), KEY, "left_anti")


def replay(log: DataFrame) -> DataFrame:
    """State after a log (user_id, passage_id, used, ts, event_id): the last toggle of each pair, if it is on."""
    last = F.max_by("used", F.struct("ts", "event_id")).alias("used")
    return log.groupBy(*KEY).agg(last, F.max("ts").alias("used_at")).where("used").select(*KEY, "used_at")


def bound(marks: DataFrame, user_id: Column) -> DataFrame:
    """``marks`` as one user's statement: a row of anybody else fails the job that reads it, and nothing is written."""
    foreign = F.raise_error(F.lit("a row of another user breaks the policy"))
    return marks.withColumn("user_id", F.when(F.col("user_id").eqNullSafe(user_id) & F.col("user_id").isNotNull(), F.col("user_id")).otherwise(foreign))


def verdicts(requests: DataFrame) -> DataFrame:
    """(request_id, n_rows, n_foreign, refused) for statements (request_id, session_user, op, user_id): an insert with a row that
    isn't its session's own is refused as a whole; a delete is never refused, as it doesn't see the rows of others; nothing
    allows updates. A session without a user owns nothing. All rows of a statement share its session and its op.
    """
    foreign = ~F.coalesce(F.col("session_user") == F.col("user_id"), F.lit(False))
    rows = requests.groupBy("request_id").agg(F.count("*").alias("n_rows"), F.count_if(foreign).alias("n_foreign"), F.bool_or(foreign & (F.col("op") == "insert") | ~F.col("op").isin("insert", "delete")).alias("refused"))
    return rows


def allowed(requests: DataFrame, op: str) -> DataFrame:
    """The rows of ``requests`` that a statement of this kind ("insert" or "delete") may touch (``verdicts``)."""
    own = requests.where(F.col("op") == op)
    if op == "delete":
        return own.where(F.col("session_user") == F.col("user_id"))
    # the whole statement goes with its first foreign row; statements are dealt by id, one row for each comes back
    refused = verdicts(own).where("refused").select("request_id")
    return own.join(refused, "request_id", "left_anti").where("user_id IS NOT NULL")


def apply_inserts(used: DataFrame, requests: DataFrame) -> DataFrame:
    """The table after the inserts that the policy allows; pairs that are there keep their time."""
    return upsert(used, allowed(requests, "insert"))


def apply_deletes(used: DataFrame, requests: DataFrame) -> DataFrame:
    """The table after the deletes that the policy allows."""
    return unmark(used, allowed(requests, "delete"))


def user_view(used: DataFrame, user_id: Column) -> DataFrame:
    """What one user may see; the filter is pushed into the scan."""
    return used.where(F.col("user_id") == user_id)


def text_ids(stored: Column) -> Column:
    """The strings of a stored JSON array; anything else in it is skipped, anything else at all gives none."""
    items = F.from_json(stored, "array<variant>")
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def with_id(ids: Column, one: Column) -> Column:
    return F.when(F.array_contains(ids, one), ids).otherwise(F.array_append(ids, one))


def without_id(ids: Column, one: Column) -> Column:
    return F.array_remove(ids, one)


def count_status(n: Column) -> Column:
    """ok, or too_many for a number of ids above the limit of a request."""
    return F.when(n > MAX_IDS, F.lit("too_many")).otherwise(F.lit("ok"))


def request_status(ids: Column) -> Column:
    """``count_status`` of an array of ids."""
    return count_status(F.size(ids))
