import hashlib
import random
import uuid
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trawlspark.operators import placed as P, state as U
from trawlspark.operators.prefix import before
from trawlspark.streaming.state import replay_stream

from .conftest import rows

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def used(spark, pairs):
    return spark.createDataFrame([(u, p, T0) for u, p in pairs], "user_id string, passage_id string, used_at timestamp")


def catalogue(spark, ids="abc"):
    return spark.createDataFrame([(c,) for c in ids], "passage_id string")


def draw(user, n, seed="s"):
    return int(hashlib.md5(f"{seed}|{user}".encode()).hexdigest()[:15], 16) % n


def test_pick_and_reset(spark):
    seen = used(spark, [("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("y", "c"), ("y", "zz")])
    users = spark.createDataFrame([("x",), ("y",), ("new",), ("new",)], "user_id string")
    picked = {r["user_id"]: r for r in U.pick(users, catalogue(spark), seen, "s").collect()}
    assert picked["x"]["passage_id"] == "c" and not picked["x"]["was_reset"] and picked["x"]["used_count"] == 2
    assert tuple(picked["y"]) == ("y", "abc"[draw("y", 3)], 3, 0, True)
    assert rows(U.after_reset(catalogue(spark), seen).select("user_id", "passage_id")) == [("x", "a"), ("x", "b")]
    assert rows(U.available(users, catalogue(spark), seen)) == [("new", "a"), ("new", "b"), ("new", "c"), ("x", "c")]
    assert tuple(picked["new"]) == ("new", "abc"[draw("new", 3)], 3, 0, False) and len(picked) == 3
    assert {r["user_id"] for r in U.pick(users, catalogue(spark), seen.limit(0), "s").collect()} == {"x", "y", "new"}
    assert U.pick(users, catalogue(spark).limit(0), seen, "s").count() == 0
    assert U.available(users, catalogue(spark).limit(0), seen).count() == 0


def test_draws_from_odd_catalogues(spark, monkeypatch):
    """Repeated and null ids, strides shorter than gaps, users with anything from nothing to all of it."""
    monkeypatch.setattr(U, "STRIDE", 3)
    r = random.Random(4)
    ids = [f"p{i:02}" for i in range(40)]
    odd = spark.createDataFrame([(c,) for c in [*ids, None, *ids[:9], None]], "passage_id string")
    has = {f"u{k}": r.sample(ids, k) for k in range(0, 41, 4)}
    seen = used(spark, [(u, p) for u, ps in has.items() for p in [*ps, *ps[:2], "gone", None]] + [(None, "p01")])
    users = spark.createDataFrame([(u,) for u in [*has, "other", None]], "user_id string")
    left = {u: [p for p in ids if p not in has.get(u, [])] for u in [*has, "other"]}
    assert rows(U.available(users, odd, seen)) == sorted((u, p) for u, ps in left.items() for p in ps)
    found = {p["user_id"]: tuple(p)[1:] for p in U.pick(users, odd, seen, "s").collect()}
    wanted = {}
    for u, ps in left.items():
        count = len(set(has[u])) + 1 if u in has else 0
        wanted[u] = ((ps or ids)[draw(u, len(ps or ids))], 40, count if ps else 0, not ps)
    assert found == wanted


def test_prefixes_of_long_groups(spark):
    r = random.Random(2)
    data = [(g, k, r.randint(0, 50)) for g in (1, 2, None) for k in range({1: 300, 2: 1, None: 20}[g])]
    table = spark.createDataFrame(data, "g long, k long, v long").repartition(5)
    found = before(table, ["g"], ["k"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, {"t": ("sum", F.lit(1))})
    wanted = []
    for g in (1, 2, None):
        own = sorted((k, v) for h, k, v in data if h == g)
        wanted += [(g, k, v, sum(x for _, x in own[:i]), max([x for _, x in own[:i]], default=None), len(own)) for i, (k, v) in enumerate(own)]
    assert rows(found) == sorted(wanted, key=str)
    assert before(table.limit(0), ["g"], ["k"], {"s": ("sum", F.col("v"))}).count() == 0


def test_deleted_users_take_their_state_along(spark):
    seen = used(spark, [("x", "a"), ("y", "a"), ("y", "b")])
    assert rows(U.forget(seen, spark.createDataFrame([("y",), ("z",)], "user_id string"))) == [("x", "a", T0)]


def test_merges_are_idempotent(spark):
    state, marks = used(spark, [("x", "a")]), used(spark, [("x", "a"), ("x", "b"), ("x", "b")]).withColumn("used_at", F.lit(T1))
    once = U.upsert(state, marks)
    assert rows(once) == rows(U.upsert(once, marks)) == [("x", "a", T0), ("x", "b", T1)]
    gone = U.unmark(once, marks)
    assert rows(gone) == rows(U.unmark(gone, marks)) == []


def test_bulk_insert_counts_new_valid_ids(spark):
    state = used(spark, [("x", "a")])
    ids = used(spark, [("x", "a"), ("x", "a"), ("x", "b"), ("x", "invalid")])
    assert rows(U.insert_ignore(state, ids, catalogue(spark))) == [("x", "b")]


def test_stored_ids(spark):
    stored = spark.createDataFrame([('["a", 2, null, "b"]',), ("{}",), ("x",), (None,)], "s string")
    found = [r[0] for r in stored.select(U.text_ids(F.col("s"))).collect()]
    assert found == [["a", "b"], [], [], []]
    both = spark.range(1).select(U.with_id(F.array(F.lit("a")), F.lit("a")).alias("x"), U.without_id(F.array(F.lit("a")), F.lit("a")).alias("y")).first()
    assert both["x"] == ["a"] and both["y"] == []


def test_request_limit(spark):
    for n, status in ((10_000, "ok"), (10_001, "too_many")):
        assert spark.range(1).select(U.request_status(F.array_repeat(F.lit("a"), n))).first()[0] == status


LOG = "user_id string, passage_id string, used boolean, ts timestamp, event_id long"


@pytest.fixture
def placed(spark):
    name = f"state_{uuid.uuid4().hex}"
    P.create(spark, name, slices=16, buckets=4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_stream_equals_replay(spark, tmp_path, placed):
    log = [("x", "a", True, T0, 1), ("x", "a", False, T1, 2), ("x", "b", True, T0, 3), ("y", "a", True, T1, 4), ("y", "a", True, T0, 5)]
    for part in (log[:2], log[2:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        replay_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), placed, str(tmp_path / "cp")).awaitTermination()
    assert rows(P.state(spark, placed).select("user_id", "passage_id")) == rows(U.replay(spark.createDataFrame(log, LOG)).select("user_id", "passage_id"))


def test_merges_replace_touched_slices_only(spark, placed):
    r = random.Random(6)
    log = [(f"u{r.randint(0, 40)}", f"p{r.randint(0, 5)}", r.random() < 0.7, datetime(2024, 1, 1, r.randint(0, 23), r.randint(0, 59)), i) for i in range(600)]
    folder = Path(spark.sql(f"DESCRIBE FORMATTED {placed}").where("col_name = 'Location'").first()["data_type"].removeprefix("file:"))
    files = lambda: {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    for part in (log[:300], log[300:]):
        P.merge(spark, placed, spark.createDataFrame(part, LOG))
    few = [("u1", "p9", True, T1, 1000), ("u1", None, True, T1, 1001), ("u2", "p0", True, datetime(2020, 1, 1), 0)]
    before = files()
    touched = P.merge(spark, placed, spark.createDataFrame(few, LOG))
    kept = {p: t for p, t in before.items() if int(p.parent.name.removeprefix("slice=")) not in touched}
    assert 1 <= len(touched) <= 2 and kept and kept.items() <= files().items() and kept.keys() != before.keys()
    assert P.merge(spark, placed, spark.createDataFrame(few, LOG)) == touched
    wanted = rows(U.replay(spark.createDataFrame(log + [few[0], few[2]], LOG)).select("user_id", "passage_id"))
    assert rows(P.state(spark, placed).select("user_id", "passage_id")) == wanted
    assert P.merge(spark, placed, spark.createDataFrame([], LOG)) == []


def test_a_merge_does_not_shuffle_the_state(spark, placed):
    P.merge(spark, placed, spark.createDataFrame([(f"u{i}", "p", True, T0, i) for i in range(50)], LOG))
    found, touched = P.merged(spark, placed, spark.createDataFrame([("u1", "p", False, T1, 99)], LOG))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan.index("FileScan parquet")
    above = [line for line in plan[:scan].splitlines() if "Exchange" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    own = depth(plan[:scan].splitlines()[-1])
    assert "PartitionFilters: [isnotnull(slice" in plan or "PartitionFilters: [slice" in plan or "slice#" in plan[scan:]
    assert not [line for line in above if depth(line) < own]


def test_policies_on_writes(spark):
    state = used(spark, [("x", "a"), ("y", "a")])
    requests = [
        (1, "x", "insert", "x", "b"), (1, "x", "insert", "x", "c"), (2, "x", "insert", "x", "d"), (2, "x", "insert", "y", "d"), (3, None, "insert", "x", "e"), (4, None, "insert", None, "e"),
        (5, "x", "delete", "x", "a"), (5, "x", "delete", "y", "a"), (6, "x", "update", "x", "a"),
    ]
    sent = spark.createDataFrame([(*r, T1) for r in requests], "request_id int, session_user string, op string, user_id string, passage_id string, used_at timestamp")
    assert rows(U.verdicts(sent)) == [(1, 2, 0, False), (2, 2, 1, True), (3, 1, 1, True), (4, 1, 1, True), (5, 2, 1, False), (6, 1, 0, True)]
    assert rows(U.apply_inserts(state, sent)) == [("x", "a", T0), ("x", "b", T1), ("x", "c", T1), ("y", "a", T0)]
    assert rows(U.apply_deletes(state, sent)) == [("y", "a", T0)]
    assert U.bound(state.where("user_id = 'x'"), F.lit("x")).count() == 1
    with pytest.raises(Exception, match="policy"):
        U.upsert(state, U.bound(state, F.lit("x"))).collect()
