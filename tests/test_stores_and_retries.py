from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trawlspark.functions import text as X
from trawlspark.operators import models as M
from trawlspark.operators.stores import AccountStore, LocalStore

from .conftest import rows

T0 = datetime(2024, 1, 1)


def test_both_stores(spark):
    catalogue = spark.createDataFrame([(c,) for c in "abc"], "passage_id string")
    local = LocalStore(spark, ["zz"])
    assert local.pick(catalogue, "s")["used_count"] == 0
    for c in "abc":
        local.mark(catalogue, c, True)
    assert local.is_used("a") and local.pick(catalogue, "s")["was_reset"] and local.ids == []
    table = spark.createDataFrame([("x", "a", T0), ("y", "b", T0)], "user_id string, passage_id string, used_at timestamp")
    account = AccountStore(table, "x")
    local.ids = ["a", "b", "b", "nope"]
    def broken(_):
        raise OSError

    with pytest.raises(OSError):
        account.migrate(local, catalogue, broken, T0)
    assert local.ids == ["a", "b", "b", "nope"] and account.rows.count() == 2
    written = []
    assert account.migrate(local, catalogue, lambda fresh: written.extend(map(tuple, fresh.collect())), T0) == 1 and local.ids == []
    assert written == [("x", "b", T0)]
    assert rows(account.rows.select("user_id", "passage_id")) == [("x", "a"), ("x", "b"), ("y", "b")]
    assert account.pick(catalogue, "s")["passage_id"] == "c"
    account.mark(catalogue, "c", True, T0)
    assert account.pick(catalogue, "s")["was_reset"] and rows(account.rows.select("user_id")) == [("y",)]
    account.mark(catalogue, "a", False)
    with pytest.raises(ValueError):
        account.mark(catalogue, "nope", True)
    assert LocalStore(spark).pick(catalogue.limit(0), "s") is None


def test_retries():
    waits, calls = [], []

    def model(x):
        calls.append(x)
        if len(calls) == 1:
            raise M.Busy
        if len(calls) == 2:
            raise OSError
        return x

    assert M.with_retries(model, sleep=waits.append)("a") == "a" and waits == [15.0, 10.0]

    def refuses(x):
        raise M.OutOfQuota

    with pytest.raises(M.OutOfQuota):
        M.with_retries(refuses, sleep=waits.append)("a")


def test_replies_and_lazy_models(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, None)], "key long, prompt string")
    lazy = M.Lazy(lambda: str.upper)
    assert rows(M.replied(prompts, lazy)) == [(1, "A"), (2, "")] and not lazy.ready


def test_request_fields(spark):
    found = spark.createDataFrame([("false",), ("",), (None,)], "x string").select(X.as_text(F.col("x")), X.truthy(F.col("x")))
    assert [tuple(r) for r in found.collect()] == [("false", True), ("", False), ("", False)]
