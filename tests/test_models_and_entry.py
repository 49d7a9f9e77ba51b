import os

import pytest

from trawlspark import plans
from trawlspark.operators import models as M
from trawlspark.sources import files

from .conftest import rows

SF = "/root/testdata/sf0.001"


def model(texts):
    return [[float(len(t)), float(ord(t[-1])) if t else 0.0] for t in texts]


class Refusing:
    """A model that is out of quota after some calls."""

    def __init__(self, model, calls):
        self.model, self.calls = model, calls

    def __call__(self, *arguments):
        if not self.calls:
            raise M.OutOfQuota
        self.calls -= 1
        return self.model(*arguments)


def test_embedding_continues_where_it_stopped(spark):
    table = spark.createDataFrame([(i, f"t{i}") for i in range(250)], "id long, text string")
    done = M.embedded(table.where("id < 100"), model)
    assert rows(M.embed_pending(table, done, model)) == rows(M.embedded(table, model))


def test_build_keeps_what_is_done_when_the_quota_ends(spark, tmp_path):
    table = spark.createDataFrame([(i, f"t{i}") for i in range(700)], "id long, text string").repartition(2)
    path, seen = str(tmp_path / "embedded"), []
    for calls in (1, 1, 2, 9):
        seen.append(M.build(spark, path, "id", table, lambda todo, calls=calls: M.embedded(todo.coalesce(1), Refusing(model, calls)), steps=3))
    assert 0 < seen[0].done < seen[1].done < 700 and seen[-1] == (700, 0) and all(sum(x) == 700 for x in seen)
    assert rows(spark.read.parquet(path)) == rows(M.embedded(table, model))
    assert M.build(spark, path, "id", table, lambda todo: M.embedded(todo, Refusing(model, 0)), steps=3) == (700, 0)
    nothing = M.build(spark, path, "id", table, lambda todo: M.embedded(todo, Refusing(model, 0)), steps=3, restart=True)
    assert nothing == (0, 700)
    assert M.build(spark, str(tmp_path / "none"), "id", table.limit(0), lambda todo: M.embedded(todo, model)) == (0, 0)


def test_null_keys_are_asked_for_once(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (None, "b")], "id long, text string")
    for _ in range(2):
        assert M.build(spark, str(tmp_path / "t"), "id", table, lambda todo: M.embedded(todo, model), steps=2) == (2, 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_a_lease_holds_for_all_tasks_together(spark, tmp_path):
    """Calls are counted by lines in files, one for each worker process, with their times."""
    log = tmp_path / "calls"
    log.mkdir()

    def timed(texts):
        import os
        import time

        with open(log / str(os.getpid()), "a") as f:
            f.write(f"{time.time()} {len(texts)}\n")
        return model(texts)

    table = spark.createDataFrame([(i, f"t{i}") for i in range(90)], "id long, text string").repartition(6)
    lease = M.Lease(calls=14, interval_s=0.1, lanes=4)
    found = M.embedded(table, timed, batch=5, lease=lease).collect()
    calls = sorted(tuple(map(float, line.split())) for f in log.iterdir() for line in f.read_text().splitlines())
    assert len(calls) == 14 and {n for _, n in calls} == {5.0} and sorted(r["id"] for r in found) == list(range(70))
    assert len(list(log.iterdir())) > 1  # several workers
    for i in range(len(calls)):
        for j in range(i + 1, len(calls)):
            assert j - i + 1 <= (calls[j][0] - calls[i][0] + 0.02) / lease.interval_s + lease.lanes
    assert M.embedded(table, timed, batch=5, lease=M.Lease(0)).count() == 0
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(9)], "key long, prompt string").repartition(3)
    assert rows(M.replied(prompts, str.upper, lease=M.Lease(4, lanes=3))) == [(i, f"P{i}") for i in range(4)]


def test_replies_continue_after_failures(spark, tmp_path):
    def reply(prompt):
        if prompt == "bad":
            raise OSError
        return prompt.upper()

    prompts = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(8)], "key long, prompt string").coalesce(1)
    once = lambda f: M.with_retries(f, tries=1)
    path = str(tmp_path / "replies")
    first = M.build(spark, path, "key", prompts, lambda todo: M.replied(todo.coalesce(1), Refusing(reply, 5), retry=once), steps=1)
    last = M.build(spark, path, "key", prompts, lambda todo: M.replied(todo, reply, retry=once), steps=1)
    assert first == (5, 3) and last == (8, 0)
    assert rows(spark.read.parquet(path)) == [(i, None if i == 3 else f"P{i}") for i in range(8)]


def test_retries_reach_the_batches(spark):
    table = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string").coalesce(1)

    class Fails:
        def __init__(self):
            self.calls = 0

        def __call__(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise M.Busy
            return model(texts)

    retry = lambda f: M.with_retries(f, sleep=lambda s: None)
    assert rows(M.embedded(table, Fails(), retry=retry)) == rows(M.embedded(table, model))


def test_json_and_versions_round_trip(spark, tmp_path):
    import json

    table = spark.createDataFrame([(1, "태초에 \"a\"\n"), (2, None), (3, "é, x")], "id long, t string").repartition(3)
    files.write_json(table, str(tmp_path / "j"))
    assert rows(files.json_rows(spark, str(tmp_path / "j"), "id LONG, t STRING")) == rows(table)
    parts = [p.read_text() for p in sorted((tmp_path / "j").glob("part-*"))]
    assert sorted(r["id"] for p in parts for r in json.loads(p)) == [1, 2, 3] and any("태초에" in p for p in parts)
    files.write_json(table.limit(0), str(tmp_path / "j"))
    assert files.json_rows(spark, str(tmp_path / "j"), "id LONG, t STRING").count() == 0
    assert files.json_rows(spark, str(tmp_path / "none"), "id LONG").count() == 0
    versions = str(tmp_path / "v")
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "chapter int, t string")
    for batch in (first, spark.createDataFrame([(1, "A")], "chapter int, t string"), spark.createDataFrame([(1, "A")], "chapter int, t string")):
        files.write_versioned(batch, versions, "chapter")
    assert rows(spark.read.parquet(versions).select("chapter", "t")) == [(1, "A"), (2, "c")]


def test_dense_round_trip(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [i / 10.0, -i / 7.0, 0.5]) for i in range(40)], "id long, embedding array<float>")
    back = {r["id"]: r["embedding"] for r in files.read_dense(files.dense_parts(vectors, 3)).collect()}
    scale = (3.9 + 39 / 7) / 255
    assert len(back) == 40
    assert all(abs(a - b) <= scale / 2 + 1e-6 for r in vectors.collect() for a, b in zip(r["embedding"], back[r["id"]], strict=True))
    (tmp_path / "d.bin").write_bytes(bytes(files.dense_parts(vectors.coalesce(1), 3).first()["content"]))
    assert files.dense_file(spark, str(tmp_path / "d.bin")).count() > 0
    assert files.dense_file(spark, str(tmp_path / "none.bin")) is None


def test_catalogue_has_sql_for_all_queries():
    assert plans.QUERIES.keys() == plans.SQL.keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_catalogue_agrees_with_sql(spark, name):
    import duckdb

    found = plans.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in "region nation customer orders lineitem events documents embeddings benchmark conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = con.execute(plans.SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)

    def plain(row):
        return str(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row))

    assert sorted(map(plain, found.select(*columns).collect())) == sorted(map(plain, wanted.fetchall()))
