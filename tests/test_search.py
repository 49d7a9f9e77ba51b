import random

import pytest
from pyspark.sql import functions as F

from trawlspark.functions import text as X
from trawlspark.operators import dense as D, postings as I, search as S
from trawlspark.plans import searches

from .conftest import rows


def ranked(spark, ids, name):
    return spark.createDataFrame([(i, r + 1) for r, i in enumerate(ids)], f"id long, {name} int")


def test_fusion_weights_and_misses(spark):
    fused = S.fuse(ranked(spark, [7, 8], "dense_rank"), ranked(spark, [7, 9], "sparse_rank"), True)
    scores = {r["id"]: (r["score"], r["rank"]) for r in fused.collect()}
    assert scores[7] == (round(1 / 61, 6), 1)
    assert scores[8] == (round(0.65 / 62 + 0.35 / 360, 6), 2)
    assert scores[9] == (round(0.65 / 360 + 0.35 / 62, 6), 3)
    assert S.fuse(None, ranked(spark, [5], "sparse_rank"), False).first()["score"] == round(1 / 61, 6)
    assert S.fuse(None, ranked(spark, [5], "sparse_rank"), True).first()["score"] == round(0.65 / 360 + 0.35 / 61, 6)


def test_ties_keep_the_dense_order(spark):
    fused = S.fuse(ranked(spark, [3, 1, 2], "dense_rank"), ranked(spark, [], "sparse_rank"), False)
    assert [r["id"] for r in fused.orderBy("rank").collect()] == [3, 1, 2]


def candidates(spark, n):
    return spark.createDataFrame([(100 + i, i, 1.0 / i) for i in range(1, n + 1)], "id long, rank int, score double")


@pytest.mark.parametrize(
    ("n", "reply", "expected"),
    [
        (15, '{"results": [{"index": 2}, {"index": 2}, {"index": 99}, {"index": 0}, {"index": 1}]}', [(102, 2), (101, 1)]),
        (3, '{"results": [{"index": 3}]}', [(101, 1), (102, 2), (103, 3)]),
        (6, "not json", [(101 + i, 1 + i) for i in range(5)]),
        (6, '{"results": [{"index": 70}]}', [(101 + i, 1 + i) for i in range(5)]),
        (6, None, [(101 + i, 1 + i) for i in range(5)]),
    ],
)
def test_rerank(spark, n, reply, expected):
    out = S.apply_rerank(candidates(spark, n), F.lit(reply).cast("string")).orderBy("position")
    assert [(r["id"], r["rank"]) for r in out.collect()] == expected


def test_context(spark):
    verses = spark.createDataFrame([("B", 1, v, f"t{v}") for v in range(1, 5)], "book string, chapter int, verse int, text string")
    hits = spark.createDataFrame([("B", 1, 1), ("B", 1, 3)], "book string, chapter int, verse int")
    found = {r["verse"]: [c["verse"] for c in r["context"]] for r in S.with_context(hits, verses, ["text"]).collect()}
    assert found == {1: [1, 2, 3], 3: [1, 2, 3, 4]}


def test_contexts_of_all_verses(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 4)
    r = random.Random(9)
    data = [("B", c, v, f"t{v}") for c in (1, 2) for v in r.sample(range(1, 40), 25)] + [("B", None, 1, "x"), ("B", 1, None, "x")]
    verses = spark.createDataFrame(data, "book string, chapter int, verse int, text string")
    found = {(x["chapter"], x["verse"]): [tuple(c) for c in x["context"]] for x in S.all_contexts(verses, ["text"]).collect()}
    good = [d for d in data if d[1] and d[2]]
    assert found == {(c, v): sorted((w, t) for _, d, w, t in good if d == c and abs(w - v) <= 2) for _, c, v, _ in good}


def vector_tables(spark, n=300, dim=6, seed=5):
    r = random.Random(seed)
    data = [(i, [r.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    data += [(n + i, data[i][1]) for i in range(20)] + [(n + 30, [0.0] * dim)]  # equal vectors, and none at all
    table = spark.createDataFrame(data, "id long, embedding array<float>").repartition(3)
    return table, table.where("id % 9 = 0").withColumnRenamed("id", "query_id")


def one_by_one(table, queries, dim, k):
    return sorted((q["query_id"], r["id"], r["similarity"], r["dense_rank"]) for q in queries.collect() for r in S.dense_topk(table, q["embedding"], dim, k).collect())


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_many_vectors_rank_as_one_by_one(spark, monkeypatch, sent):
    monkeypatch.setattr(D, "BLOCK", 32)
    monkeypatch.setattr(D, "PACK", 7)
    monkeypatch.setattr(D, "SENT", sent)
    table, queries = vector_tables(spark, 90)
    found = sorted(tuple(r) for r in D.dense_topk_batch(table, queries, 6, 12).select("query_id", "id", "similarity", "dense_rank").collect())
    assert found == one_by_one(table, queries, 6, 12)
    odd = table.union(spark.createDataFrame([(None, [1.0] * 6), (7, None)], "id long, embedding array<float>"))
    assert D.dense_topk_batch(odd, queries.limit(1), 6, 500).count() == 111
    assert D.dense_topk_batch(table.limit(0), queries, 6, 5).count() == D.dense_topk_batch(table, queries.limit(0), 6, 5).count() == 0


@pytest.mark.parametrize("stored", [False, True])
def test_no_batch_of_vectors_grows_with_queries(spark, tmp_path, monkeypatch, stored):
    seen = tmp_path / "seen"

    def watched(df, function, schema, given=D.map_arrow):
        def run(batches):
            def each():
                for batch in batches:
                    with open(seen, "a") as out:
                        out.write(f"{batch.nbytes}\n")
                    yield batch

            yield from function(each())

        return given(df, run, schema)

    table = spark.range(6000, numPartitions=2).select("id", F.array(*[F.sin(F.col("id") * n).cast("float") for n in range(1, 65)]).alias("embedding"))
    queries = table.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    if stored:
        D.grow_index(spark, str(tmp_path / "index"), table, 64, 128)
    monkeypatch.setattr(D, "map_arrow", watched)
    found = D.index_topk_batch(spark.read.parquet(str(tmp_path / "index")), queries, 64, 3) if stored else D.dense_topk_batch(table, queries, 64, 3)
    assert found.count() == 3 * 2000
    assert max(map(int, seen.read_text().split())) < 3 << 20  # ten thousand vectors; blocks times packs were more


def test_similarities_of_odd_vectors(spark):
    r = random.Random(8)
    data = [(i, [r.choice((0.0, 1e-30, 1e-5, 1.0, 3e38, r.gauss(0, 1))) * r.choice((1, -1)) for _ in range(6)]) for i in range(150)]
    data += [(150 + i, data[0][1]) for i in range(120)] + [(300, [1e-5] + [0.0] * 5)]
    table = spark.createDataFrame(data, "id long, embedding array<float>").repartition(3)
    queries = table.where("id % 25 = 0 OR id > 299").withColumnRenamed("id", "query_id")
    found = sorted(tuple(r) for r in D.dense_topk_batch(table, queries, 6, 12).select("query_id", "id", "similarity", "dense_rank").collect())
    assert [(q, i, round(s, 14), n) for q, i, s, n in found] == [(q, i, round(s, 14), n) for q, i, s, n in one_by_one(table, queries, 6, 12)]


def test_an_index_grows_and_ranks_as_decoded(spark, tmp_path):
    table, queries = vector_tables(spark)
    path = str(tmp_path / "index")
    D.grow_index(spark, path, table.where("id % 3 = 0"), 6, 50)
    first = {r["first_id"]: bytes(r["content"]) for r in spark.read.parquet(path).collect()}
    D.grow_index(spark, path, table.where("id < 100 OR id % 3 = 0"), 6, 50)
    D.grow_index(spark, path, table.withColumn("embedding", F.when(F.col("id") == 250, F.transform("embedding", lambda x: x * 1000)).otherwise(F.col("embedding"))), 6, 50)
    D.grow_index(spark, path, table, 6, 50)  # nothing is lacking
    parts = spark.read.parquet(path)
    held = {r["first_id"]: bytes(r["content"]) for r in parts.collect() if r["first_id"] % 3 == 0}
    assert first.items() <= held.items() and sorted(r[0] for r in D.part_ids(parts).collect()) == sorted(r[0] for r in table.select("id").collect())
    back = D.read_parts(parts)
    raw = {r["id"]: r["embedding"] for r in table.collect()}
    for r in back.collect():
        if r["id"] != 250:
            assert max(abs(a - b) for a, b in zip(r["embedding"], raw[r["id"]], strict=True)) <= r["scale"] / 2 + 1e-6
    assert max(r["scale"] for r in back.where("id < 200").collect()) < 0.1  # far from the large one's
    for low, high in ((None, None), (60, 220)):
        found = D.index_topk_batch(parts, queries, 6, 8, low, high)
        wanted = back.where(f"id BETWEEN {low} AND {high}") if low else back
        assert sorted(tuple(r) for r in found.select("query_id", "id", "similarity", "dense_rank").collect()) == one_by_one(wanted.select("id", "embedding"), queries, 6, 8)
    plan = D.parts_within(parts.select("first_id", "last_id"), 60, 220)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(last_id,60), LessThanOrEqual(first_i" in plan


def test_postings_in_many_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_DOCS", 7)
    monkeypatch.setattr(I, "GROUP", 3)
    r = random.Random(11)
    words = ["".join(r.choice("abcé가🙂") for _ in range(r.randint(1, 5))) for _ in range(60)]
    line = lambda n: "".join(r.choice(words) + r.choice([" ", "\n", "\u3000"]) for _ in range(n))
    docs = [(i if i % 13 else None, r.choice([None, "", line(r.randint(1, 9))])) for i in range(90)]
    queries = [(i, line(4)) for i in range(10)] + [(10, None), (11, ""), (12, "zz")]
    found = I.sparse_topk_batch(spark.createDataFrame(docs, "id long, text string").repartition(4), spark.createDataFrame(queries, "query_id long, query string"), F.col("text"), 9)
    wanted = []
    for q, text in queries:
        weights = X.token_weights(text or "")
        scores = sorted(((-sum(w for t, w in weights.items() if t in (d or "")), i is not None, i or 0, i) for i, d in docs), key=lambda x: x[:3])
        wanted += [(q, i, -s, n + 1) for n, (s, _, _, i) in enumerate(x for x in scores[:9] if x[0])]
    got = [tuple(x) for x in found.select("query_id", "id", "sparse_score", "sparse_rank").collect()]
    assert sorted(got, key=lambda x: (x[0], x[3])) == sorted(wanted, key=lambda x: (x[0], x[3]))
    assert I.sparse_topk_batch(spark.createDataFrame([], "id long, text string"), spark.createDataFrame(queries, "query_id long, query string"), F.col("text"), 9).count() == 0


def test_one_batch_writes_no_index_and_finds_what_a_written_one_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "GROUP", 2)
    monkeypatch.setattr(I, "HELD", 2)
    r = random.Random(12)
    line = lambda n: " ".join("".join(r.choice("abcd\u00e9\uac00") for _ in range(r.randint(1, 6))) for _ in range(n))
    docs = spark.createDataFrame([(i, line(r.randint(0, 8))) for i in range(120)], "id long, text string")
    queries = spark.createDataFrame([(i, line(3)) for i in range(11)], "query_id long, query string")
    I.write_postings(docs, F.col("text"), str(tmp_path / "index"))
    monkeypatch.setattr(I, "write_postings", None)
    found = I.sparse_topk_batch(docs, queries, F.col("text"), 7)
    assert rows(found) == rows(I.search(spark.read.parquet(str(tmp_path / "index")), queries, 7).select(*found.columns)) and found.count() > 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "vocabulary" not in plan and "docs#" not in plan  # no list of documents is read or sent


@pytest.mark.parametrize("table", [0, 1 << 23])
def test_blocks_pass_by_a_tree_of_tokens(monkeypatch, table):
    monkeypatch.setattr(I, "TABLE", table)
    r = random.Random(13)
    line = lambda n: "".join(r.choice(["ab", "abc", "b", "bcab", "\u00e9", "\uac00\ub098", "\U0001f642", "zz"]) + r.choice(["", "", " ", "\u3000"]) for _ in range(n))
    parts = {p: {} for p in (0, 2)}
    for q in range(9):
        for t, w in X.token_weights(line(6)).items():
            parts[2 * (q % 2)].setdefault(t, []).append((q, w))
    tokens, best, texts = I._Tokens(parts), I._Best(6), [line(r.randint(0, 9)) for _ in range(80)]
    assert (tokens.table is None) == (table == 0)
    for at in range(0, 80, 30):
        I._pass(texts[at : at + 30], *I._named(list(range(at, min(80, at + 30)))), tokens, best)
    for q in range(9):
        scores, ids, _ = best.held[q]
        wanted = sorted(x for x in [(-sum(w for t, own in parts[2 * (q % 2)].items() for o, w in own if o == q and t in d), i) for i, d in enumerate(texts)] if x[0])[:6]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == wanted


def test_order_of_partitions_does_not_matter(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(60)], "id long, text string")
    a = rows(S.sparse_topk(docs, "word1 common", F.col("text"), 7))
    b = rows(S.sparse_topk(docs.repartition(5), "word1 common", F.col("text"), 7))
    assert a == b and len(a) == 7


def test_checked_query():
    assert S.checked_query("　 a b\n") == "a b"
    for bad in ("  ", "x" * 301):
        with pytest.raises(ValueError):
            S.checked_query(bad)


def test_batch_searches_for_every_item_with_all_words(spark, tmp_path):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé가나") for _ in range(r.randint(1, 5))) for _ in range(80)]
    line = lambda n: "".join(r.choice(words) + r.choice([" ", "\n", "\u3000", "  "]) for _ in range(n))
    docs = [(i, line(r.randint(0, 12)) or None, r.choice(["a", None]), "en") for i in range(130)]
    items = [(i, line(9)) for i in range(115)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wanted = []
    for i, q in items:
        scores = [(-sum(w for t, w in X.token_weights(q).items() if t in f"{t_ or ''} {s or ''} {x}"), d) for d, t_, s, x in docs]
        wanted += [(i, d, -s, n + 1) for n, (s, d) in enumerate(sorted(x for x in scores if x[0])[:50])]
    assert rows(searches.sparse_topk_batch(spark, str(tmp_path)).select("query_id", "id", "sparse_score", "sparse_rank")) == sorted(wanted, key=str)


GOOD = '{"emotions": ["joy"], "biblical_keywords": ["a", "b", "c", "d", "e"], "search_query": "w"}'


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize(("expansion", "used"), [(GOOD, True), (f"```json\n{GOOD}\n```", True), (None, False), ("no json", False), ('{"emotions": ["joy"], "search_query": ""}', False)])
@pytest.mark.parametrize("reply", ['{"results": [{"index": 2}]}', None])
def test_flags_follow_the_expansion(spark, expansion, used, reply, dense):
    results = S.apply_rerank(candidates(spark, 5), F.lit(reply).cast("string"))
    row = S.envelope(results, "q", F.lit(5), dense, F.lit(expansion).cast("string")).first()
    assert row["usedGemini"] == used and row["usedDense"] == dense and row["mode"] == ("AI" if used else "semantic" if dense else "keyword")
    assert (row["expanded_query"], row["emotions"]) == (("w", ["joy"]) if used else (None, []))
    assert [r["id"] for r in row["results"]] == ([102] if reply else [101, 102, 103, 104, 105])
    hints = spark.range(1).select(S.hint_lines(F.lit(expansion).cast("string")).alias("h")).first()["h"]
    assert tuple(hints) == (("joy", "a, b, c, d") if used else ("", ""))


def test_candidates_are_ranked_once(spark):
    docs = spark.createDataFrame([(i, f"word{i % 9}") for i in range(60)], "id long, text string")
    top = S.fuse(None, S.sparse_topk(docs, "word1 word2", F.col("text")), False)
    plan = S.apply_rerank(top, F.lit(GOOD))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ExistingRDD") == 1
