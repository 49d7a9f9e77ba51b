from pyspark.sql import functions as F

from trawlspark.operators import dense as D
from trawlspark.plans import pipelines as P
from trawlspark.sources import canon


def build(spark, tmp_path):
    (tmp_path / "ko.txt").write_text("창세기:1:1 태초에1) 하나님이\n창세기:1:2 땅이\n창세기:1:3 빛이\n없는책:1:1 x\n시편:1:1 복 있는\n창세기:1:3 빛이 있으라\nbad line\n", encoding="utf8")
    (tmp_path / "en.txt").write_text("Genesis:1:1 In the beginning\nPsalms:1:1 Blessed\nRuth:1:1 only here\nGenesis:1:3 Let there be light: yes\n", encoding="utf8")
    return P.build_verses(spark, str(tmp_path / "ko.txt"), str(tmp_path / "en.txt")).cache()


def test_dimension():
    rows = canon.book_rows()
    assert len(rows) == 66 and rows[0][1:] == ("Genesis", "창세기", "OT", "모세오경") and rows[-1][0] == 65
    assert len(dict(canon.BOOK_TAGS)) == 33 and len(canon.GENRE_TAGS) == 10 and len(dict(canon.GENRE_TAGS)) == 9


def test_corpus_search_and_passages(spark, tmp_path):
    verses = build(spark, tmp_path)
    found = [tuple(r) for r in verses.select("id", "key", "ko", "en", "testament").orderBy("id").collect()]
    assert found == [
        (0, "Genesis:1:1", "태초에 하나님이", "In the beginning", "OT"),
        (1, "Genesis:1:2", "땅이", "", "OT"),
        (2, "Genesis:1:3", "빛이 있으라", "Let there be light: yes", "OT"),
        (3, "Psalms:1:1", "복 있는", "Blessed", "OT"),
    ]
    tags = {r["key"]: r["embed_text"] for r in verses.collect()}
    assert tags["Psalms:1:1"].startswith("복 있는 Blessed | 태그: 위로 탄식") and "창조" in tags["Genesis:1:2"]

    answer = P.search(verses, " 빛이 light ").first()
    assert answer["mode"] == "keyword" and answer["total"] == 4 and answer["results"][0]["id"] == 2
    assert [c["verse"] for c in answer["results"][0]["context"]] == [1, 2, 3]
    vectors = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)], "id long, embedding array<float>")
    both = P.search(
        verses, "빛이", vectors, 4, lambda q: [0.0, 0.0, 0.0, 1.0], lambda q: '{"emotions": ["joy"], "search_query": "Blessed 땅이"}',
        lambda q, listing, e: '{"results": [{"index": 2, "reason": "why"}]}' if listing.startswith("[1] 시편 1:1 - 복 있는") else None,
    ).first()
    assert both["mode"] == "AI" and both["emotions"] == ["joy"] and [r["rank"] for r in both["results"]] == [2]

    path = str(tmp_path / "index")
    D.grow_index(spark, path, vectors.union(spark.createDataFrame([(9, [0.0, 0.0, 0.0, 9.0])], vectors.schema)), 4, 2)
    stored = P.search(verses, "빛이", None, 4, lambda q: [0.0, 0.0, 0.0, 1.0], index=spark.read.parquet(path)).first()
    raw = P.search(verses, "빛이", vectors, 4, lambda q: [0.0, 0.0, 0.0, 1.0]).first()
    assert stored["usedDense"] and stored["results"] == raw["results"]

    replies = spark.createDataFrame([("Genesis", 1, '{"paragraphs": [{"verse_start": 2, "verse_end": 9, "theme_title": "t", "characteristics": ["c"], "core_meaning": "m"}]}')], "book string, chapter int, reply string")
    passages = P.build_passages(verses, replies).orderBy("id").collect()
    assert [(p["id"], p["range_label"], p["theme_title"]) for p in passages] == [
        ("Genesis:1:1-1", "창세기 1:1", "본문"), ("Genesis:1:2-3", "창세기 1:2-3", "t"), ("Psalms:1:1-1", "시편 1:1", "Psalms 1장"),
    ]
    out = str(tmp_path / "passages")
    P.write_passages(P.build_passages(verses, replies), out)
    P.write_passages(P.build_passages(verses.where("book_en = 'Psalms'"), replies.limit(0)).withColumn("theme_title", F.lit("new")), out)
    assert sorted((r["id"], r["theme_title"]) for r in spark.read.parquet(out).collect()) == [("Genesis:1:1-1", "본문"), ("Genesis:1:2-3", "t"), ("Psalms:1:1-1", "new")]
    assert P.segment_prompts(verses).where("book = 'Genesis'").first()["block"] == "1: 태초에 하나님이\n2: 땅이\n3: 빛이 있으라"


def test_search_goes_on_without_its_models(spark, tmp_path, monkeypatch):
    import time

    verses = build(spark, tmp_path)
    vectors = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)], "id long, embedding array<float>")

    def fails(*_):
        raise OSError("no network")

    def asked(*_):
        calls.append(1)
        return '{"results": [{"index": 4, "reason": "last"}]}'

    calls = []
    plain = P.search(verses, "빛이 땅이 복 태초에").first()
    failed = P.search(verses, "빛이 땅이 복 태초에", vectors, 4, fails, fails, fails).first()
    assert failed == plain and failed["mode"] == "keyword" and len(failed["results"]) == 4
    monkeypatch.setattr(P, "EXPAND_S", 0.05)
    monkeypatch.setattr(P, "EMBED_S", 0.05)
    late = P.search(verses, "빛이 땅이 복 태초에", vectors, 4, lambda q: time.sleep(1) or [1.0] * 4, lambda q: time.sleep(1) or '{"search_query": "Blessed"}').first()
    assert late == plain
    assert [r["rank"] for r in P.search(verses, "빛이 땅이 복 태초에", rerank=asked).first()["results"]] == [4] and len(calls) == 1
    few = P.search(verses, "Blessed", rerank=asked).first()  # two candidates: nobody is asked
    assert len(calls) == 1 and [r["id"] for r in few["results"]] == [3, 2]
    ticks = iter([0.0, 7.5])
    over = P.search(verses, "빛이 땅이 복 태초에", rerank=asked, clock=lambda: next(ticks)).first()
    assert len(calls) == 1 and over == plain


def test_model_used_is_what_expanded_the_query(spark, tmp_path):
    verses = build(spark, tmp_path)
    reply = lambda *_: '{"results": [{"index": 1}]}'
    expand = lambda q: '```json\n{"emotions": ["joy"], "search_query": "빛이 땅이 복 태초에"}\n```'
    for expander, reranker in ((expand, None), (expand, reply), (None, reply), (lambda q: '{"search_query": ""}', reply)):
        row = P.search(verses, "빛이 땅이 복 태초에", expand=expander, rerank=reranker).first()
        assert row["usedGemini"] == (expander is expand) and row["mode"] == ("AI" if expander is expand else "keyword")
        assert row["emotions"] == (["joy"] if expander is expand else [])
