import random

from pyspark.sql import functions as F

from trawlspark.operators import corpus as C, segments as G
from trawlspark.plans import segmenting
from trawlspark.sources import files

from .conftest import rows


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A B:1:2 x:y\nA:1\nA:x:2 t\nA:1:2\nA:1:2t\n\n")
    found = C.parse_lines(files.text_lines(spark, str(tmp_path / "a.txt")))
    assert rows(found.select("key", "text")) == [("AB:1:2", "x:y")]
    lines = spark.createDataFrame([(1, "A B:1:2 x:y"), (2, "A:1"), (3, "A:x:2 t"), (4, "A:1:2"), (5, "A:1:2t"), (6, "")], "line_no long, value string")
    assert rows(C.parse_lines(lines).select("key", "text")) == [("AB:1:2", "x:y")]


def test_any_white_space_is_trimmed(spark):
    lines = spark.createDataFrame([(1, "\u3000A B :\t1\u00a0:2\u3000x:y\u2003\t"), (2, "\t"), (3, "A:1:\u30002 t")], "line_no long, value string")
    assert rows(C.parse_lines(lines).select("book", "chapter", "verse", "text")) == [("A", 1, 2, "t"), ("AB", 1, 2, "x:y")]


def test_last_wins_and_coverage(spark):
    table = spark.createDataFrame([("k", 1, "u"), ("k", 2, "v")], "key string, n int, text string")
    assert rows(C.last_by_key(table, ["key"], ["n"], ["text"])) == [("k", "v")]
    pairs = spark.createDataFrame([("x", "y"), ("x", ""), ("", "y"), ("", "")], "ko string, en string")
    assert rows(C.coverage(pairs)) == [(4, 1, 1, 2)]


def test_numbers_are_dense(spark):
    table = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int").repartition(7)
    assert rows(C.numbered(table, ["x"])) == sorted(((i, i) for i in range(101)), key=str)


def test_missing_json_is_empty(spark, tmp_path):
    from trawlspark import schemas

    assert files.json_rows(spark, str(tmp_path / "none.json"), schemas.TAGS).count() == 0
    (tmp_path / "t.json").write_text('[{"key": "a", "tags": "위로"}]')
    assert rows(files.json_rows(spark, str(tmp_path / "t.json"), schemas.TAGS)) == [("a", "위로")]


def normalized(spark, cases):
    data = [(c, i, s, e, n) for c, (n, spans) in enumerate(cases) for i, (s, e) in enumerate(spans)]
    table = spark.createDataFrame(data, "ch int, pos int, verse_start int, verse_end int, n_verses int")
    chapters = spark.createDataFrame([(c, n) for c, (n, _) in enumerate(cases)], "ch int, n_verses int")
    out: dict[int, list] = {}
    for r in G.normalized(G.clipped(table), ["ch"], ["pos"], chapters).orderBy("ch", "verse_start").collect():
        out.setdefault(r["ch"], []).append((r["verse_start"], r["verse_end"], r["filler"]))
    return out


def test_normalizing_cases(spark):
    cases = [(10, [(3, 5), (4, 7), (6, 6)]), (5, []), (5, [(0, 99)]), (5, [(4, 2)]), (4, [(1, 2), (1, 4)])]
    assert normalized(spark, cases) == {
        0: [(1, 2, True), (3, 5, False), (6, 7, False), (8, 10, True)],
        1: [(1, 5, True)],
        2: [(1, 5, False)],
        3: [(1, 5, True)],
        4: [(1, 2, False), (3, 4, False)],
    }


def test_normalizing_covers_every_chapter(spark):
    r = random.Random(1)
    cases = [(n := r.randint(1, 12), [(r.randint(-2, n + 2), r.randint(-2, n + 3)) for _ in range(r.randint(0, 6))]) for _ in range(150)]
    for ch, parts in normalized(spark, cases).items():
        assert [v for s, e, _ in parts for v in range(s, e + 1)] == list(range(1, cases[ch][0] + 1))


def test_normalizing_a_group_over_many_ranges(spark):
    r = random.Random(8)
    n = 4000
    spans = [(s := r.randint(1, n), s + r.randint(0, 6)) for _ in range(2500)]
    found = normalized(spark, [(n, spans)])[0]
    wanted, at = [], 1
    for s, e in sorted(((s, min(e, n)) for s, e in spans), key=lambda x: x[0]):
        if s > at:
            wanted.append((at, s - 1, True))
            at = s
        if e >= at:
            wanted.append((at, e, False))
            at = e + 1
    wanted += [(at, n, True)] if at <= n else []
    covered = lambda parts: [(v, f) for s, e, f in parts for v in range(s, e + 1)]
    assert covered(found) == covered(wanted)


def test_hydrate_keeps_missing_verses(spark, monkeypatch):
    monkeypatch.setattr(G, "TILE", 3)
    verses = [("B", c, v, f"k{c}{v}", None) for c in (1, 2) for v in range(1, 12) if v % 4] + [("B", 1, 1, "z", "later"), ("B", None, 1, "x", "y"), ("B", 1, None, "x", "y")]
    table = spark.createDataFrame(verses, "book string, chapter int, verse int, ko string, en string")
    asked = [("a", "B", 1, 1, 11), ("b", "B", 2, 3, 4), ("c", "B", 1, 14, 15), ("d", "B", 1, 5, 4), ("e", "C", 1, 1, 2)]
    segments = spark.createDataFrame(asked, "id string, book string, chapter int, verse_start int, verse_end int")
    found = {r["id"]: [tuple(v) for v in r["verses"]] for r in G.hydrated(segments, table).collect()}
    for i, book, c, s, e in asked:
        assert found[i] == [(v, f"k{c}{v}", "") if book == "B" and v < 12 and v % 4 else (0, "", "") for v in range(s, e + 1)]


def test_named_rows(spark):
    replies = spark.createDataFrame([("B", 1, 4, '{"paragraphs": [{"verse_start": 2, "verse_end": 3, "theme_title": "T"}]}')], "book string, chapter int, n_verses int, reply string")
    chapters = replies.select("book", "chapter", "n_verses")
    out = G.named(G.normalized(G.clipped(G.paragraphs(replies)), ["book", "chapter"], ["pos"], chapters)).orderBy("verse_start")
    assert [(r["verse_start"], r["verse_end"], r["theme_title"]) for r in out.collect()] == [(1, 1, "본문"), (2, 3, "T"), (4, 4, "본문")]
    records = G.records(out, F.col("book"), F.col("chapter")).orderBy("verse_start").first()
    assert records["id"] == "B:1:1-1" and records["range_label"] == "B 1:1"


def test_records_of_every_order(spark, tmp_path):
    r = random.Random(2)
    lines = [(o, n, r.randint(1, 300), r.randint(1, 9), float(r.randint(1, 50)), float(r.randint(100, 999))) for o in range(1, 61) for n in range(1, r.randint(1, 7) + 1)]
    table = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    wanted = []
    for o in range(1, 61):
        spans = sorted((max(1, p % 45 - 2), n, p, s, x, min(segmenting.N, p % 45 - 2 + int(q % 9))) for k, n, p, s, q, x in lines if k == o)
        parts, at = [], 1
        for start, *_, end in spans:
            if start > end or end < at:
                continue
            parts += [(at, start - 1, "본문")] * (start > at) + [(max(at, start), end, "단락")]
            at = end + 1
        parts += [(at, segmenting.N, "본문")] * (at <= segmenting.N)
        wanted += [(f"O:{o}:{s}-{e}", f"O {o}:{s}" + f"-{e}" * (s != e), ",".join(f"O:{o}:{v}" for v in range(s, e + 1)), t) for s, e, t in parts]
    assert rows(segmenting.segment_records(spark, str(tmp_path))) == sorted(wanted, key=str)
