"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawlspark.llm import divergence, exact_dedup, html_text, mixing, near_dedup, packing, quality, token_counts, token_files, tokens, url_filters
from trawlspark.llm.components import connected_components, roots

from ..conftest import rows
from .layouts import LAYOUTS
from .pages import PAGES

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, hash string, row int"


def documents(spark, *texts, lang="en", source="s", ids=None):
    """Documents with columns whose names the operators use inside."""
    data = [(i, t, lang, source if isinstance(source, str) or source is None else source[k], 0, None, "h", 7) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(data, SCHEMA)


def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    return documents(spark, None, "", " \n\t", "a", "a", long, "x" * 50_000, "ünï 漢字 🙂 <|endoftext|>", None, ids=[1, 2, 3, 4, 4, 5, None, 6, 1], source=["s", None, "t", "s", "s", None, "t", "s", "s"])


# --- shared -------------------------------------------------------------------------------------------------------


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(30)] + [(3, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert dict(rows(found)) == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_roots_of_a_forest(spark):
    r = random.Random(3)
    links = [(i, r.randrange(i)) for i in range(1, 60) if r.random() < 0.8] + [(100 + i, 99 + i) for i in range(1, 30)]
    up = dict(links)

    def root(x):
        return root(up[x]) if x in up else x

    found = dict(rows(roots(spark.createDataFrame(links, "u long, v long"))))
    assert found == {x: root(x) for edge in links for x in edge}
    assert roots(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 url filters ------------------------------------------------------------------------------------------------


def test_urls(spark):
    link = '<link href="https://blocked.example.org/es/9" rel="canonical">'
    data = [
        (1, "http://A.example.org/es/1?x#y", None), (2, "http://a.example.org/en/15", ""), (3, "http://x.com/fr/", "<p>"), (4, "http://x.com/de/1", None),
        (5, "http://x.net/q", link), (6, None, link), (7, "no scheme", link), (8, "http://org.net/es/", None), (9, "http://x.net/to", '<meta http-equiv="refresh" content="0;url=/q">'),
        (5, "http://x.net/q", link), (10, "http://x.net/both", '<link rel=canonical href="http://x.net/hub">'), (11, "http://x.com/de/2", '<link rel=canonical href="http://x.net/hub">'),
        (12, "http://x.com/fr/3", '<link rel=canonical href="http://x.net/hub">'),
    ]
    found = {r["page_id"]: r for r in url_filters.judge_urls(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert [(found[i]["rule"], found[i]["verdict"]) for i in (1, 2, 3, 4)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert (found[1]["host"], found[1]["path"]) == ("a.example.org", "/es/1")
    assert (found[5]["rule"], found[5]["verdict"], found[5]["via"]) == (None, "block", "alias")
    assert (found[9]["verdict"], found[9]["via"]) == ("block", "alias")
    assert (found[10]["verdict"], found[10]["via"]) == ("allow", "alias")
    assert [(found[i]["host"], found[i]["path"], found[i]["verdict"]) for i in (6, 7)] == [("", "", "allow")] * 2
    assert found[8]["rule"] is None
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_link_forms(spark):
    forms = [
        ("http://x.com/a/b/c?q#f", to, target)
        for to, target in (
            ("index.html", "https://x.com/a/b/index.html"), ("../de/1", "https://x.com/a/de/1"), ("../../../de/1", "https://x.com/de/1"), ("./d/./e/..", "https://x.com/a/b/d/"),
            ("?id=3", "https://x.com/a/b/c?id=3"), ("#top", "https://x.com/a/b/c?q"), ("/go?next=https://other.com/de/1", "https://x.com/go?next=https://other.com/de/1"),
            ("go?next=https://other.com/de/1", "https://x.com/a/b/go?next=https://other.com/de/1"), ("?next=https://other.com/../1", "https://x.com/a/b/c?next=https://other.com/../1"),
            ("//Y.com/d", "https://y.com/d"), ("HTTP://Y.com", "https://y.com/"), ("/a/../d", "https://x.com/d"), ("https:d", "https://x.com/a/b/d"), ("mailto:a@x.com", None),
        )
    ] + [("http://x.com", "d", "https://x.com/d"), ("http://x.com", "?id=3", "https://x.com/?id=3"), ("x.com/a", "d", None), ("x.com/a", "/go?next=https://other.com/de/1", None)]
    data = [(i, url, html.format(to)) for i, (url, to, _) in enumerate(forms) for html in ('<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">')]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    found = [r["target"] for r in url_filters.links(pages).collect()]
    assert found == [t for *_, t in forms if t for _ in range(2)]


#: Ways to write a canonical link or a refresh, with a place for the url, and ways that are none.
MARKUP = (
    '<link rel="alternate canonical" href="{}">', "<LINK HREF='{}' REL='Canonical'/>", "<link rel=canonical href={}>", '<link title="a > b" rel="canonical" href="{}">', '<link data-href="/wrong" rel="canonical" href="{}">',
    '<link title="x href=/wrong" rel=canonical href="{}">', '<!-- <link rel="canonical" href="/wrong"> --><link rel="canonical" href="{}">', '<script>"<link rel=canonical href=/wrong>"</script><link rel="canonical" href="{}">',
    '<link rel="stylesheet" href="/wrong"><link rel="canonical" href=" {}\n">', '<link rel="canonical" href="{}"><link rel="canonical" href="/second">', '<meta http-equiv=refresh content="0;url={}">', "<meta content='5; {}' http-equiv='Refresh'>",
    """<meta http-equiv="refresh" content="0, URL = '{}'">""", '<style>/* <base href="/wrong/"> */</style><meta name=x content="0;url=/wrong"><meta http-equiv="refresh" content="0 url={}">',
)
NO_LINKS = (
    '<link rel="canonicals" href="/wrong">', '<link rel="canonical">', '<link rel="canonical" data-href="/wrong">', '<linked rel="canonical" href="/wrong">', '<meta http-equiv="refreshed" content="5; /wrong">', '<a rel="canonical" href="/wrong">',
    '<meta http-equiv="refresh" content="url=/wrong">', '<meta http-equiv="refresh" content="5">', '<!-- <link rel="canonical" href="/wrong">', '<script><link rel="canonical" href="/wrong"></script >', '<textarea><link rel=canonical href=/wrong></textarea>',
    '<link rel="canonical" href="/wrong',
)


def test_forms_of_markup(spark):
    data = [(i, "http://x.com/a", m.format("/de/1?x=1")) for i, m in enumerate(MARKUP)] + [(100 + i, "http://x.com/a", m) for i, m in enumerate(NO_LINKS)]
    found = [r["target"] for r in url_filters.links(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)).collect()]
    assert found == ["https://x.com/de/1?x=1"] * len(MARKUP)
    urls = [("x&#46;com", "x.com"), ("a b/c", "a b/c"), ("q?a=1&amp;b=2&lt=3&bogus;", "q?a=1&b=2&lt=3&bogus;"), ("&#x44f;&#0;&#xD800;&eacute;&sol;", "я��é/"), ("&amp;amp;&#38;&#47;46;", "&amp;&/46;")]
    data = [(i, "http://x.com/", f'<link rel="canonical" href="/{u}">') for i, (u, _) in enumerate(urls)]
    found = [r["target"] for r in url_filters.links(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)).collect()]
    assert found == [f"https://x.com/{u}" for _, u in urls]


def test_an_allow_wins_between_rules_of_one_length(spark):
    for rules in ((("allow", "x.com", "/a"), ("block", "x.com", "/a")), (("block", "x.com", "/a"), ("allow", "x.com", "/a"))):
        assert spark.range(1).select(url_filters.rule_of(F.lit("x.com"), F.lit("/ab"), rules)["verdict"]).first()[0] == "allow"


def test_relative_links_carry_verdicts(spark):
    data = [
        (1, "http://a.net/x/y", '<meta http-equiv="refresh" content="0; url=../hub">'), (2, "http://x.com/de/1", '<link rel="canonical" href="http://a.net/hub">'),
        (3, "http://b.net/x", '<link rel="canonical" href="/go?next=https://x.com/de/1">'), (4, "http://c.net/x", '<base href="//a.net/z/"><link rel="canonical" href="../hub">'),
    ]
    found = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "allow", 4: "block"}


def brute_verdicts(pages, targets):
    """Links resolved by the standard library, components by union-find, rules one by one."""
    from urllib.parse import urljoin, urlsplit

    def resource(url):
        at = urlsplit(urljoin(url, urlsplit(url).path or "/") if urlsplit(url).path in ("", "/") else url)
        path = urlsplit(urljoin(url, urlsplit(url).path)).path or "/"
        return f"https://{at.netloc.lower()}{path}" + (f"?{urlsplit(url).query}" if "?" in url.split("#")[0] else "")

    def ruled(url):
        rest = url.split("://", 1)[1]
        host, path = re.match("[^/?#]*", rest)[0].lower(), re.match("[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, url, html in pages:
        base = urljoin(url, m[1]) if (m := re.search('<base href="([^"]*)"', html or "")) else url
        for to in targets.get(i, ()):
            target = urljoin(base, to.replace("&amp;", "&"))
            if "://" in target:
                parent[find(resource(url))] = find(resource(target))
    decision = {}
    for node in list(parent):
        if ruled(node)[1]:
            decision.setdefault(find(node), set()).add(ruled(node)[1])
    out = []
    for i, url, _ in pages:
        rule, verdict = ruled(url)
        known = decision.get(find(resource(url)), set())
        out.append((i, rule, verdict or ("allow" if "allow" in known else "block" if known else "allow"), "rule" if rule else "alias" if known else "default"))
    return sorted(out)


def test_random_link_graphs(spark):
    import duckdb

    from trawlspark.llm import queries

    r = random.Random(31)
    sites = ["http://a.net", "https://B.net", "http://x.com", "http://sub.x.com", "http://example.org", "http://c.io"]
    paths = ["/", "/p/1", "/p/2", "/p/q/3", "/de/1", "/fr/2", "/es/4", "/en/1", "/go", ""]
    queries_ = ["", "", "", "?id=1", "?u=http://x.com/de/1"]
    forms = ["1", "../1", "./2", "../../de/1", "q/3", "?id=1", "?id=1&amp;b=2", "/p/2", "/de/../fr/2", "//a.net/p/1", "//x.com/de/1", "mailto:a@b", "#x", "javascript:x()"]
    target = lambda: r.choice(sites) + r.choice(paths) + r.choice(queries_) if r.random() < 0.4 else r.choice(forms)
    pages, targets = [], {}
    for i in range(160):
        html = f'<base href="{r.choice(("/p/", "//c.io/p/", "q/", "http://a.net/de/"))}">' * (r.random() < 0.1)
        for kinds, often in ((MARKUP[:9], 0.5), (MARKUP[10:], 0.3)):
            if r.random() < often:
                to, form = target(), r.choice(kinds)
                targets.setdefault(i, []).append(to)
                html += r.choice(("", "", r.choice(NO_LINKS[:6]))) + form.format(to)
        pages.append((i, r.choice(sites) + r.choice(paths) + r.choice(queries_) + r.choice(("", "", "#f")), html or None))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = url_filters.judge_urls(table.withColumn("node", F.lit(1)).withColumn("verdict", F.lit(2)))
    columns = ["page_id", "rule", "verdict", "via"]
    assert rows(found.select(columns)) == sorted(brute_verdicts(pages, targets), key=str)
    assert {x["via"] for x in found.collect()} == {"rule", "alias", "default"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    odd_pages = [*pages, (500, None, None), (501, None, "<base>"), (502, "no scheme", pages[0][2]), (503, "", ""), (500, None, None)]
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", odd_pages)
    both = url_filters.judge_urls(spark.createDataFrame(odd_pages, "page_id long, url string, html string"))
    wanted = con.execute(queries.SQL["op1_url_filters"])
    names = [c[0] for c in wanted.description]
    assert rows(both.select(names)) == sorted(map(tuple, wanted.fetchall()), key=str)


def test_url_filters_very_long(spark):
    long = "http://x.net/" + "a/../" * 3000 + "b" * 50_000
    data = [(1, long, f'<link rel="canonical" href="{long}">' + "<" * 100_000), (2, "http://x.com/de/" + "?" * 9000, "<link " * 20_000), (None, None, None)]
    found = {x["page_id"]: (len(x["path"]), x["verdict"]) for x in url_filters.judge_urls(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert found == {1: (len(long) - 12, "allow"), 2: (4, "block"), None: (0, "allow")}


# --- 2 mixing -----------------------------------------------------------------------------------------------------


def test_targets_stop_and_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 0)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weights, sizes = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 10, "b": 1000, "c": 0, None: 100}
    target, left = dict.fromkeys(sizes, 0.0), 1.5 * 1110
    full = set()
    while left > 1e-9:
        open_ = [s for s in sizes if s not in full]
        total, over = sum(weights[s] for s in open_), 0.0
        for s in open_:
            target[s] += left * weights[s] / total
        for s in open_:
            if target[s] >= 2 * sizes[s]:
                over += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
        left = over
    assert all(abs(found[s] - target[s]) < 1e-6 for s in sizes)


def test_mix_meets_its_budgets(spark):
    docs = documents(spark, *[" ".join(["w"] * (i % 17 + 1)) for i in range(300)], source=[("a", "b", None)[i % 7 % 3] for i in range(300)])
    plan = mixing.mix(docs).collect()
    for source in ("a", "b", None):
        own = [r for r in plan if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs.repartition(7)))
    taken = {r["doc_id"]: r["taken"] for r in plan}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words: dict[int, int] = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {k: v for k, v in taken.items() if v}


def test_mixing_odd_rows(spark):
    plan = mixing.mix(odd(spark)).collect()
    assert len(plan) == 9 and sum(r["size"] for r in plan) == 1 + 1 + 40_000 + 1 + 4
    taken, mixed = {}, {}
    for found, into in (((((r["doc_id"], r["source"]), r["taken"]) for r in plan), taken), ((((r["doc_id"], r["source"]), len((r["text"] or "").split())) for r in mixing.mixed_documents(odd(spark)).collect()), mixed)):
        for key, n in found:
            into[key] = into.get(key, 0) + n
    assert mixed == {k: v for k, v in taken.items() if v}
    assert mixing.mix(odd(spark).limit(0)).count() == mixing.mixed_documents(odd(spark).limit(0)).count() == 0


def test_mixing_rows_that_share_an_id(spark):
    """A third of all rows without an id, and ids in several rows, of equal and of different sizes."""
    ids = [None if i % 3 == 0 else i % 5 for i in range(200)]
    docs = documents(spark, *[" ".join([f"w{i}"] * (i % 4)) for i in range(200)], ids=ids, source=[("a", "b", None)[i % 7 % 3] for i in range(200)])
    taken, mixed = {}, {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["source"], r["size"]] = taken.get((r["doc_id"], r["source"], r["size"]), 0) + r["taken"]
    by_text = {}
    for r in mixing.mixed_documents(docs).collect():
        words = r["text"].split()
        assert len(set(words)) == 1
        by_text[words[0]] = by_text.get(words[0], 0) + len(words)
    for i in range(200):
        key = (ids[i], ("a", "b", None)[i % 7 % 3], i % 4)
        got = by_text.get(f"w{i}", 0)
        assert got <= 2 * (i % 4)
        mixed[key] = mixed.get(key, 0) + got
    assert mixed == taken


# --- 3 quality rules ----------------------------------------------------------------------------------------------


def brute_counts(text):
    from collections import Counter

    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


def test_counts_against_brute_force():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("ab é\n\t#\x1c　|") for _ in range(r.randint(0, 60)))
        assert divergence.text_counts(text.encode())[:5] == brute_counts(text)


def prose(r, n, lang="en"):
    common = divergence.COMMON_WORDS[lang].split()
    return " ".join(r.choice(common) if r.random() < 0.5 else "".join(r.choice("aeiounrstl") for _ in range(r.randint(3, 9))) for _ in range(n))


def test_junk_goes_and_prose_stays(spark):
    r = random.Random(2)
    good = [prose(r, 200) for _ in range(40)]
    bad = [" ".join(w + "***" for w in prose(r, 200).split()), prose(r, 200).upper(), "one two three " * 40, "short text"]
    docs = documents(spark, *good, *bad)
    found = {x["doc_id"]: x for x in divergence.judge(docs).collect()}
    assert all(found[i]["kept"] for i in range(40)) and not any(found[40 + i]["kept"] for i in range(4))
    assert [found[40 + i]["base_failed"] for i in range(4)] == [False, False, True, True]
    kept = divergence.passing(docs.union(docs.limit(1)))
    assert kept.columns == docs.columns and kept.count() == 41


def foreign(r, n, letters):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n))


def test_languages_and_scripts_without_a_reference_stay(spark):
    r = random.Random(21)
    italian = "il di che è la non per una sono mi ho si lo ma ti cosa con no ha come le se un bene io hai questo qui"
    polish = "nie to się w na że z do jest co jak tak mnie ale za go i o ty mi jestem czy ci po tylko już"
    others = [
        (foreign(r, 300, "абвгдежзиклмнопрст"), "ru"), (foreign(r, 300, "абвгдежзиклмнопрст"), None), (foreign(r, 300, "абвгдежзиклмнопрст"), "en"),
        (foreign(r, 300, "αβγδεζηθικλμν"), "el"), (foreign(r, 300, "的一是不了人我在有他"), "zh"),
        (" ".join(r.choice(italian.split() + ["parola", "giorno", "mare"]) if r.random() < 0.5 else foreign(r, 1, "aeiolrntsc") for _ in range(300)), "it"),
        (" ".join(r.choice(polish.split()) if r.random() < 0.5 else foreign(r, 1, "aeiołżśćrnzk") for _ in range(300)), "pl"),
        (prose(r, 300), None), (prose(r, 300, "fr"), "en"),
    ]
    junk = " ".join(w + "***" for w in prose(r, 300).split())
    data = [(i, t, lang) for i, (t, lang) in enumerate([*others, (junk, "en"), *((prose(r, 200, x), x) for x in ["en"] * 60 + ["de", "fr", "es"] * 3)])]
    found = {x["doc_id"]: x for x in divergence.judge(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert [i for i in range(len(data)) if not found[i]["kept"]] == [len(others)]
    assert [found[i]["class_distance"] is None for i in range(len(others))] == [True] * 8 + [False]


def test_windows_of_very_many_words():
    r = np.random.default_rng(7)
    for _ in range(50):
        codes = np.unique(r.integers(0, 6, r.integers(4, 60)), return_inverse=True)[1]
        assert divergence._repeated(codes, 6, most=1) == divergence._repeated(codes, 6)


def test_quality_rules_odd_rows(spark):
    found = divergence.judge(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(found) == 9 and [x["kept"] for x in found if x["n_words"] == 0] == [False] * 4
    assert divergence.judge(odd(spark).limit(0)).count() == 0


# --- 4 packing, 5 token files -------------------------------------------------------------------------------------


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    whole, encode, r = Tokenizer.from_file(WORD_BPE), tokens.WordEncoder(WORD_BPE), random.Random(4)
    parts = ["a", "É", "é", "́", "Σ", "ς", "<|endoftext|>", "'s", "1", "漢", "🙂", " ", "　", "\n", "\x0b", "\x1c", "-", ".", "Ab", "ab,", "%%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    assert all(whole.encode(t, add_special_tokens=False).ids == x.tolist() for t, x in zip(texts, encode.many(pa.array(texts)), strict=True))


def test_encoder_forgets_and_meets_words_again(monkeypatch):
    from tokenizers import Tokenizer

    forgets = []
    monkeypatch.setattr(tokens, "REMEMBERED", 20_000)
    monkeypatch.setattr(tokens.WordEncoder, "_forget", lambda self, forget=tokens.WordEncoder._forget: (forgets.append(1), forget(self)))
    monkeypatch.setattr(tokens, "LINE", 7)
    monkeypatch.setattr(tokens, "TOGETHER", 200)
    whole, encode, r = Tokenizer.from_file(WORD_BPE), tokens.WordEncoder(WORD_BPE), random.Random(24)
    assert encode.plain is not None
    texts = [" ".join("".join(r.choice("abcdeÄß.,!") for _ in range(r.choice((1, 3, 60)))) for _ in range(r.randint(0, 40))) for _ in range(200)]
    assert [whole.encode(t, add_special_tokens=False).ids for t in texts] == [x.tolist() for x in encode.many(pa.array(texts))]
    assert 0 < len(encode.known) and encode.remembered() <= 20_000 and len(forgets) > 2  # the first is the start
    assert [x.tolist() for x in encode.many(pa.array([None, "", "  "], pa.large_string()))] == [[], [], []]
    assert encode("Hello, world").tolist() == whole.encode("Hello, world").ids and list(encode.many(pa.array([], pa.string()))) == []


def test_a_piece_with_other_marks_or_capitals_is_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    sent = []
    whole, encode = Tokenizer.from_file(WORD_BPE), tokens.WordEncoder(WORD_BPE)
    monkeypatch.setattr(encode, "_ids", lambda texts, *more, ids=encode._ids: (sent.extend(" ".join(texts).split()), ids(texts, *more))[1])
    texts = ["fenouil fenouil, Fenouil.", "FENOUIL### fenouil,", "\u00c4rger### \u00e4rger, fenouil it's", ""]
    monkeypatch.setattr(tokens, "TOGETHER", 8)
    assert [whole.encode(t, add_special_tokens=False).ids for t in texts] == [x.tolist() for x in encode.many(pa.array(texts))]
    assert sorted(sent) == sorted(["fenouil", "###", "\u00e4rger", "it's"])  # the probes had the others
    monkeypatch.setattr(tokens, "PIECES", 0)  # forgotten after each use
    assert [whole.encode(t, add_special_tokens=False).ids for t in texts] == [x.tolist() for x in tokens.WordEncoder(WORD_BPE).many(pa.array(texts))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_of_other_tokenizers(name):
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path(name), random.Random(14)
    whole, encode = Tokenizer.from_file(path), tokens.WordEncoder(path)
    assert encode.by_word == (name == "word_bpe_49k.json")
    texts = ["".join(r.choice(["the ", "Word", " ", "\n", "é", "'s", "12 "]) for _ in range(r.randint(0, 14))) for _ in range(300)]
    assert [whole.encode(t, add_special_tokens=False).ids for t in texts] == [x.tolist() for x in encode.many(pa.array(texts))]


def check_pieces(found, docs, length):
    by_doc, by_window = {}, {}
    for p in found:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_window.setdefault(p["sequence_id"], []).append(p)
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
    for key, text in docs.items():
        parts = sorted(by_doc[key], key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in parts) == ids_of(text).tobytes()
        assert [p["start"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts[:-1]]]).tolist()
    for window, parts in by_window.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == length or window == max(by_window)
    return by_window


def test_packing_keeps_every_token_and_the_proportions(spark):
    r = random.Random(6)
    texts = [prose(r, r.choice((3, 40, 300))) for _ in range(120)]
    sources = [("a", "a", "b", None)[i % 4] for i in range(120)]
    found = packing.pack(documents(spark, *texts, source=sources), WORD_BPE, length=256, least=16).collect()
    windows = check_pieces(found, dict(enumerate(texts)), 256)
    share = {s: sum(len(ids_of(t)) for t, o in zip(texts, sources, strict=True) if o == s) for s in ("a", "b", None)}
    total = sum(share.values())
    for w in sorted(windows)[:-1]:
        for s in share:
            assert abs(sum(p["length"] for p in windows[w] if p["source"] == s) / 256 - share[s] / total) < 0.15


@pytest.mark.parametrize(("weights", "least"), [(None, 16), ({"a": 3, "b": 2}, 1), ({"a": 7, "b": 1, None: 2}, 40)])
def test_packing_against_a_stepwise_round_robin(spark, weights, least):
    """Rounds one by one: deficits grow by the quantum as fractions, and queues are served what has gathered."""
    from fractions import Fraction

    r, length = random.Random(15), 64
    texts = [prose(r, r.choice((1, 9, 80))) for _ in range(60)]
    sources = [("a", "b", "a", None)[i % 4] for i in range(60)]
    found = packing.pack(documents(spark, *texts, source=sources), WORD_BPE, length=length, least=least, weights=weights).collect()
    queues: dict[str | None, list[tuple[int, int]]] = {}
    order = {p["doc_id"]: (p["sequence_id"], p["offset"]) for p in found if p["start"] == 0}
    for i in sorted(order, key=order.get):  # the order inside a queue is a hash's; all else follows
        queues.setdefault(sources[i], []).extend((i, at) for at in range(len(ids_of(texts[i]))))
    names = sorted(queues, key=lambda s: (s is None, s or ""))
    weight = {s: len(queues[s]) if weights is None else weights.get(s, 1) for s in names}
    total, served, deficit, turn, stream = sum(weight.values()), dict.fromkeys(names, 0), dict.fromkeys(names, Fraction(0)), 0, []
    every = {s: max(1, -(-least * total // (length * weight[s]))) for s in names}
    while any(served[s] < len(queues[s]) for s in names):
        turn += 1
        for s in names:
            deficit[s] += Fraction(length * weight[s], total)
            if turn % every[s] == 0:
                n = int(deficit[s])
                stream += queues[s][served[s] : served[s] + n]
                served[s] += n
                deficit[s] -= n
    placed = {(p["doc_id"], p["start"] + k): p["sequence_id"] * length + p["offset"] + k for p in found for k in range(p["length"])}
    assert placed == {token: at for at, token in enumerate(stream)}


def test_packing_to_given_weights(spark):
    docs = documents(spark, *["word " * 400] * 8, source=["a", "b"] * 4)
    found = packing.pack(docs, WORD_BPE, length=128, least=8, weights={"a": 3, "b": 1}).collect()
    first = [p for p in found if p["sequence_id"] == 0]
    assert abs(sum(p["length"] for p in first if p["source"] == "a") - 96) <= 8


def test_packing_and_files_odd_rows(spark, tmp_path):
    found = packing.pack(odd(spark), WORD_BPE).collect()
    assert sum(p["length"] for p in found) == sum(len(ids_of(r["text"])) for r in odd(spark).collect())
    assert packing.pack(odd(spark).limit(0), WORD_BPE).count() == 0
    digest = token_files.token_file_digest(odd(spark), WORD_BPE, folder=str(tmp_path / "a")).collect()
    ordered = sorted(digest, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered[:-1]]]).tolist()
    assert [r["doc_id"] for r in ordered] == [None, 1, 1, 2, 3, 4, 4, 5, 6]
    wanted = sorted((str(r["doc_id"]), zlib.crc32(ids_of(r["text"]).tobytes())) for r in odd(spark).collect())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in digest) == wanted
    assert token_files.token_file_digest(odd(spark).limit(0), WORD_BPE, folder=str(tmp_path / "b")).count() == 0


def test_files_of_few_ids(spark, tmp_path):
    docs = documents(spark, *[f"word{i} more words" for i in range(50)])
    files = token_files.write_token_files(docs, str(tmp_path), WORD_BPE, file_ids=20)
    assert files.count() > 8
    back = {r["doc_id"]: r for r in token_files.read_token_files(spark, str(tmp_path), files).collect()}
    at = 0
    for i in range(50):
        assert bytes(back[i]["ids"]) == ids_of(f"word{i} more words").tobytes() and back[i]["start"] == at
        at += back[i]["n_tokens"]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 49_408, 1 << 32])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = (1 << 32) - 1 if top > 1 else 0
    starts, data = token_files.encode_blocks(ids)
    assert (token_files.decode_blocks(data, starts, n) == ids).all()


# --- 6 token counts -----------------------------------------------------------------------------------------------


def brute_count(word, scores, byte_score):
    text = "▁" + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(best[end - 1][0] + n * byte_score, -(-best[end - 1][1] + n))]
        options += [(best[s][0] + scores[text[s:end]], best[s][1] - 1) for s in range(max(0, end - 20), end) if text[s:end] in scores]
        top = max(o[0] for o in options)
        best.append(max(o for o in options if o[0] == top))
    return -best[-1][1]


def test_counts_equal_a_plain_search(spark):
    scores, byte_score = token_counts.piece_scores(PIECES)
    r = random.Random(8)
    words = ["".join(r.choice("etaoinshr漢é🙂.▁") for _ in range(r.randint(1, 12))) for _ in range(300)] + ["international", "the", "x" * 60]
    found = token_counts.UnigramCounter(scores, byte_score).counts(set(words))
    assert {w: brute_count(w, scores, byte_score) for w in set(words)} == found


def test_token_counts_of_rows(spark):
    scores, byte_score = token_counts.piece_scores(PIECES)
    r = random.Random(18)
    texts = [r.choice((" ", "\n", "\t  ")).join("".join(r.choice("etaoinshr漢é.") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 25))) for _ in range(40)]
    found = {x["doc_id"]: (x["n_words"], x["n_tokens"]) for x in token_counts.token_counts(documents(spark, *texts), PIECES).collect()}
    assert found == {i: (len(t.split()), sum(brute_count(w, scores, byte_score) for w in t.split())) for i, t in enumerate(texts)}


def test_token_counts_odd_rows(spark):
    found = rows(token_counts.token_counts(odd(spark), PIECES))
    assert len(found) == 9 and sum(1 for r in found if r[1:] == (0, 0)) == 4
    assert token_counts.token_counts(odd(spark).limit(0), PIECES).count() == 0


# --- 7 html -------------------------------------------------------------------------------------------------------


def test_article_without_the_rest(spark):
    page = (
        '<html><head><title>T</title><script>var t="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>'
        '<div class="ad">Buy now, it is cheap.</div><article><h1>Head &amp; line</h1><p>One  two\n three, and some more words of the text.</p><p>Second &lt;b&gt; part with <a href="/q">a link</a> in it.'
        '</article><div id="comments"><p>Nice text, I say as a reader.</p></div><form><label>Name</label><input></form><footer>&copy; all rights</footer></body></html>'
    )
    data = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<p>"), (5, "u", "plain < text > & more"), (6, "u", "<" * 3000 + "a href='" * 500)]
    found = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    wanted = "Head & line\nOne two three, and some more words of the text.\nSecond <b> part with a link in it."
    assert found[1]["text"] == wanted and found[1]["n_chars"] == len(wanted)
    assert found[2]["text"] == found[3]["text"] == found[4]["text"] == ""
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "before",
    [
        "<select><option>A<option>B</select>", "<select><optgroup label=x><option>A<optgroup label=y><option>B<option>C</select>", "<select><option>A</option><option>B</select>",
        "<datalist id=d><option>A<option>B</datalist>", "<div><option>A<option>B</div>", "<option>A", "<select><option>A<select>", "<button>A<svg><path d=x></button>", "<button>A<button>B</button>",
        "<head><title>T</title><meta charset=utf-8>", "<html><head><title>T</title><script>x</script><noscript><img src=i>N</noscript>", "<head><template><p>A</template><link href=x>",
        "<head><title>T</title></head>", "<head><title>T</title><body>", "<head><title>T</title><button>A</button>", "<dialog><select><option>A</dialog>",
    ],
)
def test_left_out_end_tags_lose_no_text(before):
    """Options, buttons and the like are text for the trees to judge; what stands round them is read whole."""
    article = "<article><p>First part.<p>Second <b>part</b>.</article>"
    found = [t for t in html_text.Page(before + article + before + "<p>After").text if t]
    said = [t for t in found if t not in ("First part.", "Second part.", "After")]
    assert [t for t in found if t not in said] == ["First part.", "Second part.", "After"]
    spoken = "A" if re.search("<(option|button)>A", before) else ""
    assert set("".join(said)) >= set(spoken) and not set("".join(said)) & set("Tx")


def test_article_after_left_out_end_tags(spark):
    article = "<article><h1>Head line</h1><p>One two three, and some more words of the text.</p><p>Second part with more words, as an article has.</p></article>"
    rest = "<nav><ul><li><a href=/>Home</a></ul></nav>{}" + article + "<footer>all rights</footer>"
    pages = ["<html><head><title>T</title></head><body>" + rest.format(""), "<html><head><title>T</title>" + rest.format(""), "<html><head><title>T</title></head><body>" + rest.format("<select><option>A<option>B</select>")]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert found[0].startswith("Head line\nOne two three") and found[0] == found[1] == found[2]
    assert [t for t in html_text.Page("<head><title>T</title> Text <b>at once</b>").text if t] == ["Text at once"]


def test_pages_written_by_hand(spark):
    """Layouts that the maker of training pages doesn't make."""
    table = spark.createDataFrame([(i, None, h, "x", 3) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(table).collect()}
    assert [found[i] for i in range(len(PAGES))] == [(t, len(t)) for _, t in PAGES]


def test_articles_stay_under_any_wrapper():
    found = html_text.main_texts([h for _, h, _ in LAYOUTS], html_text.trained())
    assert [(n, f) for (n, _, _), f in zip(LAYOUTS, found, strict=True)] == [(n, t) for n, _, t in LAYOUTS]


def test_nothing_inside_an_article_is_silent():
    page = "<article><p>Let <math><mi>x</mi></math>, press <button>5</button>, <object>see</object> <svg><text>map</text></svg>.</p><noscript><p>No script</p></noscript><select><option>One<option>Two</select></article>"
    assert [t for t in html_text.Page(page).text if t] == ["Let x, press 5, see map.", "No script", "One", "Two"]


@pytest.mark.parametrize(
    "part", ["<a ", "<a '", "<p title=\"'>x", "<div>", "< ", "<!-- -", "<select><option>", "<ul><li>", "</p><div>", "<template>", "<script>", "&lt;", "<td>x", "x</div>", "<p>a", "<a href='>b", "</script "],
)
def test_time_grows_as_the_length(part):
    trees = html_text.trained()

    def seconds(n):
        began = time.process_time()
        html_text.main_texts([part * n], trees)
        return time.process_time() - began

    seconds(1000)
    assert seconds(80_000) < 9 * seconds(20_000) + 0.5


def test_deep_and_long_pages_are_read_whole():
    deep = "<div>" * 30_000 + "<article><p>Deep inside there is a sentence.</p></article>"
    assert [t for t in html_text.Page(deep).text if t] == ["Deep inside there is a sentence."]
    long = "<article>" + "".join(f"<p>Paragraph number {i}, with some words of its own.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_texts([long], html_text.trained())[0].count("\n") == 19_999


def test_unseen_layouts():
    maker = html_text._Maker(4321)
    made = [maker.page() for _ in range(150)]
    wanted = [[t.replace("@", "") for t in html_text.Page(p).text if t and "@" in t] for p in made]
    got = [t.split("\n") if t else [] for t in html_text.main_texts([p.replace("@", "") for p in made], html_text.trained())]
    hit = sum(len(set(w) & set(g)) for w, g in zip(wanted, got, strict=True))
    assert hit > 0.97 * sum(map(len, map(set, wanted))) and hit > 0.97 * sum(map(len, map(set, got)))


# --- 8 near dedup, 10 exact dedup ---------------------------------------------------------------------------------


def brute_components(texts):
    sets = {i: (set(zip(w, w[1:], strict=False)) or {tuple(w)}) if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"e{r.randint(0, 9999)}"
        out.append(" ".join(words))
    return out


def test_near_copies_against_all_pairs(spark):
    r = random.Random(9)
    base = [prose(r, 60) for _ in range(4)]
    texts = [*near_copies(r, base[0], 70, 8), *near_copies(r, base[1], 40, 3), *base, "a b", "a b", "a", "", None, base[0], "A b", "one two three four five", "one two three four five six"]
    docs = documents(spark, *texts)
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(docs).collect()}
    assert found == brute_components(dict(enumerate(texts)))
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {c for _, c in found.values()}


def test_blocks_of_one_list(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    r = random.Random(10)
    texts = near_copies(r, prose(r, 50), 60, 7)
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(documents(spark, *texts)).collect()}
    assert found == brute_components(dict(enumerate(texts)))


@pytest.mark.parametrize("split", [0, 1])
def test_large_lists_are_split(spark, monkeypatch, split):
    """Near but unlinked texts with one passage in common, in lists of many parts; some are near copies."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    r = random.Random(11)
    shared = prose(r, 60)
    own = [f"{shared} {prose(r, 8 + k % 5)}" for k in range(50)]
    texts = [*own, *(f"{t} more" for t in own[::7]), *near_copies(r, shared, 30, 6)]
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(documents(spark, *texts)).collect()}
    assert found == brute_components(dict(enumerate(texts)))


def test_boilerplate_makes_rows_in_proportion(spark):
    """A list of very many classes that agree in one coordinate only goes to few blocks, and no candidate pair is lost."""
    n, matches = 60_000, near_dedup.MATCHES
    r = np.random.default_rng(8)
    signature = r.integers(0, 1 << 60, (n, near_dedup.COORDINATES))
    signature[:, 2] = 7
    twins = [(10, 50_000, (5, 9)), (20, 20_001, (29, 31)), (30, 40_000, (3, 30))]  # with the second and third collision
    for a, b, at in twins:
        signature[b, list(at)] = signature[a, list(at)]
    import pandas as pd

    classes = spark.createDataFrame(pd.DataFrame({"node": np.arange(n), "coordinates": list(signature)}), "node long, coordinates array<long>")
    lists = classes.select(F.lit(7).cast("long").alias("term"), F.lit(3).cast("long").alias("at"), "node", F.col("node").alias("part"))
    met = near_dedup._met(lists, classes)
    assert met.count() <= (2 * near_dedup.SPLIT + 1) * n
    places = met.where(F.col("node").isin([x for t in twins for x in t[:2]])).collect()
    for a, b, at in twins:
        shared = {(x["term"], x["at"]) for x in places if x["node"] == a} & {(x["term"], x["at"]) for x in places if x["node"] == b}
        assert [near_dedup.coordinates_of(p) for _, p in shared].count([2, at[0]]) == 1 and len(at) + 1 == matches


def test_shingles_of_many_texts_at_once():
    """Long and short words, marks, every white space, and texts of one word or none, beside each other and alone."""
    r = random.Random(12)
    texts = [*(bytes(r.choice(b"abAB\xc3\xa9\x00 \t\n\x0b\x0c\r") for _ in range(r.randint(0, 60))) for _ in range(800)), b"x" * 64 + b" " + b"X" * 65 + b" y", b"x" * 65]
    words = [t.lower().split() for t in texts]
    sets = near_dedup.shingle_sets(texts)
    names = {}
    for text, w, found in zip(texts, words, sets, strict=True):
        plain = set(itertools.pairwise(w)) if len(w) > 1 else set(w)
        assert len(found) == len(plain) and (np.diff(found.astype(object)) > 0).all()
        assert (near_dedup.shingle_sets([text])[0] == found).all()
        names.setdefault(frozenset(plain), found)
    assert all((names[frozenset(itertools.pairwise(w)) if len(w) > 1 else frozenset(w)] == found).all() for w, found in zip(words, sets, strict=True))
    assert len({found.tobytes() for found in sets}) == len(names)


def test_lists_that_agree_in_most_coordinates_are_not_split(spark):
    """Posted again, such a list would be as many lists of its own length; dealt as it is, every two classes meet once each way."""
    import pandas as pd

    n = 3_000
    signature = np.tile(np.arange(near_dedup.COORDINATES) + 10, (n, 1))
    classes = spark.createDataFrame(pd.DataFrame({"node": np.arange(n), "coordinates": list(signature)}), "node long, coordinates array<long>")
    lists = classes.select(F.lit(7).cast("long").alias("term"), F.lit(3).cast("long").alias("at"), "node", F.col("node").alias("part"))
    met = near_dedup._met(lists, classes).cache()
    assert met.count() <= 30 * n
    assert met.select("term", "at").distinct().count() == 1
    some = met.where("node % 500 = 0").collect()
    for a, b in itertools.permutations(range(0, n - 1, 500), 2):
        down = {(x["i"], x["j"]) for x in some if x["node"] == a and x["is_row"]}
        assert len(down & {(x["i"], x["j"]) for x in some if x["node"] == b and not x["is_row"]}) == 1


def test_candidates_against_a_plain_count():
    r = np.random.default_rng(3)
    signature = r.integers(0, 3, (40, near_dedup.COORDINATES))
    signature[:, 4] = 7  # the list of coordinate 4
    bits = np.zeros((40, 2), np.uint64)
    bits[:5, 0] = (1 << 64) - 1
    side = (np.arange(40), r.integers(0, 6, 40), np.ones(40, bool), r.integers(80, 110, 40), bits, signature)
    x, y, count = near_dedup.candidates(5, side, side, 80, 12)
    for second in (9, 12):
        got = {(int(a), int(b)) for a, b, _ in zip(*near_dedup.candidates(5 * 64 + second + 1, side, side, 80, 12), strict=True)}
        assert got == {(int(a), int(b)) for a, b in zip(x, y, strict=True) if np.flatnonzero(signature[a] == signature[b])[1] == second}
    wanted = set()
    for a in range(40):
        for b in range(a + 1, 40):
            same = signature[a] == signature[b]
            near = 100 * min(side[3][a], side[3][b]) >= 80 * max(side[3][a], side[3][b]) and (a < 5) == (b < 5)
            if near and side[1][a] != side[1][b] and same.sum() >= 12 and same.argmax() == 4:
                wanted.add((a, b, int(same.sum())))
    assert wanted and {(int(a), int(b), int(c)) for a, b, c in zip(x, y, count, strict=True)} == wanted


def test_recall_of_the_inverted_join():
    """Pairs of sets just at the threshold collide often enough to be compared, all but a few in a hundred thousand."""
    r = np.random.default_rng(4)
    few, pairs = 0, 400
    for _ in range(pairs):
        members = np.unique(r.integers(0, 1 << 63, 360, dtype=np.uint64))
        both, _ = near_dedup.signatures([members[:324], members[36:]])  # 288 of 360 in common
        few += int((both[0] == both[1]).sum()) < near_dedup.MATCHES
    assert few == 0


def test_near_dedup_odd_rows(spark):
    found = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(found) == 9 and all(x["n_shingles"] > 0 or x["kept"] for x in found)
    assert near_dedup.near_duplicates(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(odd(spark), 50)


def test_exact_copies(spark):
    long = "abc" * 3000
    texts = [long, long + "x", long, "x" + long[1:], "", None, "a", "a ", "A", long]
    docs = documents(spark, *texts)
    found = {x["doc_id"]: x for x in exact_dedup.exact_duplicates(docs, block=64).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        own, x = groups[t or ""], found[i]
        assert (x["keep_id"], x["group_size"], x["kept"]) == (max(own), len(own), i == max(own))
        assert x["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(map(max, groups.values()))


@pytest.mark.parametrize("hashes", [1, 3, None])
def test_names_tell_texts_with_one_hash_apart(spark, hashes):
    texts = ["aab" * 9, "aba" * 9, "aab" * 9, "b" * 27, "", "", "aab" * 8, "é" * 7, "aab" * 9 + "b", None]
    digest = (lambda piece: F.pmod(F.xxhash64(piece), F.lit(hashes))) if hashes else F.xxhash64
    found = {r["doc_id"]: (r["best"]["doc_id"], r["size"]) for r in exact_dedup._judged(documents(spark, *texts), 2, digest).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    assert found == {i: (max(own), len(own)) for own in groups.values() for i in own}


def test_exact_dedup_against_brute_force(spark):
    r = random.Random(13)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(400)]
    found = {x["doc_id"]: x for x in exact_dedup.exact_duplicates(documents(spark, *texts), block=2).collect()}
    for i, t in enumerate(texts):
        own = [k for k, u in enumerate(texts) if u == t]
        assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == (max(own), len(own), i == max(own))


def test_repeated_rows_leave_one(spark):
    docs = documents(spark, "a", "a", "a", "b", "b", None, "", ids=[3, 3, 1, None, None, 4, 4])
    found = sorted((x["doc_id"] or -1, x["kept"]) for x in exact_dedup.exact_duplicates(docs).collect())
    assert found == [(-1, False), (-1, True), (1, False), (3, False), (3, True), (4, False), (4, True)]
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert sorted((x["doc_id"] or -1, x["text"] or "") for x in kept.collect()) == [(-1, "b"), (3, "a"), (4, "")]
    assert "Window" not in kept._jdf.queryExecution().toString()


def test_exact_dedup_odd_rows(spark):
    found = exact_dedup.exact_duplicates(odd(spark)).collect()
    assert len(found) == 9 and sum(x["kept"] for x in found) == 6
    assert exact_dedup.exact_duplicates(odd(spark).limit(0)).count() == 0


# --- 9 quality ----------------------------------------------------------------------------------------------------


def test_quality_learns_and_holds_out(spark):
    r = random.Random(11)
    good, bad = [prose(r, 90) for _ in range(150)], [" ".join(w + "!!" for w in prose(r, 90).upper().split()) for _ in range(150)]
    docs = documents(spark, *good, *bad)
    labels = spark.createDataFrame([(i, 1 if i < 150 else 0, 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_quality(docs, labels).collect()
    held = [x for x in found if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in found)
    assert sum(x["predicted"] == (x["doc_id"] < 150) for x in held) > 0.95 * len(held)
    flipped = labels.where("doc_id IS NOT NULL").withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality.score_quality(docs, flipped)) == rows(quality.score_quality(docs, labels))


def test_quality_against_a_plain_fit(spark, monkeypatch):
    """Ridge weights from all rows at once, and the calibration by the minimax formula of isotonic regression."""
    monkeypatch.setattr(quality, "FAN_IN", 2)
    r = random.Random(12)
    texts = [prose(r, r.randint(5, 90)) + "!" * r.randint(0, 9) for _ in range(240)]
    truth = [int(t.count("!") + r.randint(0, 4) < 7) for t in texts]
    docs = documents(spark, *texts).repartition(7)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(truth)], "doc_id long, quality int")
    found = {x["doc_id"]: x["score"] for x in quality.score_quality(docs, labels).collect()}
    stats = np.array([quality.statistics(t.encode()) for t in texts])
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in range(240)])
    known, y = fold != 1, np.array(truth, float)
    features = quality.Fourier(stats[known].mean(0), np.where(stats[known].std(0) > 1e-9, stats[known].std(0), 1.0))
    z, penalty = features(stats), quality.RIDGE * np.eye(quality.FEATURES + 1)
    penalty[0, 0] = 1e-9

    def ridge(rows_):
        return np.linalg.solve(z[rows_].T @ z[rows_] + penalty, z[rows_].T @ y[rows_])

    raw = z @ ridge(known)
    crossed = np.where(fold == 0, z @ ridge(fold == 2), z @ ridge(fold == 0))[known]
    bins = np.clip(((crossed - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    at = np.unique(bins)
    value, weight = np.array([y[known][bins == b].mean() for b in at]), np.array([(bins == b).sum() for b in at])
    mean = lambda a, b: (value[a : b + 1] * weight[a : b + 1]).sum() / weight[a : b + 1].sum()
    n = len(at)
    fitted = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    wanted = 0.999 * np.interp(raw, quality.LOW + (at + 0.5) * (quality.HIGH - quality.LOW) / quality.BINS, fitted) + 0.001 * np.clip(raw, 0, 1)
    assert np.abs(np.array([found[i] for i in range(240)]) - np.clip(wanted, 0, 1)).max() < 1e-6


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.score_quality(odd(spark), labels).collect()
    assert len(found) == 9 and all(x["score"] == 0.5 for x in found)
    one = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    twice = quality.score_quality(odd(spark).union(odd(spark)), one).collect()
    assert len(twice) == 18 and all(0 <= x["score"] <= 1 for x in twice) and not any(x["held_out"] for x in twice if x["doc_id"] is None)
    assert quality.score_quality(odd(spark).limit(0), one).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 0.0, 2.0]), np.array([1.0, 1.0, 1.0])).tolist() == [0.5, 0.5, 2.0]

def test_near_duplicates_without_ids(spark):
    """Rows without an id link like others; a component that has no id at all keeps all its rows."""
    r = random.Random(21)
    a, b = prose(r, 60), prose(r, 60)
    table = spark.createDataFrame([(None, a), (None, a), (7, b), (None, b), (None, b + " more")], "doc_id long, text string")
    assert rows(near_dedup.near_duplicates(table).select("doc_id", "component_id", "kept")) == sorted([(None, None, True)] * 2 + [(7, 7, True)] + [(None, 7, False)] * 2, key=str)
