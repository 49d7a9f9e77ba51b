"""The registered queries against DuckDB, and the pipeline against a plain version of its five stages."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trawlspark.llm import divergence, queries

from .test_operators import SCHEMA, brute_components, brute_counts, ids_of, near_copies, prose

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    import duckdb

    found = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings", "sale_lines"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = con.execute(queries.SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)

    def plain(row):
        return str(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row))

    assert sorted(map(plain, found.select(*columns).collect())) == sorted(map(plain, wanted.fetchall()))


def passes(docs):
    """Ids that the quality rules keep, with histograms counted one character and one word at a time."""
    mark, forms = ".,;:!?", {}
    for word in divergence.VOCABULARY:
        for form in (word, word.capitalize(), word.upper()):
            forms |= {form + m: word for m in ("", *mark)}
    shares, base = {}, {}
    for i, text, *_ in docs:
        n, _, _, _, repeated = brute_counts(text)
        base[i] = n < 50 or 100 * repeated > 50 * n
        kinds = [
            lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in " \t\n\v\f\r", lambda c: c in ".,;:!?'\"()-",
            lambda c: c in "#*$%&|<>@^_~`+=/\\[]{}", lambda c: c < "\x80", lambda c: True,
        ]
        classes, common = [0] * 8, [0] * (len(divergence.VOCABULARY) + 1)
        for c in text:
            classes[next(k for k, f in enumerate(kinds) if f(c))] += 1
        for w in text.split():
            common[divergence.VOCABULARY.index(forms[w]) if w in forms else -1] += 1
        shares[i] = [np.array(x) / max(sum(x), 1) for x in (classes, common)]

    def jsd(p, q):
        m = (p + q) / 2
        half = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return np.sqrt(max(0, (half(p) + half(q)) / 2))

    refs = [np.mean([shares[i][k] for i, *_ in docs if not base[i]], axis=0) for k in (0, 1)]  # one language
    limits = ((divergence.CLASS_LIMIT, divergence.CLASS_ALLOWANCE), (divergence.WORD_LIMIT, divergence.WORD_ALLOWANCE))
    return {i for i, text, *_ in docs if not base[i] and all(jsd(shares[i][k], refs[k]) <= a + b / np.sqrt(len(text.split())) for k, (a, b) in enumerate(limits))}


def test_pipeline_against_a_plain_version(spark, tmp_path):
    r = random.Random(12)
    base = prose(r, 80)
    texts = [prose(r, r.randint(60, 200)) for _ in range(30)] + near_copies(r, base, 10, 2) + [base, base, "too short", " ".join(w + "***" for w in prose(r, 90).split())]
    docs = [(i, t, "en", ("a", "b", "c", None)[i % 4], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame([(*d, None, "h", 7) for d in docs], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))

    good = passes(docs)
    left = [d for d in docs if d[0] in good]
    last = {d[1]: d[0] for d in left}
    left = [d for d in left if last[d[1]] == d[0]]
    near = brute_components({d[0]: d[1] for d in left})
    left = [d for d in left if near[d[0]][1] == d[0]]
    sizes, weights, target = {}, {}, {}
    for _, text, _, source, _ in left:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s], target[s] = (5, 2, 1)[k % 3], 0.0
    rest, open_ = 1.5 * sum(sizes.values()), set(sizes)
    while rest > 1e-9:
        total, over = sum(weights[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            target[s] += rest * weights[s] / total
            if target[s] >= 2 * sizes[s]:
                over += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
        rest = over
    mixed: dict[int, list[str]] = {}
    for s in sizes:
        whole, part = divmod(int(target[s] + 0.5), sizes[s])
        before = 0
        for i, text, *_ in sorted((d for d in left if d[3] == s), key=lambda d: hashlib.md5(f"{d[0]}|mix".encode()).hexdigest()):
            words = text.split(" ")
            cut = max(0, min(len(words), part - before))
            before += len(words)
            mixed.setdefault(i, []).extend([text] * whole + ([" ".join(words[:cut])] if cut else []))

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {i: sum(len(ids_of(t)) for t in ts) for i, ts in mixed.items() if ts}
    packed: dict[int, int] = {}
    for p in found:
        packed[p["doc_id"]] = packed.get(p["doc_id"], 0) + p["length"]
    assert packed == tokens
    starts = sorted((p["sequence_id"], p["offset"], p["length"]) for p in found)
    assert [q * 2048 + o for q, o, _ in starts] == np.cumsum([0, *[n for *_, n in starts[:-1]]]).tolist()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_table(spark):
    r = random.Random(17)
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    good = [prose(r, 120) for _ in range(12)]
    texts = [None, "", " \n", "a", long, "x" * 20_000, *good, good[0], good[1], good[1], None]
    ids = [1, 2, None, 4, 5, 6, *range(10, 22), 10, None, None, 1]
    data = [(i, t, (None, "en", "xx")[k % 3], (None, "s", "t")[k % 3], None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(data, COLUMNS)


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    docs = odd_table(spark).withColumns({c: F.lit(1) for c in ("row", "kept", "_key", "_size", "size", "part", "hash")})
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, "")
            assert name == "packing" or out.columns == docs.columns
            sizes.append(out.count())
    assert sizes[1::2] == [0] * 5
    # the good texts and their three copies pass the rules; 17 texts differ, null and empty being one
    assert sizes[0] == 15 and sizes[2] == 17


def test_pipeline_of_odd_rows(spark, tmp_path):
    for name, table in (("odd", odd_table(spark)), ("empty", odd_table(spark).limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        starts = sorted((p["sequence_id"], p["offset"], p["length"]) for p in found)
        assert [q * 2048 + o for q, o, _ in starts] == np.cumsum([0, *[n for *_, n in starts[:-1]]]).tolist()[: len(starts)]
        assert bool(found) == (name == "odd")
