"""Centroid clusters, byte-level BPE and frequent itemsets against plain versions, with odd rows."""

import base64
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from trawlspark.llm import baskets, byte_bpe, elkan, queries

from ..conftest import rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- clusters -----------------------------------------------------------------------------------------------------


def lloyd(vectors, k, rounds, names):
    """(cluster of each, distance of each, centroids), one number at a time."""
    first = sorted(range(len(vectors)), key=lambda i: (names[i], vectors[i]))[:k]
    centroids = [list(vectors[i]) for i in first]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for v in vectors]
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for v, (_, c) in zip(vectors, found, strict=True) if c == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [c for _, c in found], [d for d, _ in found], centroids


@pytest.mark.parametrize(("n", "dim", "k", "spread"), [(400, 3, 8, 6), (300, 5, 7, 2000), (5, 2, 8, 3), (60, 2, 4, 1)])
def test_clusters_against_plain_rounds(spark, n, dim, k, spread):
    r = random.Random(n)
    vectors = [[r.randint(-spread, spread) + (40 * (i % 3) if spread == 6 else 0) for _ in range(dim)] for i in range(n)]  # small spreads: many ties and copies
    names = [r.randint(0, 50) for _ in range(n)]
    table = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(vectors, names, strict=True))], "vec_id long, x array<long>, m int").repartition(3)
    found = elkan.clustered(table, dim, k, 10, F.col("m"))
    cluster, distance, centroids = lloyd(vectors, k, 10, names)
    assert found.centroids == centroids
    assert rows(found.assigned.select("vec_id", "cluster", "distance")) == sorted(((i, c, d) for i, (c, d) in enumerate(zip(cluster, distance, strict=True))), key=str)


def test_bounds_leave_out_distances_and_keep_ties():
    r = np.random.default_rng(3)
    centers = r.integers(-3000, 3000, (8, 16))
    x = (centers[r.integers(0, 8, 3000)] + r.integers(-200, 200, (3000, 16))).astype(np.int64)
    moved = centers + r.integers(-3, 3, centers.shape)
    first = elkan.assigned_first(x, centers)
    shift = elkan._up(np.sqrt(((moved - centers) ** 2).sum(1)))
    cluster, upper, lower, computed = elkan.assigned_again(x, moved, shift, first[0], first[2], first[3])
    truth = np.stack([((x - c) ** 2).sum(1) for c in moved], 1)
    assert (cluster == truth.argmin(1)).all() and computed < 0.3 * x.shape[0] * 8
    assert (upper >= np.sqrt(truth[np.arange(3000), cluster])).all() and (lower <= np.sqrt(truth)).all()
    two = np.array([[-5], [5]])  # a vector between two centroids belongs to the first, whatever it had before
    for had in (0, 1):
        assert elkan.assigned_again(np.array([[0]]), two, np.zeros(2), np.array([had]), np.array([9.0]), np.array([[0.0, 0.0]]))[0].tolist() == [0]


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5] * 64, [-0.0001] * 64, [0.5] * 64, [1e3] * 64]
    data = [(1, good[0], 1), (1, good[1], 2), (None, good[2], 3), (4, good[3], None)]
    data += [(5, None, 0), (6, [], 0), (7, [1.0] * 63, 0), (8, [1.0] * 65, 0), (9, [None] + [1.0] * 63, 0), (10, [nan] + [1.0] * 63, 0), (11, [-inf] + [1.0] * 63, 0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, cluster int").withColumns({c: F.lit("z") for c in ("x", "upper", "lower", "o", "distance")})
    vectors, ids = [[512] * 64, [-1] * 64, [512] * 64, [1024000] * 64], [1, 1, None, 4]
    names = [hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest() for i in ids]
    cluster, distance, centroids = lloyd(vectors, 8, 10, names)
    total = {c: sum(d for d, e in zip(distance, cluster, strict=True) if e == c) for c in cluster}
    wanted = [(i, c, d, total[c], sum(distance), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in zip(ids, cluster, distance, strict=True)]
    found = elkan.cluster_digest(table)
    assert rows(found) == sorted(wanted, key=str)
    empty = elkan.cluster_digest(table.where("vec_id > 4"))
    assert empty.count() == 0 and empty.dtypes == found.dtypes
    with pytest.raises(Exception, match="64 bits"):
        elkan.cluster_digest(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


# --- bytes --------------------------------------------------------------------------------------------------------


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(r):
    parts = ["'s", "'t", "'re", "'ll", "'ve", "'", "''", " ", "  ", "\n", "\t", "a", "ll", "re", "S", "é", "漢", "1", "٣", "½", "!", "?", "<|endoftext|>", "🙂", "́", "x" * 9, " don't", "\u0085", "\x1c", " ", "abab"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(400)]
    return [*texts, "", "x" * 30_000, "ab" * 5000, "".join(chr(r.randint(97, 122)) for _ in range(20_000)), " " * 900, "a b " * 9000]


def test_ids_are_those_of_the_library(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STRETCH", 5000)
    texts, wanted = odd_texts(random.Random(2)), library()
    words = byte_bpe.ByteEncoder(RANKS)
    found = [ids.tolist() for part, ends in words.column(pa.array(texts)) for ids in np.split(part, ends[1:-1])]
    assert found == [wanted.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "HELD", 100)  # words are forgotten after each stretch
    assert [ids.tolist() for part, ends in words.column(pa.array(texts)) for ids in np.split(part, ends[1:-1])] == found
    other = byte_bpe.ByteEncoder(RANKS, public_tokenizers.PATTERN + "|q")  # the same matches, found by the regular expression
    assert [ids.tolist() for part, ends in other.column(pa.array(texts)) for ids in np.split(part, ends[1:-1])] == found


def test_merges_wait_for_lower_ranks(tmp_path):
    """Ranks in any order: also pairs whose merge makes a pair of a lower rank, which a vocabulary needn't avoid."""
    for seed in range(30):
        r = random.Random(seed)
        tokens = {bytes([b]) for b in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randint(2, 6))) for _ in range(60)}
        several = sorted(t for t in tokens if len(t) > 1)
        r.shuffle(several)
        order = [bytes([b]) for b in range(256)] + several
        path = tmp_path / f"{seed}"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(n).encode() for n, t in enumerate(order)))
        own = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks={t: n for n, t in enumerate(order)}, special_tokens={})
        words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 40))) for _ in range(120)]
        ids, firsts, counts = byte_bpe.Ranks(str(path)).replayed(words)
        assert [ids[a : a + n].tolist() for a, n in zip(firsts, counts, strict=True)] == [own.encode_ordinary(w.decode()) for w in words]


def test_round_trip_of_odd_rows(spark):
    texts = [None, *odd_texts(random.Random(5))[-7:], "<|endoftext|> a", None]
    table = spark.createDataFrame([(i if i != 3 else None, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int").union(spark.createDataFrame([(0, "again", "z", 1)], "doc_id long, text string, ids string, decoded int"))
    encoded = byte_bpe.encode(table, RANKS, columns=("doc_id", "text"))
    back = byte_bpe.decode(encoded, RANKS).collect()
    own = library()
    assert len(back) == len(texts) + 1
    for r in back:
        assert bytes(r["decoded"]).decode() == (r["text"] or "") and np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(r["text"] or "") and r["n_tokens"] * 4 == len(r["ids"])
    assert byte_bpe.decode(byte_bpe.encode(table.limit(0), RANKS), RANKS).count() == 0
    none = spark.createDataFrame([(1, None), (2, bytearray(b""))], "k int, ids binary")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(none, RANKS).collect()] == [b"", b""]
    for bad in (b"\xff\xff\xff\x00", b"\x01\x00\x00"):
        with pytest.raises(Exception, match="ids"):
            byte_bpe.decode(spark.createDataFrame([(bytearray(bad),)], "ids binary"), RANKS).collect()


def test_query_against_the_library(spark, tmp_path):
    texts = [*odd_texts(random.Random(9))[:60], None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    own, wanted = library(), []
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(queries.op12_byte_bpe(spark, str(tmp_path))) == sorted(wanted, key=str)


# --- baskets ------------------------------------------------------------------------------------------------------


def plain_itemsets(lines, absolute, per, confidence=60):
    held: dict[int, set[int]] = {}
    for b, i in lines:
        if b is not None and i is not None:
            held.setdefault(b, set()).add(i)
    n, least = len(held), max(absolute, -(-len(held) // per))
    closed: dict[frozenset, int] = {}
    sets: set[frozenset] = set()
    for basket in held.values():  # every closed set is an intersection of baskets
        sets |= {frozenset(basket)} | {s & basket for s in sets}
    support = lambda s: sum(s <= b for b in held.values())
    for s in sets:
        if s and (x := support(s)) >= least:
            closed[s] = x
    out = []
    for s, x in closed.items():
        rules = []
        if len(s) > 1:
            for c in sorted(s):
                a, alone = support(s - {c}), support(frozenset([c]))
                if 100 * x >= confidence * a and x * n > a * alone:
                    rules.append((c, a, alone))
        best = min(rules, key=lambda r: (r[1], r[0]))[0] if rules else None
        text = ";".join(f"{c}:{a}:{k}" for c, a, k in rules)
        out.append((",".join(map(str, sorted(s))), len(s), x, len(rules), best, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def basket_lines(r, n_baskets, n_items, large=0):
    lines = []
    for b in range(n_baskets):
        k = r.randint(1, 5) if b >= large else n_items * 2 // 3
        lines += [(b, i) for i in {min(int(r.expovariate(0.25)), n_items - 1) if b >= large else r.randrange(n_items) for _ in range(k)}]
    return lines


@pytest.mark.parametrize(("seed", "large", "least"), [(1, 0, 3), (2, 1, 3), (3, 6, 4), (4, 3, 2), (5, 9, 5)])
def test_itemsets_against_all_intersections(spark, monkeypatch, seed, large, least):
    monkeypatch.setattr(baskets, "PAIRED", 6)
    r = random.Random(seed)
    lines = basket_lines(r, 70, 18 if large < 5 else 12, large)
    lines += lines[:20] + [(None, 1), (1, None), (None, None)]
    table = spark.createDataFrame([(*x, "z", 1) for x in lines], "sale_id long, item_id long, items string, n int").repartition(5)
    assert rows(baskets.frequent_itemsets(table, absolute=least)) == plain_itemsets(lines, least, 20_000)
    assert rows(baskets.frequent_itemsets(table, absolute=1, per=10)) == plain_itemsets(lines, 1, 10)


def test_repositories_are_pruned_without_loss(monkeypatch):
    monkeypatch.setattr(baskets, "GROWTH", 3)
    for seed in range(40):
        r = random.Random(seed)
        stream = [(tuple(sorted({(r.randint(0, 2), r.randint(0, 7)) for _ in range(r.randint(1, 6))})), r.randint(1, 3)) for _ in range(40)]
        least, left = r.randint(2, 12), {}
        for items, weight in stream:
            for i in items:
                left[i] = left.get(i, 0) + weight
        shard = baskets.Shard(least, left)
        for items, weight in stream:
            shard.add(items, weight)
        sets = set()
        for items, _ in stream:
            sets |= {frozenset(items)} | {s & frozenset(items) for s in sets}
        wanted = {tuple(sorted(s)): w for s in sets if s and (w := sum(x for items, x in stream if s <= set(items))) >= least}
        assert dict(shard.closed()) == wanted and shard.pruned
        held = baskets.Repository()
        for items, weight in wanted.items():
            held.put(items, weight)
        for n in (1, 2, 3):
            for items in itertools.combinations(sorted({i for s in wanted for i in s}), n):
                assert held.above(items) == max([w for s, w in wanted.items() if set(items) <= set(s)], default=0)


def test_itemsets_of_few_rows(spark):
    empty = spark.createDataFrame([], "sale_id long, item_id long")
    assert baskets.frequent_itemsets(empty).count() == 0
    one = spark.createDataFrame([(b, i) for b in range(6) for i in (10, 9, -2)] + [(9, 9)], "sale_id long, item_id long")
    assert [r["items"] for r in baskets.frequent_itemsets(one).orderBy("n_items").collect()] == ["9", "-2,9,10"]
