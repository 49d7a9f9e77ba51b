"""An inverted index of words and pairs of characters, and the best documents of many queries from it.

The index is a table of blocks of documents. A block has one row for each gram, which is a character or a pair of adjacent
characters of a word: the documents that hold it and the block's words that hold it; and one row with the block's document
ids, its distinct words, and the documents of each word. Lists are sorted 32-bit places in the block. A token of a query that
is a gram finds its documents at once; a longer one is looked for in the words that hold all its pairs, whose documents are
its own. A block has a bounded amount of text, so the list of a gram that all documents hold is as many rows as there are
blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..workers import map_arrow

#: Characters and documents of a block at most (one document may be longer), and queries that are scored together.
BLOCK_CHARS, BLOCK_DOCS, GROUP = 3 << 19, 1 << 13, 256
#: Groups of queries that documents pass by together; more of them are dealt to more columns of the grid.
HELD = 8
#: Nodes times characters of a tree of tokens that is walked by a table; a larger one is searched.
TABLE = 1 << 23
_INDEX = "block long, gram string, docs binary, words binary, ids binary, no_ids binary, vocabulary array<string>"
_SHIFT = 21  # bits of a code point


def _lists(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each one's values begin and end, and the distinct sorted values."""
    both = np.sort(keys.astype(np.int64) << 32 | values)
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    keys = both >> 32
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], np.append(starts, len(keys)), (both & 0xFFFFFFFF).astype("<i4")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


_BLANK = np.zeros(0x110000, bool)
_BLANK[[ord(c) for c in re.findall(f"[{X.SPACES}]", "".join(map(chr, range(0xD800))) + "\uFEFF")]] = True


def _words(texts: list[str]):
    """The words of texts as an Arrow array, and the number of the text of each."""
    import pyarrow as pa

    every = " ".join(texts) + " "
    points = _points(every)
    blank = _BLANK[points]
    turns = np.flatnonzero(blank != np.append(True, blank[:-1]))  # a word's first character, and the blank after it
    places = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))[turns]
    if not len(turns):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    runs = pa.LargeStringArray.from_buffers(len(turns) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(every.encode()))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return runs.take(pa.array(np.arange(0, len(runs), 2))), np.searchsorted(ends, turns[::2], "right")


def _distinct(texts: list[str]):
    """The distinct words of a block, and where in the list of places of their documents each word's begin and end."""
    found, owner = _words(texts)
    coded = found.dictionary_encode()
    _, word_ends, word_docs = _lists(coded.indices.to_numpy(), owner) if len(owner) else (None, np.zeros(1, np.int64), np.zeros(0, "<i4"))
    return coded.dictionary, word_ends, word_docs


def _indexed(texts: list[str]):
    """(lists, word_ends, word_docs, vocabulary) of a block: for each gram its documents and its words."""
    words, word_ends, word_docs = _distinct(texts)
    vocabulary = words.to_pylist()
    grams, gram_words, gram_ends = np.zeros(0, np.int64), np.zeros(0, "<i4"), np.zeros(1, np.int64)
    if vocabulary:
        letters = _points(" ".join(vocabulary) + " ").astype(np.int64)
        of = np.repeat(np.arange(len(vocabulary)), np.array([len(w) + 1 for w in vocabulary]))
        alone = np.flatnonzero(letters != ord(" "))
        at = alone[letters[alone + 1] != ord(" ")]
        keys = np.concatenate([letters[alone], (letters[at] << _SHIFT) | letters[at + 1]])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        grams, numbers = ranked[first], np.empty(len(keys), np.int64)
        numbers[order] = np.cumsum(first) - 1
        _, gram_ends, gram_words = _lists(numbers, np.concatenate([of[alone], of[at]]))
    lists = {}
    for g, a, b in zip(grams.tolist(), gram_ends[:-1].tolist(), gram_ends[1:].tolist(), strict=True):
        held = gram_words[a:b]
        mark = np.zeros(len(texts), bool)
        counts = word_ends[held + 1] - word_ends[held]
        places = np.repeat(word_ends[held] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        mark[word_docs[places]] = True
        lists[chr(g >> _SHIFT) + chr(g & ((1 << _SHIFT) - 1)) if g >> _SHIFT else chr(g)] = np.flatnonzero(mark).astype("<i4"), held
    return lists, word_ends, word_docs, vocabulary


def _named(ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids, 0 for null, and which are null."""
    return np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], bool)


def _block(number: int, ids: list[int | None], texts: list[str]):
    """The rows of a block, as an Arrow batch."""
    import pyarrow as pa

    lists, word_ends, word_docs, vocabulary = _indexed(texts)
    names, docs, words = list(lists), [d.tobytes() for d, _ in lists.values()], [w.tobytes() for _, w in lists.values()]
    none = [None] * len(names)
    known, null = _named(ids)
    columns = [
        pa.array([number] * (len(names) + 1), pa.int64()), pa.array([*names, None], pa.string()), pa.array([*docs, word_docs.tobytes()], pa.binary()), pa.array([*words, word_ends.astype("<i8").tobytes()], pa.binary()),
        pa.array([*none, known.tobytes()], pa.binary()), pa.array([*none, null.tobytes()], pa.binary()), pa.array([*none, vocabulary], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "gram", "docs", "words", "ids", "no_ids", "vocabulary"])


def _blocks(rows) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of blocks, from Arrow scalars of ids and texts."""
    ids, texts, size = [], [], 0
    for i, t in rows:
        t = t.as_py() or ""
        if ids and (size + len(t) > BLOCK_CHARS or len(ids) >= BLOCK_DOCS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i.as_py())
        texts.append(t)
        size += len(t)
    if ids:
        yield ids, texts


def postings(docs: DataFrame, text: Column) -> DataFrame:
    """The index of ``docs`` (id and what ``text`` needs): one pass, without a shuffle.

    A null text is empty. Blocks are numbered by task and place in it, so the index is to be written once, and then read.
    """
    from pyspark import TaskContext

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for n, block in enumerate(_blocks((i, t) for batch in batches for i, t in zip(batch.column("id"), batch.column("text"), strict=True))):
            yield _block(first + n, *block)

    return map_arrow(docs.select(F.col("id").cast("long").alias("id"), text.alias("text")), run, _INDEX)


def write_postings(docs: DataFrame, text: Column, path: str) -> None:
    """The index as Parquet."""
    postings(docs, text).write.parquet(path)


def _wanted(queries: DataFrame, groups: int) -> DataFrame:
    """(part, gram, query_id, token, weight) of ``queries`` (query_id, query): each token at the gram that it begins with.

    Tokens of up to two characters are grams. ``part`` deals queries into ``groups``.
    """
    tokens = X.query_tokens(queries)
    return tokens.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("part"), F.substr("token", F.lit(1), F.lit(2)).alias("gram"), "query_id", "token", "weight")


def _documents(token: str, rows: dict, words: np.ndarray, docs: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """Places of the documents of a token of three characters or more: those of the words that have its pairs and hold it."""
    lists = [rows[token[i : i + 2]][1] for i in range(len(token) - 1) if token[i : i + 2] in rows]
    if len(lists) < len(token) - 1:
        return np.zeros(0, "<i4")
    lists.sort(key=len)
    held = lists[0]
    for other in lists[1:]:
        if len(held) < 32:
            break
        held = held[other[np.minimum(np.searchsorted(other, held), len(other) - 1)] == held]
    found = [docs[words[w] : words[w + 1]] for w in held.tolist() if token in vocabulary[w]]
    return np.concatenate(found) if found else np.zeros(0, "<i4")


class _Best:
    """The first ``k`` documents of each query so far, over blocks."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def least(self, query: int) -> float:
        """A score that a document must reach to be among them."""
        scores = self.held[query][0] if query in self.held else ()
        return scores[-1] if len(scores) == self.k else 0.0

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if query in self.held:
            scores, ids, null = (np.concatenate(x) for x in zip(self.held[query], (scores, ids, null), strict=True))
        order = np.lexsort((ids, ~null, -scores))[: self.k]  # null first, then by id
        self.held[query] = scores[order], ids[order], null[order]

    def batch(self):
        import pyarrow as pa

        scores, ids, null = (np.concatenate([x[n] for x in self.held.values()]) for n in range(3))
        queries = np.repeat(list(self.held), [len(x[0]) for x in self.held.values()])
        return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(scores.astype(float))], names=["query_id", "id", "sparse_score"])


def _score(rows: dict, asked: dict[str, list[tuple[int, float]]], block, best: _Best) -> None:
    """Put the documents of a block among the best of each query, by ``asked``: (query, weight) for each token.

    Weights are halves, so single precision sums them exactly. Tokens are taken in slabs of a bounded matrix. A query whose
    tokens in the block can't reach its least score together is left out.
    """
    words, docs, ids, null, vocabulary = block
    holders = {t: _documents(t, rows, words, docs, vocabulary) if len(t) > 2 else rows[t][0] for t in asked if len(t) > 2 or t in rows}
    reach: dict[int, float] = {}
    for token, held in holders.items():
        if len(held):
            for q, weight in asked[token]:
                reach[q] = reach.get(q, 0.0) + weight
    queries = sorted(q for q, most in reach.items() if most >= best.least(q))
    at = {q: n for n, q in enumerate(queries)}
    scores = np.zeros((len(queries), len(ids)), np.float32)
    names = [t for t, held in holders.items() if len(held)]
    slab = max(1, (8 << 20) // max(len(ids), 1))
    for first in range(0, len(names), slab):
        some = names[first : first + slab]
        holds, weights = np.zeros((len(some), len(ids)), np.float32), np.zeros((len(queries), len(some)), np.float32)
        for n, token in enumerate(some):
            holds[n, holders[token]] = 1
            for q, weight in asked[token]:
                if q in at:
                    weights[at[q], n] = weight
        scores += weights @ holds
    for q, own in zip(queries, scores, strict=True):
        least = max(best.least(q), np.partition(own, -best.k)[-best.k] if len(own) > best.k else 0)
        few = np.flatnonzero((own >= least) & (own > 0))
        if len(few):
            best.add(q, own[few], ids[few], null[few])


class _Tokens:
    """The tokens of a task's queries as a tree of characters, and each group's queries and weights."""

    def __init__(self, parts: dict[int, dict[str, list[tuple[int, float]]]]):
        names = sorted({t for asked in parts.values() for t in asked})
        self.at = {t: n for n, t in enumerate(names)}
        letters = np.unique(_points("".join(names)))
        self.letter = np.zeros(0x110000, np.int32)  # 0: a character of no token
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes, keys, self.ends = {"": 0}, {}, [-1]
        for token in names:  # a node is named by what leads to it
            for n in range(1, len(token) + 1):
                if token[:n] not in nodes:
                    keys[nodes[token[: n - 1]] * self.width + int(self.letter[ord(token[n - 1])])] = nodes[token[:n]] = len(nodes)
                    self.ends.append(-1)
            self.ends[nodes[token]] = self.at[token]
        self.ends, self.keys = np.array(self.ends, np.int64), np.array(sorted(keys), np.int64)
        self.nodes = np.array([keys[x] for x in self.keys.tolist()], np.int64)
        self.table = None
        if len(self.ends) * self.width <= TABLE:
            self.table = np.zeros(len(self.ends) * self.width, np.int32)
            self.table[self.keys] = self.nodes
        self.parts = []
        for asked in parts.values():
            queries = np.array(sorted({q for own in asked.values() for q, _ in own}), np.int64)
            rows = [(q, self.at[t], w) for t, own in asked.items() for q, w in own]
            own = np.unique([r[1] for r in rows])
            weights = np.zeros((len(queries), len(own)), np.float32)
            weights[np.searchsorted(queries, [r[0] for r in rows]), np.searchsorted(own, [r[1] for r in rows])] = [r[2] for r in rows]
            self.parts.append((queries.tolist(), own, weights))

    def _next(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes that letters lead to, 0 where there are none."""
        keys = nodes * self.width + letters
        if self.table is not None:
            return self.table[keys]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.nodes[place], 0)

    def found(self, words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(tokens, words): which of an Arrow array of words hold which tokens, for tokens of each length in turn."""
        points = _points(" ".join(words.to_pylist()) + " ")
        letters, of = self.letter[points], np.cumsum(np.append(0, points[:-1] == ord(" ")))  # a blank is in no token
        at, node = np.arange(len(letters)), self._next(np.zeros(len(letters), np.int64), letters)
        while True:
            alive = np.flatnonzero(node)
            if not len(alive):
                return
            at, node = at[alive], node[alive].astype(np.int64)
            ends = self.ends[node]
            yield ends[ends >= 0], of[at[ends >= 0]]
            at = at + 1
            node = self._next(node, letters[at])


def _pass(texts: list[str], ids: np.ndarray, null: np.ndarray, tokens: _Tokens, best: _Best) -> None:
    """Put the documents of a block among the best of each query. Weights are halves, so single precision sums them exactly."""
    words, word_ends, word_docs = _distinct(texts)
    slab = max(1, (8 << 20) // max(len(tokens.at), 1))  # documents at a time, for a bounded matrix
    hits = [x for x in tokens.found(words) if len(x[0])]
    for first in range(0, len(ids), slab):
        n = min(slab, len(ids) - first)
        holds = np.zeros((len(tokens.at), n), np.float32)
        for token, word in hits:
            for a in range(0, len(token), 1 << 20):
                counts = word_ends[word[a : a + (1 << 20)] + 1] - word_ends[word[a : a + (1 << 20)]]
                places = np.repeat(word_ends[word[a : a + (1 << 20)]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                docs = word_docs[places] - first
                inside = slice(None) if n == len(ids) else (docs >= 0) & (docs < n)
                holds[np.repeat(token[a : a + (1 << 20)], counts)[inside], docs[inside]] = 1
        for queries, some, weights in tokens.parts:
            for q, own in zip(queries, weights @ (holds if len(some) == len(holds) else holds[some]), strict=True):
                least = max(best.least(q), np.partition(own, -best.k)[-best.k] if len(own) > best.k else 0)
                few = np.flatnonzero((own >= least) & (own > 0))
                if len(few):
                    best.add(q, own[few], ids[first : first + n][few], null[first : first + n][few])


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sparse_score, sparse_rank): the first ``k`` documents of each of ``queries`` (query_id, query), scored by
    the weights of the query's tokens that they hold; ties by id, null first. Documents without any have no row.

    Queries stay a table: their tokens meet the lists of their grams by a join, and what a group of queries needs of a block
    is scored there, as one product of matrices. A task keeps the first ``k`` of each query over its blocks, leaves out
    queries that a block can't serve any more, and hands on these. One pass serves any number of queries; the lists of a block
    are sent once to each group that needs them. A null query finds nothing.
    """
    groups = max(1, -(-queries.count() // GROUP))
    wanted = _wanted(queries.select(F.col("query_id").cast("long").alias("query_id"), "query").where("query IS NOT NULL"), groups)
    asked = wanted.groupBy("part", "gram").agg(F.collect_list(F.struct("query_id", "token", "weight")).alias("asked"))
    lists = index.where("gram IS NOT NULL").select("block", "gram", "docs", "words")
    # all pairs of a longer token are tokens of its query, so their lists come along
    met = lists.join(asked, "gram").select("part", "block", "gram", "docs", "words", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("no_ids"), F.lit(None).cast("array<string>").alias("vocabulary"), "asked")
    parts = F.sequence(F.lit(0), F.lit(groups - 1))
    whole = index.where("gram IS NULL").select(F.explode(parts).alias("part"), "block", "gram", "docs", "words", "ids", "no_ids", "vocabulary", F.lit(None).cast(met.schema["asked"].dataType).alias("asked"))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = met.unionByName(whole).repartition(n, "part", "block").sortWithinPartitions("part", "block", F.desc_nulls_last("gram"))

    def run(batches):
        unit, rows, tokens, best = (None, None), {}, {}, None
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "block", "gram", "docs", "words", "ids", "no_ids", "vocabulary", "asked")]
            for r in range(batch.num_rows):
                part, block, gram, docs, words, ids, no_ids, vocabulary, own = (c[r] for c in columns)
                now = part.as_py(), block.as_py()
                if now[0] != unit[0]:
                    if best and best.held:
                        yield best.batch()
                    best, tokens = _Best(k), {}
                if now != unit:
                    unit, rows = now, {}
                if (name := gram.as_py()) is not None:
                    rows[name] = np.frombuffer(docs.as_py(), "<i4"), np.frombuffer(words.as_py(), "<i4")
                    if name not in tokens:  # the same for every block of the group
                        tokens[name] = {}
                        for x in own.as_py():
                            tokens[name].setdefault(x["token"], []).append((x["query_id"], x["weight"]))
                elif rows:  # the block's own row comes last
                    held = np.frombuffer(words.as_py(), "<i8"), np.frombuffer(docs.as_py(), "<i4"), np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(no_ids.as_py(), bool), vocabulary.as_py()
                    _score(rows, {t: q for name in rows for t, q in tokens[name].items()}, held, best)
        if best and best.held:
            yield best.batch()

    return _ranked(map_arrow(units, run, "query_id long, id long, sparse_score double"), k)


def _ranked(legs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("sparse_score"), F.asc("id"))
    return legs.withColumn("sparse_rank", F.row_number().over(order)).where(F.col("sparse_rank") <= k)


def sparse_topk_batch(docs: DataFrame, queries: DataFrame, text: Column, k: int) -> DataFrame:
    """As ``search``, of ``docs`` (id and what ``text`` needs) by one batch of queries alone.

    Documents are dealt to the lines and queries to the columns of a grid, each cell of which is a task. It holds the tokens
    of its queries, of bounded number, as a tree; documents pass them once, block by block. Each distinct word of a block goes
    down the tree from each of its characters, and what documents the words are in gives a matrix of tokens by documents.
    Nothing is written, and only the first ``k`` of a query and line are sent.
    """
    spark = docs.sparkSession
    n, groups = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-queries.count() // GROUP))
    columns = -(-groups // HELD)
    lines = max(1, n // columns)
    tokens = X.query_tokens(queries.select(F.col("query_id").cast("long").alias("query_id"), "query").where("query IS NOT NULL"))
    tokens = tokens.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("part"), "query_id", "token", "weight")
    docs = docs.select(F.col("id").cast("long").alias("id"), text.alias("text"))
    line = F.pmod(F.xxhash64("id", "text"), F.lit(lines)).cast("int")
    asked = tokens.select(F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"), "*")
    asked = asked.select((F.col("line") * columns + F.col("part") % columns).alias("cell"), *tokens.columns)
    passing = docs.select(F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"), line.alias("line"), "*")
    passing = passing.select((F.col("line") * columns + F.col("column")).alias("cell"), "id", "text")
    dealt = asked.unionByName(passing, allowMissingColumns=True).repartitionById(lines * columns, F.col("cell"))

    def run(batches):
        parts: dict[int, dict[str, list[tuple[int, float]]]] = {}

        def rows():
            for batch in batches:  # tokens come before documents
                first = batch.column("token").is_valid()
                some = batch.filter(first)
                for part, query, token, weight in zip(*(some.column(c).to_pylist() for c in ("part", "query_id", "token", "weight")), strict=True):
                    parts.setdefault(part, {}).setdefault(token, []).append((query, weight))
                if some.num_rows < batch.num_rows and parts:
                    some = batch.slice(some.num_rows)
                    yield from zip(some.column("id"), some.column("text"), strict=True)

        best, tokens = _Best(k), None
        for ids, texts in _blocks(rows()):
            tokens = tokens or _Tokens(parts)
            _pass(texts, *_named(ids), tokens, best)
        if best.held:
            yield best.batch()

    dealt = dealt.sortWithinPartitions(F.col("token").isNull()).drop("cell")
    return _ranked(map_arrow(dealt, run, "query_id long, id long, sparse_score double"), k)
