"""Byte-level BPE from a file of ranks: whole texts to ids and back, merges replayed over many words at once."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..workers import map_arrow
from .tokens import WordEncoder

# Fixed value: the pattern whose matches are found without a regular expression, by classes of characters.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Buckets of ranks of the index of pairs; bytes of text whose words are looked up together; bytes of words remembered.
BUCKETS, STRETCH, HELD = 96, 2 << 20, 40 << 20


def character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    found = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            found[run.start() : run.end()] = kind
    return found


def match_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the matches of ``PATTERN`` begin in texts put together: ``points`` are code points, ``first`` marks the places
    where a text begins.

    A match is a run of one class, but: the last of several white-space characters before something else parts from them,
    and if it is a space, the next run takes it; an apostrophe alone, without such a space, takes a contraction's letters.
    """
    kind = classes[points]
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    starts = begins.copy()
    after = np.flatnonzero(begins[1:] & ~first[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    starts[after - 1] = True
    starts[after[points[after - 1] == ord(" ")]] = False
    quote = np.flatnonzero(starts[:-1] & (points[:-1] == ord("'")) & ~first[1:] & (kind[1:] == LETTER))
    one = points[quote + 1]
    has_two = quote + 2 < len(points)
    two = np.where(has_two, points[np.minimum(quote + 2, len(points) - 1)], 0)
    two[has_two & first[np.minimum(quote + 2, len(points) - 1)]] = 0
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    taken = short | long
    starts[quote[taken] + 1] = False
    ends = quote[taken] + np.where(short[taken], 2, 3)
    starts[ends[ends < len(points)]] = True
    return np.flatnonzero(starts)


class Ranks:
    """A file of ranks: the tokens' bytes by id, and the rank of what two tokens give together."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.top = max(self.rank.values()) + 1
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.top + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bounds = np.append(np.quantile(self.merged, np.arange(1, BUCKETS) / BUCKETS).astype(np.int64), self.top)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of tokens a followed by b, ``top`` where they never merge."""
        keys = a * self.top + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.merged[at], self.top)

    def replayed(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words, and where in them each word's begin and how many they are.

        An inverted index holds the places of all pairs of neighbours in all words, by rank, in buckets of ranks. Buckets
        are taken in order; in one, each word's pair of the lowest rank (the leftmost of these) is merged in all words at
        once, and only the pairs with its two neighbours are looked up and put into the index, until no pair of the bucket
        or below is left. So every word sees its merges in rank order.
        """
        known = np.array([self.rank.get(w, -1) for w in words], np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        sizes[known >= 0] = 0
        token = self.byte[np.frombuffer(b"".join(w for w, k in zip(words, known.tolist(), strict=True) if k < 0), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        size = len(token)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        last = np.append(word[1:] != word[:-1], True)[:size]
        after[last] = -1
        before[np.flatnonzero(last)[:-1] + 1] = -1
        pair = np.full(size, self.top)  # the rank of each place's token and the next one
        some = np.flatnonzero(~last)
        pair[some] = self.of(token[some], token[some + 1])
        index: list[list[np.ndarray]] = [[] for _ in self.bounds]

        def enter(places: np.ndarray, bucket: int) -> None:
            """Into the index, by rank; not before the bucket that is at work."""
            places = places[pair[places] < self.top]
            which = np.maximum(np.searchsorted(self.bounds, pair[places], "right"), bucket)
            order = np.argsort(which, kind="stable")
            cuts = np.flatnonzero(np.diff(which[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    index[which[part[0]]].append(places[part])

        enter(some, 0)
        for bucket, bound in enumerate(self.bounds):
            while index[bucket]:
                places = np.sort(np.concatenate(index[bucket]))
                # once each; others have been merged or have another neighbour since
                places = places[np.append(True, places[1:] != places[:-1]) & (pair[places] < bound)]
                if not len(places):
                    index[bucket] = []
                    break
                starts = np.flatnonzero(np.append(True, word[places[1:]] != word[places[:-1]]))
                many = np.diff(np.append(starts, len(places)))
                lowest = pair[places] == np.repeat(np.minimum.reduceat(pair[places], starts), many)
                p = self._together(places[lowest], token, word, pair, before, after)
                index[bucket] = [places] if len(p) < len(places) else []
                q = after[p]
                token[p], token[q] = pair[p], -1
                n, b = after[q], before[p]
                after[p] = n
                before[n[n >= 0]] = p[n >= 0]
                pair[q], pair[p] = self.top, self.top
                right, left = p[n >= 0], b[b >= 0]
                touched = np.concatenate([left, right])
                pair[touched] = self.of(token[touched], token[after[touched]])
                enter(touched, bucket)
        left = token >= 0
        counts = np.bincount(word[left], minlength=len(words)) if size else np.zeros(len(words), np.int64)
        counts[known >= 0] = 1
        firsts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u4")
        out[firsts[known >= 0]] = known[known >= 0]
        out[np.repeat(known < 0, counts)] = token[left]
        return out, firsts, counts


    def _together(self, p: np.ndarray, token, word, pair, before, after) -> np.ndarray:
        """Of the places ``p`` of each word's lowest rank, those that may be merged at once: of places in a row every other
        one from the left; only the leftmost of a word if a merge there could make a pair of a lower rank."""
        same = np.append(False, word[p[1:]] == word[p[:-1]])[: len(p)]
        if not same.any():
            return p
        chained = same & np.append(False, after[p[:-1]] == p[1:])[: len(p)]
        at = np.arange(len(p))
        leader = np.maximum.accumulate(np.where(chained, 0, at))
        p = p[(at - leader) % 2 == 0]
        now, b, n = pair[p], before[p], after[after[p]]
        lower = (b >= 0) & (self.of(token[b], now) < now) | (n >= 0) & (self.of(now, token[n]) < now) | (self.of(now, now) < now)
        if lower.any():
            first = np.append(True, word[p[1:]] != word[p[:-1]])
            p = p[first | ~np.isin(word[p], word[p[lower]])]
        return p


class ByteEncoder(WordEncoder):
    """Texts to ids: texts are split by a pattern in numpy, words told apart and looked up in Arrow, new words of a stretch
    of text merged together. A word that is a token itself is that token. Words are remembered, within a bound.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        self.ranks, self.pattern = Ranks(path), pattern
        self.classes = character_classes() if pattern == PATTERN else None
        super()._forget()

    def _forget(self) -> None:
        if self.remembered() > HELD:  # more than the words of other tokenizers, as these cost more
            super()._forget()

    def _encode(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import pyarrow as pa

        return self.ranks.replayed(words.cast(pa.large_binary()).to_pylist())

    def _words(self, texts):
        """The words of texts (Arrow, no nulls) one after the other, and where each text's begin and end."""
        import pyarrow as pa

        raw = pa.concat_arrays([texts.cast(pa.large_string())])
        offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        data = raw.buffers()[2]
        body = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if data is not None else pa.py_buffer(b"")
        ends = offsets - offsets[0]
        if not ends[-1]:
            return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
        if self.classes is None:
            import regex

            cuts = [np.cumsum([0, *(len(m.encode()) for m in regex.findall(self.pattern, t))])[:-1] + ends[k] for k, t in enumerate(texts.to_pylist())]
            starts = np.concatenate(cuts)
        else:
            points = np.frombuffer(str(memoryview(body), "utf-8").encode("utf-32-le"), "<u4")
            widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            places = np.cumsum(widths, dtype=np.int64) - widths
            first = np.zeros(len(points), bool)
            first[np.searchsorted(places, ends[:-1][np.diff(ends) > 0])] = True
            starts = places[match_starts(points, first, self.classes)]
        bounds = np.append(starts, ends[-1])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), body)
        return words, np.searchsorted(starts, ends)

    def column(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``WordEncoder.column``."""
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STRETCH, "right")))
            words, cuts = self._words(texts.slice(at, end - at))
            at = end
            coded = words.dictionary_encode()
            known, firsts, lengths = self._looked_up(coded.dictionary)
            which = coded.indices.to_numpy()
            counts = lengths[which]
            ends = np.concatenate([[0], np.cumsum(counts)])
            places = np.repeat(firsts[which] - ends[:-1], counts)
            places += np.arange(ends[-1])
            yield known[places], ends[cuts]
            del words, coded, which, places
        pa.default_memory_pool().release_unused()


_encoders: dict[tuple[str, str], ByteEncoder] = {}
_tokens: dict[str, object] = {}


def encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder for each file and pattern in a worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteEncoder(path, pattern)
    return _encoders[path, pattern]


def tokens(path: str):
    """The bytes of all tokens by id, as an Arrow array; ids without a token are null."""
    import pyarrow as pa

    if path not in _tokens:
        known = {rank: token for token, rank in Ranks(path).rank.items()}
        _tokens[path] = pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary())
    return _tokens[path]


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, columns: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with n_tokens and ids (little-endian unsigned 32-bit) of the whole ``text``.

    ``path`` is a file of ranks as tiktoken reads it; each match of ``pattern`` is encoded separately, without special
    tokens, with the ids that tiktoken gives. A null text is an empty one and has no ids. Texts of any length are taken
    whole. Rows are encoded one by one wherever they lie, so repeated rows, null or repeated ids and other columns of any
    names change nothing; an empty table gives an empty table.
    """
    import pyarrow as pa

    kept = list(columns)
    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").cast("binary").alias("ids")).schema

    def run(batches):
        words = encoder(path, pattern)
        for batch in batches:
            at = 0
            for ids, ends in words.column(batch.column("_text").fill_null("")):
                n = len(ends) - 1
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends * 4), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
                part, at = batch.slice(at, n), at + n
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(np.diff(ends), pa.int64()), raw], names=[*kept, "n_tokens", "ids"])

    return map_arrow(docs.select(*kept, F.col("text").alias("_text")), run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``: the bytes of their ``ids`` (as ``encode`` gives them), empty for null.

    The bytes need not be UTF-8, as ids may be cut anywhere. An id without a token, or ids that aren't whole numbers of four
    bytes, are an error. Other columns stay.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = rows.select("*", F.lit(b"").cast("binary").alias("decoded")).schema

    def run(batches):
        vocabulary = tokens(path)
        for batch in batches:
            column = batch.column("ids").fill_null(b"").cast(pa.large_binary())
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])
            at = 0
            while at < len(column):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + STRETCH, "right")) - 1)
                some, cuts = column.slice(at, end - at), ends[at : end + 1] - ends[at]
                ids = np.frombuffer(b"".join(some.to_pylist()), "<u4")
                found = vocabulary.take(pa.array(ids))
                if found.null_count or (cuts % 4).any():
                    raise ValueError("ids that aren't ids of the file")
                offsets = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[cuts // 4] if len(found) else np.zeros(len(cuts), np.int64)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - at, [None, pa.py_buffer(np.ascontiguousarray(offsets)), found.buffers()[2]]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, raw], names=[*batch.schema.names, "decoded"])
                at = end

    return map_arrow(rows, run, schema)
