"""Token ids of whole texts from the file of a public tokenizer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..workers import map_arrow

#: Bytes of words and their ids that a worker remembers at most, and of pieces of plain words; beyond, it forgets them all
#: and starts again.
REMEMBERED, PIECES = 12 << 20, 12 << 20
#: Bytes of text whose words are looked up together, words that go to the library as one line, and lines at a time.
TOGETHER, LINE, FEW = 1 << 21, 500, 64
#: Letters, then any ASCII marks but the apostrophe: two pieces at most to a tokenizer that parts letters from marks.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
_SMALL_LETTERS, _MARK_CHARACTERS = ("".join(c for c in map(chr, range(256)) if re.match(kind, c)) for kind in (_LETTERS, _MARKS))


#: Texts that show whether a tokenizer parts at white space and drops it; the first word of each starts a line.
_PROBES = ("a b", " a\tb ", "the word\nthe  word", "\x0bIt's\x0c1, 2\r\n(3)", "é ß 漢字 🙂")
#: Plain words that show whether letters and marks, in small letters and parted by a space, give the same ids.
_PLAIN_PROBES = ("The", "word,", "Äpfel!?", "façade", "STRASSE", "naïve.", "x", "ÿ", "hello-", "internationalization", "ßÀ&&", "a_", "b`~|")


class WordEncoder:
    """Encodes with the tokenizers library, each distinct word once.

    For tokenizers that split at white space and drop it, a text's ids are its words' ids one after the other, so each
    word between ASCII white space is sent to the library when first met and remembered. The memory is bounded. Words are
    split, told apart, looked up and put together again in Arrow and numpy, so only new words are ever Python objects.

    Plain words are letters and marks behind them, two pieces that have their ids apart: each distinct piece in small letters
    is sent when first met and remembered beside the words, so that a word with other marks or capitals costs no merging.
    Many pieces go to the library as one line if its tokens mark the ends of pieces, and are told apart by these ends;
    where probes show that the tokenizer's normalisation of them is that of small letters, it is left out. A tokenizer that
    treats white space otherwise, as probes show, encodes whole texts instead.
    """

    def __init__(self, path: str):
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        whole, parts = self._ids(list(_PROBES)), [self._ids(t.split()) for t in _PROBES]
        self.by_word = all(x.tolist() == np.concatenate(y).tolist() for x, y in zip(whole, parts, strict=True))
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.plain = None
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.plain = Tokenizer(self.tokenizer.model)  # the same vocabulary, not another copy
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self._forget_pieces()
            ids, firsts, counts = self._plain(pa.array(_PLAIN_PROBES, pa.large_string()))
            if any(x.tolist() != ids[f : f + n].tolist() for x, f, n in zip(self._ids(list(_PLAIN_PROBES)), firsts, counts, strict=True)):
                self.plain = None

    def _forget(self) -> None:
        import pyarrow as pa

        nothing = np.zeros(0, np.int64)
        self.known, self.ids, self.firsts, self.counts = pa.array([], pa.large_string()), nothing.astype("<u4"), nothing, nothing

    def remembered(self) -> int:
        """Bytes held of words and their ids."""
        return self.known.nbytes + self.ids.nbytes + self.firsts.nbytes + self.counts.nbytes

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        encode, out = (tokenizer or self.tokenizer).encode_batch_fast, []
        for at in range(0, len(texts), FEW):  # the library's own form of ids is many times as large
            out += [np.array(e.ids, "<u4") for e in encode(texts[at : at + FEW], add_special_tokens=False)]
        return out

    def _forget_pieces(self) -> None:
        import pyarrow as pa

        nothing = np.zeros(0, np.int64)
        self.pieces, self.piece_ids, self.piece_firsts, self.piece_counts = pa.array([], pa.large_string()), nothing.astype("<u4"), nothing, nothing

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, as ``_encode``: a line of them at once, or one by one where its ends aren't those of the pieces."""
        lines, out, counts = [pieces[at : at + LINE] for at in range(0, len(pieces), LINE)], [np.zeros(0, "<u4")], []
        for line, ids in zip(lines, self._ids([" ".join(x) for x in lines], self.plain), strict=True):
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(line):
                out.append(ids)
                counts.append(np.diff(stops, prepend=0))
            else:
                alone = self._ids(line)
                out += alone
                counts.append(np.array(list(map(len, alone)), np.int64))
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return np.concatenate(out), np.cumsum(counts) - counts, counts

    def _plain(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_encode`` of plain words: the ids of each one's letters, then those of its marks."""
        import pyarrow as pa
        import pyarrow.compute as pc

        small = pc.utf8_lower(words)
        letters = pc.utf8_rtrim(small, characters=_MARK_CHARACTERS)
        marks = pc.utf8_ltrim(small, characters=_SMALL_LETTERS)
        coded = pa.concat_arrays([letters, marks]).dictionary_encode()
        pieces = coded.dictionary.cast(pa.large_string())  # an empty one, of words without marks, has no ids
        found = pc.index_in(pieces, value_set=self.pieces)
        new, where = pieces.filter(found.is_null()), found.fill_null(0).to_numpy().astype(np.int64)
        where[found.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.pieces), len(self.pieces) + len(new))
        if len(new):
            texts = new.to_pylist()
            filled = np.array([bool(x) for x in texts])
            ids, some_firsts, some_counts = self._piece_ids([x for x in texts if x])
            firsts, counts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
            firsts[filled], counts[filled] = some_firsts, some_counts
            self.piece_firsts, self.piece_counts = np.concatenate([self.piece_firsts, firsts + len(self.piece_ids)]), np.concatenate([self.piece_counts, counts])
            self.pieces, self.piece_ids = pa.concat_arrays([self.pieces, new]), np.concatenate([self.piece_ids, ids])
        which = where[coded.indices.to_numpy().reshape(2, -1).T.ravel()]  # letters and marks in turn
        counts = self.piece_counts[which]
        ends = np.cumsum(counts)
        places = np.repeat(self.piece_firsts[which] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        ids, lengths = self.piece_ids[places], counts.reshape(-1, 2).sum(1)
        if self.pieces.nbytes + self.piece_ids.nbytes + self.piece_firsts.nbytes + self.piece_counts.nbytes > PIECES:
            self._forget_pieces()
        return ids, np.cumsum(lengths) - lengths, lengths

    def _encode(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of an Arrow array of distinct words, and where in them each word's begin and how many they are."""
        import pyarrow.compute as pc

        out, size, left = [np.zeros(0, "<u4")], 0, np.ones(len(words), bool)
        firsts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if self.plain is not None:
            plain = np.flatnonzero(pc.match_substring_regex(words, f"^{_LETTERS}+{_MARKS}*$").to_numpy(zero_copy_only=False))
            ids, firsts[plain], counts[plain] = self._plain(words.take(plain))
            left[plain] = False
            out.append(ids)
            size = len(ids)
        rest = np.flatnonzero(left)
        alone = self._ids(words.take(rest).to_pylist())
        counts[rest] = list(map(len, alone))
        firsts[rest] = size + np.cumsum(counts[rest]) - counts[rest]
        return np.concatenate(out + alone), firsts, counts

    def _looked_up(self, distinct) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_encode`` of an Arrow array of distinct words, of which only those not remembered are encoded."""
        import pyarrow as pa
        import pyarrow.compute as pc

        distinct = distinct.cast(pa.large_string())
        found = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(found.is_null())
        where = found.fill_null(0).to_numpy().astype(np.int64)
        where[found.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(new))
        if len(new):
            ids, firsts, counts = self._encode(new)
            self.firsts, self.counts = np.concatenate([self.firsts, firsts + len(self.ids)]), np.concatenate([self.counts, counts])
            self.known, self.ids = pa.concat_arrays([self.known, new]), np.concatenate([self.ids, ids])
        answer = self.ids, self.firsts[where], self.counts[where]
        if self.remembered() > REMEMBERED:
            self._forget()
        return answer

    def column(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For stretches of an Arrow string column without nulls: the ids of their texts, and where each text's begin and end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right")))
            part, at = texts.slice(at, end - at), end
            if not self.by_word:
                ids = self._ids(part.to_pylist())
                yield np.concatenate(ids), np.cumsum([0, *map(len, ids)])
                continue
            words = pc.ascii_split_whitespace(part)
            coded = words.flatten().dictionary_encode()
            known, firsts, lengths = self._looked_up(coded.dictionary)  # an empty word, as at the ends of a text, has no ids
            which = coded.indices.to_numpy()
            counts = lengths[which]
            ends = np.concatenate([[0], np.cumsum(counts)])
            places = np.repeat(firsts[which] - ends[:-1], counts)
            places += np.arange(ends[-1])
            ids = known[places]
            yield ids, ends[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])]
            del words, coded, which, places, ids
        pa.default_memory_pool().release_unused()  # workers live on, beside those of other tasks

    def many(self, texts) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow string column, null as empty."""
        for ids, ends in self.column(texts.fill_null("")):
            yield from np.split(ids, ends[1:-1])

    def __call__(self, text: str) -> np.ndarray:
        import pyarrow as pa

        return next(self.many(pa.array([text], pa.string())))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file in a worker process, on the task's own core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, end_id: int) -> np.ndarray:
    return np.append(ids, np.uint32(end_id))


def id_type(path: str, end_id: int) -> str:
    """The narrowest of two little-endian types that holds all ids of a tokenizer, which isn't kept on the driver."""
    from tokenizers import Tokenizer

    top = max(end_id, Tokenizer.from_file(path).get_vocab_size() - 1)
    return "<u2" if top < 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end_id: int, columns: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with n_tokens and ids (of ``id_type``, end id last) of the text."""
    import pyarrow as pa

    kind = id_type(path, end_id)
    kept = list(columns)
    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").cast("binary").alias("ids")).schema

    def encode(batches):
        word_ids = encoder(path)
        for batch in batches:
            at = 0
            for ids, ends in word_ids.column(batch.column("text").fill_null("")):
                n = len(ends) - 1
                ids = np.insert(ids.astype(kind), ends[1:], end_id)
                ends = ends + np.arange(n + 1)
                offsets = pa.array(ends * ids.itemsize, pa.int64())
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, offsets.buffers()[1], pa.py_buffer(ids)]).cast(pa.binary())
                part, at = batch.slice(at, n), at + n
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(np.diff(ends), pa.int64()), raw], names=[*kept, "n_tokens", "ids"])

    return map_arrow(docs.select(*kept, "text"), encode, schema)
