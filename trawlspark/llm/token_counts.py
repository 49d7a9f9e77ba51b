"""Numbers of unigram tokens, by dynamic programming shared along a trie.

The distinct pre-tokens of a batch are the leaves of a trie. The best score with which a prefix can be cut into pieces
depends on the prefix alone, so it is computed once for each node of the trie, however many pre-tokens share it. The
trie is walked in sorted order, which holds only the path to one leaf at a time; a leaf leaves the number of pieces of
its best cut behind. A worker remembers these numbers, and a text's count is their sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame

from ..workers import map_arrow
from .shared import as_bytes

REMEMBERED, LONGEST = 1_000_000, 48
SPACE = "▁"


def piece_scores(model: str) -> tuple[dict[str, float], float]:
    """(log probability of each piece, of one byte) for the pieces of a SentencePiece file, by their rank: p ~ 1 / (rank + 3).

    The file's own scores are ranks of merges, not probabilities; a piece's probability is taken to fall with its rank
    as word frequencies do. A byte is as unlikely as the last piece.
    """
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=model)
    usable = [i for i in range(pieces.vocab_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]
    total = math.log(sum(1 / (rank + 3) for rank in range(len(usable))))
    scores = {pieces.id_to_piece(i): -math.log(rank + 3) - total for rank, i in enumerate(usable)}
    return scores, -math.log(len(usable) + 3) - total


class UnigramCounter:
    """Counts the pieces of the likeliest cut of pre-tokens; of equally likely cuts the one with fewer pieces counts.

    A character that starts no piece can be sent as its UTF-8 bytes, one piece each.
    """

    def __init__(self, scores: Mapping[str, float], byte_score: float, prefix: str = SPACE):
        self.byte_score, self.prefix, self.known = byte_score, prefix, {}
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """The number of pieces of each distinct word."""
        root, byte_score = self.root, self.byte_score
        # along the path: best score, its pieces, and the starts with the piece nodes that they have reached
        best, pieces, open_at = [0.0], [0], [[]]
        before, out = "", {}
        for word in sorted(words):
            text = self.prefix + word
            same = 0
            for a, b in zip(before, text, strict=False):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], pieces[same + 1 :], open_at[same + 1 :]
            for at in range(same, len(text)):
                c = text[at]
                n_bytes = len(c.encode())
                top, fewest = best[at] + n_bytes * byte_score, pieces[at] + n_bytes
                reached = []
                for start, node in (*open_at[at], (at, root)):
                    node = node.get(c)
                    if node is not None:
                        reached.append((start, node))
                        score = node.get("")
                        if score is not None:
                            score += best[start]
                            if score > top or (score == top and pieces[start] + 1 < fewest):
                                top, fewest = score, pieces[start] + 1
                best.append(top)
                pieces.append(fewest)
                open_at.append(reached)
            out[word] = pieces[len(text)]
            before = text
        return out

    def many(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, pieces) of each text."""
        done = []
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*split)
        found = self.counts([w.decode() for w in new])
        self.known.update((w.encode(), n) for w, n in found.items())
        for words in split:
            done.append((len(words), sum([self.known[w] for w in words])))
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return done


_counters: dict[str, UnigramCounter] = {}


def counter(model: str) -> UnigramCounter:
    if model not in _counters:
        _counters[model] = UnigramCounter(*piece_scores(model))
    return _counters[model]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens of the whole text under the pieces of ``model``.

    Reads doc_id and text. Words are runs of anything but ASCII white space, each with the mark of a space before it.
    Null and empty texts count 0, texts of any length are counted whole, and a word of any length is one pre-token. Other
    columns are ignored, whatever their names. Needs no shuffle; repeated rows repeat; an empty table gives no rows.
    """
    import pyarrow as pa

    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                words, tokens = zip(*counter(model).many(as_bytes(some.column("text"))), strict=True)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=schema.names)

    return map_arrow(docs.select("doc_id", "text"), count, schema)
