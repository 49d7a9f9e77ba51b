"""Mixture-controlled packing of documents into windows of a fixed number of tokens.

Each source is a queue, served by deficit round-robin: in each round a source's deficit grows by its quantum, its part of
one window by target weight; what has gathered is served, cutting documents freely, and the fraction of a token that
cannot be served stays as deficit. A source whose quantum is under ``least`` tokens waits until that many rounds have
gathered them, so that many small sources don't shred documents.

What a backlogged queue has been served by round r is the whole part of r quanta, so the round of a token follows from
its place in its queue alone. Deficits are thus carried exactly across windows and partitions without running the rounds
one by one: prefix sums place documents in their queues, and pieces in the stream of all rounds, which is cut into
windows without padding. Only the last window of all can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..workers import map_arrow
from .shared import cut, running
from .tokens import encoded, id_type

LENGTH, LEAST = 2048, 64


def service(token: int, weight: int, weights: int, every: int, length: int) -> int:
    """The service, from 1, in which the queue's token (from 0) is sent."""
    return -(-(token + 1) * weights // (every * length * weight))


def _serve(places: DataFrame, length: int, least: int) -> DataFrame:
    """Cut the documents, each with its place in its queue, at the ends of services."""
    import pyarrow as pa

    names = ["uid", "number", "round", "from", "start", "length"]
    schema = "uid long, number int, round long, `from` long, start long, length long"

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for uid, number, first, n, weight, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                weight, weights, token, end = int(weight), int(weights), first, first + n
                every = max(1, -(-least * weights // (length * weight)))
                while token < end:
                    m = service(token, weight, weights, every, length)
                    stop = min(end, m * every * length * weight // weights)
                    rows.append((uid, number, m * every, token, token - first, stop - token))
                    token = stop
                if len(rows) >= 20_000:
                    yield built(rows)
                    rows = []
            if rows:
                yield built(rows)

    types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    return map_arrow(places.select("uid", "number", "first", "n_tokens", "weight", "weights"), serve, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, least: int = LEAST, weights: dict[str | None, int] | None = None, seed: str = "pack", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    ``ids`` are little-endian unsigned 32-bit, null unless ``with_ids``; ids_crc32 is their checksum.

    Reads doc_id, source and text. Null text is empty: its document is the end id alone. Null sources are one source.
    ``weights`` gives whole-number targets by source, 1 for those it doesn't name; left out, each source's number of tokens is its
    target, so that all queues end together. Queues are in order of a hash of the id; repeated rows are documents of
    their own. No rows give no pieces. Other columns are ignored, whatever their names. Texts are read whole: one that is
    longer than a window, or than many, is as many pieces. The windows without a partition run over sources, one row
    each, which are taken to be few enough for one task; documents and pieces are never in one.
    """
    import pyarrow as pa

    given = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", "text")
    held = cut(encoded(given, tokenizer, end_id, ("uid", "doc_id", "source")))
    queues = held.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    queues = queues.withColumn("number", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
    weight = F.col("tokens")
    if weights is not None:
        weight = F.lit(1)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(int(w))).otherwise(weight)
    queues = queues.withColumn("weight", weight.cast("decimal(38,0)"))
    queues = cut(queues.withColumn("weights", F.sum("weight").over(W.partitionBy()).cast("decimal(38,0)")))
    rows = held.select("uid", "doc_id", "source", "n_tokens").alias("h").join(queues.alias("q"), F.col("h.source").eqNullSafe(F.col("q.source")))
    key = F.xxhash64(F.lit(seed), "doc_id").alias("key")
    placed = running(rows.select("uid", "n_tokens", "number", "weight", "weights", key), ["number"], ["key", "uid"], {"first": "n_tokens"})
    pieces = running(cut(_serve(placed, length, least)), [], ["round", "number", "from"], {"at": "length"})
    last = F.expr(f"(at + length - 1) div {length}")
    pieces = pieces.select("*", F.explode(F.sequence(F.expr(f"at div {length}"), last)).alias("sequence_id"))
    begin = F.greatest(F.col("at"), F.col("sequence_id") * length)
    end = F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * length)
    piece = F.struct((F.col("start") + begin - F.col("at")).alias("start"), (end - begin).alias("length"), "sequence_id", (begin % length).alias("offset"))
    by_doc = pieces.groupBy("uid").agg(F.collect_list(piece).alias("pieces"))
    joined = held.join(by_doc, "uid").select("doc_id", "source", "n_tokens", "ids", "pieces")
    out = held.select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(0).cast("long").alias("doc_tokens"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "source", F.lit(None).cast("binary").alias("ids")).schema
    kind = id_type(tokenizer, end_id)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                counts = some.column("pieces").value_lengths().to_numpy()
                owner = pa.array(np.repeat(np.arange(some.num_rows), counts))
                flat = some.column("pieces").flatten()
                start, size, sequence, offset = (flat.field(f) for f in ("start", "length", "sequence_id", "offset"))
                data = [memoryview(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in some.column("ids").to_pylist()]
                ids = [data[o][4 * s : 4 * (s + n)] for o, s, n in zip(owner.to_pylist(), start.to_pylist(), size.to_pylist(), strict=True)]
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                take = lambda name: some.column(name).take(owner)
                yield pa.RecordBatch.from_arrays([take("doc_id"), start, size, crc, take("n_tokens"), sequence, offset, take("source"), pa.array([bytes(x) for x in ids], pa.binary()) if with_ids else pa.nulls(len(ids), pa.binary())], names=out.names)

    return map_arrow(joined, slices, out)
