"""Token ids in files of patched frame-of-reference blocks.

A file holds whole documents in order. Its ids are cut into blocks; of each block the least id is subtracted, a
percentile of the rest gives the bit width at which all are packed, and the rest that need more bits are listed as
exceptions with their places. An index gives the start of each block.

Layout, little-endian: magic (8 bytes), documents, ids, blocks, block length (4 x u64); doc ids (i64 each), null flags
(u8 each), documents' lengths (u64 each); block starts from the first block's (u64 each, one more for the end); blocks.
A block: least id u32, exceptions u16, width u8, unused u8; packed words; exceptions' places (u16), their values (u32).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from ..workers import map_arrow
from .shared import checkpoint_dir, cut, shuffle_partitions
from .tokens import encoder, with_end

MAGIC, BLOCK, PERCENTILE, FILE_IDS = b"PFORBLK1", 512, 0.9, 1 << 21
#: Up to so many files, of about 50 bytes each, the table of their starts goes to every executor; else the contents are shuffled.
BROADCAST_FILES = 200_000
_HEAD = np.dtype([("least", "<u4"), ("exceptions", "<u2"), ("width", "u1"), ("unused", "u1")])


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values under 2**width as rows of bytes, low bits first."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def _unpacked(data: np.ndarray, width: int, length: int) -> np.ndarray:
    if not width:
        return np.zeros((len(data), length), np.uint32)
    bits = np.unpackbits(data, axis=1, count=width * length, bitorder="little").reshape(len(data), length, width)
    out = np.zeros((len(data), length), np.uint32)
    for k in range(width):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(starts of the blocks and their end, the blocks). The last block is filled up with its last id."""
    ids = np.asarray(ids, np.uint32)
    n = -(-len(ids) // block)
    if not n:
        return np.zeros(1, np.uint64), b""
    rows = np.pad(ids, (0, n * block - len(ids)), mode="edge").reshape(n, block)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    level = np.sort(rest, axis=1)[:, min(block - 1, int(percentile * block))]
    widths = np.ceil(np.log2(level.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * n
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        for some in np.array_split(at, -(-len(at) // 512)):
            values = rest[some]
            over = values >> np.uint32(width) > 0 if width < 32 else np.zeros(values.shape, bool)
            body = _packed(np.where(over, np.uint32(0), values), int(width))
            for i, row in enumerate(some):
                places = np.flatnonzero(over[i])
                head = np.array([(least[row], len(places), width, 0)], _HEAD)
                out[row] = head.tobytes() + body[i].tobytes() + places.astype("<u2").tobytes() + values[i, places].astype("<u4").tobytes()
    return np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.uint64), b"".join(out)


def decode_blocks(data: bytes, starts: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    n = len(starts) - 1
    raw, starts = np.frombuffer(data, np.uint8), np.asarray(starts, np.int64)
    if not n:
        return np.zeros(0, np.uint32)
    heads = raw[starts[:-1, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD)[:, 0]
    out = np.empty((n, block), np.uint32)
    for width in np.unique(heads["width"]):
        size = -(-int(width) * block // 8)
        at = np.flatnonzero(heads["width"] == width)
        for some in np.array_split(at, -(-len(at) // 512)):
            body = raw[starts[some, None] + _HEAD.itemsize + np.arange(size)]
            out[some] = _unpacked(body, int(width), block)
    for row in np.flatnonzero(heads["exceptions"]):
        k = int(heads["exceptions"][row])
        at = int(starts[row]) + _HEAD.itemsize + -(-int(heads["width"][row]) * block // 8)
        places = raw[at : at + 2 * k].copy().view("<u2")
        out[row, places] = raw[at + 2 * k : at + 6 * k].copy().view("<u4")
    return (out + heads["least"][:, None]).reshape(-1)[:n_ids]


def encode_file(doc_ids: list[int | None], docs: list[np.ndarray], block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    starts, body = encode_blocks(ids, block, percentile)
    parts = [
        MAGIC,
        np.array([len(docs), len(ids), len(starts) - 1, block], "<u8").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.array([len(x) for x in docs], "<u8").tobytes(),
        starts.astype("<u8").tobytes(),
        body,
    ]
    return b"".join(parts)


def decode_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, all ids) of a file's bytes."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks, block = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
    at = 40
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, np.uint8, n_docs, at := at + 8 * n_docs)
    lengths = np.frombuffer(data, "<u8", n_docs, at := at + n_docs).astype(np.int64)
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * n_docs)
    ids = decode_blocks(data[at + 8 * (n_blocks + 1) :], starts, n_ids, block)
    return [None if null else int(x) for x, null in zip(doc_ids, nulls, strict=True)], lengths, ids


def _write(folder: str, name: str, data: bytes) -> None:
    """Under a name of this attempt first, so that a lost or repeated task leaves whole files only."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    own = f"{place}/_{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    final = f"{place}/{name}"
    if store.type_name != "local" and store.get_file_info(final).type != fs.FileType.NotFound:
        store.delete_file(final)
    store.move(own, final)


def _uri(folder: str) -> str:
    if folder.startswith("file:/"):
        return "file:///" + folder[len("file:") :].lstrip("/")
    return folder if "://" in folder else f"file://{os.path.abspath(folder)}"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, block: int = BLOCK, percentile: float = PERCENTILE, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts, in ascending order of doc_id, as files of about ``file_ids`` ids into ``folder``.

    Reads doc_id, a whole number as the files hold it in 64 bits, and text; other columns are ignored, whatever their names.
    Null text is empty: its document has the end id alone. Null ids come first; rows of one id
    are ordered by their text. A document stays in one file, so a very long one makes a long file. Returns the files'
    table: file, part, number, docs, ids. An empty table gives no files. ``folder`` must be shared by all executors.
    """
    import pyarrow as pa

    folder = _uri(folder)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list = []
        total = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}.pfor"
            _write(folder, name, encode_file(doc_ids, held, block, percentile))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "number": [number], "docs": [len(held)], "ids": [total]}, schema=out)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), word_ids.many(batch.column(1)), strict=True):
                ids = with_end(found, end_id)
                doc_ids.append(doc_id)
                held.append(ids)
                total += len(ids)
                if total >= file_ids:
                    yield flush()
                    doc_ids, held, total, number = [], [], 0, number + 1
        if held:
            yield flush()

    out = pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])
    return cut(map_arrow(rows, write, "file string, part int, number int, docs long, ids long"))


def file_starts(files: DataFrame) -> DataFrame:
    """(file, file_start): ids in all files before. Sums by part first, so no window holds more than parts or a part's files."""
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("part", "file", F.coalesce(F.sum("ids").over(within), F.lit(0)).alias("start"))
    return files.join(parts, "part").select("file", (F.col("start") + F.col("before")).alias("file_start"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (u32 bytes)."""
    import pyarrow as pa

    stored = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.pfor").load(_uri(folder)) if not files.isEmpty() else None
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if stored is None:
        return spark.createDataFrame([], schema)
    starts = file_starts(files)
    starts = F.broadcast(starts) if files.count() <= BROADCAST_FILES else starts
    stored = stored.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(starts, "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                doc_ids, lengths, ids = decode_file(data.as_py())
                ends = np.cumsum(lengths)
                for at in range(0, len(doc_ids), 512):
                    some = slice(at, at + 512)
                    raw = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[some], lengths[some], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[some], pa.int64()), pa.array(first + ends[some] - lengths[some], pa.int64()), pa.array(lengths[some], pa.int64()), pa.array(raw, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return map_arrow(stored.select("content", "file_start"), read, schema)


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write all texts' ids, read the files back: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit)."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    files = write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
