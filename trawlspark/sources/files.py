"""Text, JSON and dense binary files.

The dense file: counts of vectors and dimensions (u32 each), least value and scale (f64 each), all little-endian, then
one byte for each number, vector by vector.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X, vectors as V
from ..workers import map_arrow

HEADER = "<IIdd"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the lines that aren't blank; line numbers grow with the place in the file."""
    lines = spark.read.text(path, wholetext=False)
    place = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    return lines.select(place.alias("line_no"), X.trim_all(F.col("value")).alias("value")).where("value <> ''")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file, or of a folder of files, that each hold one JSON array; a missing one is an empty table."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def write_json(rows: DataFrame, path: str) -> None:
    """Files that each hold one compact JSON array of a partition's rows, a row to a line; non-ASCII characters as they are.

    ``json_rows`` reads them back. Fields that are null are written as null.
    """
    import pyarrow as pa

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            items = batch.column("value").to_pylist()
            if items:
                yield pa.RecordBatch.from_arrays([pa.array([before + items[0], *("," + x for x in items[1:])])], names=["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])

    text = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    map_arrow(text, listed, "value string").write.mode("overwrite").text(path)


def write_versioned(rows: DataFrame, path: str, *partition: str) -> None:
    """Parquet; only the partitions present in ``rows`` are replaced, so a repeated batch writes the same table."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def quantized_table(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, q), one row of vmin and scale): the quantised form, distributed."""
    found = V.limits(vectors, "embedding")
    rows = vectors.join(F.broadcast(found), how="cross")  # one row
    return rows.select("id", V.quantized(F.col("embedding"), F.col("vmin"), F.col("scale")).alias("q")), found.select("vmin", "scale")


def dense_parts(vectors: DataFrame, dim: int) -> DataFrame:
    """(part, content): the dense table as whole binary files, one for each range of ids, made on the executors."""
    import pyarrow as pa

    rows, found = quantized_table(vectors)
    limits = found.first()
    vmin, scale = float(limits["vmin"] or 0.0), float(limits["scale"] or 0.0)
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count, body = None, 0, []
        for batch in batches:
            if batch.num_rows:
                first = batch.column("id")[0].as_py() if first is None else first
                count += batch.num_rows
                body.append(batch.column("q").flatten().to_numpy().astype(np.uint8).tobytes())
        if count:
            content = struct.pack(HEADER, count, dim, vmin, scale) + b"".join(body)
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([content], pa.binary())], names=["first_id", "content"])

    return map_arrow(ordered, pack, "first_id long, content binary")


def decode_dense(content: bytes) -> np.ndarray:
    """The vectors of a dense file in single precision."""
    n, dim, vmin, scale = struct.unpack_from(HEADER, content)
    return (np.frombuffer(content, np.uint8, n * dim, struct.calcsize(HEADER)).astype(np.float64) * scale + vmin).astype(np.float32).reshape(n, dim)


def read_dense(files: DataFrame) -> DataFrame:
    """(id, embedding, norm) of dense files given as (first_id, content); ids follow the place in the file."""
    import pyarrow as pa

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column("first_id").to_pylist(), batch.column("content"), strict=True):
                found = decode_dense(content.as_py())
                for at in range(0, len(found), 4096):
                    some = found[at : at + 4096]
                    ids = pa.array(first + at + np.arange(len(some)), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(list(some), pa.list_(pa.float32()))], names=["id", "embedding"])

    rows = map_arrow(files.select("first_id", "content"), unpack, "id long, embedding array<float>")
    return rows.withColumn("norm", V.stored_norm(F.col("embedding")))


def dense_file(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, embedding, norm) of one dense file, or None where there is none, which turns the dense leg off."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return read_dense(files.select(F.lit(0).cast("long").alias("first_id"), "content"))
