"""Small building blocks that several operators of this package use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from ..storage import checkpoint_dir, cut

__all__ = ["WORD", "as_bytes", "checkpoint_dir", "cut", "n_words", "numbered", "running", "shuffle_partitions"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, within: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """Exclusive running totals of columns, in ``order`` inside each group of ``within``, without one task per group.

    The rows are range-sorted by group and order, so a group of any size spreads over many ranges. Each range sums its
    own rows; a total of a row is what earlier ranges of its group hold plus what precedes it in its range.
    ``totals`` maps each new column to the column that it sums. Order columns must hold no nulls.
    """
    ranges = shuffle_partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(ranges, *within, *order).withColumn("_range", F.spark_partition_id()))
    key = [*within, "_range"]
    sums = ranged.groupBy(*key).agg(*[F.sum(v).alias(k) for k, v in totals.items()])
    earlier = W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*key, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in totals])
    before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(k) for k, v in totals.items()])
    joined = local.join(offsets, key)
    return joined.select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in totals])


def numbered(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``distinct`` with an integer ``name`` from 0 that rises with its keys; integers are unique, with gaps between ranges.

    The rows are range-sorted and each is named by its range and its place there, so no task holds more than a range and
    no totals are needed.
    """
    ranged = distinct.repartitionByRange(shuffle_partitions(distinct.sparkSession), *keys).sortWithinPartitions(*keys)
    return cut(ranged.withColumn(name, F.monotonically_increasing_id()))


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
