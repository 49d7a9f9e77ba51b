"""State that lies where merges need it: a table in slices of users, bucketed by pair, of which a merge replaces slices only.

A slice is a partition: one user's rows are in one slice. In a slice pairs are spread over buckets, a user's too, so that
merging by pair needs no shuffle of the state and a user with many rows is no task of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import checkpoint_dir, remove
from .state import KEY

#: Slices of a table, and buckets of a slice. They are properties of a table and stay as it was made.
SLICES, BUCKETS = 64, 8
COLUMNS = [*KEY, "used", "ts", "event_id"]


def _slice(slices: int):
    return F.pmod(F.xxhash64("user_id"), F.lit(slices)).cast("int")


def create(spark: SparkSession, name: str, slices: int = SLICES, buckets: int = BUCKETS) -> None:
    """An empty table ``name`` of the last toggle of each (user_id, passage_id): used, ts, event_id."""
    spark.sql(
        f"CREATE TABLE {name} (user_id STRING, passage_id STRING, used BOOLEAN, ts TIMESTAMP, event_id LONG, slice INT) USING parquet "
        f"PARTITIONED BY (slice) CLUSTERED BY (user_id, passage_id) INTO {buckets} BUCKETS TBLPROPERTIES ('slices' = '{slices}')"
    )


def _slices(spark: SparkSession, name: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {name}('slices')").first()["value"])


def last_toggles(log: DataFrame) -> DataFrame:
    """The last toggle of each (user_id, passage_id) by time and number."""
    last = F.max_by(F.struct("used", "ts", "event_id"), F.struct("ts", "event_id")).alias("last")
    return log.groupBy(*KEY).agg(last).select(*KEY, "last.used", "last.ts", "last.event_id")


def merged(spark: SparkSession, name: str, log: DataFrame) -> tuple[DataFrame, list[int]]:
    """The slices that ``log`` touches as they are after it, and their numbers, of which there are a fixed few.

    A toggle replaces an earlier one of its pair. The state's side is read in its buckets and isn't shuffled: only the log is
    dealt out to them.
    """
    new = last_toggles(log).withColumn("slice", _slice(_slices(spark, name)))
    touched = [r[0] for r in new.select("slice").distinct().collect()]
    old = spark.table(name).where(F.col("slice").isin(touched))
    both = old.alias("o").join(new.alias("n"), KEY, "full")
    later = F.col("o.ts").isNull() | (F.struct("n.ts", "n.event_id") > F.struct("o.ts", "o.event_id"))
    pick = lambda c: F.when(F.col("n.ts").isNotNull() & later, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*KEY, pick("used"), pick("ts"), pick("event_id"), F.coalesce("n.slice", "o.slice").alias("slice")), touched


def merge(spark: SparkSession, name: str, log: DataFrame) -> list[int]:
    """Merge a log of toggles (user_id, passage_id, used, ts, event_id) into the table; returns the slices that were replaced.

    What they will hold is written to the shared folder first, as a table can't be read and overwritten at once. Slices are written beside the old ones and put in their place when the job is done, so a merge that fails changes nothing,
    and one that is repeated changes nothing more. Rows with a null user, passage or time are left out.
    """
    good = log.select(*COLUMNS).where("user_id IS NOT NULL AND passage_id IS NOT NULL AND ts IS NOT NULL")
    rows, touched = merged(spark, name, good)
    if touched:
        folder = f"{checkpoint_dir(spark)}/merge-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        own = spark.newSession()  # whose setting makes an overwrite replace the partitions that are written, and no others
        own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        own.read.parquet(folder).write.insertInto(name, overwrite=True)
        remove(spark, folder)
        spark.catalog.refreshTable(name)
    return touched


def state(spark: SparkSession, name: str) -> DataFrame:
    """(user_id, passage_id, used_at) of the pairs that are on."""
    return spark.table(name).where("used").select(*KEY, F.col("ts").alias("used_at"))
