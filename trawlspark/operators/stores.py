"""Where a user's state is kept: with the user, or in the table of accounts. Both answer the same calls."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import MAX_IDS
from ..storage import cut
from . import state as U


class Store(Protocol):
    def pick(self, catalogue: DataFrame, seed: str) -> dict | None: ...

    def mark(self, catalogue: DataFrame, passage_id: str, used: bool) -> None: ...


class LocalStore:
    """State of a user without an account: a list of ids; ids that the catalogue lacks don't count."""

    def __init__(self, spark: SparkSession, ids: list[str] | None = None):
        self.spark, self.ids = spark, list(ids or [])

    def _used(self, catalogue: DataFrame) -> DataFrame:
        if len(self.ids) > MAX_IDS:
            raise ValueError(f"more than {MAX_IDS} ids")
        own = self.spark.createDataFrame([("local", i) for i in dict.fromkeys(self.ids)], "user_id string, passage_id string")
        return U.valid(own, catalogue)

    def pick(self, catalogue: DataFrame, seed: str) -> dict | None:
        """One passage with its counters; None if there is no catalogue. A reset empties the list."""
        picked = _pick(catalogue, self._used(catalogue), "local", seed)
        if picked and picked["was_reset"]:
            self.ids = []
        return picked

    def mark(self, catalogue: DataFrame, passage_id: str, used: bool) -> None:
        self.ids = [i for i in self.ids if i != passage_id] + ([passage_id] if used else [])

    def is_used(self, passage_id: str) -> bool:
        return passage_id in self.ids


class AccountStore:
    """State of a user with an account: rows of the shared table, of which only the user's own are seen and changed.

    Each change gives the next version of the table in ``rows``.
    """

    def __init__(self, rows: DataFrame, user_id: str):
        self.rows, self.user_id = rows, user_id

    def _own(self) -> DataFrame:
        return U.user_view(self.rows, F.lit(self.user_id))

    def _others(self) -> DataFrame:
        return self.rows.where(~F.col("user_id").eqNullSafe(F.lit(self.user_id)))

    def pick(self, catalogue: DataFrame, seed: str) -> dict | None:
        picked = _pick(catalogue, self._own().select(*U.KEY), self.user_id, seed)
        if picked and picked["was_reset"]:
            self.rows = self._others()
        return picked

    def mark(self, catalogue: DataFrame, passage_id: str, used: bool, at: datetime | None = None) -> None:
        """Idempotent; an id that the catalogue lacks is refused."""
        if catalogue.where(F.col("passage_id") == passage_id).isEmpty():
            raise ValueError("no such passage")
        spark = self.rows.sparkSession
        mark = spark.createDataFrame([(self.user_id, passage_id)], "user_id string, passage_id string").withColumn("used_at", F.lit(at).cast("timestamp") if at else F.current_timestamp())
        self.rows = U.upsert(self.rows, mark) if used else U.unmark(self.rows, mark)

    def migrate(self, local: LocalStore, catalogue: DataFrame, write: Callable[[DataFrame], None], at: datetime | None = None) -> int:
        """Take over a local list on signing in: valid new ids are given to ``write`` and counted.

        The list is emptied only once ``write`` has returned; if it fails, list and table are as before. The rows that are
        written are those that are counted and added, with one time.
        """
        if not local.ids:
            return 0
        if len(local.ids) > MAX_IDS:
            raise ValueError(f"more than {MAX_IDS} ids")
        ids = self.rows.sparkSession.createDataFrame([(self.user_id, i) for i in local.ids], "user_id string, passage_id string")
        fresh = cut(U.insert_ignore(self._own(), ids, catalogue).select(*U.KEY, F.lit(at or datetime.now()).cast("timestamp").alias("used_at")))
        n = fresh.count()
        write(fresh)
        self.rows = self.rows.select(*U.KEY, "used_at").unionByName(fresh)
        local.ids = []
        return n


def _pick(catalogue: DataFrame, used: DataFrame, user_id: str, seed: str) -> dict | None:
    """``state.pick`` for one user, who may have used nothing yet."""
    user = catalogue.sparkSession.range(1).select(F.lit(user_id).alias("user_id"))
    one = U.pick(user, catalogue, used, seed).first()
    return one and {c: one[c] for c in ("passage_id", "total_passages", "used_count", "was_reset")} | {"is_used": False}
