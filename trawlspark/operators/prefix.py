"""Running totals and maxima inside groups of any length, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..storage import cut

_FOLDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest)}


def before(rows: DataFrame, within: Sequence[str], order: Sequence[str], folds: Mapping[str, tuple[str, Column]], totals: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """``rows`` with a column for each of ``folds``: the sum or the maximum, as named, of a column over all earlier rows of the
    group ``within``, in ``order``; a sum over none is 0, a maximum is null. ``totals`` are the same over the whole group.

    Rows are range-sorted by group and order, so a long group lies in many ranges. Each range folds its own rows; what lies
    before is one small row for each range of a group, of which a group has no more than there are shuffle partitions.
    A null in ``within`` is a group. Rows that share their place in ``order`` are taken in no certain order.
    """
    folds, totals = dict(folds), dict(totals or {})
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row's range must not change between its own fold and that of its range
    ranged = cut(rows.repartitionByRange(n, *within, *order).withColumn("_range", F.spark_partition_id()))
    key = [*within, "_range"]
    every = {**folds, **totals}
    parts = ranged.groupBy(*key).agg(*[_FOLDS[kind][0](column).alias(f"_{name}") for name, (kind, column) in every.items()])
    whole, earlier = W.partitionBy(*within), W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)],
        *[_FOLDS[kind][0](f"_{name}").over(earlier).alias(f"_{name}") for name, (kind, _) in folds.items()],
        *[_FOLDS[kind][0](f"_{name}").over(whole).alias(name) for name, (kind, _) in totals.items()],
    )
    local = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = ranged.select("*", *[_FOLDS[kind][0](column).over(local).alias(f"_own_{name}") for name, (kind, column) in folds.items()])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)])
    found = {name: _FOLDS[kind][1](F.col(f"_own_{name}"), F.col(f"_{name}")) for name, (kind, _) in folds.items()}
    return own.join(offsets, on).select(*rows.columns, *[c.alias(name) for name, c in found.items()], *totals)
