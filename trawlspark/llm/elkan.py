"""Clusters of vectors of whole numbers by Lloyd's rounds, with Elkan's bounds to leave out distances, exact in every bit."""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import checkpoint_dir, remove
from ..workers import map_arrow

#: Components up to so large are taken: the squared distances of 64 of them fit 64 bits.
LARGEST = 1 << 27
#: Vectors whose distances are computed together.
TOGETHER = 4096


class Clusters(NamedTuple):
    """``assigned``: the vectors' columns with cluster and distance; ``centroids`` by number."""

    assigned: DataFrame
    centroids: list[list[int]]


def whole_vectors(df: DataFrame, column: str, dim: int, scale: int) -> DataFrame:
    """``df`` with ``x``: floor(scale * component) of vectors of ``dim`` components, none null or not finite; others go."""
    v = F.col(column)
    good = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(good).withColumn("x", F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _up(x: np.ndarray) -> np.ndarray:
    """At least the true value, after a square root or a sum that is rounded."""
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def _squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def assigned_first(x: np.ndarray, centroids: np.ndarray):
    """(cluster, squared distance, upper, lower) with every distance computed."""
    squared = np.stack([_squared(x, c) for c in centroids], 1)
    nearest = squared.argmin(1)  # the smaller number of equal ones
    own = squared[np.arange(len(x)), nearest]
    return nearest, own, _up(np.sqrt(own)), _down(np.sqrt(squared))


def assigned_again(x: np.ndarray, centroids: np.ndarray, moved: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """(cluster, upper, lower, distances computed) after the centroids moved by ``moved`` at most.

    ``upper`` is not below a vector's distance to its own centroid, ``lower`` not above those to all centroids. A centroid
    is left out only where it is farther for certain: where equal distances are possible, they are computed as integers.
    """
    cluster, lower = cluster.copy(), _down(lower - moved)
    upper = _up(upper + moved[cluster])
    half = np.stack([_down(np.sqrt(_squared(centroids, c))) / 2 for c in centroids])
    np.fill_diagonal(half, np.inf)
    near = half.min(1)
    todo = np.flatnonzero(upper >= near[cluster])
    own = np.zeros(len(todo), np.int64)
    for c in range(len(centroids)):
        mine = cluster[todo] == c
        own[mine] = _squared(x[todo[mine]], centroids[c])
    lower[todo, cluster[todo]], upper[todo] = _down(np.sqrt(own)), _up(np.sqrt(own))
    computed = len(todo)
    some = upper[todo] >= near[cluster[todo]]
    todo, own = todo[some], own[some]
    for c in range(len(centroids)):
        a = cluster[todo]
        at = np.flatnonzero((a != c) & (upper[todo] >= lower[todo, c]) & (upper[todo] >= half[a, c]))
        if len(at):
            squared = _squared(x[todo[at]], centroids[c])
            computed += len(at)
            lower[todo[at], c] = _down(np.sqrt(squared))
            wins = (squared < own[at]) | (squared == own[at]) & (c < a[at])
            at, squared = at[wins], squared[wins]
            own[at], cluster[todo[at]], upper[todo[at]] = squared, c, _up(np.sqrt(squared))
    return cluster, upper, lower, computed


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _assign(rows: DataFrame, centroids: list[list[int]], moved: list[float] | None) -> DataFrame:
    """``rows`` (x and more) with cluster, upper, lower as of these centroids; they are few and go with the tasks' code."""
    import pyarrow as pa

    held = np.array(centroids, np.int64)
    k, dim = held.shape
    names = [c for c in rows.columns if c not in ("cluster", "upper", "lower")]
    schema = rows.select(*names, F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.array().cast("array<double>").alias("lower")).schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                x = _matrix(some.column("x"), dim)
                if abs(x).max() > LARGEST:
                    raise ValueError(f"a component beyond {LARGEST}: squared distances would not fit 64 bits")
                if moved is None:
                    cluster, _, upper, lower = assigned_first(x, held)
                else:
                    state = some.column("cluster").to_numpy(), some.column("upper").to_numpy(), _matrix(some.column("lower"), k)
                    cluster, upper, lower, _ = assigned_again(x, held, np.array(moved), *state)
                bounds = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(cluster.astype(np.int32)), pa.array(upper), bounds], names=schema.names)

    return map_arrow(rows, run, schema)


def _distances(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``rows`` without bounds, with the exact squared distance to the own centroid."""
    import pyarrow as pa

    held = np.array(centroids, np.int64)
    names = [c for c in rows.columns if c not in ("x", "upper", "lower")]
    schema = rows.select(*names, F.lit(0).cast("long").alias("distance")).schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                found = _squared(_matrix(some.column("x"), held.shape[1]), held[some.column("cluster").to_numpy()])
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(found)], names=schema.names)

    return map_arrow(rows, run, schema)


def clustered(vectors: DataFrame, dim: int, k: int, rounds: int, order: Column) -> Clusters:
    """Clusters of ``vectors`` (x: ``dim`` whole numbers, and columns that stay).

    Centroids 0, 1, ... start as the first ``k`` vectors in ``order``, fewer if there are fewer; equal places in it go by the
    components. A round gives every vector the nearest centroid (ties: the smaller number) and moves each centroid that has
    vectors to the floor of their mean; after ``rounds`` of them vectors are assigned once more.

    Each round reads the vectors with their bounds and writes them to a table in the shared folder, which the next one
    reads, so a lost executor costs its tasks only. Only the k centroids and sums of k clusters pass through the driver. A
    round that moves no centroid is the last, as all others would do the same.
    """
    spark = vectors.sparkSession
    first = vectors.select("x", order.alias("o")).orderBy("o", "x").limit(k).collect()
    centroids = [list(r["x"]) for r in first]
    if not centroids:
        none = vectors.drop("x").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
        return Clusters(none, [])
    folder, state, moved = f"{checkpoint_dir(spark)}/clusters-{uuid.uuid4().hex}", vectors, None
    for n in range(rounds + 1):
        _assign(state, centroids, moved).write.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
        state = spark.read.parquet(f"{folder}/{n}")
        if n == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dim)]).collect()
        before, centroids = centroids, [list(c) for c in centroids]
        for row in sums:
            centroids[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dim)]
        if centroids == before:
            break
        squared = np.array([sum((a - b) ** 2 for a, b in zip(c, d, strict=True)) for c, d in zip(before, centroids, strict=True)], float)
        moved = _up(np.sqrt(squared)).tolist()
    return Clusters(_distances(state, centroids), centroids)


def cluster_digest(vectors: DataFrame, dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors`` (vec_id, embedding).

    The first centroids are the vectors with the smallest sha256 of ``seed:vec_id``, a null id being empty there; rows that
    share an id are vectors of their own, and so are equal vectors. A null vector, one of another length and one with a
    component that is null or not finite have no row. Other columns are left out, whatever their names. An empty table, or
    one without such vectors, gives no rows.
    """
    rows = whole_vectors(vectors.select("vec_id", "embedding"), "embedding", dim, scale).select("vec_id", "x")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = clustered(rows, dim, k, rounds, order)
    sums = dict(found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    own = F.array(*[F.lit(int(sums.get(c, 0))).cast("long") for c in range(len(found.centroids))])
    names = F.array(*[F.sha2(F.lit(",".join(map(str, c))).cast("binary"), 256) for c in found.centroids])
    total = F.lit(sum(map(int, sums.values()))).cast("long")
    if not found.centroids:
        return found.assigned.select("vec_id", "cluster", "distance", *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    return found.assigned.select("vec_id", "cluster", "distance", F.get(own, "cluster").alias("cluster_inertia"), total.alias("inertia"), F.get(names, "cluster").alias("centroid_sha256"))
