"""Nearest vectors of many queries, over raw vectors or over an index of bytes that grows, in blocks of matrix products.

The index is a table of parts: ids that fall into one range of ``rows_of`` ids, their numbers as bytes with the part's own
least value and scale, and the norms of the decoded vectors. A part never changes; what is added makes new parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from ..functions.vectors import TINY
from ..sources.files import table_or_none
from ..workers import map_arrow

#: Vectors and queries of one product of matrices.
BLOCK, PACK = 8192, 256
#: Bytes of queries and of what they have found that a task holds; more queries are dealt to more columns of the grid.
SENT = 64 << 20
#: Candidates that are computed exactly at a time, and the fewest vectors that a line of the grid is made for.
EXACT, LINE = 1 << 14, 2048
PARTS = "part long, first_id long, last_id long, n int, dim int, vmin double, scale double, ids binary, content binary, norms binary"


def _vectors(column, dim: int) -> np.ndarray:
    """Vectors of an Arrow column, each cut or refused by its length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (np.isnan(lengths.astype(float)).any() or (lengths != dim).any()):
        raise ValueError(f"vectors must have {dim} numbers")
    return column.flatten().to_numpy().astype(np.float32).reshape(-1, dim)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the sum of products, added from left to right in double, as the column functions add."""
    return np.cumsum(a.astype(np.float64) * b.astype(np.float64), axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


class _Queries:
    """The queries of a task, and the first ``k`` vectors of each by similarity (ties by id) among those met so far."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.norms = np.concatenate([np.zeros(0), *(np.sqrt(_in_order(x, x)) for x in np.array_split(values, 1 + len(values) // EXACT))])
        self.units = _units(values, self.norms)
        self.sums = self.units.sum(1)
        self.found, self.names = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, norms: np.ndarray, close: Callable[[np.ndarray, np.ndarray], np.ndarray], slack: np.ndarray, decoded: Callable[[np.ndarray], np.ndarray]) -> None:
        """Put a block's vectors among the first. ``close`` gives the similarities of a pack of queries, by its units and their
        sums, right within ``slack``; vectors that can be among the first by these are computed exactly."""
        tiny = not self.norms.min(initial=np.inf) * norms.min(initial=np.inf) >= TINY
        for a in range(0, len(self.ids), PACK):
            pack = slice(a, a + PACK)
            near = close(self.units[pack], self.sums[pack])
            if tiny:
                near[self.norms[pack, None] * norms[None, :] < TINY] = 0
            least = self.found[pack, -1].astype(np.float32)
            some = ~(near + slack < least[:, None])
            many = np.flatnonzero(some.sum(1) > 4 * self.k) if len(ids) > self.k else ()
            if len(many):
                floor = np.partition(near[many] - slack, -self.k, axis=1)[:, -self.k]
                some[many] &= ~(near[many] + slack < floor[:, None])
            q, v = np.nonzero(some)
            for at in range(0, len(q), EXACT):
                self._add(a + q[at : at + EXACT], v[at : at + EXACT], ids, norms, decoded)

    def _add(self, q: np.ndarray, v: np.ndarray, ids: np.ndarray, norms: np.ndarray, decoded: Callable[[np.ndarray], np.ndarray]) -> None:
        below = self.norms[q] * norms[v]
        with np.errstate(all="ignore"):
            similarity = np.where(below < TINY, 0.0, _in_order(decoded(v), self.values[q]) / np.where(below < TINY, 1, below))
        similarity[np.isnan(similarity)] = np.inf  # not a number comes first, as in Spark, and no similarity is infinite
        better = similarity >= self.found[q, -1]
        q, similarity, names = q[better], similarity[better], ids[v[better]]
        own = np.unique(q)
        q, similarity, names = np.concatenate([np.repeat(own, self.k), q]), np.concatenate([self.found[own].ravel(), similarity]), np.concatenate([self.names[own].ravel(), names])
        order = np.lexsort((names, -similarity, q))
        begins = np.searchsorted(q[order], own)
        first = order[(begins[:, None] + np.arange(self.k)).ravel()]
        self.found[own], self.names[own] = similarity[first].reshape(-1, self.k), names[first].reshape(-1, self.k)

    def batches(self) -> Iterator:
        import pyarrow as pa

        for a in range(0, len(self.ids), PACK):
            found = self.found[a : a + PACK]
            held = found > -np.inf
            ids, similarity = np.repeat(self.ids[a : a + PACK], held.sum(1)), found[held]
            similarity[np.isinf(similarity)] = np.nan
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(self.names[a : a + PACK][held], pa.int64()), pa.array(similarity, pa.float64(), from_pandas=False)], names=["query_id", "id", "similarity"])


def _units(values: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Vectors over their norms, none where there is no norm."""
    with np.errstate(all="ignore"):
        return np.where(norms > 0, values.T / np.where(norms > 0, norms, 1), np.where(norms == 0, 0, np.nan)).T.astype(np.float32)


def _off(n: int, most: np.ndarray) -> np.ndarray:
    """How far sums of ``n`` products in single precision can be off, of units with norms of ``most``, with room to spare."""
    return ((n + 8) * 2.0**-22 * most).astype(np.float32)


def _met(vectors: DataFrame, queries: DataFrame, count: int, dim: int, use: int, k: int, block: Callable) -> DataFrame:
    """(query_id, id, similarity): the first ``k`` of ``queries`` in each line of a grid.

    ``vectors`` are dealt to the lines and ``queries`` to the columns of a grid, each cell of which is a task: it holds the
    queries of its column, of bounded size, and vectors stream past them as rows, so that neither a batch nor what is held
    grows with the tables. A query has one list for each line. ``block`` turns a batch of vectors into arguments of
    ``_Queries.meet``.
    """
    spark = vectors.sparkSession
    queries = queries.select(F.col("query_id").cast("long").alias("id"), F.col("embedding").alias("asked")).where("id IS NOT NULL AND asked IS NOT NULL")
    n, asked = int(spark.conf.get("spark.sql.shuffle.partitions")), queries.count()
    most = max(PACK, SENT // (8 * dim + 16 * k))
    columns = max(-(-asked // most), min(round((n / 2) ** 0.5), -(-asked // PACK)), 1)
    lines = max(1, min(n // columns, -(-count // LINE)))
    line, column = (F.pmod(F.xxhash64(*table.columns), F.lit(parts)).cast("int") for table, parts in ((vectors, lines), (queries, columns)))
    cell = lambda line, column: (line * columns + column).alias("cell")
    vectors = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"), line.alias("line"), "*").select(cell(F.col("line"), F.col("column")), *vectors.columns)
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"), column.alias("column"), "*").select(cell(F.col("line"), F.col("column")), "id", "asked")
    dealt = queries.unionByName(vectors, allowMissingColumns=True).repartitionById(lines * columns, F.col("cell"))

    def run(batches):
        ids, values, held = [], [], None
        for batch in batches:
            first = batch.column("asked").is_valid().to_numpy(zero_copy_only=False)
            if first.any():  # queries come before vectors
                some = batch.filter(batch.column("asked").is_valid())
                ids.append(some.column("id").to_numpy())
                values.append(_vectors(some.column("asked"), dim)[:, :use])
            if not first.all() and ids:
                held = held or _Queries(np.concatenate(ids), np.concatenate(values), k)
                some = batch.filter(batch.column("asked").is_null())
                for at in range(0, some.num_rows, BLOCK):
                    held.meet(*block(some.slice(at, BLOCK)))
        if held:
            yield from held.batches()

    dealt = dealt.sortWithinPartitions(F.col("asked").isNull()).drop("cell")
    return map_arrow(dealt, run, "query_id long, id long, similarity double")


def _ranked(legs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return legs.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= k)


def dense_topk_batch(vectors: DataFrame, queries: DataFrame, dim: int, k: int, use: int | None = None) -> DataFrame:
    """(query_id, id, similarity, dense_rank): for each of ``queries`` (query_id, embedding) the first ``k`` of ``vectors``
    (id, embedding) by cosine over the first ``use`` numbers (all, if not given); ties by id.

    Blocks of vectors meet packs of queries in products in single precision, after which the few that can be
    among the first are added up in order, so that ranks are those of ``search.dense_topk``. Norms are in single precision
    over all numbers, in double over some. Rows with a null id or vector are left out, vectors of another length refused.
    """
    use = use or dim

    def block(batch):
        own = _vectors(batch.column("embedding"), dim)[:, :use]
        norms = np.sqrt(_in_order(own, own))
        stored = norms.astype(np.float32).astype(np.float64) if use == dim else norms
        units = _units(own, stored)
        with np.errstate(all="ignore"):
            slack = _off(use, np.maximum(1, np.where(stored > 0, norms / stored, 1)))
        return batch.column("id").to_numpy(), stored, lambda asked, sums: asked @ units.T, slack, lambda some: own[some]

    rows = vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("id IS NOT NULL AND embedding IS NOT NULL")
    return _ranked(_met(rows, queries, vectors.count(), dim, use, k, block), k)


def index_parts(vectors: DataFrame, dim: int, rows_of: int) -> DataFrame:
    """The parts of ``vectors`` (id, embedding): one for each range of ``rows_of`` ids that has any.

    Numbers are clipped and rounded half to even as in the dense file; a part of one value is all zero. Of rows that share an
    id the one with the least vector counts. Null ids and vectors are left out, vectors of another length refused.
    """
    import pyarrow as pa

    once = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("embedding").alias("embedding"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("id") / F.lit(rows_of))
    dealt = once.withColumn("part", part).repartition(n, "part").sortWithinPartitions("part", "id").select("part", "id", "embedding")

    def packed(part: int, ids: list[np.ndarray], values: list[np.ndarray]):
        ids, values = np.concatenate(ids).astype("<i8"), np.concatenate(values)
        vmin = float(values.min())
        scale = (float(values.max()) - vmin) / 255.0
        levels = np.zeros(values.shape, np.uint8) if scale == 0 else np.clip(np.rint((values.astype(np.float64) - vmin) / scale), 0, 255).astype(np.uint8)
        norms = np.sqrt(_in_order(d := decoded(levels, vmin, scale), d)).astype("<f4")
        row = [part, int(ids[0]), int(ids[-1]), len(ids), dim, vmin, scale, ids.tobytes(), levels.tobytes(), norms.tobytes()]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.float64()] * 2 + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=[c.split()[0] for c in PARTS.split(", ")])

    def run(batches):
        now, ids, values = None, [], []
        for batch in batches:
            parts, own, matrix = batch.column("part").to_numpy(), batch.column("id").to_numpy(), _vectors(batch.column("embedding"), dim)
            cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])[: len(parts)])
            for a, b in zip(cuts, [*cuts[1:], len(parts)], strict=True):
                if ids and parts[a] != now:
                    yield packed(now, ids, values)
                    ids, values = [], []
                now = int(parts[a])
                ids.append(own[a:b])
                values.append(matrix[a:b])
        if ids:
            yield packed(now, ids, values)

    return map_arrow(dealt, run, PARTS)


def decoded(levels: np.ndarray, vmin: float, scale: float) -> np.ndarray:
    return (levels.astype(np.float64) * scale + vmin).astype(np.float32)


def read_parts(parts: DataFrame) -> DataFrame:
    """(id, embedding, norm, scale) of parts, each decoded by its own least value and scale."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                values = decoded(np.frombuffer(r["content"], np.uint8).reshape(r["n"], r["dim"]), r["vmin"], r["scale"])
                columns = pa.array(np.frombuffer(r["ids"], "<i8")), pa.array(list(values), pa.list_(pa.float32())), pa.array(np.frombuffer(r["norms"], "<f4")), pa.array(np.full(r["n"], r["scale"]))
                yield pa.RecordBatch.from_arrays(list(columns), names=["id", "embedding", "norm", "scale"])

    return map_arrow(parts, run, "id long, embedding array<float>, norm float, scale double")


def grow_index(spark: SparkSession, path: str, vectors: DataFrame, dim: int, rows_of: int) -> None:
    """Add the vectors whose ids the index at ``path`` lacks, as new parts; the parts that are there stay as they are.

    Each part is as exact as its own range of values allows: no number is off by more than half its part's scale, whatever
    is added later. A range of ids that is added to in several steps has several parts. An interrupted addition has written
    nothing, and is repeated.
    """
    have = table_or_none(spark, path)
    if have is not None:
        vectors = vectors.join(part_ids(have), "id", "left_anti")
    index_parts(vectors, dim, rows_of).write.mode("append").parquet(path)


def part_ids(parts: DataFrame) -> DataFrame:
    """(id): the ids of parts."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8"))], names=["id"])

    return map_arrow(parts.select("ids"), run, "id long")


def parts_within(parts: DataFrame, first_id: int | None, last_id: int | None) -> DataFrame:
    """The parts that can have ids within bounds; the others' row groups are skipped by the scan."""
    if first_id is not None:
        parts = parts.where(F.col("last_id") >= first_id)
    return parts if last_id is None else parts.where(F.col("first_id") <= last_id)


def index_topk_batch(parts: DataFrame, queries: DataFrame, dim: int, k: int, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """``dense_topk_batch`` over the parts of an index, with the ranks of the decoded vectors.

    Products are taken with the bytes: of a query q and bytes b it is scale * (q . b) + least value * sum(q). The stored
    norms go under it; only those that can be among the first are decoded. ``first_id`` and ``last_id`` bound the ids, and
    parts outside are not read.
    """
    import pyarrow as pa

    def opened(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                ids, levels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["content"], np.uint8).reshape(r["n"], r["dim"])
                if len(levels) and r["dim"] != dim:
                    raise ValueError(f"vectors must have {dim} numbers")
                inside = (ids >= (ids[0] if first_id is None else first_id)) & (ids <= (ids[-1] if last_id is None else last_id))
                norms, levels = np.frombuffer(r["norms"], "<f4")[inside], np.ascontiguousarray(levels[inside])
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(levels), [None, pa.py_buffer(levels)]).cast(pa.binary())
                columns = [pa.array(ids[inside]), raw, pa.array(norms), *(pa.array(np.full(len(levels), r[x])) for x in ("vmin", "scale"))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "levels", "norm", "vmin", "scale"])

    def block(batch):
        levels = np.frombuffer(b"".join(batch.column("levels").to_pylist()), np.uint8).reshape(-1, dim)
        norms, vmin, scale = (batch.column(c).to_numpy().astype(np.float64) for c in ("norm", "vmin", "scale"))
        below = np.where(norms > 0, norms, 1)
        wide, times, plus = levels.astype(np.float32).T, (scale / below).astype(np.float32), (vmin / below).astype(np.float32)
        # a query's numbers add up to no more than the root of their count; decoding rounds to single precision
        slack = _off(dim, dim**0.5 * (np.abs(vmin) + 255 * scale) / below)
        close = lambda asked, sums: (asked @ wide) * times + sums[:, None] * plus
        return batch.column("id").to_numpy(), norms, close, slack, lambda some: (levels[some].astype(np.float64) * scale[some, None] + vmin[some, None]).astype(np.float32)

    parts = parts_within(parts, first_id, last_id)
    rows = map_arrow(parts.select("n", "dim", "vmin", "scale", "ids", "content", "norms"), opened, "id long, levels binary, norm float, vmin double, scale double")
    return _ranked(_met(rows, queries, parts.agg(F.sum("n")).first()[0] or 0, dim, dim, k, block), k)
