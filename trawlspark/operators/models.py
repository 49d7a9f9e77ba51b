"""Calls of models from outside: batches on the executors, and builds that continue where they stopped."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.files import table_or_none
from ..storage import checkpoint_dir, remove
from ..workers import map_arrow
from .corpus import numbered

BATCH = 100
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class OutOfQuota(RuntimeError):
    """A model refuses for good; a build stops and continues later from what is done."""


class Busy(RuntimeError):
    """A model asks to wait."""


class Lease(NamedTuple):
    """Leave to call a model, for a whole build: ``calls`` of it (None: as many as it takes), no more than one in
    ``interval_s`` seconds, made by ``lanes`` tasks."""

    calls: int | None = None
    interval_s: float = 0.0
    lanes: int = 8


def leased(rows: DataFrame, key: str, batch: int, lease: Lease) -> DataFrame:
    """``rows`` that may be asked for, with _slot, the number of their call: ``batch`` rows of the order of ``key`` to a call.

    Slots are given out before the first call, so the number of calls doesn't depend on the number of tasks. They go to lanes
    in turn, and a lane is a partition; a lane waits its share of the interval before its first call, and ``lanes`` intervals
    from one call to the next. So in any time t there are no more than t / interval + lanes calls, whichever lanes run at once,
    without clocks that agree. A lane that is run again after a lost executor makes its calls again.
    """
    slot = F.floor(F.col("_place") / F.lit(batch)).cast("long")
    placed = numbered(rows, [key], "_place").withColumn("_slot", slot)
    if lease.calls is not None:
        placed = placed.where(F.col("_slot") < lease.calls)
    lane = F.pmod("_slot", F.lit(lease.lanes)).cast("int")
    return placed.repartitionById(lease.lanes, lane).sortWithinPartitions("_slot", "_place").drop("_place")


def _calls(batches, key: str, content: str, batch: int, lease: Lease | None, sleep: Callable[[float], None] | None = None) -> Iterator[tuple[list, list]]:
    """(keys, contents) of one call after the other; with a lease, at its time."""
    import time

    wait, last = sleep or time.sleep, None
    if lease is None:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                yield part.column(key).slice(at, batch).to_pylist(), part.column(content).slice(at, batch).to_pylist()
        return
    slot, keys, contents = None, [], []

    def turn() -> None:
        nonlocal last
        now = time.monotonic()
        if lease.interval_s:
            due = now + slot % lease.lanes * lease.interval_s if last is None else last + lease.lanes * lease.interval_s
            if due > now:
                wait(due - now)
        last = time.monotonic()

    for part in batches:
        for s, k, c in zip(*(part.column(x).to_pylist() for x in ("_slot", key, content)), strict=True):
            if keys and s != slot:
                turn()
                yield keys, contents
                keys, contents = [], []
            slot = s
            keys.append(k)
            contents.append(c)
    if keys:
        turn()
        yield keys, contents


def embedded(rows: DataFrame, model: Embedder, batch: int = BATCH, retry: Callable[[Callable], Callable] | None = None, lease: Lease | None = None) -> DataFrame:
    """(id, embedding) for rows (id, text), ``batch`` texts to a call, each call with ``retry`` (``with_retries``), under a
    ``lease`` if there is one.

    Rows beyond the lease have no row. Once a model is out of quota, a task calls it no more: the rows that it has are kept,
    the others have no row.
    """
    import pyarrow as pa

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = (retry or with_retries)(model)
        for ids, texts in _calls(batches, "id", "text", batch, lease):
            try:
                vectors = ask([t or "" for t in texts])
            except OutOfQuota:
                break
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])
        for _ in batches:  # read to the end
            pass

    rows = rows.select(F.col("id").cast("long").alias("id"), "text")
    return map_arrow(leased(rows, "id", batch, lease) if lease else rows, call, "id long, embedding array<float>")


def embed_pending(rows: DataFrame, done: DataFrame, model: Embedder, retry: Callable[[Callable], Callable] | None = None) -> DataFrame:
    """``done`` (id, embedding) with the rows that it lacks. What is done follows from the output, so it can't disagree."""
    todo = rows.join(done.select("id"), "id", "left_anti")
    return done.select("id", "embedding").unionByName(embedded(todo, model, retry=retry))


class Progress(NamedTuple):
    done: int
    left: int


def build(spark: SparkSession, path: str, key: str, rows: DataFrame, ask: Callable[[DataFrame], DataFrame], steps: int = 10, restart: bool = False) -> Progress:
    """Add to the table at ``path`` what ``ask`` gives for the rows whose ``key`` it lacks, in ``steps`` parts.

    Each part is written before the next begins, so a lost driver or a quota that ends costs one part at most, and what a
    part got before its quota ended is written too; a part that brings nothing new ends the build. Calling it again
    continues; ``restart`` begins anew. The table itself says what is done. ``rows`` are read once, what is to do is dealt into
    its parts in the shared folder. A null key is a key like any other.
    """
    if restart:
        remove(spark, path)
    total = rows.select(key).distinct().count()
    done = table_or_none(spark, path)
    if done is not None:
        had = done.select(F.col(key).alias("_had")).distinct()
        rows = rows.join(had, F.col(key).eqNullSafe(F.col("_had")), "left_anti")
    folder = f"{checkpoint_dir(spark)}/todo-{uuid.uuid4().hex}"
    dealt = rows.withColumn("_step", F.pmod(F.xxhash64(key), F.lit(steps)).cast("int"))
    dealt.write.partitionBy("_step").parquet(folder)
    todo, before = spark.read.schema(dealt.schema).parquet(folder), done.count() if done is not None else 0
    for step in range(steps):
        part = todo.where(F.col("_step") == step).drop("_step")
        if part.isEmpty():
            continue
        ask(part).write.mode("append").parquet(path)
        now = table_or_none(spark, path).count()
        if now == before:
            break
        before = now
    remove(spark, folder)
    done = table_or_none(spark, path)
    n = done.select(key).distinct().count() if done is not None else 0
    return Progress(n, total - n)


def sparse_weights(weights: Column, least: float = 0.01) -> Column:
    """Entries above ``least``, rounded to four places."""
    return F.transform_values(F.map_filter(weights, lambda _, v: v > least), lambda _, v: F.round(v, 4))


def encoded_reply(dense: Column, sparse: Column, dim: int) -> Column:
    """An encoder's answer: the first ``dim`` numbers, and the weights that count."""
    return F.struct(F.slice(dense, 1, dim).alias("dense"), sparse_weights(sparse).alias("sparse"))


def with_retries(model: Callable, tries: int = 6, busy_s: float = 15.0, error_s: float = 5.0, sleep: Callable[[float], None] | None = None) -> Callable:
    """``model`` called again after a wait: twice as long each time it is busy, a little longer after each other error.

    ``OutOfQuota`` passes at once; the last error passes when the tries are used up.
    """
    import time

    wait = sleep or time.sleep

    def call(*arguments):
        for n in range(tries):
            try:
                return model(*arguments)
            except OutOfQuota:
                raise
            except Busy:
                if n == tries - 1:
                    raise
                wait(busy_s * 2**n)
            except Exception:
                if n == tries - 1:
                    raise
                wait(error_s * (n + 1))
        raise ValueError("tries must be positive")

    return call


def attempt(model: Callable | None, *arguments, seconds: float) -> Callable:
    """Starts ``model`` at once; the returned call waits for its answer up to ``seconds`` from the start.

    The answer is None if there is no model, if it raises, or if it takes longer: a search goes on without it.
    """
    import time

    answer, began = [], time.monotonic()

    def run() -> None:
        try:
            answer.append(model(*arguments))
        except Exception:  # noqa: BLE001  any failure of a model counts as no answer
            answer.append(None)

    thread = threading.Thread(target=run, daemon=True)
    if model is not None:
        thread.start()

    def wait():
        if model is not None:
            thread.join(max(0.0, seconds - (time.monotonic() - began)))
        return answer[0] if answer else None

    return wait


class Lazy:
    """A model that is loaded by the process that first calls it, once: workers load it, the driver does not."""

    def __init__(self, load: Callable[[], Callable]):
        self.load, self.model = load, None

    def __call__(self, *arguments):
        if self.model is None:
            self.model = self.load()
        return self.model(*arguments)

    def __getstate__(self):
        return {"load": self.load, "model": None}

    @property
    def ready(self) -> bool:
        return self.model is not None


def replied(rows: DataFrame, model: Callable[[str], str | None], out: str = "reply", retry: Callable[[Callable], Callable] | None = None, lease: Lease | None = None) -> DataFrame:
    """``rows`` (key, prompt) with the reply of a text model to each prompt, null where it gives none or fails; a prompt is a
    call of the ``lease``, if there is one.

    Once the model is out of quota, a task asks no more. What wasn't asked for has no row.
    """
    import pyarrow as pa

    keys = rows.select("key").schema[0]
    schema = rows.select("key").withColumn(out, F.lit(None).cast("string")).schema

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, kind = (retry or with_retries)(model), None
        for key, prompt in _calls(batches, "key", "prompt", 1, lease):
            try:
                text = ask(prompt[0] or "")
            except OutOfQuota:
                break
            except Exception:  # noqa: BLE001  a prompt that fails for good has no reply, the others have
                text = None
            kind = kind or to_arrow_type(keys.dataType)
            yield pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array([text], pa.string())], names=["key", out])
        for _ in batches:
            pass

    rows = rows.select("key", "prompt")
    return map_arrow(leased(rows, "key", 1, lease) if lease else rows, call, schema)
