"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are range-sorted by key and a distributed prefix
sum of their sizes is formed; the source is cut at the exact word at which its budget ends. A budget above the source's
size repeats the whole source first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from .shared import WORD, cut, n_words, running

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets for one row per source: ``sizes`` has source and source_size; adds weight and target (double).

    Sources are ordered by code point, null last, and take the weights in turn. They share ``share`` times the sum of
    all sizes by weight; a target stops at ``most`` times its source's size and the excess goes to the others by weight
    until none is above. Written as one pass: with sources sorted by the level at which they fill up, a source is full
    if its part of what the earlier ones leave is above its stop. The windows run over sources, not documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((rank - 1) % len(weights)) + 1)
    ranked = sizes.select("source", "source_size", rank.alias("rank"), turn.cast("double").alias("weight"))
    ranked = ranked.withColumn("stop", F.col("source_size").cast("double") * F.lit(float(most)))
    whole = W.partitionBy()
    filled = W.orderBy(F.col("stop") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        (F.sum(F.col("source_size")).over(whole).cast("double") * F.lit(float(share))).alias("budget"),
        F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("stop").over(filled), F.lit(0.0)).alias("stops_before"),
        F.coalesce(F.sum("weight").over(filled), F.lit(0.0)).alias("weights_before"),
    )
    level = (F.col("budget") - F.col("stops_before")) / (F.col("weights") - F.col("weights_before"))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("stop"))
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("stop") / F.col("weight"), F.col("rank"), F.col("level")))).over(whole)
    target = F.when(F.col("full"), F.col("stop")).otherwise(shared["level"] * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, epochs, part, taken.

    ``size`` is the number of words (null text: 0). The mix takes the document ``epochs`` whole times and ``part`` more
    of its first words, ``taken`` words in all. Reads doc_id, text and source only, whatever other columns are called; words
    are counted in whole texts of any length. The key is a hash of the id, so
    reruns agree; rows of one id are ordered by size, and equal ones can stand for each other. Null sources are one
    source. An empty table gives no rows, a source without words a target of 0.
    """
    ids = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    ids = cut(ids)
    sizes = ids.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, share, most).withColumn("number", F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))))
    rows = ids.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    name = F.coalesce(F.col("d.doc_id").cast("string"), F.lit(""))
    rows = rows.select("d.doc_id", "d.source", "size", "source_size", "target", "number", F.md5(F.concat(name, F.lit(f"|{seed}"))).alias("key"), name.alias("tie"))
    placed = running(rows, ["number"], ["key", "tie", "size"], {"before": "size"})
    size, source_size = F.col("size"), F.col("source_size")
    epochs = F.when(source_size > 0, F.floor(F.col("target") / source_size)).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target") - F.col("epochs") * source_size + F.lit(0.5)).cast("long") - F.col("before")
    placed = placed.withColumn("epochs", epochs).withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(size, left)))
    taken = (F.col("epochs") * size + F.col("part")).alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", taken)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole time that a document is taken, and one that
    ends after the last taken word where a budget ends inside a document. Documents without words have no place in it.

    Rows that share a doc_id and a source are told apart by their sizes; among those of one size any can stand for
    another, so they share out what the plan takes of them together: they stand next to each other in the plan, which
    takes the first ones whole, then part of one.
    """
    size = n_words(F.col("row.text")).alias("_size")
    key = F.to_json(F.struct(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"))).alias("_key")
    plan = mix(docs, weights, share, most, seed).select(F.struct("doc_id", "source", "size", "epochs", "part").alias("row"))
    plan = plan.select(key, F.col("row.size").alias("_size"), "row.epochs", "row.part")
    plan = cut(plan.groupBy("_key", "_size").agg(F.max("epochs").alias("_epochs"), F.sum("part").alias("_part"), F.count("*").alias("_alike")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.select("row", key, size).join(plan, ["_key", "_size"])
    if not plan.where("_alike > 1").isEmpty():
        several = rows.where("_alike > 1").withColumn("_one", F.lit(1).cast("long")).withColumn("_tie", F.monotonically_increasing_id())
        several = running(several, ["_key", "_size"], ["_tie"], {"_nth": "_one"}).withColumn("_part", F.col("_part") - F.col("_nth") * F.col("_size"))
        rows = rows.where("_alike = 1").select("row", "_size", "_epochs", "_part").union(several.select("row", "_size", "_epochs", "_part"))
    part, n = F.greatest(F.lit(0).cast("long"), F.least("_part", "_size")), F.col("_size")
    copies = F.when(n > 0, F.col("_epochs") + F.when(part == n, 1).otherwise(0)).otherwise(0).cast("int")
    rows = rows.select("row", F.array_repeat(F.lit(-1).cast("long"), copies).alias("whole"), part.alias("part"), n.alias("size"))
    begun = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array("part")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("row", F.explode(F.concat("whole", begun)).alias("first"))
    pieces = F.regexp_extract_all("row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(F.col("first") < 0, F.col("row.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("first").cast("int")), ""))
    return rows.withColumn("row", F.col("row").withField("text", text)).select("row.*")
