"""Exact duplicates by block naming.

A text's UTF-8 bytes are cut into blocks of a fixed size. All distinct blocks are sorted and given integers, so that a
block's name is an integer that no other block shares; then distinct pairs of adjacent names are sorted and given
integers, again and again, until one name is left for each text. Two texts have the same last name, after as many
pairings, exactly if they are identical. Every block of every text is named, also of texts that have no copy.

Blocks are sorted by a 64-bit hash, and contents that share a hash by content. Whether any do is found by grouping the
contents themselves, so no step relies on a hash being free of collisions; the rest of the work moves hashes and names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut, numbered

BLOCK = 1 << 14


def _blocks(docs: DataFrame, block: int, digest: Callable[[Column], Column]) -> DataFrame:
    """(uid, doc_id, sha, left, at, piece, hash): a row for each block of each text; ``left`` is the text's number of blocks.

    The bytes are a column of their own below the generator, so each block is one copy out of them, whatever the length.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    left = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block))).cast("int")
    texts = texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "body", F.sha2("body", 256).alias("sha"), left.alias("left"))
    rows = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("at"))
    rows = rows.withColumn("piece", F.substring("body", F.col("at") * block + 1, F.lit(block)))
    return rows.select("uid", "doc_id", "sha", "left", "at", "piece", digest(F.col("piece")).alias("hash"))


def _held(docs: DataFrame, block: int, digest: Callable[[Column], Column]) -> DataFrame:
    """(uid, doc_id, sha, left, at, hash, which): blocks without their content. ``which`` tells contents of one hash apart."""
    rows = _blocks(docs, block, digest)
    distinct = rows.select("hash", "piece").distinct()
    shared = cut(distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    which = F.lit(0).cast("long")
    if not shared.isEmpty():
        contents = distinct.join(shared, "hash").groupBy("hash").agg(F.sort_array(F.collect_list("piece")).alias("contents"))
        rows = rows.join(cut(contents), "hash", "left")
        which = F.coalesce(F.array_position("contents", F.col("piece")), which)
    sha = F.when(F.col("at") == 0, F.col("sha")).alias("sha")  # once for each text
    return cut(rows.select("uid", "doc_id", sha, "left", "at", "hash", which.alias("which")))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the name of their ``keys``, and for the texts that end here (``left`` is 1) those of the same name:
    ``best``, the struct (doc_id, uid) that is greatest, and their number ``size``."""
    ends = F.col("left") == 1
    groups = rows.groupBy(*keys).agg(F.max(F.when(ends, F.struct("doc_id", "uid"))).alias("best"), F.count_if(ends).alias("size"))
    return cut(rows.join(numbered(groups, keys, "name"), keys).drop(*keys))


def _judged(docs: DataFrame, block: int, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, sha, best, size, uid of every row."""
    held = _held(docs, block, digest)
    left = held.agg(F.max("left")).first()[0] or 0
    named = _named(held, ["hash", "which"])
    done = [named]
    while left > 1:
        odd = F.col("at") % 2 == 1
        pairs = named.where("left > 1").groupBy("uid", F.expr("at div 2").cast("int").alias("at")).agg(
            F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.expr("(max(left) + 1) div 2").cast("int").alias("left"),
            F.max(F.when(~odd, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("second"),
        )
        named = _named(pairs, ["first", "second"])
        done.append(named)
        left = (left + 1) // 2
    out = None
    for rows in done:
        rows = rows.where("left = 1").select("uid", "doc_id", "sha", "best", "size")
        out = rows if out is None else out.union(rows)
    return out


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Reads the columns doc_id and text, others are ignored. Null text counts as empty; texts are compared as they are,
    whatever their length. Of equal texts the row with the largest doc_id is kept (null ids come last); of repeated rows
    with that id one is kept. An empty table gives no rows.
    """
    judged = _judged(docs, block)
    kept = F.col("best.uid") == F.col("uid")
    return judged.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns, whatever their names.

    Kept rows are matched by doc_id and SHA-256 of the text; of repeated rows with both in common one is returned.
    """
    def key(doc_id: Column, sha: Column) -> Column:
        return F.concat(sha, F.coalesce(F.concat(F.lit(":"), doc_id.cast("string")), F.lit("")))

    judged = _judged(docs, block).where("best.doc_id <=> doc_id").select(key(F.col("doc_id"), F.col("sha")).alias("_key"), (F.col("best.uid") == F.col("uid")).alias("kept"))
    kept = judged.where("kept").select("_key")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("_key", key(F.col("row.doc_id"), F.sha2(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"), 256)))
    if not judged.where("NOT kept").isEmpty():  # rows that repeat a kept one: a task hands on one of a key, so no key is hot
        rows = rows.groupBy("_key").agg(F.first("row").alias("row"))
    return rows.join(kept, "_key", "left_semi").select("row.*")
