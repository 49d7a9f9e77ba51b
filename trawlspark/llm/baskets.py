"""Closed frequent itemsets of baskets, and rules among them, by cumulative intersection in one shard for each item.

Items are ordered by support, the rarest first (ties: the smaller id), and written as structs (s: support, i: id), so that an
item carries its place. The shard of an item holds, of every basket that has the item, the items after it that are frequent
together with it, so common items have short shards and equal ones are counted before they are sent. Each shard is a stream
of baskets into a repository of their intersections.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import checkpoint_dir
from ..workers import map_arrow
from .shared import cut, shuffle_partitions

#: Baskets of up to so many frequent items give their pairs; in larger ones only pairs that can be frequent are looked up.
#: It changes no result.
PAIRED = 64
#: Sets that a repository may gain before it is pruned.
GROWTH = 2000

Item = tuple[int, int]


class Repository:
    """A prefix tree of sets of items in ascending order, each with a weight."""

    __slots__ = ("root", "size")

    def __init__(self):
        self.root, self.size = [{}, 0, 0], 0  # of a node: children by item, weight of the set that ends here, greatest weight below or here

    def put(self, items: tuple[Item, ...], weight: int) -> None:
        """Add a set, or raise its weight."""
        node = self.root
        for item in items:
            node = node[0].setdefault(item, [{}, 0, 0])
            node[2] = max(node[2], weight)
        self.size += not node[1]
        node[1] = max(node[1], weight)

    def sets(self) -> Iterator[tuple[tuple[Item, ...], int]]:
        stack = [(self.root, ())]
        while stack:
            node, items = stack.pop()
            if node[1]:
                yield items, node[1]
            stack += [(child, (*items, item)) for item, child in node[0].items()]

    def meeting(self, basket: tuple[Item, ...]) -> dict[tuple[Item, ...], int]:
        """The intersections of the sets with a basket, each with the greatest weight of a set that gives it, and the basket."""
        inside, last, found = set(basket), basket[-1], {basket: 0}
        stack = [(self.root, ())]
        while stack:
            node, items = stack.pop()
            for item, child in node[0].items():
                if item > last:  # nothing of the basket can follow
                    both, weight = items, child[2]
                else:
                    both = (*items, item) if item in inside else items
                    weight = child[1]
                    if child[0]:
                        stack.append((child, both))
                if both and weight > found.get(both, 0):
                    found[both] = weight
        return found

    def above(self, items: tuple[Item, ...], proper: bool = False) -> int:
        """The greatest weight of a set that holds ``items``; 0 if none does. ``proper`` leaves the set itself out."""
        most, stack = 0, [(self.root, 0, True)]
        while stack:
            node, at, exact = stack.pop()
            if node[2] <= most and node is not self.root:
                continue
            if at == len(items):
                most = max([most, *(c[2] for c in node[0].values())]) if exact and proper else max(most, node[2])
                continue
            for item, child in node[0].items():
                if item == items[at]:
                    stack.append((child, at + 1, exact))
                elif item < items[at]:
                    stack.append((child, at, False))
        return most


class Shard:
    """Closed sets of a stream of weighted baskets that have ``least`` weight or more.

    ``left`` gives each item's weight in the whole stream. A set keeps only items that can still reach ``least`` with what is
    left of them; what that makes of a set is the set of no lower weight that holds it, in the end, or one of its own.
    """

    def __init__(self, least: int, left: dict[Item, int]):
        self.least, self.left, self.held, self.pruned, self.bound = least, left, Repository(), False, GROWTH

    def add(self, basket: tuple[Item, ...], weight: int) -> None:
        for items, before in self.held.meeting(basket).items():
            self.held.put(items, before + weight)
        for item in basket:
            self.left[item] -= weight
        if self.held.size > self.bound:
            self.prune()

    def prune(self) -> None:
        smaller = Repository()
        for items, weight in self.held.sets():
            if kept := tuple(i for i in items if weight + self.left[i] >= self.least):
                smaller.put(kept, weight)
        self.held, self.pruned, self.bound = smaller, True, 2 * smaller.size + GROWTH

    def closed(self) -> Iterator[tuple[tuple[Item, ...], int]]:
        for items, weight in self.held.sets():
            if weight >= self.least and not (self.pruned and self.held.above(items, proper=True) >= weight):
                yield items, weight


def _columns(items: str) -> list:
    """An array of items as two arrays for Arrow."""
    return [F.transform(items, lambda x: x["s"]).alias("s"), F.transform(items, lambda x: x["i"]).alias("i")]


def _items(s: str, i: str):
    return F.zip_with(s, i, lambda a, b: F.struct(a.alias("s"), b.alias("i")))


_OUT = "owner struct<s:long,i:long>, s array<long>, i array<long>, weight long"


def _by_owner(rows: DataFrame) -> DataFrame:
    """``rows`` (owner, kind, s, i, weights, weight), each owner's in one task, its kinds in order, short sets first."""
    n = shuffle_partitions(rows.sparkSession)
    return rows.withColumn("length", F.size("i")).repartition(n, "owner").sortWithinPartitions("owner", "kind", "length", "i").drop("length")


def _rows(batches) -> Iterator[tuple[Item, int, tuple[Item, ...], list[int], int]]:
    for batch in batches:
        owners = batch.column("owner")
        columns = owners.field("s"), owners.field("i"), *map(batch.column, ("kind", "s", "i", "weights", "weight"))
        for a, b, kind, s, i, weights, weight in zip(*(c.to_pylist() for c in columns), strict=True):
            yield (a, b), kind, tuple(zip(s, i, strict=True)), weights, weight


def _batch(found: list[tuple[Item, tuple[Item, ...], int]]):
    import pyarrow as pa

    owner = pa.StructArray.from_arrays([pa.array([o[k] for o, *_ in found], pa.int64()) for k in (0, 1)], ["s", "i"])
    sides = [pa.array([[x[k] for x in items] for _, items, _ in found], pa.list_(pa.int64())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([owner, *sides, pa.array([w for *_, w in found], pa.int64())], names=["owner", "s", "i", "weight"])


def _mined(shards: DataFrame, least: int) -> DataFrame:
    """(owner, s, i, weight): the closed sets of each shard, without its owner, from its items' weights (kind 0) and baskets."""

    def run(batches):
        now, shard, out = None, None, []
        for owner, kind, items, weights, weight in _rows(batches):
            if owner != now:
                if shard:
                    out += [(now, *x) for x in shard.closed()]
                now, shard = owner, Shard(least, {})
                if len(out) > 5000:
                    yield _batch(out)
                    out = []
            if kind == 0:
                shard.left.update(zip(items, weights, strict=True))
            else:
                shard.add(items, weight)
        if shard:
            out += [(now, *x) for x in shard.closed()]
        yield _batch(out)

    return map_arrow(_by_owner(shards), run, _OUT)


def _answered(rows: DataFrame) -> DataFrame:
    """(owner, s, i, weight): for each set asked for (kind 1) the greatest weight of a set of its shard (kind 0) that holds it."""

    def run(batches):
        now, held, out = None, Repository(), []
        for owner, kind, items, _, weight in _rows(batches):
            if owner != now:
                now, held = owner, Repository()
            if kind == 0:
                held.put(items, weight)
            else:
                out.append((owner, items, held.above(items)))
                if len(out) > 5000:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    return map_arrow(_by_owner(rows), run, _OUT)


def _suffixes(rows: DataFrame) -> DataFrame:
    """(owner, rest, n): of baskets (basket, item) every item with the items after it, equal ones counted."""
    baskets = rows.repartition("basket").groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).where("size(items) > 1")
    tails = F.transform(F.sequence(F.lit(1), F.size("items") - 1), lambda k: F.struct(F.element_at("items", k).alias("owner"), F.slice("items", k + 1, F.size("items") - k).alias("rest")))
    return baskets.select(F.inline(tails)).groupBy("owner", "rest").agg(F.count("*").alias("n"))


def _large(large: DataFrame, pairs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Of large baskets (basket, item): (basket, owner, partner) for pairs that can be frequent, and these pairs with n.

    A pair that is in small baskets (``pairs``: owner, partner, n) too few times by more than there are large ones with its
    items can't be frequent. One that isn't in small baskets at all can be only if each of its items is in ``least`` large
    ones; pairs of such items are made basket by basket.
    """
    times = cut(large.groupBy("item").agg(F.count("*").alias("times")))
    most = times.agg(F.max("times")).first()[0]
    able = cut(pairs.where(F.col("n") + most >= least))
    seen = large.select("basket", F.col("item").alias("owner")).join(able.select("owner", "partner").hint("merge"), "owner")
    seen = seen.join(large.select("basket", F.col("item").alias("partner")).hint("merge"), ["basket", "partner"]).select("basket", "owner", "partner")
    if most >= least:
        often = large.join(times.where(F.col("times") >= least).select("item").hint("merge"), "item", "left_semi")
        a, b = often.select("basket", F.col("item").alias("owner")), often.select("basket", F.col("item").alias("partner"))
        new = a.join(b.hint("merge"), "basket").where("owner < partner").join(able.select("owner", "partner").hint("merge"), ["owner", "partner"], "left_anti")
        seen = seen.union(new.select("basket", "owner", "partner"))
    seen = cut(seen)
    both = able.select("owner", "partner", "n").union(seen.select("owner", "partner", F.lit(1).cast("long")))
    return seen, both.groupBy("owner", "partner").agg(F.sum("n").alias("n"))


def closed_itemsets(lines: DataFrame, basket: str, item: str, absolute: int, per: int) -> tuple[DataFrame, DataFrame, int]:
    """((items, support): closed frequent itemsets; (items, support): closed sets of two or more by shard; number of baskets).

    ``lines`` are rows of a basket and an item (longs), repeated ones count once, rows with a null in either are left out. An
    itemset is frequent in ``absolute`` baskets or more that are also one of ``per`` or more; it is closed if every larger
    one is in fewer baskets. ``items`` are arrays of structs (s, i). No lines, no itemsets.

    An item's shard may show a set as closed that is not, where an item before the owner is in all its baskets. That item's
    own shard then has a set which ends in it with the same support: each set of a shard strikes out all that it ends in.
    """
    spark: SparkSession = lines.sparkSession
    own = lines.select(F.col(basket).cast("long").alias("basket"), F.col(item).cast("long").alias("id")).where("basket IS NOT NULL AND id IS NOT NULL")
    n_baskets = own.groupBy("basket").agg(F.lit(1)).count()
    least = max(absolute, -(-n_baskets // per))
    distinct = own.distinct()
    counts = distinct.groupBy("id").agg(F.count("*").alias("s")).where(F.col("s") >= least)
    counts = cut(counts.select("id", F.struct("s", F.col("id").alias("i")).alias("item")))
    folder = f"{checkpoint_dir(spark)}/baskets-{uuid.uuid4().hex}"
    distinct.join(counts.hint("merge"), "id").select("basket", "item").write.parquet(folder)
    rows = spark.read.parquet(folder)
    over = cut(rows.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > PAIRED).select("basket"))
    some_large = not over.isEmpty()
    tails = cut(_suffixes(rows.join(over.hint("merge"), "basket", "left_anti") if some_large else rows))
    pairs = tails.select("owner", F.explode("rest").alias("partner"), "n").groupBy("owner", "partner").agg(F.sum("n").alias("n"))
    if some_large:
        seen, pairs = _large(rows.join(over.hint("merge"), "basket", "left_semi"), pairs, least)
    frequent = cut(pairs.where(F.col("n") >= least))

    partners = frequent.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("partner", "n"))).alias("p"))
    partners = cut(partners.select("owner", F.transform("p", lambda x: x["partner"]).alias("partners"), F.transform("p", lambda x: x["n"]).alias("weights")))
    # rest and partners are sets of which the smaller is short: a basket's, or those that are frequent with one item
    short = tails.join(partners.select("owner", "partners").hint("merge"), "owner").select("owner", F.array_intersect("rest", "partners").alias("rest"), "n").where("size(rest) > 0")
    if some_large:
        kept = seen.join(frequent.select("owner", "partner").hint("merge"), ["owner", "partner"], "left_semi")
        short = short.unionByName(kept.groupBy("basket", "owner").agg(F.array_sort(F.collect_list("partner")).alias("rest")).select("owner", "rest", F.lit(1).cast("long").alias("n")))
    short = short.repartition("owner", "rest").groupBy("owner", "rest").agg(F.sum("n").alias("n"))
    none = F.array().cast("array<long>")
    shards = short.select("owner", F.lit(1).alias("kind"), *_columns("rest"), none.alias("weights"), F.col("n").alias("weight"))
    shards = shards.unionByName(partners.select("owner", F.lit(0).alias("kind"), *_columns("partners"), "weights", F.lit(0).cast("long").alias("weight")))
    mined = cut(_mined(shards, least).select(F.concat(F.array("owner"), _items("s", "i")).alias("items"), F.col("weight").alias("support")))

    ends = F.concat(F.transform(F.sequence(F.lit(2), F.size("items")), lambda k: F.slice("items", k, F.size("items"))), F.array(F.slice("items", 1, 1)))
    struck = mined.select(F.explode(ends).alias("items"), F.col("support").alias("other"), F.lit(None).cast("long").alias("support"))
    single = counts.select(F.array("item").alias("items"), F.lit(None).cast("long").alias("other"), F.col("item.s").alias("support"))
    every = mined.select("items", F.lit(None).cast("long").alias("other"), "support").union(single).unionByName(struck)
    closed = every.groupBy("items").agg(F.max("support").alias("support"), F.max("other").alias("other")).where("support IS NOT NULL AND NOT (other <=> support)")
    return cut(closed.select("items", "support")), mined, n_baskets


def _supports(wanted: DataFrame, mined: DataFrame) -> DataFrame:
    """(part, a) for sets ``part`` of two or more items: the support, that of the smallest closed set of the shard round it."""
    none = F.array().cast("array<long>")
    own = lambda rows, items, kind, weight: rows.select(F.element_at(items, 1).alias("owner"), F.lit(kind).alias("kind"), F.slice(items, 2, F.size(items)).alias("rest"), weight.alias("weight"))
    both = own(mined, "items", 0, F.col("support")).union(own(wanted, "part", 1, F.lit(0).cast("long")))
    found = _answered(both.select("owner", "kind", *_columns("rest"), none.alias("weights"), "weight"))
    return found.select(F.concat(F.array("owner"), _items("s", "i")).alias("part"), F.col("weight").alias("a"))


def frequent_itemsets(lines: DataFrame, basket: str = "sale_id", item: str = "item_id", absolute: int = 5, per: int = 20_000, confidence: int = 60) -> DataFrame:
    """(items, n_items, support, n_rules, best_item, rules_sha256) of every closed frequent itemset (``closed_itemsets``).

    Taking item c from a set of two or more is a rule if 100 * support >= ``confidence`` * a and support * baskets > a * s,
    where a is the support of the rest and s that of c. ``items`` are ascending ids joined by commas; the rules, by
    ascending c, are hashed as ``c:a:s`` joined by ``;``. Rows with a null basket or item are left out, repeated rows count
    once, columns beside these two are not read. An empty table gives no rows.
    """
    closed, mined, baskets = closed_itemsets(lines, basket, item, absolute, per)
    each = closed.where("size(items) > 1").select("items", "support", F.explode("items").alias("c"))
    each = each.withColumn("part", F.array_remove("items", F.col("c")))
    asked = each.where("size(part) > 1")
    answers = _supports(asked.select("part").distinct(), mined)
    known = each.where("size(part) = 1").select("items", "support", "c", F.element_at("part", 1)["s"].alias("a"))
    known = known.unionByName(asked.join(answers.hint("merge"), "part").select("items", "support", "c", "a"))
    good = known.where((100 * F.col("support") >= confidence * F.col("a")) & (F.col("support") * baskets > F.col("a") * F.col("c.s")))
    listed = good.groupBy("items").agg(F.array_sort(F.collect_list(F.struct(F.col("c.i").alias("c"), "a", F.col("c.s").alias("s")))).alias("rules"))
    rules = F.coalesce("rules", F.array().cast("array<struct<c:long,a:long,s:long>>"))
    text = F.array_join(F.transform(rules, lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";")
    ids = F.array_join(F.transform(F.array_sort(F.transform("items", lambda x: x["i"])), lambda i: i.cast("string")), ",")
    best = F.array_min(F.transform(rules, lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))["c"]
    return closed.join(listed.hint("merge"), "items", "left").select(
        ids.alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size(rules).cast("long").alias("n_rules"), best.alias("best_item"), F.sha2(text.cast("binary"), 256).alias("rules_sha256")
    )
