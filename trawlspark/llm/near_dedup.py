"""Near duplicates by an inverted join of signature coordinates, confirmed on full shingle sets.

A document's set holds its distinct pairs of adjacent words. Documents with equal sets form one class, and everything
after works on classes. A class's signature has ``COORDINATES`` coordinates, each the combination of ``WIDTH`` of
``HASHES`` MinHash values. Two classes are compared in full if ``MATCHES`` coordinates collide at least. At the threshold
a coordinate collides with a chance of 0.41, so a pair has fewer collisions than that with a chance of 1 in 70,000.

Classes are posted under their (coordinate, value) pairs. Prefix: so many collisions leave one among all but the last
``MATCHES`` - 1 coordinates, so only these are posted; the others are looked at where two classes meet. Skip: a pair is
counted in the list of its first collision and passed over in all later ones.

No list is expanded into all its pairs. Lists of one class are dropped. In a merging round each class is held against one
class, the one that is first in most of its lists; pairs that the full sets confirm make components. What is left are
lists that hold several components. There each class outside the list's largest component meets all others, in blocks of
both: a first visit, with signatures only, counts collisions and hands on the classes that have ``MATCHES`` with a class
of another component; a second visit brings the full sets of these and links components. Pairs never leave a block, only
links that tie further components do, and yet no link between components is lost.

A list with more than ``SPLIT`` blocks of classes outside its largest component, as a passage that very many documents
share makes, is split where that saves work: a pair that collides there first must collide a second time at a later
coordinate, so the list's classes are posted again under each later (coordinate, value), and then once more if need be.
Where classes agree in most coordinates, as short texts round one passage do, each of these lists is about as long as the
one that it comes from. So what is posted again is counted first, and the list is dealt to blocks as it is if its pairs
wouldn't become fewer by half; every two classes of such a list are a candidate pair, or nearly so, which has to be
looked at by any order of work.

Members of sets are 64-bit hashes of the pairs of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..workers import map_arrow
from .components import connected_components, roots
from .shared import as_bytes, cut, shuffle_partitions

HASHES, WIDTH, COORDINATES, MATCHES = 128, 4, 32, 3
#: One-bit values of two sets at the threshold that agree at least (115 of 128 are expected to, with a deviation of 3.4).
AGREE = 96
PERCENT = 80
#: Up to so many 8-byte ids are sent to every executor to pick texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Classes that are held against one center in one place, and by how much more of them meet those of another block in a list.
BLOCK, SIDE = 256, 4
#: Blocks of classes outside a list's largest component, beyond which the list is split by the next collision if that pays.
SPLIT = 2
#: What a row costs that is posted or dealt, as a number of pairs of signatures that are held against each other.
ROW_COST = 256
#: Pairs that are looked at together, bytes of texts whose words are hashed together, and the longest words that are.
PAIRS, STRETCH, LONG = 1 << 16, 1 << 22, 64

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_PICK = np.arange(COORDINATES * WIDTH).reshape(COORDINATES, WIDTH)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first bytes of eight


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, A-Z in lower case; where each text's words end)."""
    from xxhash import xxh3_64_intdigest as digest

    data = b"\n".join(texts).lower()
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(data, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    hashes = sizes.astype(np.uint64) * _C3
    some = np.flatnonzero(sizes <= LONG)
    for k in range(0, LONG, 8):
        part = eights[starts[some] + k] & _FIRST[np.minimum(sizes[some] - k, 8)]
        part *= _C1
        part ^= part >> np.uint64(32)
        part *= _C2
        part ^= hashes[some]
        part ^= part >> np.uint64(29)
        part *= _C3
        part ^= part >> np.uint64(32)
        hashes[some] = part
        some = some[sizes[some] > k + 8]
        if not len(some):
            break
    for k in np.flatnonzero(sizes > LONG).tolist():
        hashes[k] = digest(data[starts[k] : starts[k] + sizes[k]])
    return hashes, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sets of texts: sorted distinct 64-bit hashes of their pairs of adjacent words, A-Z in lower case."""
    if not texts:
        return []
    hashes, ends = _words(texts)
    mixed = hashes[:-1] * _C1
    after = (hashes[1:] << np.uint64(31)) | (hashes[1:] >> np.uint64(33))
    after *= _C2
    mixed += after
    mixed ^= mixed >> np.uint64(29)
    mixed *= _C3
    mixed ^= mixed >> np.uint64(32)
    sets, a = [], 0
    for b in ends.tolist():
        if b - a < 2:
            sets.append(hashes[a:b].copy())
        else:
            pairs = mixed[a : b - 1].copy()
            pairs.sort()
            sets.append(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])])
        a = b
    return sets


def _together(column) -> Iterator[list[bytes]]:
    """The texts of an Arrow column in stretches, of 512 or about ``STRETCH`` bytes."""
    for at in range(0, len(column), 512):
        some, size = [], 0
        for text in as_bytes(column.slice(at, 512)):
            if some and size + len(text) > STRETCH:
                yield some
                some, size = [], 0
            some.append(text)
            size += len(text)
        yield some


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For sets that aren't empty: (coordinates int64, 128 one-bit values as two int64)."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    least = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        least[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
    value = np.broadcast_to(np.arange(COORDINATES, dtype=np.uint64) * _C1, (len(sets), COORDINATES)).copy()
    for j in range(WIDTH):
        value = (value ^ least[:, _PICK[:, j]]) * _C2
        value ^= value >> np.uint64(31)
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return value.view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, digest of the set, bits, coordinates; the last three null for an empty set."""
    import pyarrow as pa

    schema = docs.select("doc_id", "mark").schema.add("n_shingles", "long").add("digest", "binary")
    schema = schema.add("bits", T.ArrayType(T.LongType())).add("coordinates", T.ArrayType(T.LongType()))

    def listed(values: np.ndarray, width: int, take: pa.Array) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1), pa.int64()), width).cast(pa.list_(pa.int64())).take(take)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            at = 0
            for texts in _together(batch.column("text")):
                sets = shingle_sets(texts)
                some = batch.slice(at, len(sets))
                at += len(sets)
                full = [k for k, s in enumerate(sets) if len(s)]
                digest, where = [None] * len(sets), np.full(len(sets), -1)
                coordinates, bits = np.zeros((0, COORDINATES), np.int64), np.zeros((0, 2), np.int64)
                if full:
                    coordinates, bits = signatures([sets[k] for k in full])
                    where[full] = np.arange(len(full))
                    for k in full:
                        digest[k] = xxh3_128_digest(sets[k].tobytes())
                take = pa.array(where, pa.int64(), mask=where < 0)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), listed(bits, 2, take), listed(coordinates, COORDINATES, take)],
                    names=schema.names,
                )

    return map_arrow(docs.select("doc_id", "mark", "text"), sign, schema)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted`` but doc_id, mark and digest, with ``members``: the sorted hashes of that class's set, as bytes.

    The sets are made where the texts are and leave with the place that asked for them, so they are shuffled once. Texts
    are found by doc_id and by mark, their hash, as many rows can lack an id or share one; of rows with both in common and
    the class's digest a task hands on one.
    """
    import pyarrow as pa

    carried = [c for c in wanted.columns if c not in ("doc_id", "mark", "digest")]
    schema = wanted.select(*carried).schema.add("members", "binary")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen: set[tuple] = set()
        for batch in batches:
            rows = zip(batch.column("digest").to_pylist(), zip(*(batch.column(c).to_pylist() for c in carried), strict=True), strict=True)
            at, keep, found = 0, [], []
            for texts in _together(batch.column("text")):
                new = [k == 0 or text != texts[k - 1] for k, text in enumerate(texts)]
                sets = iter(shingle_sets([text for text, is_new in zip(texts, new, strict=True) if is_new]))
                for is_new in new:
                    if is_new:
                        members = next(sets).tobytes()
                        digest = xxh3_128_digest(members)
                    own, place = next(rows)
                    if digest == own and place not in seen:
                        seen.add(place)
                        keep.append(at)
                        found.append(members)
                    at += 1
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in carried), pa.array(found, pa.binary())], names=schema.names)

    wanted = wanted.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    same = docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["mark"] == wanted["_mark"])
    texts = docs.join(wanted, same).select(*carried, "text", "digest")
    return map_arrow(texts, collect, schema)


def overlaps(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Two sorted sets have ``percent`` of their union in common."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.concatenate([x, y])
    merged.sort()
    both = np.count_nonzero(merged[1:] == merged[:-1])
    return 100 * both >= percent * (len(x) + len(y) - both)


def _star(classes: DataFrame, shared: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v), at most one for each class u, to the class v < u that is first in most of its lists, in
    ``MATCHES`` of them at least. A class v that very many are held against is sent to several places, for a part of them each.
    """
    import pyarrow as pa

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of place, the center of a place first."""
        center, at = None, None
        for batch in batches:
            links = []
            for v, part, is_center, node, raw in zip(*(batch.column(c).to_pylist() for c in ("v", "part", "center", "node", "members")), strict=True):
                members = np.frombuffer(raw, np.uint64)
                if is_center:
                    center, at = members, (v, part)
                elif at != (v, part):
                    raise ValueError(f"no set for class {v}")
                elif overlaps(members, center, percent):
                    links.append((node, v))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["u", "v"])

    firsts = shared.where("node <> first").groupBy("node").agg(F.mode("first", True).alias("v"), F.collect_list("first").alias("firsts"))
    often = F.size(F.filter("firsts", lambda x: x == F.col("v"))) >= MATCHES
    pairs = cut(firsts.where(often).select("node", "v"))
    centers = pairs.groupBy("v").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    around = pairs.join(centers, "v").select("node", "v", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("center"))
    wanted = around.union(centers.select("v", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.lit(True)))
    sets = _sets(docs, cut(wanted.join(classes.select("node", "doc_id", "mark", "digest"), "node")))
    placed = sets.repartition(shuffle_partitions(docs.sparkSession), "v", "part").sortWithinPartitions("v", "part", F.desc("center"))
    return cut(map_arrow(placed, compare, "u long, v long").distinct())


def coordinates_of(path: int) -> list[int]:
    """The coordinates that the classes of a list have in common, the first collision first."""
    found = []
    while path:
        path, digit = divmod(path, 64)
        found.insert(0, digit - 1)
    return found


def _near(x: np.ndarray, y: np.ndarray, at: np.ndarray, rows: tuple, columns: tuple, percent: int, matches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, collisions) of the pairs (``x``, ``y``) that are ``candidates`` in the lists with the paths ``at``, one for each row."""
    node, part, _, n, bits, signature = rows
    node2, part2, inside2, n2, bits2, signature2 = columns
    able = part[x] != part2[y]
    able &= ~inside2[y] | (node[x] < node2[y])
    able &= 100 * np.minimum(n[x], n2[y]) >= percent * np.maximum(n[x], n2[y])
    x, y = x[able], y[able]
    differing = np.bitwise_count(bits[x] ^ bits2[y]).sum(axis=1, dtype=np.int64)
    x, y = x[differing <= HASHES - AGREE], y[differing <= HASHES - AGREE]
    same = signature[x] == signature2[y]
    count = same.sum(axis=1)
    own = np.flatnonzero(count >= matches)
    x, y, count, same, path = x[own], y[own], count[own], same[own], at[x[own]]
    good = np.ones(len(x), bool)
    for place in reversed(range(MATCHES)):
        coordinate = ((path >> (6 * place)) & 63) - 1  # below 0 where the path is shorter
        known = np.flatnonzero(coordinate >= 0)
        good[known] &= same[known].argmax(axis=1) == coordinate[known]  # the first one; then the first of those after it
        same[known, coordinate[known]] = False
    return x[good], y[good], count[good]


def _all_near(group: np.ndarray, group2: np.ndarray, at: np.ndarray, rows: tuple, columns: tuple, percent: int, matches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_near`` for each row with each column of its group, ``PAIRS`` at a time; groups are whole numbers that don't fall."""
    first = np.searchsorted(group2, group)
    many = np.searchsorted(group2, group, side="right") - first
    ends, found, a = np.cumsum(many), [], 0
    while a < len(group):
        before = ends[a] - many[a]
        b = max(a + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        x = np.repeat(np.arange(a, b), many[a:b])
        y = np.arange(len(x)) - np.repeat(ends[a:b] - many[a:b] - before, many[a:b]) + first[x]
        found.append(_near(x, y, at, rows, columns, percent, matches))
        a = b
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def candidates(at: int, rows: tuple[np.ndarray, ...], columns: tuple[np.ndarray, ...], percent: int, matches: int = MATCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, collisions) of the pairs of different parts that may be near and whose first collisions are those of ``at``.

    ``at`` is a list's ``path``: its coordinates, each as its number and one, as digits of base 64, the last one lowest.
    ``rows`` and ``columns`` are (node, part, inside, n, bits, coordinates), all in the list of that path. Of a
    pair that is in both, once each way round, the one with the smaller node in the rows counts.
    """
    r, c = len(rows[0]), len(columns[0])
    return _all_near(np.zeros(r, np.int64), np.zeros(c, np.int64), np.full(r, at), rows, columns, percent, matches)


#: What a class brings to a block: the block, the path of its list, what it is there, and its signature.
_MET = "term long, i int, j int, at long, is_row boolean, node long, part long, inside boolean, n long, bits array<long>, coordinates array<long>"


def _stretches(batches: Iterator, key: tuple[str, ...]) -> Iterator:
    """(table, group of each row): whole groups of the rows with one key each, from batches that are sorted by it."""
    import pyarrow as pa

    def whole(held: list) -> tuple:
        table = pa.Table.from_batches([batch for batch, _ in held]).combine_chunks()
        keys = np.concatenate([keys for _, keys in held])
        return table, np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)])

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in key])
        last = int((keys != keys[-1]).any(axis=1).nonzero()[0].max(initial=-1)) + 1  # where the last group starts
        if held and (last or (held[-1][1][-1] != keys[0]).any()):
            if last:
                held.append((batch.slice(0, last), keys[:last]))
            yield whole(held)
            held = []
        elif last:
            yield whole([(batch.slice(0, last), keys[:last])])
        held.append((batch.slice(last), keys[last:]))
    if held:
        yield whole(held)


def _candidates(table, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, collisions): the ``candidates`` of all blocks in ``table``, as places there."""
    plain = [table.column(c).to_numpy() for c in ("node", "part", "inside", "n")]
    wide = [table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) for c in ("bits", "coordinates")]
    everything = (*plain, wide[0].view(np.uint64), wide[1])  # bits are counted of whole numbers without a sign
    is_row, at = table.column("is_row").to_numpy(), table.column("at").to_numpy()
    down, along = np.flatnonzero(is_row), np.flatnonzero(~is_row)
    sides = [tuple(c[w] for c in everything) for w in (down, along)]
    x, y, count = _all_near(group[down], group[along], at[down], *sides, percent, MATCHES)
    return down[x], along[y], count


def _promising(percent: int) -> Callable:
    """First visit of the blocks: the classes that are in any candidate pair there."""

    def visit(batches: Iterator) -> Iterator:
        for table, group in _stretches(batches, ("term", "i", "j")):
            x, y, _ = _candidates(table, group, percent)
            if len(x):
                yield from table.take(np.unique(np.concatenate([x, y]))).to_batches()

    return visit


def _linking(percent: int) -> Callable:
    """Second visit, with full sets: pairs of parts that confirmed pairs link, no more than tie all linked parts together."""
    import pyarrow as pa

    def visit(batches: Iterator) -> Iterator:
        for table, group in _stretches(batches, ("term", "i", "j")):
            has = table.column("members").is_valid().to_numpy()
            raw = table.column("members").filter(pa.array(has)).to_pylist()
            sets = {(g, n): np.frombuffer(m, np.uint64) for g, n, m in zip(group[has].tolist(), table.column("node").to_numpy()[has].tolist(), raw, strict=True)}
            table, group = table.filter(pa.array(~has)), group[~has]
            x, y, count = _candidates(table, group, percent)
            node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
            order = np.lexsort((-count, group[x]))  # block by block
            root: dict[tuple[int, int], int] = {}

            def find(block: int, part: int) -> int:
                while (up := root.get((block, part), part)) != part:
                    root[block, part] = part = root.get((block, up), up)
                return part

            links = []
            for block, u, v, n, m in zip(*(c.tolist() for c in (group[x[order]], part[x[order]], part[y[order]], node[x[order]], node[y[order]])), strict=True):
                a, b = find(block, u), find(block, v)
                if a != b and overlaps(sets[block, n], sets[block, m], percent):
                    root[block, a] = b
                    links.append((u, v))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["u", "v"])

    return visit


def _mixed(lists: DataFrame) -> DataFrame:
    """``lists`` (term, at, node, part) that hold several parts, with inside (not in the list's largest part) and the numbers
    of blocks ``down`` (of the classes inside) and ``along`` (of all)."""
    sizes = lists.groupBy("term", "part").agg(F.count("*").alias("n")).groupBy("term")
    sizes = sizes.agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(SIDE * BLOCK)).cast("int")
    sizes = sizes.select("term", F.col("most.part").alias("main"), blocks(F.col("size") - F.col("most.n")).alias("down"), blocks(F.col("size")).alias("along"))
    return lists.join(cut(sizes), "term").withColumn("inside", F.col("part") != F.col("main")).drop("main")


def _split(lists: DataFrame, classes: DataFrame, fixed: int) -> DataFrame:
    """``lists`` of which ``fixed`` collisions are known, posted again under each later coordinate that can be the next one; ``parent`` is the term before."""
    known = F.col("at") % 64  # the last known coordinate and one
    rows = lists.select("term", "at", "node", "part").join(classes.select("node", "coordinates"), "node")
    later = F.slice("coordinates", known.cast("int") + 1, F.greatest(F.lit(0), F.lit(COORDINATES - MATCHES + fixed + 1) - known.cast("int")))
    rows = rows.select("term", "at", "node", "part", known.alias("known"), F.posexplode(later).alias("after", "value"))
    at = F.col("at") * 64 + F.col("known") + F.col("after") + 1
    return rows.select(F.xxhash64("term", at, "value").alias("term"), at.alias("at"), "node", "part", F.col("term").alias("parent"))


def _paying(large: DataFrame, posted: DataFrame) -> DataFrame:
    """The terms (parent) of the lists ``large`` whose mixed lists, ``posted`` again, cost half of what they do at most."""
    cost = (F.sum(F.col("inside").cast("long")) + F.lit(ROW_COST)) * F.count("*")
    own = large.groupBy(F.col("term").alias("parent")).agg(cost.alias("cost"))
    then = posted.groupBy("parent", "term").agg(cost.alias("cost")).groupBy("parent").agg(F.sum("cost").alias("then"))
    return cut(own.join(then, "parent", "left").where(2 * F.coalesce("then", F.lit(0)) <= F.col("cost")).select("parent"))


def _met(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(term, at, node, part, inside, i, j, is_row): the blocks that each class of the lists (term, at, node, part) goes to."""
    place = lambda i, j, is_row: F.struct(i.alias("i"), j.alias("j"), F.lit(is_row).alias("is_row"))
    own_i, own_j = F.pmod(F.xxhash64("node"), F.col("down")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("along")).cast("int")
    as_row = F.when(F.col("inside"), F.transform(F.sequence(F.lit(0), F.col("along") - 1), lambda j: place(own_i, j, True))).otherwise(F.array().cast("array<struct<i:int,j:int,is_row:boolean>>"))
    as_column = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: place(i, own_j, False))

    def dealt(mixed: DataFrame) -> DataFrame:
        return mixed.select("term", "at", "node", "part", "inside", F.inline(F.concat(as_row, as_column)))

    mixed, out = _mixed(lists), []
    for fixed in range(1, MATCHES):
        large = cut(mixed.where(F.col("down") > SPLIT))
        out.append(dealt(mixed.where(F.col("down") <= SPLIT)))
        if large.isEmpty():
            return reduce(DataFrame.union, out)
        posted = cut(_mixed(cut(_split(large, classes, fixed))))
        paying = _paying(large, posted)
        out.append(dealt(large.join(paying.withColumnRenamed("parent", "term"), "term", "left_anti")))
        mixed = posted.join(paying, "parent", "left_semi")
    return reduce(DataFrame.union, [*out, dealt(mixed)])


def _across(classes: DataFrame, shared: DataFrame, parts: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components, from all lists that hold several."""
    labelled = shared.select("term", (F.col("at") + 1).cast("long").alias("at"), "node").join(parts, "node", "left")
    dealt = _met(labelled.withColumn("part", F.coalesce("component", "node")).drop("component"), classes)
    names = [c.split()[0] for c in _MET.split(", ")]

    def meeting(rows: DataFrame) -> DataFrame:
        return rows.repartition(shuffle_partitions(docs.sparkSession), "term", "i", "j").sortWithinPartitions("term", "i", "j")

    promising = cut(map_arrow(meeting(dealt.join(classes.select("node", "n", "bits", "coordinates"), "node").select(*names)), _promising(percent), _MET))
    wanted = promising.select("term", "i", "j", "node").distinct().join(classes.select("node", "doc_id", "mark", "digest"), "node")
    full = promising.unionByName(_sets(docs, cut(wanted)), allowMissingColumns=True)
    return cut(map_arrow(meeting(full), _linking(percent), "u long, v long"))


def class_components(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that any link ties to another."""
    large = classes.where("n > 3")  # smaller sets are near no set but an equal one
    postings = large.select("node", F.posexplode(F.slice("coordinates", 1, COORDINATES - MATCHES + 1)).alias("at", "term"))
    lists = postings.groupBy("term").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1").drop("size")
    shared = cut(postings.join(lists, "term"))
    parts = roots(_star(classes, shared, docs, percent))
    bridges = connected_components(_across(classes, shared, parts, docs, percent))
    renamed = bridges.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    wholes = parts.join(renamed, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = bridges.join(parts.select("node"), "node", "left_anti")  # components of one class, which the star left alone
    return cut(wholes.union(alone.select("node", "component")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Reads doc_id (of any ordered type) and text. Rows are linked if their sets have ``percent`` of their union in common
    (80 at least); component_id is the smallest doc_id that links reach, and a row with that id is kept. A text without
    words, or null, has an empty set and is linked with nothing; it is kept, also without a doc_id. Texts are read whole,
    whatever their length, and other columns are ignored. Repeated rows share a component, and all with its id are kept.
    Rows without a doc_id take part: where their component has an id none of them is kept, where it has none all are.
    No rows give no rows.
    """
    if percent < PERCENT:
        raise ValueError(f"the signature is made for {PERCENT} percent and more")
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    rows = cut(_signed(docs))
    whole = rows.where("n_shingles > 0")
    own = F.struct("doc_id", "mark")
    own = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), own)), F.min(own)).alias("own")
    groups = whole.groupBy("digest").agg(own, *[F.first(c).alias(c) for c in ("n_shingles", "bits", "coordinates")])
    classes = cut(groups.select("own.*", "digest", F.col("n_shingles").alias("n"), "bits", "coordinates").withColumn("node", F.monotonically_increasing_id()))
    parts = class_components(classes, docs, percent)
    linked = parts.join(classes.select("node", "doc_id"), "node")
    linked = linked.join(linked.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("node", "least")
    named = cut(classes.join(linked, "node", "left").select("digest", F.coalesce("least", "doc_id").alias("component_id")))
    joined = whole.select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    out = joined.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns, matched by doc_id and text."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    judged = near_duplicates(docs.select(F.struct("doc_id", mark.alias("mark")).alias("doc_id"), "text"), percent)
    kept = judged.where("kept").select("doc_id").distinct()
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    mine = F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("mark"))
    marked = marked.withColumn("_id", mine)
    return marked.join(kept, marked["_id"].eqNullSafe(kept["doc_id"]), "left_semi").select("row.*")
