"""N-gram Jaccard join: documents whose word shingles overlap by 80 % or more, and their groups.

Two sets can only be that similar if their sizes are within a factor of 0.8 and if they share one of
the first ``n - ceil(0.8 n) + 1`` shingles in any common order. Candidates therefore meet in *tiles*:
one shingle of that prefix and one band of sizes. The common order puts rare shingles first, by counts
in a table of fixed size (all shingles are counted; several may share a counter, which changes the order
but no result), so a passage in very many documents makes no tile unless whole documents consist of it.

In a tile, each set has a bitmap with a bit for each shingle's hash, longer for larger bands. Every bit
set in one bitmap only is a shingle that the other lacks, which bounds the overlap from above; so does the place
of the shared shingle in either prefix. Pairs that the bounds let through are intersected exactly.

What keeps large groups of copies from making pairs:

1. Equal sets are one class.
2. Classes that share one of their smallest hashes are a *cluster*; near copies nearly always share one. A cluster is
   cut into blocks, and two blocks at a time are compared exactly by one matrix product. Only links that connect
   something new are put out, at most one for each member.
3. In the tiles, only pairs of different components without a common cluster are left to compare. Every such pair
   with a common prefix shingle is, so no link between components is missed and the final components are exact.

Defined results: null and empty texts have an empty set, no links, and their own id as component; a row
with a null id belongs to its class, whose name is the smallest id that is not null; rows with the same
id keep a result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, let, packed, store, without
from .graph import components
from .shingles import Powers, set_key, shingle_sets

# Links: 5 * intersection >= 4 * union, which is 9 * intersection >= 4 * (both sizes).
COUNTERS = 1 << 18
STARTS = 2
BLOCK = 1_000  # members of a cluster that are compared with as many others in one group of rows
COLUMNS = 4_096
LEAST_WORDS, MOST_WORDS = 4, 256  # of 64 bits in a bitmap
GROUP = 2_000  # members that are compared with one set in one group of rows


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def band(n: Column) -> Column:
    """Sizes whose ratio is 0.8 or more lie in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit or two for each shingle, in a power of two of 64-bit words."""
    words = LEAST_WORDS
    while words < MOST_WORDS and words * 64 < len(shingles):
        words *= 2
    bits = np.zeros(words * 64, np.uint8)
    bits[(shingles >> np.uint64(20)).astype(np.int64) & (words * 64 - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))


PORTION = 1_000  # rows whose shingles a task holds at once


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, PORTION):
            yield batch.slice(first, PORTION)


def shingle_counts(texts: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """How many shingles of all documents fall on each counter. The result's size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = Powers(), np.zeros(counters, np.int64)
        for batch in _portions(batches):
            sets = shingle_sets(batch.column(0).to_pylist(), powers)
            at = np.concatenate(sets) & np.uint64(counters - 1) if sets else np.empty(0, np.uint64)
            total += np.bincount(at.astype(np.int64), minlength=counters)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["counter", "n"])

    found = texts.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    total = np.zeros(counters, np.int64)
    rows = found.toPandas()  # at most one row for each counter
    total[rows["counter"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return total


SIGNED = "id long, h long, k1 long, k2 long, n int, starts array<long>, prefix array<long>, bitmap array<long>"


def signatures(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """For each row with words: its set's key and size, smallest hashes, rare-first prefix, bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = Powers(), shared.value
        mask = np.uint64(len(total) - 1)
        for batch in _portions(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), powers)
            keep = [i for i, s in enumerate(sets) if len(s)]
            sets = [sets[i] for i in keep]
            keys = [set_key(s) for s in sets]
            prefixes = [
                s[np.lexsort((s, total[(s & mask).astype(np.int64)]))[: prefix_length(len(s))]] for s in sets
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    batch.column(2).take(pa.array(keep, pa.int64())),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    _lists([s[:STARTS] for s in sets]),
                    _lists(prefixes),
                    _lists([bitmap(s) for s in sets]),
                ],
                ["id", "h", "k1", "k2", "n", "starts", "prefix", "bitmap"],
            )

    return texts.select("id", "text", "h").mapInArrow(run, SIGNED)


def keyed_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, text) of the documents whose ids are wanted, and of a few others.

    A text compresses to a fraction of its shingles' hashes, so it is what travels; sets are made again where it arrives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in _portions(batches):
            sets = shingle_sets(batch.column(0).to_pylist(), powers)
            keep = [i for i, s in enumerate(sets) if len(s)]
            keys = [set_key(sets[i]) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    batch.column(0).take(pa.array(keep, pa.int64())),
                ],
                ["k1", "k2", "text"],
            )

    near = among(texts.select("id", "text"), wanted.select("id"), ["id"]).where("_hit")
    return near.select("text").mapInArrow(run, "k1 long, k2 long, text string")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by exact intersection of their sorted arrays.

    The texts of just these documents travel to the groups that ask for them: one group for every ``GROUP``
    members a that one b is compared with.
    """
    named = classes.select("node", "id", "k1", "k2")
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    salted = pairs.join(groups, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("groups")))
    members = salted.select(F.col("a").alias("node"), "b", "salt", F.col("a").alias("member"))
    heads = groups.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"))
    asked = members.unionByName(heads.withColumn("member", F.lit(None).cast("long"))).join(named, "node")
    asked = store(asked.select("id", "k1", "k2", "b", "salt", "member"))
    sent = keyed_texts(texts, asked.select("id").distinct()).join(asked.drop("id"), ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, group, head = Powers(), None, np.empty(0, np.uint64)
        for batch in _portions(batches):
            b, salt, member, text = (batch.column(k) for k in range(4))
            sets = shingle_sets(text.to_pylist(), powers)
            first, second = [], []
            for i, key in enumerate(zip(b.to_pylist(), salt.to_pylist(), strict=True)):
                own = sets[i]
                if member[i].as_py() is None:
                    group, head = key, own
                elif key == group:
                    common = len(np.intersect1d(own, head, assume_unique=True))
                    if 9 * common >= 4 * (len(own) + len(head)):
                        first.append(member[i].as_py())
                        second.append(key[0])
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])

    order = ["b", "salt", F.col("member").asc_nulls_first()]
    ordered = sent.select("b", "salt", "member", "text").repartition("b", "salt").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "a long, b long")


def _bound(x: Column, y: Column) -> Column:
    """Bits of x that y lacks, at the smaller one's length."""

    def folded(s: Column, size: Column) -> Column:
        half = F.zip_with(F.slice(s, 1, size), F.slice(s, size + 1, size), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(s) > size, half).otherwise(s)

    return let(
        F.least(F.size(x), F.size(y)),
        lambda size: F.aggregate(
            F.zip_with(
                folded(x, size), folded(y, size), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))
            ),
            F.lit(0),
            lambda total, bits: total + bits,
        ),
    )


def clusters(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, cluster): the classes that share one of their smallest hashes, named by the one with the smallest id."""
    own = _of_classes(signed, classes, "starts")
    tokens = own.select("id", "node", F.explode("starts").alias("token"))
    first = tokens.groupBy("token").agg(F.min(F.struct("id", "node")).alias("f"), F.count(F.lit(1)).alias("members"))
    met = tokens.join(first.where("members > 1"), "token")
    return met.select("node", F.col("f.node").alias("cluster")).distinct()


def overlaps(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Intersection sizes of the sets from ``first`` on (rows) with all sets (columns).

    Only shingles that several sets have matter; their incidence matrix is multiplied with itself, some columns
    at a time.
    """
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    change = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    size = np.diff(np.append(change, len(values)))
    column = np.repeat(np.cumsum(size > 1) - 1, size)
    shared = np.repeat(size > 1, size)
    column, owner = column[shared], owner[shared]
    total = np.zeros((len(sets) - first, len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += part[first:] @ part.T
    return total


def spanning_links(nodes: list[int], sets: list[np.ndarray], first: int) -> list[tuple[int, int]]:
    """Links that connect what all links from the sets from ``first`` on connect; no more than there are sets."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.float32)
    linked = 9 * overlaps(sets, first) >= 4 * (sizes[first:, None] + sizes[None, :])
    linked[np.arange(len(sets) - first), np.arange(first, len(sets))] = False
    name = np.arange(len(sets))
    found = []
    for row in np.flatnonzero(linked.any(axis=1)):
        for other in np.flatnonzero(linked[row] & (name != name[row + first])):
            if name[other] != name[row + first]:
                found.append((nodes[row + first], nodes[other]))
                name[name == name[other]] = name[row + first]
    return found


def cluster_links(signed: DataFrame, classes: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked members of each cluster.

    A cluster's members are dealt to blocks, and each pair of blocks is a group of rows of bounded size; members
    travel once for each block of their cluster, not once for each other member.
    """
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = dealt.select("node", "cluster", "own", other.alias("other"))
    rows = rows.select(
        "node",
        "cluster",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).alias("second"),
    )
    asked = store(rows.join(classes.select("node", "id", "k1", "k2"), "node"))
    wanted = asked.select("id").distinct()
    sent = keyed_texts(texts, wanted).join(asked.drop("id"), ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, key, nodes, sets, split = Powers(), None, [], [], 0

        def done() -> list[tuple[int, int]]:
            # In a group of one block all are compared with all, else the second block's with all others.
            return spanning_links(nodes, sets, split if key[1] != key[2] else 0) if nodes else []

        for batch in _portions(batches):
            found = []
            columns = [batch.column(c).to_pylist() for c in ("cluster", "low", "high", "second", "node")]
            made = shingle_sets(batch.column("text").to_pylist(), powers)
            for i, (cluster, low, high, second, node) in enumerate(zip(*columns, strict=True)):
                if (cluster, low, high) != key:
                    found += done()
                    key, nodes, sets, split = (cluster, low, high), [], [], 0
                if nodes and nodes[-1] == node:
                    continue  # another document with the same set
                nodes.append(node)
                sets.append(made[i])
                split += not second
            yield _links(found)
        yield _links(done())

    group = ["cluster", "low", "high"]
    ordered = sent.select(*group, "second", "node", "text").repartition(*group).sortWithinPartitions(*group, "second", "node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"]
    )


def placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with their node's component, which is the node itself while it has no links."""
    found = rows.join(known.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
    return found.withColumn("component", F.coalesce("component", "node"))


def _of_classes(signed: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """A column of the signatures for each class, from the document that names it."""
    own = signed.select("k1", "k2", F.col("id").alias("_id"), column)
    return classes.join(own, ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("_id"))).drop("_id")


def _sided(side: DataFrame, k: int) -> DataFrame:
    """All columns with a 1 (smaller set of a pair) or a 2."""
    return side.toDF(*[f"{c}{k}" for c in side.columns])


SAME_TILE = "token1 = token2 AND tile1 = tile2"


def _meeting(smaller: DataFrame, larger: DataFrame, possible: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of either side that may be linked to one of the other side. No pairs are made."""
    left, right = _sided(smaller, 1), _sided(larger, 2)
    on = F.expr(SAME_TILE) & possible
    near = left.join(right, on, "left_semi").toDF(*smaller.columns).withColumn("side", F.lit(1))
    far = right.join(left, on, "left_semi").toDF(*larger.columns).withColumn("side", F.lit(2))
    met = store(near.unionByName(far))
    return met.where("side = 1").drop("side"), met.where("side = 2").drop("side")


def tile_pairs(signed: DataFrame, classes: DataFrame, known: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of different components and without a common cluster that share a prefix shingle and pass the
    bounds. Pairs with a common cluster have been compared."""
    own = members.groupBy(F.col("node").alias("_m")).agg(F.collect_set("cluster").alias("clusters"))
    nodes = placed(classes, known).join(own, F.col("node") == F.col("_m"), "left").drop("_m")
    nodes = store(nodes.withColumn("clusters", F.coalesce("clusters", F.array().cast("array<bigint>"))))
    own = _of_classes(signed, nodes, "prefix")
    rows = own.select("node", "n", "component", "clusters", F.posexplode("prefix").alias("at", "token"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = store(mixed.where("low < high").select("token"))
    # Of the prefixes only what may be such a shingle is dealt out once more.
    tokens = signed.select("k1", "k2", F.col("id").alias("_id"), F.posexplode("prefix").alias("at", "token"))
    hits = among(tokens, mixed, ["token"]).where("_hit").drop("_hit")
    met = nodes.join(hits, ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("_id"))).join(mixed, "token")
    met = met.select("node", "n", "component", "clusters", "at", "token")
    rows = store(met.withColumn("band", band(F.col("n"))))
    # The smaller set of a pair shares one of its first n / 9 + 1 shingles, and lies in the larger one's band or in
    # the one below. Tiles without a smaller and a larger set of different components have nothing to compare.
    smaller = rows.where("9 * (n - at) >= 8 * n").withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    larger = rows.withColumn("tile", F.col("band"))
    sides = smaller.select("token", "tile", "component", F.lit(1).alias("small")).unionByName(
        larger.select("token", "tile", "component", F.lit(0).alias("small"))
    )
    both = sides.groupBy("token", "tile").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("small").alias("a"), F.max("small").alias("b")
    )
    both = store(both.where("low < high AND a < b").select("token", "tile"))
    smaller, larger = (among(side, both, ["token", "tile"]).where("_hit").drop("_hit", "band") for side in (smaller, larger))
    once = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
    need = 4 * (F.col("n1") + F.col("n2"))
    # At the first shingle that two sets share, all others that they share come later in both prefixes' order.
    possible = (
        (F.col("component1") != F.col("component2"))
        & once
        & ~F.arrays_overlap("clusters1", "clusters2")
        & (9 * F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= need)
    )
    # Rows that may be linked so far are few, and only these get bitmaps.
    sides = _meeting(smaller, larger, possible)
    asked = sides[0].select("node").unionByName(sides[1].select("node")).distinct()
    bitmaps = _of_classes(signed, nodes.join(asked, "node"), "bitmap")
    bitmaps = store(bitmaps.select("node", "bitmap"))
    left, right = (_sided(side.join(bitmaps, "node"), k) for k, side in enumerate(sides, 1))
    bounded = (
        possible
        & (9 * (F.col("n1") - _bound(F.col("bitmap1"), F.col("bitmap2"))) >= need)
        & (9 * (F.col("n2") - _bound(F.col("bitmap2"), F.col("bitmap1"))) >= need)
    )
    pairs = left.join(right, F.expr(SAME_TILE) & bounded)
    return pairs.select(F.greatest("node1", "node2").alias("a"), F.least("node1", "node2").alias("b")).distinct()


def _grouped(docs: DataFrame, id: str, text: str) -> DataFrame:
    """For each row with words: id, h (hash of its text), n (shingles), name (its component's smallest id)."""
    texts = _texts(docs, id, text)
    signed = store(signatures(texts, shingle_counts(texts)))
    keys = ["k1", "k2"]
    classes = signed.groupBy(*keys).agg(F.min("id").alias("id"), F.first("n").alias("n"))
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()))

    members = store(clusters(signed, classes))
    links = store(cluster_links(signed, classes, members, texts))
    known = components(links)
    more = verified(store(tile_pairs(signed, classes, known, members)), classes, texts)
    whole = components(links.unionByName(more))

    smallest = classes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = smallest.groupBy("component").agg(F.min("id").alias("name"))
    resolved = smallest.join(names, "component").select(*keys, "name")
    return signed.select("id", "h", "n", *keys).join(resolved, keys)


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: ``id``, ``n_shingles`` and ``component_id``."""
    texts, found = _texts(docs, id, text), _grouped(docs, id, text)
    empty = texts.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return found.select(F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), F.col("name").alias("component_id")).unionByName(
        empty.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one whose id names it, with all its columns.

    Rows equal in id and text are the same document and share its fate; rows with the same id and other
    texts are told apart. Documents without words are no copies of anything and stay, and so do rows
    whose id is null.
    """
    copies = store(_grouped(docs, id, text).where("id != name").select("id", "h").distinct())
    return without(packed(docs, id=F.col(id).cast("long"), h=F.xxhash64(F.col(text))), copies, ["id", "h"])
