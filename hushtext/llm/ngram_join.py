"""Similarity join of texts by the Jaccard index of their word shingles.

Equal sets are one node.  Nodes meet in tiles: a tile holds the nodes of a band of sizes
that have a certain shingle in their prefix, and within a tile only nodes of a like size
are compared.  A band goes up to four times its least size; a node that could be linked
with a larger one in the next band is in that band as well.  The prefix of a set of ``n`` is its first ``n - ceil(t * n) + 1`` elements in
one order for all sets, so two sets with an index of ``t`` or more share a tile.  The
order puts shingles that many texts share last; it rests on counts of hashed slots and
may be any order for the result to be exact.

Within a tile a pair goes through two tests.  Each node has a bitmap of hashed bits, four
to eight for each element: every bit that one has and the other lacks is at least one
element not shared, which bounds the overlap from above.  Pairs within the bound are then compared exactly, by
intersecting their sorted arrays.

What is asked for are the classes of linked documents, so not every link need be looked
at.  First each node is compared with the first node of each of its tiles.  Then, in large
tiles whose nodes are not yet all in one class, each is compared with a few others at
random, which joins up what is left of a group of near copies.  At last all pairs of
different classes are compared that the tile and the bitmaps leave possible, each in one
of the first tiles that it shares.  No pair of
like texts in different classes is left out, and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hushtext.llm.common import discard, saved
from hushtext.llm.components import members
from hushtext.llm.shingles import WordHashes, shingle_set

_SLOT_BITS = 22
_SLOTS = 1 << _SLOT_BITS
_LEAST_BITS, _MOST_BITS = 6, 20  # widths of bitmaps as powers of two
_MARKS = [f"mark{i}" for i in range(8)]  # a bitmap of 512 bits as columns
_SMALL_TILE = 32
_SUB_TILE = 128
_NEIGHBOURS = 8
_RANDOM_ROUNDS = 1
_BEFORE = 8  # tiles of a node looked back at


def near_duplicate_classes(
    docs: DataFrame,
    words: int = 5,
    at_least: tuple[int, int] = (4, 5),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs``.

    Two documents are linked when ``den * |A & B| >= num * |A | B|`` for their sets of
    shingles of ``words`` words and ``at_least = (num, den)``.  ``component_id`` is the
    smallest id reachable by links.  Null and empty texts, and texts of white space, have
    no shingle and are linked with nothing.  Rows that repeat an id are one document
    that is linked by any of its texts.  Rows of null id are told apart by their place; each
    gets the id of its class, null if it has none.  Other columns play no part.  An empty
    table gives an empty one.

    Sets are told apart by a 64-bit hash of their content and by their size.
    """
    rows = numbered_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    classes = row_classes(rows, words, at_least)
    found = rows.select("row", "doc_id").join(classes, "row")
    filled = found.where("n_shingles > 0").select("doc_id", "n_shingles", "root")
    # rows that repeat an id tie their classes together
    labelled = _tie_repeated_ids(saved(filled, "shingle_labels"))
    least = saved(
        labelled.groupBy("root").agg(F.min("doc_id").alias("component_id")), "shingle_least"
    )
    empty = found.where("n_shingles = 0")
    return (
        labelled.join(least, "root")
        .select("doc_id", "n_shingles", "component_id")
        .union(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def numbered_rows(docs: DataFrame, row: str = "row", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with a number of its own for each row.

    It is the id where every row has an id of its own.  Otherwise the rows are numbered and
    written once, so that the numbers stay.
    """
    if docs.schema[doc_id].dataType == T.LongType():
        odd = docs.groupBy(F.col(doc_id).alias("id")).count().where("count > 1 OR id IS NULL")
        if odd.isEmpty():
            return docs.withColumn(row, F.col(doc_id))
    return saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered_rows")


def row_classes(
    rows: DataFrame,
    words: int = 5,
    at_least: tuple[int, int] = (4, 5),
    row: str = "row",
    text: str = "text",
) -> DataFrame:
    """``row``, ``n_shingles`` and ``root``, a number that the rows of a class share.

    ``rows`` comes from ``numbered_rows``: whatever ids the rows have, each is told apart
    and its text is found again by its number.  Rows without a shingle have the root 0.
    """
    num, den = at_least
    texts = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
    levels = _slot_levels(texts, words)
    features = saved(_features(texts, words, num, den, levels), "shingle_features", "zstd")
    filled = features.where("n > 0")
    nodes = saved(
        filled.groupBy("node").agg(
            F.min("row").alias("rep"),
            *[F.first(c).alias(c) for c in ("n", "bits", *_MARKS)],
        ),
        "shingle_nodes",
    )

    in_tiles = filled.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    in_tiles = in_tiles.select(
        "node", "n", "pos", F.explode(_bands(num, den)).alias("band"), "shingle"
    ).select("node", "n", "pos", F.xxhash64("shingle", "band").alias("tile"))
    # most tiles hold one node: no more than its hash is shuffled to find that out
    tiles = (
        in_tiles.groupBy("tile")
        .agg(F.min("node").alias("least"), F.max("node").alias("last"))
        .where("least <> last")
    )
    joint = saved(
        in_tiles.join(tiles.select("tile", "least"), "tile")
        .select("tile", "node", "n", "pos", "least").distinct(),
        "shingle_joint",
    )
    first = joint.where("node = least").groupBy("tile")
    first = first.agg(F.min(F.struct("node", "n", "pos")).alias("head"))
    shared = saved(joint.drop("least").join(first, "tile"), "shingle_tiles")
    sizes = saved(features.select("row", "n", "node"), "shingle_sizes")
    discard(features, joint)
    # texts of the nodes that share a tile: the documents are shuffled once
    wanted = shared.select("node").distinct().join(nodes.select("node", "rep"), "node")
    own = saved(
        texts.withColumnRenamed("row", "rep").join(wanted, "rep").select("node", "text"),
        "shingle_texts",
        "zstd",
    )

    def linked(pairs: DataFrame) -> DataFrame:
        close = _within_bound(pairs, nodes, num, den)
        a = own.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = own.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        loaded = close.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
        return loaded.mapInPandas(_exact(words, num, den), "a long, b long")

    room = _has_room(num, den, "", "head.")
    heads = shared.where(F.expr(f"node <> head.node AND {room}"))
    heads = heads.select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
    links = saved(linked(heads), "shingle_links")
    done = [links]

    def mixed(roots: DataFrame, at_least: int) -> DataFrame:
        """Rows, with their classes, of tiles that hold more than one class."""
        placed = saved(
            shared.where("node <> head.node")  # pairs with the head are done
            .join(roots, "node", "left")
            .select("tile", "node", "n", "pos", F.coalesce("root", "node").alias("root")),
            "shingle_placed",
        )
        done.append(placed)
        counts = placed.groupBy("tile").agg(
            F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")
        )
        counts = counts.where(F.col("r0") != F.col("r1")).where(F.col("size") > at_least)
        return placed.join(counts.select("tile", "size"), "tile")

    for seed in range(_RANDOM_ROUNDS):
        roots = members(links)
        chance = F.xxhash64("node", F.lit(seed))
        subs = F.ceil(F.col("size") / _SUB_TILE)
        order = Window.partitionBy("tile", "sub").orderBy("chance")
        row = F.struct("node", "n", "pos", "root")
        met = (
            mixed(roots, _SMALL_TILE)
            .withColumns({"chance": chance, "sub": F.pmod(F.shiftright(chance, 7), subs)})
            .withColumn("others", F.array(*[F.lead(row, i + 1).over(order) for i in range(_NEIGHBOURS)]))
            .withColumn("others", F.expr(
                f"filter(others, x -> root <> x.root AND {_has_room(num, den, '', 'x.')})"
            ))
            .select("node", F.explode("others").alias("other"))
            .select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b"))
            .distinct()
        )
        links = saved(_stars(roots).union(linked(met)), "shingle_links")
        done.append(links)

    roots = members(links)
    # a pair that shares one of the tiles just before this one has been met there: it is
    # open as well, or one of the two is its head, and there is more room
    last = Window.partitionBy("node").orderBy("pos", "tile").rowsBetween(-_BEFORE, -1)
    open_ = mixed(roots, 1).withColumn("before", F.collect_list("tile").over(last))
    open_ = open_.join(nodes.select("node", *_MARKS), "node")
    sides = ["node", "n", "pos", "root", "before", *_MARKS]
    left = open_.select("tile", *[F.col(c).alias(f"{c}_a") for c in sides])
    right = open_.select("tile", *[F.col(c).alias(f"{c}_b") for c in sides])
    only_a = " + ".join(f"bit_count({m}_a & ~{m}_b)" for m in _MARKS)
    only_b = " + ".join(f"bit_count({m}_b & ~{m}_a)" for m in _MARKS)
    bound = f"least(n_a - ({only_a}), n_b - ({only_b}))"
    possible = f"{bound} * {num + den}L >= (n_a + n_b) * {num}L"
    pairs = (
        left.join(
            right,
            (left["tile"] == right["tile"])
            & F.expr("node_a < node_b AND root_a <> root_b")
            & F.expr(_has_room(num, den, "", "", "_a", "_b"))
            & F.expr(possible)
            & F.expr("NOT arrays_overlap(before_a, before_b)"),
        )
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )
    links = saved(_stars(roots).union(linked(pairs)), "shingle_links")
    roots = saved(members(links), "shingle_roots")
    count = F.col("n").cast("long").alias("n_shingles")
    found = sizes.where("n > 0").join(roots, "node", "left").select(
        "row", count, F.coalesce("root", "node").alias("root")
    )
    empty = sizes.where("n = 0").select("row", count, F.lit(0).cast("long").alias("root"))
    classes = saved(found.union(empty), "shingle_classes")
    discard(sizes, nodes, shared, own, links, roots, *done)
    return classes


def _bands(num: int, den: int) -> Column:
    """The bands of a size ``n``: its own, and the next if a link could go there."""
    band = "cast(floor(log2(n) / 2) as int)"
    return F.expr(
        f"CASE WHEN n * {den}L >= shiftleft(1L, 2 * {band} + 2) * {num}L "
        f"THEN array({band}, {band} + 1) ELSE array({band}) END"
    )


def _stars(roots: DataFrame) -> DataFrame:
    """Classes as edges to their least node; they stand for all links found so far."""
    return roots.selectExpr("node AS a", "root AS b")


def _tie_repeated_ids(labelled: DataFrame) -> DataFrame:
    twice = labelled.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("root").alias("a"), F.max("root").alias("b")
    ).where("a <> b")
    if twice.isEmpty():
        return labelled
    # ids with three or more classes: every class with the least one
    edges = labelled.join(twice, "doc_id").select("a", F.col("root").alias("b"))
    roots = members(edges).withColumnRenamed("root", "tied")
    return labelled.join(roots, labelled["root"] == roots["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("tied", "root").alias("root")
    )


def _has_room(num: int, den: int, a: str, b: str, end_a: str = "", end_b: str = "") -> str:
    """Whether two nodes of a tile can be linked if it is the first that they share.

    Then none of the elements before it are shared, which bounds the overlap; sets of
    too different size fail as well.
    """
    n_a, n_b = f"{a}n{end_a}", f"{b}n{end_b}"
    left = f"least({n_a} - {a}pos{end_a}, {n_b} - {b}pos{end_b})"
    return f"{left} * {num + den}L >= ({n_a} + {n_b}) * {num}L"


def _within_bound(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps leave room for the overlap that is needed."""
    a = nodes.selectExpr("node AS a", "n AS n_a", "bits AS bits_a")
    b = nodes.selectExpr("node AS b", "n AS n_b", "bits AS bits_b")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bounds = list(map(overlap_bound, batch["n_a"], batch["n_b"], batch["bits_a"], batch["bits_b"]))
            sizes = (batch["n_a"].astype("int64") + batch["n_b"]).to_numpy()
            good = np.array(bounds, np.int64) * (num + den) >= sizes * num
            yield batch.loc[good, ["a", "b"]]

    joined = pairs.join(b, "b").join(a, "a")
    return joined.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInPandas(
        test, "a long, b long"
    )


def bitmap(found: np.ndarray, least: int = _LEAST_BITS, most: int = _MOST_BITS) -> bytes:
    """Hashed bits of a set; widths are powers of two, so a wide one can be folded."""
    power = min(max(int(4 * found.size - 1).bit_length(), least), most)
    bits = np.zeros(1 << power, bool)
    bits[((found >> np.uint64(_SLOT_BITS)) & np.uint64(bits.size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(n_a: int, n_b: int, bits_a: bytes, bits_b: bytes) -> int:
    """The most elements two sets can share, by the bits only one of them has."""
    x, y = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    while x.size > y.size:
        x = x[: x.size // 2] | x[x.size // 2 :]
    while y.size > x.size:
        y = y[: y.size // 2] | y[y.size // 2 :]
    only_a = int(np.bitwise_count(x & ~y).sum())
    only_b = int(np.bitwise_count(y & ~x).sum())
    return min(n_a - only_a, n_b - only_b)


def _exact(words: int, num: int, den: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        last_text, last_set = None, None
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["text_a"], batch["text_b"], strict=True)):
                if x is not last_text and x != last_text:
                    last_text, last_set = x, shingle_set(x, words, hashes)
                other = shingle_set(y, words, hashes)
                both = np.intersect1d(last_set, other, assume_unique=True).size
                union = last_set.size + other.size - both
                good[i] = den * both >= num * union
            yield batch.loc[good, ["a", "b"]]

    return compare


def _slot_levels(texts: DataFrame, words: int):
    """How much fuller than the mean each slot of shingle hashes is, as powers of two.

    The table has a fixed size whatever the input.  Tasks report slots that are fuller
    than twice their own mean, a small share of all.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        counts = np.zeros(_SLOTS, np.uint32)
        pending, waiting, total = [], 0, 0
        for batch in batches:
            for text in batch["text"]:
                found = shingle_set(text, words, hashes)
                pending.append((found & np.uint64(_SLOTS - 1)).astype(np.uint32))
                waiting += found.size
                if waiting > 2_000_000:
                    counts += np.bincount(np.concatenate(pending), minlength=_SLOTS).astype(np.uint32)
                    pending, total, waiting = [], total + waiting, 0
        if waiting:
            counts += np.bincount(np.concatenate(pending), minlength=_SLOTS).astype(np.uint32)
            total += waiting
        full = np.flatnonzero(counts > 2 + 2 * total / _SLOTS)
        yield pd.DataFrame({"slot": full.astype(np.int32), "seen": counts[full].astype(np.int64)})
        yield pd.DataFrame({"slot": np.array([-1], np.int32), "seen": np.array([total], np.int64)})

    counted = saved(
        texts.select("text").mapInPandas(count, "slot int, seen long").groupBy("slot").agg(F.sum("seen").alias("seen")),
        "shingle_slots",
    )
    total = counted.where("slot = -1").agg(F.sum("seen")).first()[0] or 0
    mean = total / _SLOTS
    # far beyond what chance would put into a slot
    full = counted.where("slot >= 0").where(F.col("seen") > 8 + mean + 6 * mean**0.5)
    full = full.toPandas()  # fewer than slots, of which there is a fixed number
    levels = np.zeros(_SLOTS, np.uint8)
    levels[full["slot"].to_numpy()] = (1 + np.log2(full["seen"].to_numpy() / (1 + mean))).astype(np.uint8)
    return texts.sparkSession.sparkContext.broadcast(levels)


def _features(texts: DataFrame, words: int, num: int, den: int, levels) -> DataFrame:
    schema = "row long, n int, node long, prefix array<long>, bits binary, "
    schema += ", ".join(f"{m} long" for m in _MARKS)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        level_of = levels.value
        for batch in batches:
            sizes, nodes, prefixes, bitmaps, marks = [], [], [], [], []
            for text in batch["text"]:
                found = shingle_set(text, words, hashes)
                size = found.size
                sizes.append(size)
                raw = found.tobytes()
                nodes.append(xxhash.xxh3_64_intdigest(raw, seed=size))
                level = level_of[(found & np.uint64(_SLOTS - 1)).astype(np.int64)]
                head = size - -(-num * size // den) + 1 if size else 0
                if level.any():
                    first = found[np.lexsort((found, level))[:head]]
                else:
                    first = found[:head]
                prefixes.append(first.view(np.int64))
                bitmaps.append(bitmap(found))
                marks.append(np.frombuffer(bitmap(found, 9, 9), np.int64))
            columns = np.array(marks, np.int64).reshape(-1, len(_MARKS))
            yield pd.DataFrame(
                {
                    "row": batch["row"],
                    "n": np.array(sizes, np.int32),
                    "node": np.array(nodes, np.uint64).view(np.int64),
                    "prefix": prefixes,
                    "bits": bitmaps,
                }
                | {m: columns[:, i] for i, m in enumerate(_MARKS)}
            )

    return texts.mapInPandas(describe, schema)
