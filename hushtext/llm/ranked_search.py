"""Ranked lexical search with a K2-treap over the term-document grid.

A block of documents is a grid: a row for each term that some item of the tile holds, a
column for each document, and in a cell the impact of the term in the document.  The
K2-treap is the quadtree over that grid without its empty parts.  A node holds the largest
impact of its square and four bits for the quadrants that are not empty; children lie side
by side on the next level, so the first child of a node is found by rank and there are no
pointers.

An item is a set of rows.  For a range of documents its state is one node for each of its
rows, the square of that row and range; the sum of their maxima bounds the score of every
document of the range.  Ranges are halved best-first, all rows at once, down to single
documents, where the bound is the score.  Ranges whose bound is below the item's ``k``-th
best score so far are dropped; that score is carried from block to block within a task.

Impacts need corpus statistics, so texts are read twice: once for the number of documents
and terms and the document frequencies of the items' terms, once for blocks and search.
Postings never leave their task; the only rows that are shuffled are ``k`` for each item
and task.  Items come in tiles of about ``TILE``, whose terms travel with the job.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushtext.llm.common import saved, slices
from hushtext.sources.scratch import scratch_path

TILE = 500
BLOCK = 4_096  # documents of a block
_PART_BYTES = 4_000_000
_CHUNK = 48  # ranges that are halved together, at first
_COMMON = 64  # a term in more than one of so many documents is a common one
_SALTS = 64

# digits, letters and everything beyond ASCII stay, A-Z are lowered, the rest separates
_TERMS = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in (ord(chr(b).lower()) if b < 0x80 else b for b in range(256))
)
# offset of the child in quadrant q of a node with the given bits, -1 if it is empty
_CHILD = np.array(
    [[(m & ((1 << q) - 1)).bit_count() if m >> q & 1 else -1 for q in range(4)] for m in range(16)],
    np.int64,
)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, ASCII digits and characters beyond ASCII; A-Z are lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    tile: int = TILE,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each item.

    Only documents with a score above 0 are returned, ties go to the smaller id, a null id
    last.  Null and empty texts, and texts without a term, are no documents to the
    statistics and match nothing; such an item has no rows.  Every row of ``docs`` is a document of its
    own, also if it repeats an id or a text; every row of ``items`` is an item of its own,
    so a repeated item id gets its list as often.  Other columns play no part.  Empty
    tables give an empty one.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(item_id).alias("item_id"),
        F.col(item_text).alias("text"),
    )
    asked = saved(asked, "search_items")
    tiles = max(1, -(-asked.count() // tile))
    found = []
    for number in range(tiles):
        chosen = asked.where(F.pmod(F.xxhash64("row"), F.lit(tiles)) == number)
        best = _search(texts, chosen, k)
        if tiles > 1:
            path = scratch_path(docs.sparkSession, "search_tile")
            best.write.parquet(path)
            best = docs.sparkSession.read.schema(best.schema).parquet(path)
        found.append(best)
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # the lists of many tasks shrink in parts before they meet
    some = Window.partitionBy("row", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    whole = Window.partitionBy("row").orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return best.join(asked.select("row", "item_id"), "row").select(
        "item_id", "rank", "doc_id", "score"
    )


@dataclass
class Queries:
    """The items of a tile as rows of the grid, and what impacts are made of."""

    rows: dict[bytes, int]
    weights: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray]]  # row of the item, its rows, how often
    documents: int
    terms: int

    def length_norm(self, words: int) -> int:
        return 100 - 25 + (25 * words * self.documents) // self.terms


def _search(texts: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    counted = [(r.row, Counter(terms_of(r.text))) for r in chosen.select("row", "text").toLocalIterator()]
    queries = _weighed(texts, counted)
    sent = texts.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        lists = [Best(k) for _ in queries.items]
        for block in _blocks(batches, queries):
            grid = Treap.build(block, queries)
            if grid:
                for (_, rows, times), best in zip(queries.items, lists, strict=True):
                    grid.descend(rows, times, best)
        found = [
            (row, doc, score)
            for (row, _, _), best in zip(queries.items, lists, strict=True)
            for score, doc in best.ranked()
        ]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["row", "doc_id", "score"]
        )

    return texts.mapInArrow(search, "row long, doc_id long, score long")


def _weighed(texts: DataFrame, counted: list[tuple[int, Counter]]) -> Queries:
    """One pass over the texts for the weights of the items' terms.

    What comes to the driver are one row for each term of the tile and two more.
    """
    terms = list(dict.fromkeys(t for _, counts in counted for t in counts))
    sent = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        seen = np.zeros(len(known) + 2, np.int64)
        for _, words, numbers in _documents(batches, known):
            seen[np.unique(numbers[numbers >= 0])] += 1
            seen[-2] += bool(words)
            seen[-1] += words
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["i", "n"])

    sums = np.zeros(len(terms) + 2, np.int64)
    for row in texts.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        sums[row.i] = row.n
    documents, total = int(sums[-2]), max(1, int(sums[-1]))
    frequency = dict(zip(terms, sums.tolist(), strict=False))
    weight = {
        t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in frequency.items()
    }
    # the grid has common terms first and then those that only few items share, item by item
    order = [t for t in terms if frequency[t] and weight[t] > 0]
    order.sort(key=lambda t: (0, -frequency[t]) if frequency[t] * _COMMON > documents else (1, 0))
    rows = {t: i for i, t in enumerate(order)}
    items = []
    for row, counts in counted:
        own = sorted((rows[t], n) for t, n in counts.items() if t in rows)
        if own:
            items.append((row, *np.array(own, np.int64).T))
    weights = np.array([weight[t] for t in order], np.int64)
    return Queries(rows, weights, items, documents, total)


def _documents(
    batches: Iterator[pa.RecordBatch], known: dict[bytes, int]
) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Id, number of terms and the numbers of the known ones (-1: unknown) of each row."""
    for batch in batches:
        ids, at = batch.column(0).to_pylist(), 0
        for part in slices(batch.column(1), _PART_BYTES):
            for text in part.to_pylist():
                words = terms_of(text)
                numbers = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                yield ids[at], len(words), numbers
                at += 1


@dataclass
class Block:
    ids: list[int | None] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)  # distinct terms of each document
    impacts: list[np.ndarray] = field(default_factory=list)
    leading: list[int] = field(default_factory=list)


def _blocks(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[Block]:
    block = Block()
    for doc, words, numbers in _documents(batches, queries.rows):
        rows, often = np.unique(numbers[numbers >= 0], return_counts=True)
        if rows.size:
            norm = queries.length_norm(words)
            block.ids.append(doc)
            block.rows.append(rows)
            block.impacts.append(
                queries.weights[rows] * ((1_000_000_000 * often) // (1000 * often + 12 * norm))
            )
            block.leading.append(int(rows[often.argmax()]))
        if len(block.ids) >= BLOCK:
            yield block
            block = Block()
    if block.ids:
        yield block


def _spread(values: np.ndarray) -> np.ndarray:
    """Bits of values below 2^31 with a gap after each."""
    x = values.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Best:
    """The ``k`` best scores so far, ties to the smaller id, a null id last."""

    def __init__(self, k: int):
        self.k = k
        self.kept: list[tuple[int, bool, int]] = []  # minus the score, whether the id is null, id

    def least(self) -> int:
        """Scores below this one are of no use."""
        return -self.kept[-1][0] if len(self.kept) == self.k else 1

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        new = [(-s, d is None, d or 0) for s, d in zip(scores.tolist(), ids, strict=True)]
        self.kept = heapq.nsmallest(self.k, self.kept + new)

    def ranked(self) -> list[tuple[int, int | None]]:
        return [(-s, None if null else d) for s, null, d in self.kept]


@dataclass
class Treap:
    """Levels from single cells up; the last entry of each array is an empty node."""

    ids: np.ndarray
    masks: list[np.ndarray]
    firsts: list[np.ndarray]
    maxima: list[np.ndarray]

    @classmethod
    def build(cls, block: Block, queries: Queries) -> Treap | None:
        if not queries.items:
            return None
        # documents with the same leading term lie together, so those of a language do
        order = np.argsort(block.leading, kind="stable")
        columns = np.empty(order.size, np.int64)
        columns[order] = np.arange(order.size)
        column = np.repeat(columns, [r.size for r in block.rows])
        row = np.concatenate(block.rows)
        impact = np.concatenate(block.impacts)
        codes = (_spread(row) << np.uint64(1)) | _spread(column)
        by_code = np.argsort(codes)
        codes, top = codes[by_code], impact[by_code]
        depth = max(1, int(max(len(queries.rows) - 1, order.size - 1)).bit_length())
        masks, firsts, maxima = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.append(top, 0)]
        for _ in range(depth):
            above = codes >> np.uint64(2)
            first = np.concatenate(([0], np.flatnonzero(above[1:] != above[:-1]) + 1))
            bits = np.int64(1) << (codes & np.uint64(3)).astype(np.int64)
            masks.append(np.append(np.bitwise_or.reduceat(bits, first), 0))
            firsts.append(np.append(first, 0))
            top = np.maximum.reduceat(top, first)
            maxima.append(np.append(top, 0))
            codes = above[first]
        ids = np.empty(order.size, object)
        ids[columns] = block.ids
        return cls(ids, masks, firsts, maxima)

    def descend(self, rows: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Put the best documents of the grid into ``best``."""
        depth = len(self.masks) - 1
        # groups of ranges of a level: minus the best bound, a serial number, the level,
        # the bounds, the ranges and the nodes of all rows, by bound
        root = np.zeros((1, rows.size), np.int64)
        open_ = [(0, 0, depth, np.array([np.iinfo(np.int64).max]), np.zeros(1, np.int64), root)]
        serial = 0
        while open_:
            top, _, level, bounds, ranges, nodes = heapq.heappop(open_)
            least = best.least()
            if top and -top < least:
                break
            good = bounds >= least
            ranges, nodes = ranges[good], nodes[good]
            mask, first = self.masks[level][nodes], self.firsts[level][nodes]
            quadrant = 2 * ((rows >> (level - 1)) & 1)
            halves = []
            for half in (0, 1):
                offset = _CHILD[mask, quadrant + half]
                child = np.where(offset < 0, -1, first + offset)
                bound = self.maxima[level - 1][child] @ times
                good = np.flatnonzero(bound >= least)
                halves.append((bound[good], ranges[good] * 2 + half, child[good]))
            bounds, ranges, nodes = map(np.concatenate, zip(*halves, strict=True))
            if not bounds.size:
                continue
            if level == 1:
                best.add(bounds, self.ids[ranges].tolist())
                continue
            order = np.argsort(-bounds)
            at, width = 0, _CHUNK
            while at < order.size:
                some = order[at : at + width]
                serial += 1
                heapq.heappush(
                    open_, (-int(bounds[some[0]]), serial, level - 1, bounds[some], ranges[some], nodes[some])
                )
                at, width = at + width, width * 2
