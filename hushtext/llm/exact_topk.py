"""Exact search for the highest inner products, block by block.

Vectors in a range of ids form a block: a forward index (a matrix of integers) and,
for every term (component), the largest and smallest value in the block.  A query's
sum of its products with these maxima bounds every score in the block.  Each query takes
the blocks in order of their bounds and scores a block through its forward index; it is
done when the next bound falls below its k-th score.

Queries are packed into tiles and blocks into chunks, in the narrowest integers that
hold them; every tile meets every chunk once, in a cogroup by chunk and group of tiles.
A task holds one chunk and about ``GROUP_TILES`` tiles at a time, so memory does not grow
with either side; both are shuffled, and the driver gets the numbers of the chunks only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushtext.llm.common import saved

BLOCK = 512
CHUNK_BLOCKS = 32
TILE = 512
GROUP_TILES = 16
_FOUND = {"query_id": "int64", "vec_id": "int64", "score": "int64"}


def quantised(vector: str, scale: int = 64):
    """``floor(scale * x)`` of each component; null if one is null or not finite."""
    whole = F.forall(
        F.col(vector),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.when(
        whole, F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    skip_self: bool = True,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` highest per query.

    Both sides have ``vec_id`` (long) and ``vector`` (array of long).  Ties go to the
    smaller id.  Null ids or vectors take no part.  Vectors of different length are
    compared on the components both have.  With ``skip_self`` rows with the query's own
    id are no candidates.  A query id that is repeated is answered once per row, which
    then share their ranks' order; give distinct queries.  Fewer than ``k`` candidates
    give fewer rows; an empty side gives none.
    """
    chunks = saved(_packed(vectors, BLOCK * CHUNK_BLOCKS), "topk_chunks")
    tiles = saved(_packed(queries, TILE), "topk_tiles")
    groups = -(-(tiles.agg(F.sum("n")).first()[0] or 1) // (TILE * GROUP_TILES))
    # a number per 16,384 rows is all that is broadcast: copies of tiles would be
    # collected on the driver, as many as there are pairs of a tile and a chunk
    every = F.broadcast(chunks.select(F.col("number").alias("chunk")))
    left = tiles.withColumn("group", F.expr(f"pmod(xxhash64(number), {groups}L)")).crossJoin(every)
    right = chunks.withColumnRenamed("number", "chunk").withColumn(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    )
    schema = "query_id long, vec_id long, score long"
    found = (
        left.groupBy("chunk", "group")
        .cogroup(right.groupBy("chunk", "group"))
        .applyInPandas(_searcher(k, skip_self), schema)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _packed(vectors: DataFrame, most: int) -> DataFrame:
    """Rows of up to ``most`` vectors each, in ranges of ids."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = [], []

        def packed() -> pd.DataFrame:
            width = max(map(len, rows))
            matrix = np.zeros((len(rows), width), np.int64)
            for i, row in enumerate(rows):
                matrix[i, : len(row)] = row
            matrix = _narrowed(matrix)
            return pd.DataFrame(
                {
                    "n": [len(rows)], "width": [width], "kind": [matrix.dtype.str],
                    "ids": [np.array(ids, np.int64).tobytes()], "matrix": [matrix.tobytes()],
                }
            )

        for batch in batches:
            for i, row in zip(batch["vec_id"], batch["vector"], strict=True):
                ids.append(i)
                rows.append(row)
                if len(ids) == most:
                    yield packed()
                    ids, rows = [], []
        if ids:
            yield packed()

    usable = vectors.select("vec_id", "vector").where("vec_id IS NOT NULL AND vector IS NOT NULL")
    count = usable.count()
    ranged = usable.repartitionByRange(max(1, -(-count // most)), "vec_id")
    return (
        ranged.sortWithinPartitions("vec_id")
        .mapInPandas(pack, "n int, width int, kind string, ids binary, matrix binary")
        .select(F.monotonically_increasing_id().alias("number"), "*")
    )


def _narrowed(matrix: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest kind that holds them and their negatives."""
    least, most = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    for kind in (np.int8, np.int16, np.int32):
        if max(most, -least) <= np.iinfo(kind).max:
            return matrix.astype(kind)
    return matrix


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.frombuffer(row.matrix, np.dtype(row.kind)).reshape(row.n, row.width)
    return np.frombuffer(row.ids, np.int64), matrix


def _searcher(k: int, skip_self: bool):
    def search(tiles: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: np.empty(0, kind) for c, kind in _FOUND.items()})]
        for chunk in chunks.itertuples(index=False):
            ids, matrix = _unpacked(chunk)
            for tile in tiles.itertuples(index=False):
                found.append(search_chunk(*_unpacked(tile), ids, matrix, k, skip_self))
        return pd.concat(found, ignore_index=True)

    return search


def search_chunk(query_ids, query, ids, matrix, k, skip_self) -> pd.DataFrame:
    """The ``k`` best of one chunk for each query of a tile, by block pruning."""
    width = min(query.shape[1], matrix.shape[1])
    query, matrix = query[:, :width], matrix[:, :width]
    # products in floating point are exact while all sums stay below 2**24 or 2**53
    largest = float(np.abs(query).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * width
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    query, matrix = query.astype(kind), matrix.astype(kind)
    starts = range(0, len(ids), BLOCK)
    most = np.stack([matrix[s : s + BLOCK].max(axis=0) for s in starts])
    least = np.stack([matrix[s : s + BLOCK].min(axis=0) for s in starts])
    bounds = np.maximum(query, 0) @ most.T + np.minimum(query, 0) @ least.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    lowest = -np.inf if kind != np.int64 else -np.iinfo(np.int64).max
    scores = np.full((len(query), k), lowest, kind)
    found = np.full((len(query), k), np.iinfo(np.int64).max)
    every = np.arange(len(query))
    active = every
    for turn in range(len(starts)):
        # a query is done when its best remaining bound is below its k-th score
        active = active[bounds[active, order[active, turn]] >= scores[active, -1]]
        if not len(active):
            break
        turn_block = order[active, turn]
        for block in np.unique(turn_block):
            rows = active[turn_block == block]
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            new = query[rows] @ matrix[part].T
            new_ids = np.broadcast_to(ids[part], new.shape)
            if skip_self:
                own = new_ids == query_ids[rows][:, None]
                new = np.where(own, lowest, new)
                new_ids = np.where(own, np.iinfo(np.int64).max, new_ids)
            # only rows with a score that can enter the list
            high = (new >= scores[rows, -1:]) & (new_ids != np.iinfo(np.int64).max)
            if new.shape[1] > 4 * k:
                at = new.shape[1] - k
                high &= new >= np.partition(new, at, axis=1)[:, at : at + 1]
            for i in np.flatnonzero(high.any(axis=1)):
                all_scores = np.concatenate([scores[rows[i]], new[i, high[i]]])
                all_ids = np.concatenate([found[rows[i]], new_ids[i, high[i]]])
                best = np.lexsort((all_ids, -all_scores))[:k]
                scores[rows[i]], found[rows[i]] = all_scores[best], all_ids[best]
    at, rank = np.nonzero(found != np.iinfo(np.int64).max)
    return pd.DataFrame(
        {
            "query_id": query_ids[at],
            "vec_id": found[at, rank],
            "score": scores[at, rank].astype(np.int64),
        }
    )
