"""Near-duplicate classes by SimHash, with a generalised pigeonhole join.

The 64 bits of a fingerprint are cut into parts, and each part gets a threshold of its
own: two fingerprints within ``distance`` bits agree, in some part ``i``, within ``t_i``
bits, if the thresholds sum to ``distance - parts + 1``.  A part may have the threshold -1
and is then not probed at all.  So every fingerprint may choose its own thresholds:

* Bits that go together are put into the same part, by the correlations over all distinct
  fingerprints.
* The number of candidates within ``t`` bits of a part's value is estimated from
  histograms of a fixed size, taking groups of some eleven bits as independent.
* Dynamic programming over the parts finds the thresholds of least cost, that is probes
  plus expected candidates.  The number of parts is the one of least total cost.

A fingerprint probes all values within the threshold of each part, and the pairs that meet
are verified.  Where a value of a part is held by more than ``BUCKET`` fingerprints, pairs
would grow with the square of that number.  The fingerprints that hold or probe such a
value are joined another way, as exact: two fingerprints are within two bits just if some
third value is within one bit of both, so each is put under the 65 values within one bit
and those under one value are linked in a star.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtext.llm.common import saved, slices
from hushtext.llm.components import members

BITS = 64
SEED = 42
BUCKET = 64
PARTS = (2, 3, 4)
_SUB_BITS = 11
_CHUNK = 32_768  # shingles whose bits are counted at once
_ROWS = 4_096  # fingerprints that are expanded into probes at once
_PART_BYTES = 4_000_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of all shingles of ``words`` words, repeats included; 0 without words.

    Words lie between ASCII white space, A-Z are lowered, a text of fewer words is one
    shingle.  A bit is 1 if it is set in over half of the XXH64 hashes (seed 42).
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    words = min(words, len(found))
    joined = b" ".join(found)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in found)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    count = len(found) - words + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, _CHUNK):
        spans = map(slice, starts[at : min(at + _CHUNK, count)], ends[at + words - 1 :])
        shingles = map(joined.__getitem__, spans)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def simhash(words: int = 3):
    """Column function from a text to its fingerprint as a long."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch, _PART_BYTES):
                yield pa.array((fingerprint(t, words) for t in part.to_pylist()), pa.int64())

    return prints


def simhash_classes(
    docs: DataFrame,
    words: int = 3,
    distance: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long), ``component_id`` for every row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``distance`` bits, an even
    number.  ``component_id`` is the smallest id reachable by links.  Null and empty texts,
    and texts of white space, have the fingerprint 0 and are linked like any other.  Rows
    that repeat an id are one document that is linked by any of its texts.  A null id gets
    the id of its class, null if it has none.  Other columns play no part.  An empty table
    gives an empty one.
    """
    if distance < 0 or distance % 2:
        raise ValueError("the distance is an even number of bits")
    hashed = simhash(words)(F.col(text).cast("string"))
    rows = saved(
        docs.select(F.col(doc_id).alias("doc_id"), hashed.alias("fingerprint")), "simhash_rows"
    )
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    prints = saved(prints, "simhash_prints")
    edges = close_pairs(prints.select("fingerprint"), distance).union(_same_id(rows))
    roots = members(saved(edges.distinct(), "simhash_links"))
    placed = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(least, "root").select("fingerprint", "component_id")
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _same_id(rows: DataFrame) -> DataFrame:
    """Edges between the fingerprints of rows that repeat an id."""
    twice = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")
    ).where("a <> b")
    # with three or more of them, each goes with the least
    return rows.join(twice.select("doc_id", "a"), "doc_id").selectExpr("a", "fingerprint AS b")


def close_pairs(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a``, ``b`` that connect whatever distinct fingerprints are within ``distance``.

    ``prints`` has one long column of distinct values.  Not every close pair is an edge,
    but the two are connected by edges between close pairs, or by way of a value within
    half the distance of both.
    """
    plan = _best_plan(prints, distance)
    index = saved(prints.mapInArrow(plan.index, "key long, fp long"), "simhash_index")
    probes = saved(prints.mapInArrow(plan.probes, "key long, fp long"), "simhash_probes")
    hot = saved(
        index.groupBy("key").count().where(F.col("count") > bucket).select("key"), "simhash_hot"
    )
    a = probes.join(hot, "key", "left_anti").withColumnRenamed("fp", "a")
    b = index.join(hot, "key", "left_anti").withColumnRenamed("fp", "b")
    near = F.expr(f"a < b AND bit_count(a ^ b) <= {distance}")
    pairs = a.join(b, (a["key"] == b["key"]) & near).select("a", "b")
    crowded = probes.union(index).join(hot, "key", "left_semi").select("fp").distinct()
    masks = [sum(1 << k for k in c) for r in range(distance // 2 + 1) for c in combinations(range(BITS), r)]
    masks = np.array(masks, np.uint64).view(np.int64).tolist()
    ball = F.expr(f"explode(transform(array({', '.join(f'{m}L' for m in masks if m != -(1 << 63))}"
                  f"{', shiftleft(1L, 63)' * (-(1 << 63) in masks)}), m -> fp ^ m))")  # fmt: skip
    # as many fingerprints as masks can meet under one value
    met = crowded.select("fp", ball.alias("value")).groupBy("value").agg(
        F.collect_list("fp").alias("fps"), F.min("fp").alias("a")
    )
    stars = met.where("size(fps) > 1").select("a", F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars)


# --- parts and thresholds --------------------------------------------------------------


def group_bits(alike: np.ndarray, bits: list[int], parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, correlated ones together."""
    left = list(bits)
    groups = []
    for i in range(parts):
        size = -(-len(left) // (parts - i))
        # the bit that goes most with the others, then those that go with the group
        group = [max(left, key=lambda b: (alike[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (alike[b, group].sum(), -b))  # noqa: B023
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def gathered(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as a number, the first as its lowest."""
    out = np.zeros(prints.size, np.int64)
    for place, bit in enumerate(bits):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << np.int64(place)
    return out


@dataclass
class Plan:
    """Parts of the bits, each made of sub-parts, and what is known of their values."""

    distance: int
    parts: list[list[list[int]]]
    near: list[list[np.ndarray]] | None = None  # share of fingerprints by distance, for each value
    total: int = 0

    def widths(self) -> list[int]:
        return [sum(map(len, part)) for part in self.parts]

    def values(self, prints: np.ndarray) -> list[np.ndarray]:
        return [gathered(prints, [b for sub in part for b in sub]) for part in self.parts]

    def costs(self, prints: np.ndarray) -> np.ndarray:
        """By part, fingerprint and units (threshold + 1): probes and expected candidates."""
        units = self.distance + 2
        out = np.zeros((len(self.parts), prints.size, units))
        for p, part in enumerate(self.parts):
            share = None
            for sub, near in zip(part, self.near[p], strict=True):
                one = near[gathered(prints, sub)]
                if share is None:
                    share = one
                    continue
                both = np.zeros_like(one)
                for i in range(one.shape[1]):
                    for j in range(one.shape[1] - i):
                        both[:, i + j] += share[:, i] * one[:, j]
                share = both
            width = self.widths()[p]
            probes = np.cumsum([len(list(combinations(range(width), t))) for t in range(units - 1)])
            out[p, :, 1:] = probes + self.total * np.cumsum(share, axis=1)
        return out

    def allocate(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of each part for every fingerprint, and the cost.

        Thresholds that sum to ``distance - parts + 1`` are ``distance + 1`` units.
        """
        costs = self.costs(prints)
        units = self.distance + 1
        best = costs[0][:, : units + 1]
        picks = []
        for cost in costs[1:]:
            options = np.full((prints.size, units + 1, units + 1), np.inf)
            for total in range(units + 1):
                for own in range(total + 1):
                    options[:, total, own] = best[:, total - own] + cost[:, own]
            picks.append(options.argmin(axis=2))
            best = options.min(axis=2)
        chosen = np.zeros((prints.size, len(self.parts)), np.int64)
        left = np.full(prints.size, units)
        rows = np.arange(prints.size)
        for p in range(len(self.parts) - 1, 0, -1):
            chosen[:, p] = picks[p - 1][rows, left]
            left = left - chosen[:, p]
        chosen[:, 0] = left
        return chosen, best[:, units]

    def index(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints in _parts_of(batches):
            for p, values in enumerate(self.values(prints)):
                yield _keyed(p, values, prints)

    def probes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints in _parts_of(batches):
            chosen, _ = self.allocate(prints)
            for p, values in enumerate(self.values(prints)):
                for units in range(1, self.distance + 2):
                    who = np.flatnonzero(chosen[:, p] == units)
                    masks = np.array(
                        [sum(1 << k for k in c) for t in range(units) for c in combinations(range(self.widths()[p]), t)],
                        np.int64,
                    )
                    step = max(1, 500_000 // masks.size)
                    for at in range(0, who.size, step):
                        some = who[at : at + step]
                        near = values[some][:, None] ^ masks[None, :]
                        yield _keyed(p, near.ravel(), np.repeat(prints[some], masks.size))


def _keyed(part: int, values: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    keys = values + (np.int64(part) << np.int64(40))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(prints.view(np.int64))], names=["key", "fp"]
    )


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, prints.size, _ROWS):
            yield prints[at : at + _ROWS]


def _best_plan(prints: DataFrame, distance: int) -> Plan:
    """The plan of least cost over all fingerprints.

    What comes to the driver has a fixed size: counts of pairs of bits, histograms of
    sub-parts, one sum of costs for each number of parts.
    """
    alike, total = _correlations(prints)
    plans = []
    for count in PARTS:
        parts = [
            group_bits(alike, part, -(-len(part) // _SUB_BITS))
            for part in group_bits(alike, list(range(BITS)), count)
        ]
        plans.append(Plan(distance, parts, total=total))
    _count_values(prints, plans)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(plans))
        for some in _parts_of(batches):
            for i, plan in enumerate(plans):
                sums[i] += plan.allocate(some)[1].sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(plans)), pa.int32()), pa.array(sums)], names=["plan", "cost"]
        )

    sums = prints.mapInArrow(costs, "plan int, cost double").groupBy("plan").agg(F.sum("cost").alias("cost"))
    best = min(sums.collect(), key=lambda r: (r.cost, r.plan), default=None)
    return plans[best.plan if best else 0]


def _correlations(prints: DataFrame) -> tuple[np.ndarray, int]:
    """How much each two bits go together, from -1 or 1 down to 0, without sign; rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, rows = np.zeros((BITS, BITS)), 0
        for some in _parts_of(batches):
            bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype(np.float32)
            both += bits.T @ bits
            rows += some.size
        cells = np.concatenate((both.ravel(), [rows])).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(cells.size), pa.int32()), pa.array(cells)], names=["cell", "n"]
        )

    found = prints.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(BITS * BITS + 1)
    for row in found.collect():  # 4,097 rows
        cells[row.cell] = row.n
    total = int(cells[-1])
    share = cells[:-1].reshape(BITS, BITS) / max(1, total)
    ones = np.diag(share)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    return np.abs((share - np.outer(ones, ones)) / np.outer(spread, spread)), total


def _count_values(prints: DataFrame, plans: list[Plan]) -> None:
    """Fill in the shares of fingerprints by distance from each value of each sub-part."""
    subs = [(plan, p, sub) for plan in plans for p, part in enumerate(plan.parts) for sub in part]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(1 << len(sub), np.int64) for _, _, sub in subs]
        for some in _parts_of(batches):
            for counts, (_, _, sub) in zip(seen, subs, strict=True):
                counts += np.bincount(gathered(some, sub), minlength=counts.size)
        for i, counts in enumerate(seen):
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(full.size, i, np.int32)), pa.array(full.astype(np.int32)), pa.array(counts[full])],
                names=["sub", "value", "n"],
            )

    found = prints.mapInArrow(count, "sub int, value int, n long").groupBy("sub", "value")
    tables = [np.zeros(1 << len(sub)) for _, _, sub in subs]
    for row in found.agg(F.sum("n").alias("n")).collect():  # as many as values, some 40,000
        tables[row["sub"]][row["value"]] = row["n"]
    for plan in plans:
        plan.near = [[] for _ in plan.parts]
    for (plan, p, sub), counts in zip(subs, tables, strict=True):
        values = np.arange(counts.size)
        near = [
            sum(counts[values ^ sum(1 << k for k in c)] for c in combinations(range(len(sub)), t))
            for t in range(plan.distance + 1)
        ]
        plan.near[p].append(np.stack(near, axis=1) / max(1, plan.total))
