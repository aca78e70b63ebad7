"""Periodic runs of words, by a branching-tandem test on an enhanced suffix array.

A run is a stretch of words with a smallest period ``q`` that no neighbouring word extends.
Its last square, the ``2 q`` words at its right end, starts at two suffixes that share
exactly ``q`` words: they lie in one LCP interval of depth ``q``, in different children.
So for each interval the suffixes of all children but the largest are asked whether the
suffix ``q`` words before or after lies in the same interval and in another child.  Each
square found that way is rotated to the left as far as the words agree, which gives the
whole run.  Intervals come from a stack over the LCP array and are not kept.

Of a square whose period is a multiple of a smaller one the run has been found before, as
squares are taken in the order of their periods.

Arrays are built for many texts at once, with the text as the first part of each key, so
that suffixes of different texts share nothing.  A run of at least ``min_length`` words
and ``min_exponent`` periods repeats ``min_length * (min_exponent - 1) / min_exponent``
words, rounded up, at a distance of its period; texts in which no stretch of that many
words repeats hold none and are left out before suffixes are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hushtext.llm.common import slices

_PART_BYTES = 1_500_000  # of texts whose arrays are built together; a longer text stands alone
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SMALL = 48  # children with fewer suffixes are asked one by one

_TYPE = "n_words int, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def run_finder(min_length: int = 24, min_exponent: int = 3):
    """Column function from a text to ``struct<n_words, runs, collapsed>``.

    Words lie between ASCII white space and are numbered from 0.  ``runs`` holds
    ``start, length, period`` of every run of at least ``min_length`` words and
    ``min_exponent`` (2 or more) periods, by start, then period.  ``collapsed`` is the text
    without the words that some run holds after its first period, joined by single spaces.
    A null or empty text, or one of white space, has no words, no runs and an empty
    ``collapsed``.  Memory follows the longest text: some 100 bytes a word.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")

    @F.arrow_udf(_TYPE)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch, _PART_BYTES):
                texts = [
                    (t or "").encode("utf-8", "surrogatepass").split() for t in part.to_pylist()
                ]
                found = find_runs(texts, min_length, min_exponent)
                kept = [
                    _collapsed(words, runs).decode("utf-8", "surrogatepass")
                    for words, runs in zip(texts, found, strict=True)
                ]
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found]
                yield pa.StructArray.from_arrays(
                    [
                        pa.array(map(len, texts), pa.int32()),
                        pa.array(runs, pa.list_(_RUN)),
                        pa.array(kept, pa.string()),
                    ],
                    ["n_words", "runs", "collapsed"],
                )

    return find


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    covered = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        covered[start + period] += 1
        covered[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    return b" ".join(map(words.__getitem__, keep.tolist()))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def find_runs(
    texts: list[list[bytes]], min_length: int, min_exponent: int
) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each list of words."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    number = _Numbers().__getitem__
    sizes = np.array([len(w) for w in texts], np.int64)
    symbols = np.fromiter((number(w) for words in texts for w in words), np.int64, int(sizes.sum()))
    least = -(-min_length * (min_exponent - 1) // min_exponent)
    chosen = _repeating(symbols, sizes, max(1, least))
    if not chosen.size:
        return found
    starts = np.concatenate(([0], np.cumsum(sizes)))
    symbols = np.concatenate([symbols[starts[t] : starts[t + 1]] for t in chosen])
    sizes = sizes[chosen]
    order, inverse, lcp = enhanced_suffix_array(symbols, sizes)
    at = 0
    for text, size in zip(chosen.tolist(), sizes.tolist(), strict=True):
        here = slice(at, at + size)
        squares = _branching_squares(
            order[here] - at, inverse[here] - at, lcp[here], size // min_exponent
        )
        found[text] = _rotate(symbols[here], squares, min_length, min_exponent)
        at += size
    return found


def _repeating(symbols: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """The texts in which some stretch of ``words`` words occurs twice (or seems to)."""
    count = symbols.size - words + 1
    if count <= 1:
        return np.empty(0, np.int64)
    mixed = (symbols.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    rolled = mixed[:count].copy()
    for i in range(1, words):
        rolled *= _FACTOR
        rolled += mixed[i : i + count]
    text = np.repeat(np.arange(sizes.size), sizes)
    inside = text[:count] == text[words - 1 :]
    rolled = (rolled + text[:count].astype(np.uint64) * _MIX)[inside]
    text = text[:count][inside]
    order = np.argsort(rolled)
    twice = rolled[order[1:]] == rolled[order[:-1]]
    return np.unique(text[order[1:]][twice])


def enhanced_suffix_array(
    symbols: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the LCP array of texts that lie one after the other.

    Suffixes are sorted text by text.  ``lcp[i]`` is the number of symbols that the
    suffixes ``i - 1`` and ``i`` of a text share, 0 for its first.
    """
    n = symbols.size
    ends = np.repeat(np.cumsum(sizes), sizes)
    places = np.arange(n, dtype=np.int64)
    text = np.repeat(np.arange(sizes.size), sizes)
    rank, order = _dense(text * (int(symbols.max(initial=0)) + 1) + symbols)
    levels, step = [rank], 1  # classes of suffixes by their first 1, 2, 4, ... symbols
    while rank[order[-1]] + 1 < n:
        after = places + step
        inside = after < ends
        second = np.zeros(n, np.int64)
        second[inside] = rank[after[inside]] + 1
        rank, order = _dense(rank * np.int64(n + 1) + second)
        levels.append(rank)
        step *= 2
    lcp = np.zeros(n, np.int64)
    same = np.flatnonzero(text[order[1:]] == text[order[:-1]]) + 1
    a, b = order[same - 1], order[same]
    shared = np.zeros(same.size, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = np.flatnonzero((x < ends[a]) & (y < ends[b]))
        equal = levels[level][x[inside]] == levels[level][y[inside]]
        shared[inside[equal]] += 1 << level
    lcp[same] = shared
    return order, rank.astype(np.int64), lcp


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    values = keys[order]
    rank = np.empty(keys.size, np.int32)
    rank[order] = np.concatenate(([0], np.cumsum(values[1:] != values[:-1])))
    return rank, order


def _branching_squares(
    order: np.ndarray, inverse: np.ndarray, lcp: np.ndarray, longest: int
) -> list[tuple[int, int]]:
    """``(period, start)`` of all branching squares of periods up to ``longest``, sorted."""
    found: set[tuple[int, int]] = set()
    suffix, place, shared = order.tolist(), inverse.tolist(), lcp.tolist()
    size = len(suffix)

    def ask(depth: int, left: int, right: int, starts: list[int]) -> None:
        """``starts``: where the children of the interval ``left`` to ``right`` begin."""
        bounds = [*starts, right + 1]
        lengths = [y - x for x, y in zip(bounds, bounds[1:], strict=False)]
        largest = lengths.index(max(lengths))
        for child, length in enumerate(lengths):
            if child == largest:
                continue
            first = bounds[child]
            if length < _SMALL:
                for i in suffix[first : first + length]:
                    if i + depth < size:
                        other = place[i + depth]
                        if left <= other <= right and not first <= other < first + length:
                            found.add((depth, i))
                    if i >= depth:
                        other = place[i - depth]
                        if left <= other <= right and not first <= other < first + length:
                            found.add((depth, i - depth))
                continue
            members = order[first : first + length]
            for shift in (depth, -depth):
                near = members[(members + shift >= 0) & (members + shift < size)]
                other = inverse[near + shift]
                hit = (other >= left) & (other <= right)
                hit &= (other < first) | (other >= first + length)
                found.update((depth, i) for i in (near[hit] + min(shift, 0)).tolist())

    # depth, left end and beginnings of the children of the open intervals
    open_: list[tuple[int, int, list[int]]] = [(0, 0, [0])]
    for i in range(1, size + 1):
        depth = shared[i] if i < size else 0
        left = i - 1
        while open_[-1][0] > depth:
            closed, left, starts = open_.pop()
            if closed <= longest:
                ask(closed, left, i - 1, starts)
        if i < size and depth:
            if open_[-1][0] == depth:
                open_[-1][2].append(i)
            else:
                open_.append((depth, left, [left, i]))
    return sorted(found)


def _rotate(
    symbols: np.ndarray, squares: list[tuple[int, int]], min_length: int, min_exponent: int
) -> list[tuple[int, int, int]]:
    """Runs from their last squares, which come by period."""
    by_end: dict[int, list[tuple[int, int]]] = {}
    runs = []
    for period, start in squares:
        end = start + 2 * period
        known = by_end.setdefault(end, [])
        if any(period % q == 0 and first <= start for q, first in known):
            continue  # the run of a smaller period
        first, width = start, 16
        while first:
            low = max(0, first - width)
            differ = np.flatnonzero(
                symbols[low:first] != symbols[low + period : first + period]
            )
            if differ.size:
                first = low + int(differ[-1]) + 1
                break
            first, width = low, width * 4
        known.append((period, first))
        if end - first >= max(min_length, min_exponent * period):
            runs.append((first, end - first, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))
