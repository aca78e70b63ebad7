"""Chat formatting with repair of the order of turns at least cost.

A conversation is legal if it has at most one system turn, at its start, and then user
and assistant turns in alternation that end with the assistant.  Turns that break this are
merged into the turn before, given another role, or preceded by an empty turn; dynamic
programming over the automaton finds the cheapest way.

The last role that was written is the automaton's state, so the effect of any run of
turns is a small matrix of costs from state to state.  Turns are numbered within their
conversation, by ranges of the order and offsets, and cut by that number into blocks, and
blocks into spans; tasks work on blocks, the matrices of a span's blocks are chained, then
those of a conversation's spans, and with the state at both ends of each span, then of
each block known the blocks are repaired and rendered on their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushtext.llm.common import saved

ROLES = ("system", "user", "assistant")
BLOCK_TURNS = 256
SPAN_BLOCKS = 4_096
# ties of turn and role go by so much of the text, then by its hash: keys of ranges are short
HEAD_CHARS = 64
START, SYSTEM, USER, ASSISTANT = range(4)  # states: the role written last
_FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
KEEP, MERGE, RELABEL, INSERT = "keep", "merge", "relabel", "insert"
MERGE_COST, MERGE_OTHER_COST, RELABEL_COST, INSERT_COST = 1, 3, 2, 2
_FAR = 1 << 40


def _moves() -> list[list[tuple[int, int, int, str, int]]]:
    """By role (0 unknown): ``from, to, cost, action, inserted role (0 none)``.

    Ties are broken by this order.
    """
    table = []
    for role in range(4):
        moves = []
        for state in range(4):
            for to in _FOLLOWS[state]:
                if to == role:
                    moves.append((state, to, 0, KEEP, 0))
            if state != START:
                cost = MERGE_COST if role == state else MERGE_OTHER_COST
                moves.append((state, state, cost, MERGE, 0))
            for to in _FOLLOWS[state]:
                if to != role:
                    moves.append((state, to, RELABEL_COST, RELABEL, 0))
            for between in _FOLLOWS[state]:
                for to in _FOLLOWS[between]:
                    if to == role:
                        moves.append((state, to, INSERT_COST, INSERT, between))
        table.append(moves)
    return table


MOVES = _moves()


def role_number(role: str | None) -> int:
    """1 to 3; 0 for null and unknown roles.  Case and outer spaces do not matter."""
    name = role.strip().lower() if role else ""
    return ROLES.index(name) + 1 if name in ROLES else 0


def transfer(roles: list[int]) -> np.ndarray:
    """Least cost from each state (row) to each state over a run of turns."""
    cost = np.full((4, 4), _FAR)
    np.fill_diagonal(cost, 0)
    for role in roles:
        step = np.full((4, 4), _FAR)
        for state, to, price, _, _ in MOVES[role]:
            step[:, to] = np.minimum(step[:, to], cost[:, state] + price)
        cost = step
    return np.minimum(cost, _FAR)


def repair(roles: list[int], first: int, last: int) -> list[tuple[int, str, int, int]]:
    """``state before, action, role, inserted role`` of each turn, cheapest way."""
    costs = [_FAR] * 4
    costs[first] = 0
    back = []
    for role in roles:
        new, how = [_FAR] * 4, [None] * 4
        for move in MOVES[role]:
            price = costs[move[0]] + move[2]
            if price < new[move[1]]:
                new[move[1]], how[move[1]] = price, move
        costs = new
        back.append(how)
    found, state = [], last
    for how in reversed(back):
        move = how[state]
        found.append((move[0], move[3], state, move[4]))
        state = move[0]
    return found[::-1]


def missing_end(state: int) -> tuple[int, ...]:
    """Roles of the empty turns that make a conversation ending in ``state`` legal."""
    return {USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}.get(state, ())


def render(before: int, action: str, role: int, inserted: int, text: str | None) -> str:
    """A turn as text; it closes the turn before it unless merged into that one."""
    if action == MERGE:
        return "\n" + (text or "")
    closed = "<|end|>\n" if before != START else ""
    empty = f"<|{ROLES[inserted - 1]}|>\n<|end|>\n" if inserted else ""
    return f"{closed}{empty}<|{ROLES[role - 1]}|>\n{text or ''}"


def ending(state: int) -> str:
    """What closes a conversation."""
    return "<|end|>\n" + "".join(f"<|{ROLES[r - 1]}|>\n<|end|>\n" for r in missing_end(state))


def chained(costs: list) -> np.ndarray:
    """Least cost from state to state over runs of turns that follow each other."""
    whole = transfer([])
    for cost in costs:
        step = np.asarray(cost).reshape(4, 4)
        whole = np.minimum((whole[:, :, None] + step[None]).min(axis=1), _FAR)
    return whole


def states(costs: list, first: int = START, last: int | None = None) -> list[int]:
    """States before, between and after runs of turns on the cheapest way.

    Without ``last`` the way ends where a legal end costs least.
    """
    best = np.full(4, _FAR)
    best[first] = 0
    back = []
    for cost in costs:
        total = best[:, None] + np.asarray(cost).reshape(4, 4)
        back.append(total.argmin(axis=0))
        best = np.minimum(total.min(axis=0), _FAR)
    if last is None:
        last = min(range(4), key=lambda s: (best[s] + INSERT_COST * len(missing_end(s)), s))
    way = [last]
    for choice in reversed(back):
        way.append(int(choice[way[-1]]))
    return way[::-1]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` and ``place``, the turn's number in its conversation.

    Rows are dealt out by ranges of their whole order, so a conversation of any size, also
    one of equal rows, lies in as many ranges as its share of the table.  A turn's number
    is its place in its range and conversation after the conversation's rows in the ranges
    before, of which only the counts meet in one task.
    """
    rows = turns.select("conv_id", "turn", "role", "text").withColumns(
        {
            "head": F.substring("text", 1, HEAD_CHARS),
            "hash": F.xxhash64("text"),
            "row": F.monotonically_increasing_id(),
        }
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "head", "hash", "row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number counts rows within a partition and has the partition's above them
    at = F.monotonically_increasing_id()
    dealt = saved(dealt.select("conv_id", "turn", "role", "text", at.alias("at")), "chat_turns")
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    counts = dealt.groupBy("conv_id", "range").agg(F.min("at").alias("start"), F.count("at").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))
    counts = counts.select(
        F.col("conv_id").alias("c_conv"), F.col("range").alias("c_range"), (before - F.col("start")).alias("shift")
    )
    met = F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("range") == F.col("c_range"))
    return dealt.join(counts, met).select(
        "conv_id", "turn", "role", "text", (F.col("at") + F.col("shift")).alias("place")
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Repair and render the conversations of ``conv_id, turn, role, text``.

    One row per input row: ``conv_id``, ``turn``, ``role``, ``action`` (keep, merge,
    relabel or insert; insert means an empty turn was put before), ``role_out``,
    ``inserted`` (the role of that empty turn, else null), ``rendered``, ``place`` (the
    turn's number in its conversation, from 0).  A conversation is its rows'
    ``rendered`` in order of ``place``, one after the other.  Turns come in order of
    ``turn``, nulls first, ties by role, the first 64 characters of the text and the
    text's hash, nulls first; repeated rows are turns too.  A null or unknown role may
    become any; a null text is empty; rows with a null ``conv_id`` are one conversation.
    Any number of turns may be null or equal.  Other columns play no part.  An empty
    table gives an empty one.
    """
    rows = numbered_turns(turns).withColumn("block", F.expr(f"place div {BLOCK_TURNS}"))
    keys, spans = ["conv_id", "block"], ["conv_id", "span"]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    conv = f"conv_id {kind['conv_id']}"

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (
            (*key, transfer(list(map(role_number, run["role"]))).ravel().tolist())
            for key, run in _runs(batches, keys)
        )
        yield from _frames(found, [*keys, "costs"])

    costs = saved(
        rows.select(*keys, "place", "role")
        .repartition(*keys).sortWithinPartitions(*keys, "place")
        .mapInPandas(matrices, f"{conv}, block long, costs array<long>"),
        "chat_costs",
    ).withColumn("span", F.expr(f"block div {SPAN_BLOCKS}"))

    def span_matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ((*key, chained(run["costs"]).ravel().tolist()) for key, run in _runs(batches, spans))
        yield from _frames(found, [*spans, "costs"])

    def span_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (
            (key[0], span, way[i], way[i + 1], i + 2 == len(way))
            for key, run in _runs(batches, ["conv_id"])
            for way in [states(run["costs"])]
            for i, span in enumerate(run["span"])
        )
        yield from _frames(found, [*spans, "first", "last", "final"])

    def block_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (
            (key[0], block, way[i], way[i + 1], run["final"][0] and i + 2 == len(way))
            for key, run in _runs(batches, spans)
            for way in [states(run["costs"], run["first"][0], run["last"][0])]
            for i, block in enumerate(run["block"])
        )
        yield from _frames(found, [*keys, "first", "last", "final"])

    ends = "first int, last int, final boolean"
    ways = (
        costs.repartition(*spans).sortWithinPartitions(*spans, "block")
        .mapInPandas(span_matrices, f"{conv}, span long, costs array<long>")
        .repartition("conv_id").sortWithinPartitions(*spans)
        .mapInPandas(span_ends, f"{conv}, span long, {ends}")
    )
    paths = (
        _met(costs, ways, "span")
        .repartition(*spans).sortWithinPartitions(*spans, "block")
        .mapInPandas(block_ends, f"{conv}, block long, {ends}")
    )
    marked = _met(rows, paths, "block")

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for key, run in _runs(batches, keys):
                plan = repair(list(map(role_number, run["role"])), run["first"][0], run["last"][0])
                for i, (before, action, role, inserted) in enumerate(plan):
                    text = render(before, action, role, inserted, run["text"][i])
                    if i + 1 == len(plan) and run["final"][0]:
                        text += ending(role)
                    empty = ROLES[inserted - 1] if inserted else None
                    yield (
                        key[0], run["turn"][i], run["role"][i], action, ROLES[role - 1], empty, text,
                        run["place"][i],
                    )

        names = ["conv_id", "turn", "role", "action", "role_out", "inserted", "rendered", "place"]
        yield from _frames(each(), names)

    out = (
        f"{conv}, turn {kind['turn']}, role string, action string, "
        "role_out string, inserted string, rendered string, place long"
    )
    return marked.repartition(*keys).sortWithinPartitions(*keys, "place").mapInPandas(rendered, out)


def _met(rows: DataFrame, ends: DataFrame, part: str) -> DataFrame:
    """``rows`` with the states at both ends of their ``part`` of a conversation."""
    ends = ends.withColumnsRenamed({"conv_id": "p_conv", part: "p_part"})
    met = F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col(part) == F.col("p_part"))
    return rows.join(ends, met).drop("p_conv", "p_part")


def _frames(rows, names: list[str], size: int = 2_000) -> Iterator[pd.DataFrame]:
    """Rows gathered into frames of bounded size."""
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield pd.DataFrame(part, columns=names, dtype=object)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]):
    """Rows of equal ``keys`` that follow each other: the key, lists by column."""
    key, run = None, {}
    for batch in batches:
        columns = {c: [None if _null(x) else x for x in batch[c].tolist()] for c in batch}
        for i, now in enumerate(zip(*[columns[k] for k in keys], strict=True)):
            if run and now != key:
                yield key, run
                run = {}
            key = now
            for name, values in columns.items():
                run.setdefault(name, []).append(values[i])
    if run:
        yield key, run


def _null(x) -> bool:
    return x is None or isinstance(x, float) and x != x
