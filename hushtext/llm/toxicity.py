"""A toxicity classifier that is indifferent to which group a text mentions.

A logistic model over the presence of words and word beginnings.  For every labelled
text that names a group, a twin is made in which each identity term is swapped for
another of its kind; training penalises the squared difference of the two scores' logits,
so identity terms cannot carry weight of their own and neutral mentions of a group do
not raise the score.

Identity terms come from a lexicon, and for languages without one from the sample itself:
words that stand in like contexts (the nearest to each other by the words before and after
them) and are not tied to the label are swapped for each other.

The model is fitted on a sample of labelled rows of bounded size (``MAX_LABELLED``), with a
bounded number of features (``MAX_FEATURES``); scoring is one pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtext.llm.common import discard, saved, slices

MAX_LABELLED = 20_000
MAX_FEATURES = 4_096
LEARNED_TERMS = 400  # words of which swaps are learned, the most frequent ones
_PART_BYTES = 2_000_000  # of texts that are scored together
_ROWS = 64  # labelled texts that are described together
_CONTEXTS = 300  # neighbours that make up a context
# kinds of identity terms; a term is swapped for the next of its kind
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("deaf", "blind", "disabled"), ("old", "young"),
    ("immigrants", "refugees", "natives"),
)
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words, and the first 4 and 5 letters of longer ones."""
    found = set(_WORD.findall(text.lower())) if text else set()
    starts = {w[:4] + "*" for w in found if len(w) > 4}
    starts.update(w[:5] + "*" for w in found if len(w) > 5)
    return found | starts


def swap_identities(text: str | None, kinds=IDENTITY_TERMS) -> str | None:
    """The text with each identity term swapped; None if it has none."""
    if not text:
        return None
    turn = {t: k[(i + 1) % len(k)] for k in kinds for i, t in enumerate(k)}
    twin = _WORD.sub(lambda m: turn.get(m[0].lower(), m[0]), text)
    return None if twin == text else twin


@dataclass(frozen=True)
class ToxicityModel:
    """``twins``: labelled texts that had a twin; ``swaps``: the learned pairs."""

    weights: dict[str, float]
    bias: float
    twins: int = 0
    swaps: tuple[tuple[str, str], ...] = ()

    def scorer(self) -> Callable[[Column], Column]:
        """Column function from a text to its score."""
        weights, bias = self.weights, self.bias

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            weight = weights.get
            for batch in batches:
                for part in slices(batch, _PART_BYTES):
                    logits = []
                    for text in part.to_pylist():
                        total = bias
                        for token in sorted(weights.keys() & tokens(text)):
                            total += weight(token)
                        logits.append(total)
                    yield pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))), pa.float64())

        return score


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    fairness: float = 1.0,
    identities=IDENTITY_TERMS,
    max_features: int = MAX_FEATURES,
    learned_terms: int = LEARNED_TERMS,
) -> ToxicityModel:
    """Fit on ``labels`` (``doc_id``, ``label`` 0 or 1) and the texts of ``docs``.

    Rows with a null id or label are left out; of conflicting labels of an id the
    more frequent one counts, 1 on a tie.  Above ``max_labelled`` labelled documents
    about that many are taken, by a hash of the id; of rows that repeat an id the text that
    comes first by its bytes.  The model looks at the ``max_features`` words and word
    beginnings that say most about the label.  Swaps are learned for ``learned_terms``
    words, 0 for the lexicon ``identities`` alone.  Without labelled texts, or with
    labels of one kind, the score is the share of that kind (0 without labels).
    """
    known = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y"))
        .where("doc_id IS NOT NULL AND y IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    found = known.count()
    if found > max_labelled:
        share = int(max_labelled / found * (1 << 30))
        known = known.where(F.expr(f"(xxhash64(doc_id, 9) & {(1 << 30) - 1}) < {share}"))

    # about max_labelled rows of 12 bytes, however many documents there are
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(known), "doc_id"
    )
    sample = saved(
        sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")),
        "toxicity_rows",
    )
    swaps = learn_swaps(sample, learned_terms) if learned_terms else ()
    kinds = (*identities, *swaps)

    def describe(batches):
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                rows = []
                for y, text in batch[["y", "text"]].iloc[at : at + _ROWS].itertuples(index=False):
                    own, twin = tokens(text), swap_identities(text, kinds)
                    other = None if twin is None else tokens(twin)
                    rows.append((
                        y, list(own), other and list(own - other), other and list(other - own)
                    ))
                yield pd.DataFrame(rows, columns=["y", "found", "lost", "gained"])

    described = saved(
        sample.select("text", "y").mapInPandas(
            describe, "y int, found array<string>, lost array<string>, gained array<string>"
        ),
        "toxicity_sample",
    )
    rows, positive, twins = described.agg(F.count("*"), F.sum("y"), F.count("lost")).first()
    if not rows or positive in (0, rows):
        rate = (positive or 0) / max(1, rows)
        bias = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        return ToxicityModel({}, bias, twins, swaps)
    base = positive / rows
    seen = described.select("y", F.explode("found").alias("token")).groupBy("token")
    score = (F.col("hits") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    chosen = (
        seen.agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
        .where("n >= 5")
        .orderBy(F.abs(score).desc(), "token")
        .limit(max_features)
    )
    names = sorted(row.token for row in chosen.collect())
    index = {name: i for i, name in enumerate(names)}

    def encode(batches):
        pick = lambda ts: None if ts is None else sorted(index[t] for t in ts if t in index)
        for batch in batches:
            columns = {c: batch[c].map(pick) for c in ("found", "lost", "gained")}
            yield pd.DataFrame({"y": batch["y"]} | columns)

    small = described.mapInPandas(
        encode, "y int, found array<int>, lost array<int>, gained array<int>"
    )
    weights, bias = _fit(small.toPandas(), len(names), fairness)
    discard(sample, described)
    kept = {n: float(round(x, 6)) for n, x in zip(names, weights, strict=True) if abs(x) > 1e-3}
    return ToxicityModel(kept, float(round(bias, 6)), twins, swaps)


def learn_swaps(sample: DataFrame, terms: int) -> tuple[tuple[str, str], ...]:
    """Pairs of words of ``sample`` (``text``, ``y``) that stand in like contexts.

    Looked at are the ``terms`` most frequent words, of five texts or more, whose share of
    toxic texts lies within two standard errors of that of all.  A word is described by how
    often each of the most frequent words stands right before and right after it; two words
    are a pair if each is the other's nearest by the cosine of the logarithms.  What comes
    to the driver are counts of so many words by so many neighbours.
    """
    words = F.expr(r"regexp_extract_all(lower(text), '[^\\W\\d_]+', 0)")
    listed = sample.select("y", words.alias("words")).where("size(words) > 0")
    once = listed.select("y", F.explode(F.array_distinct("words")).alias("word"))
    rows, positive = listed.agg(F.count("*"), F.sum("y")).first()
    if not rows:
        return ()
    base = positive / rows
    spread = F.sqrt(F.col("n") * max(base * (1 - base), 1e-9))
    seen = once.groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    seen = seen.where("n >= 5").orderBy(F.desc("n"), "word").limit(2 * max(terms, _CONTEXTS))
    tied = F.abs(F.col("hits") - F.col("n") * base) > 2 * spread
    frequent = seen.select("word", tied.alias("tied")).collect()
    near = [r.word for r in frequent[:_CONTEXTS]]
    asked = sorted([r.word for r in frequent if not r.tied][:terms])
    if len(asked) < 2:
        return ()
    pairs = listed.select(
        F.explode(F.expr("zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words)), "
                         "(a, b) -> struct(a, b))")).alias("p")
    ).select("p.a", "p.b")
    counts = pairs.where(
        (F.col("a").isin(asked) & F.col("b").isin(near)) | (F.col("a").isin(near) & F.col("b").isin(asked))
    ).groupBy("a", "b").count()
    place = {w: i for i, w in enumerate(asked)}
    column = {w: i for i, w in enumerate(near)}
    matrix = np.zeros((len(asked), 2 * len(near)))
    for a, b, n in counts.collect():
        if a in place and b in column:
            matrix[place[a], column[b]] = n
        if b in place and a in column:
            matrix[place[b], len(near) + column[a]] = n
    matrix = np.log1p(matrix)
    length = np.sqrt((matrix**2).sum(axis=1))
    matrix /= np.maximum(length, 1e-9)[:, None]
    alike = matrix @ matrix.T
    np.fill_diagonal(alike, -1)
    nearest = alike.argmax(axis=1)
    return tuple(
        (asked[i], asked[j])
        for i, j in enumerate(nearest.tolist())
        if i < j and nearest[j] == i and alike[i, j] > 0
    )


class Problem:
    """Loss and gradient over texts as feature numbers, with twins for some of them.

    ``rows`` has ``y`` and ``found``, and of a twin the features ``lost`` and ``gained``.

    The loss is the mean logistic loss, plus ``fairness`` times the mean squared change of
    the logit from a text to its twin, plus a small square of the weights.
    """

    RIDGE = 1e-4

    def __init__(self, rows: pd.DataFrame, size: int, fairness: float):
        self.y = rows["y"].to_numpy(float)
        self.size, self.count, self.fairness = size, len(rows), fairness
        sizes = np.array([len(f) for f in rows["found"]])
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.column = np.concatenate([np.asarray(f, np.int64) for f in rows["found"]])
        differ = [
            (np.asarray(a, np.int64), np.asarray(b, np.int64))
            for a, b in zip(rows["lost"], rows["gained"], strict=True)
            if a is not None and len(a) + len(b)
        ]
        self.twins = len(differ)
        nothing = [np.empty(0, np.int64)]
        self.twin_row = np.repeat(np.arange(len(differ)), [len(a) + len(b) for a, b in differ])
        self.twin_col = np.concatenate([np.concatenate(p) for p in differ] or nothing)
        self.sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in differ] or nothing)

    def logits(self, w: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.owner, w[self.column], self.count)

    def gaps(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.twin_row, self.sign * w[self.twin_col], self.twins)

    def loss(self, w: np.ndarray, bias: float) -> float:
        logits = self.logits(w, bias)
        loss = np.mean(np.logaddexp(0, logits) - self.y * logits) + self.RIDGE / 2 * (w @ w)
        return loss + self.fairness * np.mean(self.gaps(w) ** 2) if self.twins else loss

    def gradient(self, w: np.ndarray, bias: float) -> np.ndarray:
        """By each weight, and last by the bias."""
        error = 1 / (1 + np.exp(-np.clip(self.logits(w, bias), -500, 500))) - self.y
        grad = np.bincount(self.column, error[self.owner], self.size) / self.count + self.RIDGE * w
        if self.twins:
            by_twin = self.sign * self.gaps(w)[self.twin_row]
            by_weight = np.bincount(self.twin_col, by_twin, self.size)
            grad += 2 * self.fairness * by_weight / self.twins
        return np.r_[grad, error.mean()]


def _fit(rows: pd.DataFrame, size: int, fairness: float) -> tuple[np.ndarray, float]:
    rows = rows.assign(key=[f"{y}{list(f)}" for y, f in zip(rows["y"], rows["found"], strict=True)])
    rows = rows.sort_values("key")  # the order of rows must not change the sums
    problem = Problem(rows, size, fairness)
    w, bias = np.zeros(size), float(np.log(problem.y.mean() / (1 - problem.y.mean())))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, 401):
        full = problem.gradient(w, bias)
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias
