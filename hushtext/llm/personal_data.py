"""Personal data in texts: fixed patterns plus a classifier without hand labels.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by
pattern; base spans always stay.  Beyond them every token with a digit or ``@`` is a
candidate.  Labelers look at it: the patterns, the shape of the token, a gazetteer of key
words before it, and the context.  Each says yes, no or nothing.  Expectation
maximisation estimates how reliable each labeler is from how they agree (Dawid and
Skene), and the resulting probabilities train a logistic classifier on features of the
span.  Candidates that it accepts and that no base span touches are added with the kind
``secret``.

Candidates are counted over all texts by their votes and features.  Both are a few small
numbers, so the counts have a fixed number of rows at most, and the estimates are made
from them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
Span = tuple[int, int, int]  # start, end, number of the kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
# gazetteers of the word before a candidate
_SECRET_WORDS = frozenset(
    "password passwd pwd pass passphrase secret token key apikey api_key access_key auth "
    "bearer credential pin ssn account iban login".split()
)
_PLAIN_WORDS = frozenset(
    "version release page chapter section figure table volume no number nr cc by by-nc "
    "by-sa gpl lgpl apache license licence year in of".split()
)
_TRIM = "\"'`.,;:!?()[]{}<>«»“”"


def base_spans(text: str) -> list[Span]:
    """The base patterns: leftmost, not overlapping within a kind, ends exclusive."""
    spans: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            spans.append((start, last, 0))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(int(part) <= 255 for part in _short(m[0].split("."))):
            spans.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = [int(c) for c in m[0] if c not in " -"]
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def _short(parts: list[str]) -> list[str]:
    """Numbers without leading zeros, very long ones cut to four digits (over 255)."""
    return [p.lstrip("0")[:4] or "0" for p in parts]


def _luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 if d > 4 else d * 2 for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, str, str]]:
    """``start, end, votes, features`` of each token with a digit or ``@``.

    ``base`` comes by start, so one pass over it goes along with the tokens.
    """
    end, at, reach = 0, 0, 0  # reach: the end of all base spans that start before a token's
    while mark := _MARK.search(text, end):
        start = mark.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = mark.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        token = text[start:end]
        lead = len(token) - len(token.lstrip(_TRIM))
        core = token.strip(_TRIM)
        if core:
            first = start + lead
            before = text[max(0, start - 40) : start].lower().split()
            while at < len(base) and base[at][0] < first + len(core):
                reach = max(reach, base[at][1])
                at += 1
            touched = reach > first
            yield (first, first + len(core), *_describe(core, before, touched, lead > 0))


def _describe(core: str, before: list[str], touched: bool, quoted: bool) -> tuple[str, str]:
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(map(str.isalpha, core))
    head, equals, value = core.partition("=")
    previous = [w.strip(_TRIM + "=") for w in before if w not in ("=", ":")][-1:]
    key = head.lower() if equals else previous[0] if previous else ""
    assigned = bool(equals and value) or before[-1:] == ["="] or key.endswith(":")
    mixed = digits > 1 and letters > 1
    simple = digits + sum(c in ".,%-/:" for c in core) == len(core)
    votes = (
        "+" if touched else "0",  # the base patterns
        "+" if mixed and len(core) >= 12 else "-" if simple and digits <= 4 else "0",  # shape
        "+" if key in _SECRET_WORDS else "-" if key in _PLAIN_WORDS else "0",  # gazetteer
        "+" if assigned or (quoted and mixed) else "-" if simple and "." in core and digits < 4 else "0",  # context
        "+" if digits >= 9 else "-" if digits <= 2 and "@" not in core else "0",  # digits
    )
    features = (
        touched, mixed, key in _SECRET_WORDS, key in _PLAIN_WORDS, assigned, quoted,
        "@" in core, simple, digits >= 5, digits >= 9, len(core) >= 12, len(core) >= 18,
        core.isupper() and mixed,
    )
    return "".join(votes), "".join("01"[f] for f in features)


@dataclass(frozen=True)
class SpanModel:
    """Logistic classifier of candidate spans; ``reliability`` of each labeler."""

    weights: tuple[float, ...]
    bias: float
    reliability: tuple[float, ...]

    def accepts(self, features: str) -> bool:
        return self.bias + sum(w for w, f in zip(self.weights, features, strict=True) if f == "1") >= 0


def train_spans(docs: DataFrame, text: str = "text", rounds: int = 100) -> SpanModel:
    """Estimate labelers and classifier from all texts.

    Null texts count as empty.  Without any candidate nothing is ever added.
    """

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for value in batch["text"]:
                if value:
                    for _, _, v, f in candidates(value, base_spans(value)):
                        seen[v, f] = seen.get((v, f), 0) + 1
            rows = [(v, f, n) for (v, f), n in seen.items()]
            yield pd.DataFrame(rows, columns=["votes", "features", "n"])

    counted = (
        docs.select(F.col(text).alias("text"))
        .mapInPandas(votes, "votes string, features string, n long")
        .groupBy("votes", "features")
        .agg(F.sum("n").alias("n"))
        .orderBy("votes", "features")
        .toPandas()  # at most 2 * 3**4 * 2**13 rows, a few hundred in practice
    )
    return fit_spans(counted, rounds)


def fit_spans(counted: pd.DataFrame, rounds: int = 100) -> SpanModel:
    """EM over vote patterns, then a classifier of the features."""
    labelers = 5
    if not len(counted):
        return SpanModel((0.0,) * 13, -1.0, (0.5,) * labelers)
    n = counted["n"].to_numpy(float)
    says = np.array([[" -0+".index(c) - 1 for c in v] for v in counted["votes"]])  # 0 no, 1 none, 2 yes
    # chance of each vote given the truth; the start says labelers are better than a guess
    chance = np.array([[[0.35, 0.55, 0.1]] * labelers, [[0.1, 0.45, 0.45]] * labelers])
    prior = np.array([0.5, 0.5])
    for _ in range(rounds):
        logs = np.log(prior)[:, None] + np.array(
            [np.log(chance[y][np.arange(labelers), says]).sum(axis=1) for y in (0, 1)]
        )
        truth = np.exp(logs - logs.max(axis=0))
        truth /= truth.sum(axis=0)
        weight = truth * n
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        for y in (0, 1):
            for vote in range(3):
                hits = ((says == vote) * weight[y][:, None]).sum(axis=0)
                chance[y, :, vote] = (hits + 1) / (weight[y].sum() + 3)
    # share of right ones among the votes a labeler casts
    right = prior[1] * chance[1, :, 2] + prior[0] * chance[0, :, 0]
    cast = right + prior[0] * chance[0, :, 2] + prior[1] * chance[1, :, 0]
    x = np.array([[f == "1" for f in fs] for fs in counted["features"]], float)
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    mass = n / n.sum()
    ridge = np.diag(np.r_[np.full(x.shape[1] - 1, 1e-4), 1e-9])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (mass * (p - truth[1])) + ridge @ w
        hess = (x * (mass * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    w = np.round(w, 6)
    return SpanModel(tuple(map(float, w[:-1])), float(w[-1]), tuple(map(float, right / cast)))


def find_spans(text: str | None, model: SpanModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start and then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [
        (start, end, 4)
        for start, end, _, features in candidates(text, base)
        if features[0] == "0" and model.accepts(features)
    ]
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def span_report(model: SpanModel):
    """Column function from a text to counts, digest of the base, and all spans."""

    @F.pandas_udf(
        "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "spans string, n_secret long, n_spans long"
    )
    def report(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, every = find_spans(text, model)
            counts = [sum(s[2] == k for s in base) for k in range(4)]
            digest = hashlib.sha256(spans_text(base).encode()).hexdigest()
            extra = len(every) - len(base)
            rows.append((*counts, digest, spans_text(every), extra, len(every)))
        names = "n_email n_ip n_card n_phone base_sha256 spans n_secret n_spans"
        return pd.DataFrame(rows, columns=names.split())

    return report


def masker(model: SpanModel):
    """Column function that puts ``[KIND]`` in place of each span; null stays null.

    Of overlapping spans the one that starts first is masked together with the rest.
    """

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        done = []
        for text in texts:
            if not text:
                done.append(text)
                continue
            parts, last = [], 0
            for start, end, kind in find_spans(text, model)[1]:
                if start >= last:
                    parts += [text[last:start], f"[{KINDS[kind].upper()}]"]
                last = max(last, end)
            done.append("".join(parts) + text[last:])
        return pd.Series(done, dtype=object)

    return mask
