"""What the classifiers learn from: gradients, swaps, votes; bounds; long texts."""

import random
import time

import numpy as np
import pandas as pd

from hushtext.llm import personal_data as pii
from hushtext.llm.queries import _held_out
from hushtext.llm.toxicity import Problem, learn_swaps, train_toxicity

SMALL = "/root/testdata/sf0.01"


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({
        "y": rng.integers(0, 2, 40),
        "found": [sorted(rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(40)],
        "lost": [sorted(rng.choice(6, 2, replace=False)) if i % 3 else None for i in range(40)],
        "gained": [sorted(rng.choice([7, 8, 9], 1)) if i % 3 else None for i in range(40)],
    })
    for fairness in (0.0, 1.0, 5.0):
        problem = Problem(rows, 12, fairness)
        w, bias = rng.normal(size=12), 0.3
        got = problem.gradient(w, bias)
        step = 1e-6
        for k in range(12):
            more, less = w.copy(), w.copy()
            more[k] += step
            less[k] -= step
            slope = (problem.loss(more, bias) - problem.loss(less, bias)) / (2 * step)
            assert abs(slope - got[k]) < 1e-6
        slope = (problem.loss(w, bias + step) - problem.loss(w, bias - step)) / (2 * step)
        assert abs(slope - got[-1]) < 1e-6


def test_loss_by_hand():
    rows = pd.DataFrame({"y": [1, 0], "found": [[0, 1], [1]], "lost": [[0], None], "gained": [[2], None]})
    w = np.array([0.5, -0.25, 0.1])
    logits = np.array([0.5 - 0.25 + 0.2, -0.25 + 0.2])
    plain = np.mean(np.log1p(np.exp(logits)) - np.array([1, 0]) * logits)
    expected = plain + 2.0 * (0.5 - 0.1) ** 2 + 0.5e-4 * (w @ w)
    assert abs(Problem(rows, 3, 2.0).loss(w, 0.2) - expected) < 1e-12


def test_words_in_like_contexts_are_swapped(spark):
    rng = random.Random(2)
    texts = []
    for i in range(400):
        group = rng.choice(["zorbans", "mipplets"])
        bad = ["grunk"] if i % 4 == 0 else []
        extra = [rng.choice(["one", "two", "red", "blue"]) for _ in range(6)]
        texts.append((" ".join(extra[:3] + ["the", group, "went"] + bad + extra[3:]), int(i % 4 == 0)))
    sample = spark.createDataFrame(texts, "text string, y int")
    swaps = learn_swaps(sample, 50)
    assert ("mipplets", "zorbans") in swaps
    assert all("grunk" not in pair for pair in swaps)
    assert learn_swaps(sample.limit(0), 50) == ()


def test_twins_exist_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(~_held_out(5, 0))
    model = train_toxicity(docs, labels)
    assert model.twins > 50 and model.swaps


def test_labelled_rows_are_bounded_by_ids(spark):
    texts = [(i % 40, f"w{i % 7} w{i % 11} " + ("vile" if i % 40 < 10 else "")) for i in range(2_000)]
    docs = spark.createDataFrame(texts + [(3, "aaa")] * 3_000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(40)], "doc_id long, toxic int")
    model = train_toxicity(docs, labels)
    assert model.twins <= 40
    assert train_toxicity(docs, labels, max_features=3).weights.keys().__len__() <= 3


def test_estimated_reliability_is_that_of_the_votes():
    """Votes made from a known truth give back how often each labeler is right."""
    rng = np.random.default_rng(5)
    right = [0.95, 0.9, 0.8, 0.7, 0.9]
    truth = rng.random(20_000) < 0.3
    votes = [
        "".join("+" if (rng.random() < q) == t else "-" for q in right) for t in truth
    ]
    # the features tell the truth in one place
    features = ["0" * 12 + "01"[int(t)] for t in truth]
    counted = pd.DataFrame({"votes": votes, "features": features, "n": 1}).groupby(["votes", "features"], as_index=False).sum()
    model = pii.fit_spans(counted)
    assert np.allclose(model.reliability, right, atol=0.03)
    assert model.accepts("0" * 12 + "1") and not model.accepts("0" * 13)


def test_touched_candidates_equal_a_plain_test():
    rng = random.Random(9)
    parts = ["a1@b.co", "10.0.0.1", "4539578763621486", "+1 (988) 555-2485", "x9", " ", "  ", "(", "password=ab12", ","]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=12))
        base = pii.base_spans(text)
        for start, end, _, features in pii.candidates(text, base):
            assert (features[0] == "1") == any(s < end and start < e for s, e, _ in base)


def test_many_spans_in_one_text_take_linear_time():
    text = " ".join(f"user{i}@mail.example.com" for i in range(120_000))
    model = pii.SpanModel((0.0,) * 13, -1.0, (0.5,) * 5)
    began = time.time()
    base, every = pii.find_spans(text, model)
    assert len(base) == len(every) == 120_000 and time.time() - began < 30
