"""Exact top-k on many tiles and chunks: what reaches the driver, and the results."""

import re

import numpy as np

from hushtext.llm import exact_topk
from hushtext.llm.exact_topk import top_k

SCHEMA = "vec_id long, vector array<long>"


def test_no_vectors_are_broadcast(spark):
    df = spark.range(2_000).selectExpr("id AS vec_id", "array(id % 7, -id % 5, id) AS vector")
    plan = top_k(df, df.where("vec_id % 20 = 0"))._jdf.queryExecution().executedPlan().toString()
    # the joins through which tiles meet chunks: only numbers of chunks go by the driver
    for after in plan.split("BroadcastExchange")[1:]:
        assert re.search(r"ReadSchema: struct<(.*?)>", after)[1] == "number:bigint"


def test_many_chunks_and_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CHUNK_BLOCKS", 2)
    monkeypatch.setattr(exact_topk, "TILE", 8)
    monkeypatch.setattr(exact_topk, "GROUP_TILES", 2)
    # vectors of 8, 16, 32 and 64 bits, with the ends of each range
    ends = [-128, 127, -32768, 32767, -(2**31), 2**31 - 1, 128, 40_000, 2**31]
    rng = np.random.default_rng(3)
    vectors = rng.integers(-100, 100, (3_000, 4))
    vectors[::200, 0] = [ends[i % len(ends)] for i in range(15)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = top_k(df, df.where("vec_id % 20 = 0"), 5).collect()
    expected = set()
    for q in range(0, 3_000, 20):
        scores = vectors @ vectors[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == expected
