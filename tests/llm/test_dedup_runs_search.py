"""SimHash classes, periodic runs and ranked search against brute force, and odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from hushtext.llm import ranked_search as search
from hushtext.llm import simhash_join as simhash
from hushtext.llm.periodic_runs import enhanced_suffix_array, find_runs, run_finder
from hushtext.llm.queries import op11_simhash_classes, op12_periodic_runs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, rank int, row string, fingerprint string, score string"
SPACES = r"[^\x20\x09-\x0D]+"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 7, "r", "f", "s") for i, t in rows], DOCS)


def words(n, seed, size=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# --- SimHash ---------------------------------------------------------------------------


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(SPACES, lowered)
    if not found:
        return 0
    size = min(3, len(found))
    hashes = [
        xxhash.xxh64(" ".join(found[i : i + size]).encode(), seed=42).intdigest()
        for i in range(len(found) - size + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(rows, prints, distance=2):
    """Smallest id reachable from each row; rows with the same id are one document."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
        if same_id or (prints[a] ^ prints[b]).bit_count() <= distance:
            root[find(a)] = find(b)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return [least[find(i)] for i in range(len(rows))]


def near_texts():
    base = words(300, 1, 5_000)
    texts = [" ".join(base)]
    for i in range(60):
        copy = list(base)
        for at in random.Random(i).sample(range(300), i % 9):
            copy[at] = f"x{i}"
        texts.append(" ".join(copy))
    texts += ["", None, " \n ", "One two", "one  TWO", "é É", "a b c", "a b c d"]
    texts += [" ".join(words(40, s, 900)) for s in range(40)]
    texts.append(" ".join(words(60_000, 3, 900)))
    return texts


def test_simhash_classes_equal_brute_force(spark):
    rows = list(enumerate(near_texts()))
    prints = [plain_fingerprint(t) for _, t in rows]
    found = simhash.simhash_classes(documents(spark, rows)).collect()
    assert {r.doc_id: r.fingerprint & (2**64 - 1) for r in found} == dict(enumerate(prints))
    expected = classes_by_hand(rows, prints)
    assert len(set(expected)) < len(rows) - 10
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(expected))


def test_simhash_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(words(80, s)) for s in (1, 2, 3))
    rows = [(7, a), (7, b), (3, b), (9, a), (9, a), (None, a), (None, c), (None, None), (12, c)]
    prints = [plain_fingerprint(t) for _, t in rows]
    found = simhash.simhash_classes(documents(spark, rows)).collect()
    got = sorted(((r.doc_id, r.component_id) for r in found), key=str)
    want = zip([i for i, _ in rows], classes_by_hand(rows, prints), strict=True)
    assert got == sorted(want, key=str)
    assert simhash.simhash_classes(documents(spark, [])).collect() == []


@pytest.mark.parametrize("bucket", [2, 64])
@pytest.mark.parametrize("distance", [0, 2, 4])
def test_close_fingerprints_are_connected(spark, bucket, distance):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    prints = set()
    for centre in centres:
        for _ in range(25):
            flips = rng.sample(range(64), rng.randrange(6))
            prints.add(centre ^ sum(1 << f for f in flips))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    edges = simhash.close_pairs(rows, distance, bucket).collect()
    assert all((e.a ^ e.b) % 2**64 for e in edges)
    order = sorted(prints)
    place = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(order)}
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(place[e.a])] = find(place[e.b])
    by_hand = classes_by_hand([(i, None) for i in range(len(order))], order, distance)
    mine = {}
    for i in range(len(order)):
        mine.setdefault(find(i), i)
    assert [mine[find(i)] for i in range(len(order))] == by_hand


def test_thresholds_are_a_cheapest_pigeonhole():
    rng = random.Random(4)
    prints = np.array([rng.getrandbits(64) for _ in range(50)], np.uint64)
    plan = simhash.Plan(2, [[[*range(10)], [*range(10, 20)]], [[*range(20, 31)], [*range(31, 42)]],
                            [[*range(42, 53)], [*range(53, 64)]]], total=1000)
    plan.near = [
        [np.array([[rng.random() / 50 for _ in range(3)] for _ in range(1 << len(s))]) for s in part]
        for part in plan.parts
    ]
    units, cost = plan.allocate(prints)
    costs = plan.costs(prints)
    for i in range(50):
        options = [u for u in itertools.product(range(4), repeat=3) if sum(u) == 3]
        best = min(sum(costs[p][i][u[p]] for p in range(3)) for u in options)
        assert units[i].sum() == 3
        assert math.isclose(cost[i], best)
        assert math.isclose(sum(costs[p][i][units[i][p]] for p in range(3)), best)


def test_correlated_bits_share_a_part():
    alike = np.eye(64)
    for a, b in ((3, 60), (10, 40), (10, 41), (40, 41)):
        alike[a, b] = alike[b, a] = 0.9
    groups = simhash.group_bits(alike, list(range(64)), 3)
    assert sorted(map(len, groups)) == [21, 21, 22]
    assert sorted(itertools.chain(*groups)) == list(range(64))
    where = {b: i for i, g in enumerate(groups) for b in g}
    assert where[10] == where[40] == where[41]


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    prints = [plain_fingerprint(t) for _, t in rows]
    expected = {
        d: (f"{p:016x}", c)
        for (d, _), p, c in zip(rows, prints, classes_by_hand(rows, prints), strict=True)
    }
    found = op11_simhash_classes(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == expected


# --- periodic runs -----------------------------------------------------------------------


def runs_by_hand(symbols, min_length, min_exponent):
    runs, n = [], len(symbols)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if symbols[i] != symbols[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and symbols[j] == symbols[j + q]:
                j += 1
            length = j + q - i
            smaller = any(
                all(symbols[i + k] == symbols[i + k + p] for k in range(length - p))
                for p in range(1, q)
            )
            if length >= max(min_length, min_exponent * q) and not smaller:
                runs.append((i, length, q))
            i = j
    return sorted(runs, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (4, 2), (7, 3)])
def test_runs_equal_brute_force(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(200):
        texts = []
        for _ in range(rng.randrange(5)):
            text = []
            for _ in range(rng.randrange(6)):
                unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
                text += rng.choice([(unit * 9)[: rng.randrange(60)], words(9, rng.random(), 9)])
            texts.append([w.encode() for w in text])
        expected = [runs_by_hand(t, min_length, min_exponent) for t in texts]
        assert find_runs(texts, min_length, min_exponent) == expected


def test_suffix_array():
    rng = random.Random(8)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 40))] for _ in range(20)]
    order, inverse, lcp = enhanced_suffix_array(
        np.array(sum(texts, [])), np.array([len(t) for t in texts])
    )
    assert inverse[order].tolist() == list(range(order.size))
    at = 0
    for text in texts:
        suffixes = sorted(range(len(text)), key=lambda i: text[i:])
        assert (order[at : at + len(text)] - at).tolist() == suffixes
        for i, (a, b) in enumerate(itertools.pairwise(suffixes), start=1):
            shared = 0
            while max(a, b) + shared < len(text) and text[a + shared] == text[b + shared]:
                shared += 1
            assert lcp[at + i] == shared
        at += len(text)


def collapsed_by_hand(found, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(found) if i not in gone)


def test_runs_of_odd_texts(spark):
    long = ["x y z"] * 30_000
    texts = [None, "", " \t\n", "a " * 24, "a " * 23, "a b c\t" * 8 + "a", " ".join(long), "é " * 30]
    texts += [" ".join(words(200, 1, 3) + ["p", "q"] * 20 + words(200, 2, 3)), "u v " * 12 + "u v"]
    rows = documents(spark, list(enumerate(texts)) + [(0, texts[3]), (None, texts[3])])
    found = rows.select("doc_id", "text", run_finder()("text").alias("f")).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        split = re.findall(SPACES, r.text or "")
        runs = [tuple(x) for x in r.f["runs"]]
        if len(split) < 10_000:
            assert runs == runs_by_hand(split, 24, 3)
        else:
            assert runs == [(0, 90_000, 3)]
        assert r.f["n_words"] == len(split) and r.f["collapsed"] == collapsed_by_hand(split, runs)
    assert documents(spark, []).select(run_finder()("text")).count() == 0


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in op12_periodic_runs(spark, SF).collect()}
    assert len(found) == len(docs)
    with_runs = 0
    for d in docs:
        split = re.findall(SPACES, d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(split)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            split = split[:a] + [split[a + (i - a) % p] for i in range(a, n)]
        if n > 1_500:
            continue  # too long for the plain method
        runs = runs_by_hand(split, 24, 3)
        with_runs += bool(runs)
        r = found[d.doc_id]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        collapsed = collapsed_by_hand(split, runs)
        assert r.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()
        if runs:
            s, length, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period) == (s, length, q)
            assert r.exponent_milli == 1000 * length // q
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert with_runs > 5


# --- ranked search -----------------------------------------------------------------------


def ranked_by_hand(docs, items, k):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def terms(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(pattern, lowered)

    counted = [(d, terms(t)) for d, t in docs]
    counted = [(d, len(t), Counter(t)) for d, t in counted if t]
    total = sum(n for _, n, _ in counted)
    df = Counter(t for _, _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, n, c in counted:
            m = 75 + (25 * n * len(counted)) // total
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        for rank, (score, null, d) in enumerate(sorted(scores)[:k], start=1):
            out.append((item, rank, None if null else d, -score))
    return sorted(out, key=str)


def search_input():
    rng = random.Random(6)
    docs = [(i, " ".join(words(rng.randrange(1, 80), i, 400))) for i in range(300)]
    docs += [(300 + i, " ".join(words(30, 5, 400))) for i in range(40)]  # ties
    docs += [(None, docs[5][1]), (None, "w1 w2"), (7, "W1-w2, é_É"), (8, ""), (9, None), (10, "-- _")]
    docs.append((500, " ".join(words(30_000, 9, 300))))
    items = [(i, " ".join(words(rng.randrange(1, 25), 1_000 + i, 500))) for i in range(30)]
    items += [(30, "é É w1"), (31, None), (32, "nothing"), (3, "w3 w3 w3"), (None, "w2"), (33, "-")]
    return docs, items


@pytest.mark.parametrize(("tile", "block"), [(500, 4_096), (7, 33)])
def test_ranking_equals_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(search, "BLOCK", block)
    docs, items = search_input()
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, row int, doc_id string")
    found = search.rank_documents(documents(spark, docs).repartition(5), asked, 12, tile=tile).collect()
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=str)
    assert got == ranked_by_hand(docs, items, 12)


def test_ranking_of_empty_tables(spark):
    docs, items = search_input()
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search.rank_documents(documents(spark, []), asked).collect() == []
    assert search.rank_documents(documents(spark, docs), asked.limit(0)).collect() == []
    blank = documents(spark, [(1, None), (2, "")])
    assert search.rank_documents(blank, asked).collect() == []


def test_bounds_of_ranges_hold():
    """No node lies below what is under it."""
    rng = random.Random(2)
    block = search.Block()
    for i in range(60):
        rows = np.array(sorted(rng.sample(range(50), rng.randrange(1, 20))))
        block.ids.append(i)
        block.rows.append(rows)
        block.impacts.append(np.array([rng.randrange(1, 1000) for _ in rows]))
        block.leading.append(int(rows[0]))
    rows = {str(i).encode(): i for i in range(50)}
    queries = search.Queries(rows, np.ones(50, np.int64), [(0, np.array([1]), np.array([1]))], 60, 600)
    grid = search.Treap.build(block, queries)
    assert grid.maxima[-1][0] == max(map(max, block.impacts))
    for level in range(1, len(grid.masks)):
        bits = [m.bit_count() for m in grid.masks[level][:-1].tolist()]
        assert grid.firsts[level][:-1].tolist() == [0, *np.cumsum(bits)[:-1].tolist()]
        for node, (first, count) in enumerate(zip(grid.firsts[level], bits, strict=False)):
            below = grid.maxima[level - 1][first : first + count]
            assert grid.maxima[level][node] == below.max()
