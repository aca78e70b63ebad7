"""Null and repeated ids, and the stages of the pipeline on odd rows."""

import random

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from hushtext.llm import language_id
from hushtext.llm.common import slices
from hushtext.llm.language_id import train_languages
from hushtext.llm.ngram_join import near_duplicate_classes, numbered_rows, row_classes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, root string, near_row int"


def words(n, seed, size=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "src0", len(t or ""), 1, "x", 2) for i, t in rows], DOCS
    )


def near(text, seed, count):
    found = text.split()
    for at in random.Random(seed).sample(range(len(found)), count):
        found[at] = f"x{seed}"
    return " ".join(found)


def test_a_text_of_null_id_links_others(spark):
    a = " ".join(words(400, 1, 5_000))
    b = near(a, 1, 7)
    c = near(b, 2, 7)
    rows = [(1, a), (None, b), (3, c), (None, " ".join(words(50, 9))), (5, " ".join(words(50, 8)))]
    found = near_duplicate_classes(documents(spark, rows), 5, (4, 5)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == [
        (1, 1), (3, 1), (5, 5), (None, 1), (None, None),
    ]
    # without the null row the other two are apart
    apart = near_duplicate_classes(documents(spark, [rows[0], rows[2]]), 5, (4, 5)).collect()
    assert {r.component_id for r in apart} == {1, 3}


def test_sizes_at_the_edges_of_bands(spark):
    """Pairs just within and just beyond the threshold, over all sizes around a power of four."""
    rows = []
    for k, size in enumerate((3, 4, 15, 16, 17, 63, 64, 65, 255, 256, 257)):
        base = [f"b{k}_{i}" for i in range(size + 4)]  # so many shingles of five words
        for j, more in enumerate((0, size // 5, size // 4, size // 4 + 1)):
            extra = [f"e{k}_{j}_{i}" for i in range(more)]
            rows.append((k * 10 + j, " ".join(base + extra)))
    found = {r.doc_id: r.component_id for r in near_duplicate_classes(documents(spark, rows), 5, (4, 5)).collect()}
    sets = {i: set(zip(*[t.split()[n:] for n in range(5)], strict=False)) for i, t in rows}
    for k in range(11):
        for j in range(1, 4):
            a, b = sets[k * 10], sets[k * 10 + j]
            if 5 * len(a & b) >= 4 * len(a | b):
                assert found[k * 10 + j] == found[k * 10]
    assert len(set(found.values())) > 11


def test_near_duplicates_stage_decides_by_row(spark):
    a, b = " ".join(words(80, 1)), " ".join(words(300, 2, 900))
    b2 = near(b, 5, 3)
    rows = [(3, a), (7, a), (7, b), (9, b2), (9, b2), (None, a), (None, a), (None, ""), (2, None), (2, None)]
    docs = documents(spark, rows)
    out = pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (None, ""), (2, None), (2, None)], key=str)


def test_rows_keep_their_numbers(spark):
    rows = numbered_rows(documents(spark, [(i % 3, " ".join(words(30, i))) for i in range(50)]), "number")
    found = row_classes(rows, row="number").collect()
    assert sorted(r.row for r in found) == sorted(r.number for r in rows.collect())
    assert len({r.root for r in found}) == 50


@pytest.mark.parametrize("stage", pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_rows(spark, stage):
    long = " ".join(words(40_000, 4, 900))
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (None, ""), (2, long), (3, " \n "), (4, "é漢👍 x@y.example")]
    docs = documents(spark, rows)
    out = stage[1](spark, docs, SF)
    if stage[0] != "sentence_pieces":
        assert out.columns == docs.columns
    got = out.collect()
    assert {1, 2, 3, 4, None} >= {r.doc_id for r in got} >= {1, 2, 4}
    if stage[0] in ("sentence_pieces", "personal_data"):
        assert len(got) == len(rows)
    nothing = stage[1](spark, docs.limit(0), SF)
    assert nothing.count() == 0


# --- language ------------------------------------------------------------------------------


def language_rows(count, doc_id):
    rng = random.Random(3)
    kinds = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "der die das und nicht".split()}
    return [
        (doc_id(i), " ".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(5, 40))), lang)
        for i in range(count)
        for lang in kinds
    ]


@pytest.mark.parametrize("doc_id", [lambda i: None, lambda i: 5, lambda i: i], ids=["null", "one", "own"])
def test_languages_are_learned_whatever_the_ids(spark, doc_id):
    rows = language_rows(1_000, doc_id)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_languages(docs)
    assert set(model.dictionaries) == {"aa", "bb"}
    found = docs.select("lang", model.identifier()("text").alias("f")).where("f.lang <> lang")
    assert found.count() < 20


def test_one_row_repeated_is_learned_and_bounded(spark):
    text = " ".join(words(60_000, 2, 900))
    docs = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("aa").alias("lang"))
    model = train_languages(docs, dictionary_bytes=1_000)
    assert model.dictionaries == {"aa": text[:1_000].encode()}


def test_language_equals_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = train_languages(docs)
    rows = docs.select("text", model.identifier()("text").alias("f")).collect()

    def size(raw, text):
        level = zstandard.ZstdCompressor(
            level=7, write_content_size=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_RAWCONTENT),
        )
        step = language_id.PIECE_CHARS
        return sum(len(level.compress(text[i : i + step].encode())) for i in range(0, len(text), step))

    for r in rows[:80]:
        sizes = sorted((size(raw, r.text), lang) for lang, raw in model.dictionaries.items())
        assert r.f["lang"] == sizes[0][1]
        assert r.f["score"] == pytest.approx((sizes[1][0] - sizes[0][0]) / sizes[-1][0])


def test_slices_cover_a_column():
    import pyarrow as pa

    texts = ["a" * n for n in (0, 5, 100, 3, 3, 3)] + [None, "é" * 50]
    for column in (pa.array(texts), pa.chunked_array([texts[:3], texts[3:]]), pa.array(texts).slice(2)):
        parts = [p.to_pylist() for p in slices(column, 10)]
        assert sum(parts, []) == column.to_pylist() and all(parts)
    assert [len(p) for p in slices(pa.array([], pa.string()), 10)] == [0]
    lists = pa.array([[1, 2], None, [], [3] * 9], pa.list_(pa.int32()))
    assert sum((p.to_pylist() for p in slices(lists, 8)), []) == lists.to_pylist()
