import random

import pytest
import regex
from pyspark.sql import functions as F

import hushtext as ht
from hushtext.operators import lookup
from hushtext.operators.numbering import numbered
from hushtext.plans import fixed_values as fixed
from hushtext.plans.dictionary import (
    alternation,
    atoms,
    build_dictionary,
    case_folds,
    dictionary_pattern,
)
from hushtext.plans.rules import ANY_CASE, KeywordScan, all_rules
from hushtext.plans.options import Options


def test_build_dictionary_from_list_and_table(spark):
    extra = ["  Zed ", "", " \t", "Smith", "a b", "　Ünal\x85"]
    terms = build_dictionary(["Smith", "Jones"], extra)
    assert terms == ["Jones", "Smith", "Zed", "a b", "Ünal"]
    table = spark.createDataFrame([(t,) for t in [*extra, *extra, None]], "t string")
    rows = build_dictionary(["Smith", "Jones"], table).collect()
    assert sorted((r.ord, r.term) for r in rows) == list(enumerate(terms, start=1))
    with pytest.raises(ValueError, match="one column"):
        build_dictionary([], table.withColumn("u", F.lit(1)))
    assert build_dictionary([], table.limit(0)).collect() == []


def test_numbers_follow_the_order_over_many_ranges(spark):
    rows = spark.range(5_000).select(F.sha2(F.col("id").cast("string"), 256).alias("t"))
    found = numbered(rows.repartition(7), "t")
    assert "t" in found.columns and found.count() == 5_000
    got = [r.t for r in sorted(found.collect(), key=lambda r: r.ord)]
    assert got == sorted(got)
    assert {r.ord for r in found.collect()} == set(range(1, 5_001))


def options(names, keywords, literal_chars):
    return ht.Options(names=names, keywords=keywords, literal_chars=literal_chars)


def both_forms(df, names, keywords=(), **kw):
    literal = ht.redact(df, config=options(names, keywords, 10**9), **kw)
    table = ht.redact(df, config=options(names, keywords, 0), **kw)
    assert "SortMergeJoin" not in plan_of(literal) and "Join" in plan_of(table)
    return ([tuple(r) for r in sorted(d.collect(), key=lambda r: r.id)] for d in (literal, table))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


ODD_TERMS = [
    "Zed", "Zed Fitz", "O'Neil", "O’Neil Bay", "'tis", "Inc.", "++", "#", "St. Ann", "a b c d",
    "ünal", "ÉCOLE normale", "σίγμας", "naïve", "x-ray", "x ray", "two\nlines", "b", "\x01", "ß", "İz",
    "reptomycin", "sepsis", "a  b", "-dash", "dash-", "_u_", "1st", "٣", "Garcia Ann", "the pump",
]


def test_a_table_of_terms_gives_what_the_pattern_gives(spark):
    pick = random.Random(3)
    parts = [*ODD_TERMS, *map(str.upper, ODD_TERMS), " ", " ", ", ", ".", "\n", "-", "'", "+", "é", "garcia"]
    parts += ["5 mg Streptomycin", "Σίγμασ", "Mercy Medical Center", "a@b.co", "12345", "John Smith"]
    texts = ["".join(pick.choice(parts) + pick.choice(["", " "]) for _ in range(12)) for _ in range(400)]
    texts += [None, "", "Zed " * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    names = spark.createDataFrame([(t,) for t in ODD_TERMS], "t string")
    literal, table = both_forms(df, names, ["Fitz", "b c", "pump, a"], safe_harbor=True)
    assert literal == table
    assert sum(r[-1] for r in table) > 1_000
    rule = [
        sorted(map(tuple, ht.redact_rule(df, "text", "person_dict", config=options(ODD_TERMS, (), n)).collect()))
        for n in (10**9, 0)
    ]
    assert rule[0] == rule[1]


def test_half_a_million_terms(spark):
    names = spark.range(500_000).select(F.format_string("Name%06dx Lane", "id").alias("t"))
    texts = [f"met name{7 * i:06d}X lane, Name{500_000 + i:06d}x Lane and Name{i:06d}x Road" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    skip = ["person", "address"]
    rows = [tuple(r) for r in sorted(ht.redact(df, config=options((), names, 1_000), skip=skip).collect(), key=lambda r: r.id)]
    assert all(r[2].startswith("met [FACILITY], Name") and r[-1] == 1 for r in rows)
    literal, table = both_forms(df.limit(8), (), names, skip=skip)
    assert literal == table == rows[:8]


def test_keys_fold_what_patterns_match_alike(spark):
    """Characters that a term's pattern takes for each other have one key."""
    classes = [p[1:-1] for p in set(atoms().values()) if p.startswith("[") and len(p) > 3]
    source, target = case_folds()
    assert len(source) == len(target) == len(set(source))
    rows = spark.createDataFrame([(i, ch) for i, c in enumerate(classes) for ch in c], "i int, t string")
    keys = rows.select("i", lookup._folded("t").alias("k")).distinct().groupBy("i").count()
    assert keys.where("count > 1").isEmpty()


def test_streams_need_a_short_dictionary(spark, tmp_path):
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path))
    ht.redact(stream, config=options(["Zed"], (), 10**9))
    with pytest.raises(ValueError, match="foreachBatch"):
        ht.redact(stream, config=options(["Zed"], (), 0))


def test_no_terms_no_pattern():
    assert dictionary_pattern([]) is None


@pytest.mark.parametrize("seed", range(20))
def test_alternation_keeps_the_order_of_preference(seed):
    pick = random.Random(seed)
    terms = [
        "".join(pick.choice("abAB -'.") for _ in range(pick.randint(1, 5)))
        for _ in range(30)
    ]
    text = "".join(pick.choice("abAB -'.") for _ in range(3000))
    flat = "|".join(regex.escape(t).replace("'", "[’']") for t in terms)
    expected = regex.findall(f"(?i)(?:{flat})", text)
    assert regex.findall(f"(?i){alternation(terms)}", text) == expected


def test_large_dictionary(spark):
    names = [f"Name{n:05d}x" for n in range(20_000)]
    pattern = ANY_CASE + dictionary_pattern(build_dictionary(fixed.SURNAMES, names))
    df = spark.createDataFrame([("name00007X and Name19999x, Name20000x",)], "t string")
    assert df.select(F.regexp_replace("t", pattern, "#")).first()[0] == (
        "# and #, Name20000x"
    )


def test_keyword_scan_reports_a_stem_for_longer_words():
    guards = [r.guard for r in all_rules(Options(names=["Vincent"])) if r.guard]
    scan = KeywordScan.of(guards)
    assert scan.key("vincent") == "vin"
    assert scan.key("license") == "lic"
    assert scan.key("smith") == "smith"
