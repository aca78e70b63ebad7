"""Column functions against Python on every character."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import hushtext as ht
from hushtext import functions as hf
from hushtext.functions.text import _nfkc_pattern, may_change_by_nfkc, nfkc_spans
from hushtext.plans.dictionary import WHITE_SPACE


@pytest.fixture(scope="module")
def characters(spark):
    """Every assigned code point, alone and between letters."""
    codes = [
        c for c in range(1, 0x110000)
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"
        and not 0xAC00 <= c < 0xD7A4 and not 0x20000 <= c < 0xE0000 and c < 0xF0000
    ]
    texts = [(chr(c), f"a{chr(c)}́ b{chr(c)}") for c in codes]
    return spark.createDataFrame(texts, "ch string, text string").repartition(8).cache()


def test_nfkc(characters):
    rows = characters.select("ch", "text", hf.nfkc("text").alias("out")).collect()
    wrong = [r for r in rows if unicodedata.normalize("NFKC", r.text) != r.out]
    assert not wrong
    ascii_only = characters.where(F.octet_length("text") == F.length("text"))
    assert ascii_only.where(hf.nfkc("text") != F.col("text")).isEmpty()


def test_nfkc_without_marks_around(characters):
    """Most of these texts stay in the JVM."""
    texts = characters.select("ch", F.concat(F.lit("a"), "ch", F.lit("b"), "ch").alias("text"))
    rows = texts.select("text", hf.nfkc("text").alias("out")).collect()
    assert not [r for r in rows if unicodedata.normalize("NFKC", r.text) != r.out]
    kept = texts.where(~may_change_by_nfkc("text"))
    assert kept.count() > 0.8 * len(rows)


def test_quick_check_of_nfkc_over_all_code_points(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    inside = {c for first, last in nfkc_spans() for c in range(first, last + 1)}
    for code in set(codes) - inside:
        ch = chr(code)
        assert unicodedata.combining(ch) == 0
        assert unicodedata.is_normalized("NFKC", ch)
    # no character outside the ranges combines with one before it
    for code in codes:
        parts = unicodedata.normalize("NFD", chr(code))
        assert all(ord(part) in inside for part in parts[1:])
    # the pattern is these ranges
    found = spark.range(1, 0x110000, numPartitions=8).where(f"id < {0xD800} OR id >= {0xE000}")
    found = found.withColumn("ch", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32"))
    found = found.where(may_change_by_nfkc("ch")).select("id").collect()
    assert {r.id for r in found} == inside - set(range(0xD800, 0xE000))


def test_common_signs_are_ruled_out_before_the_long_class():
    ordinary = _nfkc_pattern().split("&&[[")[0]
    free = re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", ordinary)
    spans = [(int(first, 16), int(last, 16)) for first, last in free]
    for ch in "‘’‛“”–—•‧é":
        assert any(first <= ord(ch) <= last for first, last in spans)


def test_letters_of_many_scripts_stay_in_the_jvm(spark):
    texts = ["Größe, État, señal", "Ελλάδα", "Привет", "日本語のテキスト", "한국어", "שלום", "مرحبا", "“ok” – it’s"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(may_change_by_nfkc("t")).isEmpty()
    assert [r[0] for r in df.select(hf.nfkc("t")).collect()] == texts
    assert df.select(ht.normalize_text("t")).collect()[-1][0] == "\"ok\" - it's"
    changed = ["ﬁt", "e\u0301", "½", "a\u00a0b", "\u1112\u1161", "ｶﾞ"]
    df = spark.createDataFrame([(t,) for t in changed], "t string")
    assert df.where(~may_change_by_nfkc("t")).isEmpty()
    assert [r[0] for r in df.select(hf.nfkc("t")).collect()] == [
        unicodedata.normalize("NFKC", t) for t in changed
    ]


def test_whitespace_is_the_unicode_property(characters):
    spaces = characters.where(hf.squeeze_spaces(F.concat("ch", "ch")) == " ")
    assert {r.ch for r in spaces.collect()} == set(WHITE_SPACE) - set("\r\n")
    trimmed = characters.where(hf.trim_whitespace("ch") == "")
    assert {r.ch for r in trimmed.collect()} == set(WHITE_SPACE)
    before = hf.strip_space_before_punctuation(F.concat("ch", F.lit(".")))
    assert {r.ch for r in characters.where(before == ".").collect()} == set(WHITE_SPACE)


def test_folds(spark):
    df = spark.createDataFrame([("‘’‛′ “”″ –—− •·‧⁃・",)], "t string")
    assert df.select(hf.fold_symbols("t")).first()[0] == "''''" + ' """ --- ' + " " * 5
    assert df.select(hf.fold_symbols("t", "-")).first()[0] == "‘’‛′ “”″ --- •·‧⁃・"
    # NFKC comes first: the double prime falls apart, so it ends as two
    assert df.select(ht.normalize_text("t")).first()[0] == "'''' \"\"'' --- "


def test_tidy(spark):
    df = spark.createDataFrame([(" a \n , b ?! c .. d ;;;: e  ",)], "t string")
    assert df.select(ht.tidy_text("t")).first()[0] == "a, b! c. d: e"


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(ht.normalize_text("t"), ht.tidy_text("t"), hf.nfkc("t")).first()
    assert tuple(row) == (None, None, None)
