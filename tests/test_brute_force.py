"""The Spark plan against brute force on random texts."""

import random
from unittest import mock

import pytest
from conftest import counted
from model import redacted_by_hand
from pyspark.sql import functions as F

import sql_oracle
from hushtext.functions import marks
from hushtext.operators import redact as engine
from hushtext.plans.options import Options
from hushtext.plans.rules import ANY_CASE, EXACT, RULE_IDS, all_rules

# bits that the rules react to, and bits that get in their way
BITS = """
a@b.co jo.e+x@mail-1.example.com @ . .. - + % _ x at dot b a.b -- at dot DOT AT
http://x.y https://q www.z.org 555-111-2222 (555) 5551112222 +1 1 ext. x12 extension
123-45-6789 xxx-xx-1234 12345 12345-6789 123456 1234567890 12345678901 7 31st 2nd
MRN Acct account Patient ID chart : # -12AB A1-2 St. Saint Mt. Mount University
Memorial Children's children's General county Hospital Med Medical Center Clinic
Healthcare Mercy Mary's O'Neil N. S E W. Main Elm Street St St., Ave Road Dr. Dr Way
Way. , Apt Suite #4B Room Bed OR 5A 9-9-9 41.8781 87.62 ° N, W ; Member Policy Plan No
No. Number ID# License Driver's DL lic Passport State ID1 VIN Vehicle Identification
Plate tag 1HGCM82633A004352 IOQ Device pump Serial S/N S/N-4455-XYZ 10.0.0.5 1.2.3.4.5
Smith smith Martin Martinez Li Min Ng Kim Lee David Mary Rev. Prof Mrs Mr Ms. Captain
imam Zelda Fitzgerald Bob Alice O' 'X D'Arcy' Jean-Luc iv E Coli COLI ICU sepsis St
MRSA Sa st. 04/02/2024 4-5-99 2024-01-02 Jan April Sept 5, 2024 99 yesterday today last
night Monday this morning week 3 days ago weeks [EMAIL] [MRN] [ ] ! ? ?! ,, é ñandú Ünal
naïve ß Clarké éClark ١٢٣٤٥٦ 京都 Ⅷ ﬁn ª ½ ’s “q” – — • · … ́a ⁠ ‍ \x01 \x02 \x03 \x04
""".split()
GAPS = [" "] * 8 + ["", "", "", "\n", "\r\n", "  ", "\t", "\n\n", " \n ", "\xa0", "\x85"]


def texts(seed, n):
    pick = random.Random(seed)
    for _ in range(n):
        size = pick.choice([2, 3, 4, 5, 6, 8, 12, 30])
        yield "".join(
            pick.choice(BITS) + pick.choice(GAPS) for _ in range(size)
        )


OPTION_SETS = [
    {"safe_harbor": True},
    {},
    {"safe_harbor": True, "skip": ["address", "email", "person"]},
    {"safe_harbor": True, "skip": ["phone", "zip", "mrn", "facility", "ssn", "url"]},
    {
        "safe_harbor": True,
        "config": {
            "names": ["Bob", "St Elm", "sepsis", "ID", "Zelda Fitzgerald", "ñandú"],
            "keywords": ["Mercy", "O'Neil", "Main Elm", "N"],
            "mrn_min_length": 1,
            "mrn_max_length": 5,
        },
    },
]


@pytest.mark.parametrize("number", range(len(OPTION_SETS)))
def test_whole_chain(run, number):
    options = OPTION_SETS[number]
    batch = list(texts(number, 4000))
    renamed = {"mrn_min_length": "low", "mrn_max_length": "high"}
    model = {k: v for k, v in options.items() if k != "config"}
    for name, value in options.get("config", {}).items():
        model[renamed.get(name, name)] = value
    for text, row in zip(batch, run(batch, **options), strict=True):
        assert (row.redacted, counted(row)) == redacted_by_hand(text, **model), repr(text)


def test_guards_change_nothing(run):
    """Without guards every rule runs on every text, with the same outcome."""
    batch = list(texts(99, 3000))
    guarded = run(batch, safe_harbor=True)

    def unguarded(*args, **kwargs):
        rules = engine_rules(*args, **kwargs)
        return [type(r)(**{**vars(r), "guard": None}) for r in rules]

    engine_rules = engine.active_rules
    with mock.patch.object(engine, "active_rules", unguarded):
        plain = run(batch, safe_harbor=True)
    assert guarded == plain


@pytest.mark.parametrize("source", ["random", "documents"])
def test_patterns_match_like_the_plain_ones(spark, source):
    """Possessive and guarded patterns against the plain ones, span by span."""
    if source == "random":
        batch = [(t,) for t in texts(7, 6000)]
        df = spark.createDataFrame(batch, "text string").repartition(8)
    else:
        df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = sql_oracle.patterns(**sql_oracle.NATIVE)
    by = f"{marks.OPEN}$0{marks.CLOSE}"
    checks = []
    for rule in all_rules(Options()):
        body = plain[rule.id].removeprefix("(?i)")
        flags = EXACT if body == plain[rule.id] else ANY_CASE
        checks.append(
            F.count_if(
                F.regexp_replace("text", rule.pattern, by)
                != F.regexp_replace("text", flags + body, by)
            ).alias(rule.id)
        )
    differing = df.select("text").agg(*checks).first().asDict()
    assert differing == dict.fromkeys(RULE_IDS, 0)
