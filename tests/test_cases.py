"""Hand-written cases with exact results."""

import pytest
from conftest import counted

from hushtext import redact, redact_rule
from hushtext.plans import fixed_values as fixed

SH = {"safe_harbor": True}

# fixed values: inputs and results that must come out just so
# input, options, redacted text, counts (None: not part of the case)
CASES = [
    ("Reach me at jane.doe@example.com or (555) 867-5309.", {},
     "Reach me at [EMAIL] or ([PHONE].", {"emails": 1, "phones": 1}),
    ("Call 555-111-2222 and email foo@bar.com.", {"skip": ["phone"]},
     "Call 555-111-2222 and email [EMAIL].", {"emails": 1}),
    ("Lives at 1200 W. 31st St., Apt #4B in Chicago.", {},
     "Lives at [ADDRESS], [ADDRESS] in Chicago.", {"addresses": 2}),
    ("Contact jrsmith at midstate dot edu for questions.", {},
     "Contact [EMAIL] for questions.", {"emails": 1}),
    ("See http://midstate.example/pt/12345 for records.", SH,
     "See [URL] for records.", {"urls": 1}),
    ("See http://midstate.example/pt/abc for records.", {},
     "See http://midstate.example/pt/abc for records.", {}),
    ("Discussed plan with Zelda Fitzgerald today.",
     {"config": {"names": ["Zelda Fitzgerald"]}},
     "Discussed plan with [PERSON] [REL_DATE].", {"persons": 1, "relative_dates": 1}),
    ("David Harmon discussed the plan.", {}, "[PERSON] the plan.", {"persons": 1}),
    ("Rev. O'Connor provided counseling.", {}, "[PERSON] counseling.", {"persons": 1}),
    ("Coordinates 41.8781° N, 87.6298° W were logged.", {},
     "Coordinates [COORD] were logged.", {"coordinates": 1}),
    ("Dr. Harmon visited 128 Elmwood Drive.", {}, "[PERSON] [ADDRESS].",
     {"persons": 1, "addresses": 1}),
    ("Policy Number 8392-77-551 and Driver's License #A123-4567.", SH,
     "[INSURANCE]-[ADDRESS]r's [LICENSE].",
     {"insurance_ids": 1, "licenses": 1, "addresses": 1}),
    ("VIN 1HGCM82633A004352 and Device Serial S/N-4455-XYZ.", SH,
     "[VEHICLE] and [DEVICE] [DEVICE].", {"vehicles": 1, "devices": 2}),
    ("Client connected from 192.168.10.24 and 10.0.0.5.", SH,
     "Client connected from [IP] and [IP].", {"ip_addresses": 2}),
    ("Transferred from St. John’s Medical Center.", {},
     "Transferred from [FACILITY].", {"facilities": 1}),
    ("Symptoms started 3 days ago and worsened yesterday.", {},
     "Symptoms started [REL_DATE] and worsened [REL_DATE].", {"relative_dates": 2}),
    ("Met with Jane Doe on 04/02/2024", {"skip": ["person"]},
     "Met with Jane Doe on [DATE]", {"dates": 1}),
    ("Met with Jane Doe on 04/02/2024", {}, "Met with [PERSON] on [DATE]", None),
    ("Visited 128 Elmwood Drive for follow-up", {"skip": ["address"]},
     "Visited 128 [PERSON] for follow-up", None),
    ("Visited 128 Elmwood Drive for follow-up", {},
     "Visited [ADDRESS] for follow-up", None),
    ("Member # 8392-77-551 with VIN 1HGCM82633A004352", SH,
     "[INSURANCE] [VEHICLE]", None),
    # order of the rules
    ("MRN: 1234567890 and 1234567890 and MRN 12345", {},
     "MRN: [PHONE] and [PHONE] and [MRN]", {"phones": 2, "mrn": 1}),
    ("Call +1 (555) 867-5309 ext. 12 now", {}, "Call +[PHONE] now", {"phones": 1}),
    ("12345 Main Street", {}, "[ZIP] [PERSON]", {"zip_codes": 1, "persons": 1}),
    ("At 41.87812° N, 87.62981° W.", {}, "At 41.[ZIP]° N, 87.[ZIP]° W.", None),
    ("At 41.87º N, 87.62º W.", {}, "At 41.87o N, 87.62o W.", {}),
    ("Seen Monday April 5, 2024.", {}, "[PERSON] 5, 2024.", None),
    ("Last Monday she came last Monday", {}, "[PERSON] she came [REL_DATE]", None),
    ("Chart review done; accountable staff.", {}, "[MRN] done; [MRN] staff.",
     {"mrn": 2}),
    ("In general the patient was doing well today.", {},
     "In [FACILITY] [REL_DATE].", None),
    ("Please mark the chart now", {}, "Please [PERSON] now", None),
    ("white blood cell 10 ng", {}, "[PERSON] blood cell 10 [PERSON]", {"persons": 2}),
    ("Gave 5 mg Streptomycin.", {}, "Gave [ADDRESS]reptomycin.", {"addresses": 1}),
    ("He planned to follow up soon ok", SH, "He [INSURANCE] soon ok", None),
    ("see http://a.b/c@d.com.", SH, "see [URL]", {"emails": 1, "urls": 1}),
    ("[EMAIL] a@b.co", {}, "[EMAIL] [EMAIL]", {"emails": 1}),
    ("XXX-XX-1234 xxx-xx-1234 123-45-6789", {}, "XXX-XX-1234 [SSN] [SSN]",
     {"ssn": 2}),
    # a word laid open by an address that ends inside a word
    ("Gave 5 mg StJohn Smithers.", {}, "Gave [ADDRESS][PERSON].",
     {"addresses": 1, "persons": 1}),
    ("Bed 5ABCDEDavid Harmonix", {}, "[ADDRESS][PERSON]",
     {"addresses": 1, "persons": 1}),
    # clinical terms and saints
    ("E Coli, St Kilda Roadhouse.", SH, "E Coli, St Kilda Roadhouse.", {}),
    ("sepsis noted", {"config": {"names": ["sepsis"]}}, "sepsis noted", {}),
    ("sep-sis noted", {"config": {"names": ["sep-sis"]}}, "sep-sis noted", {}),
    ("Mr\nSa", {}, "Mr\nSa", {}),
    ("Mr Sa", {}, "[PERSON]", {"persons": 1}),
    # normalize and tidy
    ("Really?!  e.g., this… ok ,then\n. End", {}, "Really! e.g, this. ok,then. End",
     {}),
    ("5″ wide ′x′", {}, "5'' wide 'x'", {}),
    ("Medical\nCenter visit", {}, "[PERSON] visit", {"persons": 1}),
    ("Medical Center visit", {}, "[FACILITY] visit", {"facilities": 1}),
    ("  a   b ,, c ", {"skip": list(fixed.TOKENS), **SH}, "a b, c", {}),
    ("a\x85b c \td\r\n e", {}, "a b c d\r\n e", {}),
    # Unicode
    ("éClark Clark’s naïve 123456é 123456", {},
     "éClark [PERSON]'s naïve 123456é [MRN]", {"persons": 1, "mrn": 1}),
    ("１２３４５６ ٣٤٥٦٧٨ end", {}, "[MRN] [MRN] end", {"mrn": 2}),
    ("mın gelen alı ve kİm ise", {}, "mın gelen alı ve kİm ise", {}),
    ("Kim KİM KIM", {}, "[PERSON] KİM [PERSON]", {"persons": 2}),
    ("MÜLLER müller Straße", {"config": {"names": ["Müller"]}},
     "[PERSON] [PERSON] Straße", {"persons": 2}),
    ("seen by MUELLER-ÖZ today", {"config": {"names": ["Mueller-öz"]}},
     "seen by [PERSON] [REL_DATE]", {"persons": 1, "relative_dates": 1}),
    # marks used inside the engine survive as text
    ("\x01x\x02 Kim \x03\x04\x05 a@b.co", {},
     "\x01x\x02 [PERSON] \x03\x04\x05 [EMAIL]", {"persons": 1, "emails": 1}),
    ("a \x01b c", {"config": {"names": ["b", "a \x01b"]}}, "[PERSON] c",
     {"persons": 1}),
    # dictionaries
    ("Zelda Fitzgerald", {"config": {"names": ["Zelda", "Zelda Fitzgerald"]}},
     "[PERSON] Fitzgerald", {"persons": 1}),
    ("at the phone desk 555-111-2222", {"config": {"keywords": ["phone"]}},
     "at the [FACILITY] desk [[FACILITY]]", {"phones": 1, "facilities": 2}),
    ("O’Brien o'brien", {"config": {"names": ["O'Brien"]}}, "[PERSON] [PERSON]",
     {"persons": 2}),
    ("a+b c", {"config": {"names": ["a+b"]}}, "[PERSON] c", {"persons": 1}),
    ("12 and 1234 and 123456",
     {"config": {"mrn_min_length": 2, "mrn_max_length": 4}},
     "[MRN] and [MRN] and 123456", {"mrn": 2}),
    (None, {}, None, {}),
    ("", SH, "", {}),
]


@pytest.fixture(scope="module")
def results(run):
    """All cases with the same options share one plan."""
    groups = {}
    for text, options, _, _ in CASES:
        groups.setdefault(repr(options), (options, []))[1].append(text)
    found = {}
    for key, (options, texts) in groups.items():
        found |= {(key, t): row for t, row in zip(texts, run(texts, **options))}
    return found


@pytest.mark.parametrize("case", CASES, ids=lambda c: repr(c[0])[:40])
def test_case(results, case):
    text, options, redacted, counts = case
    row = results[repr(options), text]
    assert row.redacted == redacted
    if counts is not None:
        assert counted(row) == counts
    assert row.redactions_total == sum(row.redaction_counts)


def test_schema_and_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "id long, note string, w double")
    out = redact(df, "note")
    assert out.columns == [
        "id", "note", "w", "redacted", "redaction_counts", "redactions_total"
    ]
    fields = out.schema["redaction_counts"].dataType.fields
    assert [f.name for f in fields] == list(fixed.COUNT_FIELDS)
    assert {f.dataType.simpleString() for f in fields} == {"bigint"}
    assert not any(f.nullable for f in fields)
    assert redact(df, "note", counts=False).columns == ["id", "note", "w", "redacted"]


def test_text_without_counts_is_the_same(spark, run):
    texts = [case[0] for case in CASES]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    bare = {r.id: r.redacted for r in redact(df, counts=False).collect()}
    assert bare == {r.id: r.redacted for r in run(texts)}


def test_single_rule(spark):
    df = spark.createDataFrame([("a@b.co ,  and 555-111-2222",), (None,)], "t string")
    rows = redact_rule(df, "t", "phone").select("redacted", "n").collect()
    assert [tuple(r) for r in rows] == [("a@b.co , and [PHONE]", 1), (None, 0)]
    with pytest.raises(ValueError, match="unknown rule"):
        redact_rule(df, "t", "nonsense")


def test_taken_columns_and_unknown_categories(spark):
    df = spark.createDataFrame([("x", "y")], "text string, redacted string")
    with pytest.raises(ValueError, match="already has"):
        redact(df)
    with pytest.raises(ValueError, match="unknown categories"):
        redact(df.drop("redacted"), skip=["emails"])
