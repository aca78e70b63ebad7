"""Texts made to blow up a backtracking matcher must finish, and come out right."""

import time

from conftest import counted

N = 20_000

HOSTILE = {
    "labels": "a at b" + " dot a" * N,
    "labels with dots": "a at b" + " dot a." * N,
    "labels without words": "a at b" + " dot --" * N,
    "no address in sight": "a." * N,
    "runs and an at sign": "a." * N + " x@y",
    "runs of pluses": "a+" * N + "@",
    "many ats": "a@" * N,
    "dotted domain": "a@" + "1." * N,
    "at at at": "at " * N + "dot",
    "capitals": "O'" * N,
    "capitals at the end": "Bb " + "Cc'" * N + "9",
    "line breaks after a label": "MRN" + "\n" * N + "!x",
    "line breaks after a unit": "Bed" + "\n" * N + "x",
    "line breaks after a street": "5 Main St" + "\n" * N + "x",
    "line breaks after a degree": "1.5" + "\n" * N + "x",
    "line breaks after a plan": "Plan" + "\n" * N + "!x",
    "line breaks after a vin": "VIN" + "\n" * N + "!x",
    "line breaks alone": "x" + "\n" * N + "x",
    "line breaks at the end": "x" + "\n" * N,
    "punctuation": "x" + "?!" * N,
    "digits": "1" * N,
    "digit groups": "1 " * N,
    "dotted digits": "1." * N,
    "ordinals": "1 1st " * N,
    "counties": "County a- " * N,
    "dashes": "chart " + "-" * N + "_",
    "months": "mar" * N,
    "names": "Li Li " * N,
    "letters": "a" * N,
    "slashes": "s/" * N,
    "marks": "\x01\x02\x03" * N,
}


def test_hostile_texts_finish(run):
    start = time.monotonic()
    rows = dict(zip(HOSTILE, run(list(HOSTILE.values()), safe_harbor=True), strict=True))
    assert time.monotonic() - start < 120
    # one address however many labels it has: no label is left over
    assert rows["labels"].redacted == "[EMAIL]"
    assert counted(rows["labels with dots"]) == {"emails": 1}
    assert rows["labels with dots"].redacted == "[EMAIL]."
    assert counted(rows["labels without words"]) == {}
    assert rows["line breaks alone"].redacted == HOSTILE["line breaks alone"]
    assert rows["line breaks at the end"].redacted == "x"
    assert rows["punctuation"].redacted == "x!"
    assert rows["marks"].redacted == HOSTILE["marks"]
