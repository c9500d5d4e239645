"""p6_found: personal information."""

import numpy as np
import pytest

from spanloom.llm.personal import personal_spans, reliabilities, spans_of
from spanloom.llm.redact import redacted_strings
from tests.llm.helpers import ODD, files

KNOWN = {"given": {"ann", "jörg"}, "family": {"millervik", "rossholm"}}


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("see mail of a.millervik@mail.example now", "email", "a.millervik@mail.example"),
        ("contact: ann(at)mail dot example dot org", "email", "ann(at)mail dot example dot org"),
        ("# call +44 20 7946 0459 in case", "phone_number", "+44 20 7946 0459"),
        ('fax = "(390) 555-0113"', "phone_number", "(390) 555-0113"),
        ('ssn = "988-66-9776"', "ID", "988-66-9776"),
        ("tax_id=94 274 286 981", "ID", "94 274 286 981"),
        ("to 315 Quarry Court Apt 5, Dunhallow, QN 78421.", "address", "315 Quarry Court Apt 5, Dunhallow, QN 78421"),
        ("from Quarry-Allee 355a, D-34290 Linden-Nor", "address", "Quarry-Allee 355a, D-34290 Linden-Nor"),
        ("asked Calle Hollis 259, 45258 Mirafonte, confirmed", "address", "Calle Hollis 259, 45258 Mirafonte"),
        ("// @author Ann B. Millervik <x>", "name", "Ann B. Millervik"),
        ("owner: 'Rossholm, Jörg'", "name", "Rossholm, Jörg"),
    ],
)
def test_spans(text, kind, want):
    found = {(k, text[a:b]) for k, a, b, votes in spans_of(text, KNOWN, {})}
    assert (kind, want) in found


@pytest.mark.parametrize("text", ['part_no = "268-51-148909"', 'version = "2.90.30.4154"', 'font = "Copper Field"', "trigger@2x.png", "look at page.title"])
def test_no_spans(text):
    assert not [x for x in spans_of(text, KNOWN, {}) if sum(x[3]) > 0]


def test_em_finds_the_reliable_labelers():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.4
    votes = np.stack([np.where(r.random(4000) < q, truth, ~truth) * 2 - 1 for q in (0.95, 0.9, 0.55)], 1)
    p, prior, table = reliabilities(votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.92 and abs(prior - 0.4) < 0.05
    assert table[0, 2, 1] > 0.9 > 0.7 > table[2, 2, 1]


def test_files(spark):
    people = [("Ann", "Millervik"), ("Jörg", "Rossholm"), ("Ann", "Rossholm"), ("Jörg", "Millervik")] * 6
    rows = [(i, "a.py", f'# @author {a} {b}\nfont = "Copper Field"\nowner = "{a} {b}"\nmail = "{a[0].lower()}.{b.lower()}{i}@mail.example"\npkg = "support@mail.example"\n', f"r{i}", [(0, "name", 10, 20, f'"{a} {b}', "reviewer: +44 20 7946 0459")]) for i, (a, b) in enumerate(people)]
    rows += [rows[0], (900, "b.py", "x = 1 # Ann Millervik\n" + "y = 2\n" * 20_000, None, [None, (1, None, None, None, None, None)]), *ODD]
    df = files(spark, rows).withColumnRenamed("repoName", "pattern")
    found = personal_spans(df).collect()
    text = {k: c for k, _, c, *_ in rows}
    content = {(r.fileId, r.piiType, text[r.fileId][r.location_start : r.location_end]) for r in found if r.field == "content"}
    assert {x for x in content if x[0] == 0} == {(0, "name", "Ann Millervik"), (0, "email", "a.millervik0@mail.example")}
    assert (900, "name", "Ann Millervik") in content and not [x for x in content if "Copper" in x[2] or "support" in x[2]]
    assert sum(r.field == "notes" and r.piiType == "phone_number" for r in found) == sum(r.field == "value" for r in found) == len(people)
    out = {r.fileId: r.text for r in redacted_strings(df, personal_spans(df), "piiType").collect() if r.field == "content"}
    assert out[0].startswith('# @author name\nfont = "Copper Field"\nowner = "name"\n')
    assert personal_spans(files(spark, [])).count() == 0
