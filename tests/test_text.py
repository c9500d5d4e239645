"""Span extraction, detectors and checks against the standard library."""

import ipaddress
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import draw, entropy, spans
from spanloom.operators import checks, detect

FILES = "fileId long, content string, language string"


def found(spark, kind, text):
    rows = detect.find_spans(spark.createDataFrame([(1, text, "Java"), (1, text, "Java"), (2, None, None), (3, "", None)], FILES), kind).collect()
    assert all(text[r.location_start : r.location_end] == r.value for r in rows)
    return sorted(r.value for r in rows)


def test_spans_equal_finditer(spark):
    text = "😀 a1 b22\x01 c333 ü4\n\x02d5 " * 3
    got = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), r"(\b)([a-z]\d+)()")).first()[0]
    assert [(x.start, x.end, x.value) for x in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\b[a-z]\d+", text.translate({1: " ", 2: " "}))]
    assert spark.createDataFrame([(None,)], "t string").select(spans(F.col("t"), "()(a)()")).first()[0] is None


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("email", "a@b.cc\n<x.y@mail.example>; 'q@w.e' é@ü.dé", ["a@b.cc", "x.y@mail.example", "é@ü.dé"]),
        ("ip_address", "at 84.1.2.33, 10.01.2.3 and 1.2.3.4 x", ["84.1.2.33"]),
        ("ip_address", "the dns 1.2.3.4 x", ["1.2.3.4"]),
        ("ip_address", "to 2001:db8::7 or :: x", ["2001:db8::7"]),
        ("ip_address", "on 12.10.20.99 x", []),
        ("credit_card", "4111111111111111 4111111111111112", ["4111111111111111"]),
        ("key", "AKIA" + "B2C3" * 4 + " and gh" + "p_" + "a" * 36, ["AKIA" + "B2C3" * 4, "gh" + "p_" + "a" * 36]),
        ("gender", "A Man, a female; non-binary", ["Man", "female", "non-binary"]),
    ],
)
def test_detectors(spark, kind, text, want):
    assert found(spark, kind, text) == sorted(want)


def test_unknown_kind_and_language(spark):
    df = spark.createDataFrame([(1, "x", "Java")], FILES)
    with pytest.raises(ValueError):
        detect.find_spans(df, "shoe_size")
    with pytest.raises(ValueError):
        detect.only_language(df, "cobol")


def test_search_numbers_from_zero(spark):
    df = spark.createDataFrame([(1, 'password = "abcdef" a@b.cc and 84.1.2.33 x', "Java"), (2, "nothing", "Java")], FILES)
    rows = sorted((r.piiId, r.piiType, r.detectedBy) for r in detect.search(df).collect())
    assert rows == [(0, "email", "regex"), (1, "ip_address", "regex"), (2, "password", "rule")]


def test_remap_leaves_the_end_to_the_next_chunk(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 5, 15)], "fileId long, chunk int, char_start int, char_end int")
    hits = spark.createDataFrame([(1, 0, 6, 10, "end"), (1, 1, 1, 5, "end")], "fileId long, chunk int, start int, end int, value string")
    assert [(r.location_start, r.location_end) for r in detect.remap(hits, pieces).collect()] == [(6, 10)]


@pytest.mark.parametrize("value", ["8.8.8.8", "10.1.1.1", "192.168.0.1", "172.20.1.1", "100.64.0.1", "203.0.113.5", "255.255.255.255", "127.0.0.1", "1.2.3.004", "2001:4860:4860::8888", "fe80::1", "::1", "256.1.1.1", "x"])
def test_public_addresses_equal_the_standard_library(spark, value):
    try:
        want = ipaddress.ip_address(value).is_global
    except ValueError:
        want = False
    assert bool(spark.range(1).select(checks.good_ip(F.lit(value))).first()[0]) == want


@pytest.mark.parametrize("text", ["", "aaaa", "abcd", "aab😀", None])
def test_entropy(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(entropy(F.col("t"))).first()[0]
    want = None if text is None else -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())
    assert got is None if want is None else abs(got - want) < 1e-9


RECORDS = "fileId long, piiId int, piiType string, value string, location_start int, location_end int, content string"


def check(spark, kind, value, content, start):
    row = (1, 0, kind, value, start, start + len(value or ""), content)
    return [(r.value, r.location_start, r.location_end) for r in checks.passed(spark.createDataFrame([row], RECORDS)).collect()]


@pytest.mark.parametrize(
    ("kind", "content", "value", "want"),
    [
        ("email", "x <a@b.cc>, y", "<a@b.cc>,", "a@b.cc"),
        ("email", "a@b..cc", "a@b..cc", None),
        ("email", "a@@b.cc", "a@@b.cc", None),
        ("key", 'k = "A1b2C3d4E5f6G7h8"', "1b2C3d4E5f6G7h", "A1b2C3d4E5f6G7h8"),
        ("key", "k = aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaa", None),
        ("name", "by Ann B. Miller.", "Ann B. Miller.", "Ann B. Miller"),
        ("name", "by Ann", "Ann", None),
        ("password", "p = 'hunter2hunter2'", "hunter2hunter2", "hunter2hunter2"),
        ("password", "p = 'password123'", "password123", None),
        ("username", " some_user ", " some_user ", "some_user"),
        ("username", "root", "root", None),
        ("gender", "male", "male", "male"),
        ("email", "x", None, None),
    ],
)
def test_checks(spark, kind, content, value, want):
    start = content.find(value) if value else 0
    got = check(spark, kind, value, content, start)
    assert [g[0] for g in got] == ([want] if want else [])
    assert all(content[a:b] == v for v, a, b in got)


def test_draw_is_even_and_depends_on_the_key(spark):
    x = [r[0] for r in spark.range(4000).select(draw(F.col("id"))).collect()]
    assert abs(sum(x) / 4000 - 0.5) < 0.02 and 0 <= min(x) and max(x) < 1 and len(set(x)) > 3990
