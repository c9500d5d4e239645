"""Records: strip, first wins, relocate, clean, merge; judging; sampling."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import judge, records, sampling

ROW = "fileId long, content string, piiId int, piiType string, location_start int, location_end int, value string, detectedBy string, isHumanReviewed boolean"


def frame(spark, *rows):
    return spark.createDataFrame([(1, c, i, t, a, b, v, "regex", False) for i, (c, t, a, b, v) in enumerate(rows)], ROW)


@pytest.mark.parametrize(
    ("content", "start", "end", "value", "want"),
    [
        ("abc secret xyz", 4, 10, "secret", (4, 10)),
        ("abc secret xyz", 0, 6, "secret", (4, 10)),
        ("x" * 60 + "secret", 0, 6, "secret", (60, 66)),
        ("x" * 300 + "secret", 0, 6, "secret", (-1, -1)),
        ("secret .. secret", 7, 9, "secret", (0, 6)),
        ("abc", 0, 0, "", (-1, -1)),
        ("abc", 0, 0, None, (-1, -1)),
        (None, 0, 1, "x", (-1, -1)),
        ("ab", -3, -1, "ab", (0, 2)),
    ],
)
def test_relocate(spark, content, start, end, value, want):
    r = records.relocate(frame(spark, (content, "key", start, end, value))).first()
    assert (r.location_start, r.location_end) == want


def test_strip_and_first_wins(spark):
    df = frame(spark, ("  ab  ", "key", 0, 6, "  ab  "), ("x", "email", 2, 4, "ab"), ("x", "name", 9, 9, "   "))
    out = records.strip_value(df).orderBy("piiId").collect()
    assert [(r.value, r.location_start, r.location_end) for r in out] == [("ab", 2, 4), ("ab", 2, 4), ("", 9, 9)]
    assert sorted(r.piiId for r in records.first_wins(records.strip_value(df)).collect()) == [0, 2]


def test_clean(spark):
    df = frame(spark, *[("", t, 0, 0, v) for t, v in [("email", "abc"), ("email", "abcd"), ("email", "x" * 300), ("email", "x" * 301), ("name", "Anna"), ("name", "An B"), ("key", "12345678"), ("key", "123456789"), ("ip_address", "10.1.2.3"), ("ip_address", "10.01.2.3"), ("ip_address", "2020-10-11"), (None, "abcd"), ("email", None)]])
    assert sorted(r.piiId for r in records.clean(df).collect()) == [1, 2, 5, 7, 8, 11]


def test_merge(spark):
    one = frame(spark, ("abcdef", "bigcode_key", 0, 3, "abc"), ("abcdef", "nonsense", 3, 6, "def"))
    two = frame(spark, ("abcdef", "email", 0, 3, "abc"), ("abcdef", "email", 0, 3, "def"))
    out = records.merge_records(one, two).orderBy("piiId").collect()
    assert [(r.piiId, r.piiType, r.value, r.location_start) for r in out] == [(0, "key", "abc", 0), (1, "email", "def", 3)]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"score": 7, "reason": "r"}', (7, "r")),
        ('text ```json\n{"score": 8, "reason": "r"}\n``` more', (8, "r")),
        ('I say "score": 9 since "reason": "it fits" ok', (9, "it fits")),
        ("nothing", (0, "nothing")),
        (None, (0, None)),
    ],
)
def test_answers(spark, answer, want):
    r = spark.createDataFrame([(answer,)], "a string").select(judge.parse_answer(F.col("a")).alias("x")).first().x
    assert (r.score, r.reason) == want


def test_fold(spark):
    text = "x" * 50
    rows = [(i, t, "x" * 8, a, a + 8, "regex", text) for i, t, a in [(1, "key", 0), (1, "key", 9), (1, "email", 20), (2, "email", 0), (3, "email", 0), (3, "email", 9)]]
    df = spark.createDataFrame(rows, "id long, piiType string, value string, location_start int, location_end int, detectedBy string, content string")
    sure = lambda r: r.withColumns({"score": F.lit(100), "reason": F.lit("")})
    out = [(r.id, r.piiType) for r in judge.fold(df, sure).collect()]
    assert sorted(out) == [(1, "key"), (2, "email"), (3, "email")]  # one per file, earlier types first
    assert len([x for x in judge.fold(df, sure, enough=1).collect() if x.piiType == "email"]) == 1
    assert len(judge.fold(df, lambda r: r.withColumns({"score": F.lit(0), "reason": F.lit("")})).collect()) == 6  # those below stay


SPAN = "id long, location_start int, location_end int, piiType string, value string, score int"


def test_splits(spark):
    rows = [(i, 0, 5, "key" if i % 3 else "email", f"v{i}", i % 101) for i in range(300)] + [(7, 9, 12, "name", None, None)]
    df = spark.createDataFrame(rows, SPAN)
    out = sampling.stratified_split(df, 40, 10).collect()
    sizes = {}
    for r in out:
        sizes[r.piiType, r.split] = sizes.get((r.piiType, r.split), 0) + 1
    assert len(out) == 301 and sizes == {("key", "train"): 40, ("key", "val"): 10, ("key", "test"): 150, ("email", "train"): 40, ("email", "val"): 10, ("email", "test"): 50, ("name", "train"): 1}
    again = sampling.stratified_split(df.repartition(7), 40, 10).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    best = sampling.one_per_file(df, 5).filter("piiType = 'key'").collect()
    assert len(best) == 5 and min(r.score for r in best) >= 97
    ratio = sampling.ratio_split(df.filter("score is not null")).groupBy("piiType").pivot("split").count().collect()
    assert all(abs(r.train / (r.train + (r.val or 0) + (r.test or 0)) - 0.8) < 0.06 for r in ratio)
    assert sampling.duplicates(df.union(df)).count() == 301 and sampling.first_n(df, 3, "id").count() == 3 and sampling.first_n(df, None).count() == 301
