"""p9_found: texts cut off by field limits or in transfer."""

import random

import pytest

from spanloom.llm.cut import DONE, OPEN, UNSURE, cut_texts, end_of, goes_on, source_limits, strict_prefixes, truncation_rates

BODY = "The first reader holds the queue. The second reader waits for it.\n\n"
DOCS = "doc_id long, source string, text string, lang string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (BODY + "The third reader frees the block while the wri", OPEN),
        (BODY + "The third reader frees the block.", DONE),
        (BODY + "The third reader frees the block…", OPEN),
        (BODY + "The third reader [truncated]", OPEN),
        (BODY + "and so on...", DONE),
        (BODY + "Refs: #4711", DONE),
        (BODY + "- item\n- second item", UNSURE),
        (BODY + "```\nrun it\n```", DONE),
        (BODY + "## A headi", OPEN),
        ("ok", DONE),
        ("", DONE),
        (None, DONE),
        ("def f(x):\n    y = x\n    z = g(x, y)\n    return z", UNSURE),
        ("def f(x):\n    y = x\n    z = g(x, y)\n    return g(z, y", OPEN),
        ("int f() {\n    a();\n    b();\n    return 1;\n}\n", DONE),
        ("int f() {\n    a();\n    b();\n    c();\n    int value = othe", OPEN),
        ("默认配置生成空字符串，在下次重试之前。临时文件保存旧的归", OPEN),
        ("默认配置生成空字符串，在下次重试之前。临时文件保存旧的归档。", DONE),
    ],
)
def test_ends(text, want):
    assert end_of(text) == want


@pytest.mark.parametrize("parts", [1, 5])
def test_prefixes_equal_brute_force(spark, parts):
    r = random.Random(4)
    texts = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 12))) for _ in range(400)})
    df = spark.createDataFrame(list(enumerate(texts)), "h long, bare string")
    got = {x.h for x in strict_prefixes(df, parts).collect()}
    assert got == {i for i, t in enumerate(texts) if any(u.startswith(t) and u != t for u in texts)}
    assert got


def test_limits(spark):
    rows = [(i, "s", "x" * 50, None) for i in range(8)] + [(i, "s", "y" * i, None) for i in range(10, 40)] + [(99, "t", "z" * 50, None)]
    got = {(r.source, r.unit, r["size"]) for r in source_limits(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {("s", "char", 50), ("s", "byte", 50)}


def test_evidence_and_odd_rows(spark):
    code = "def f(x):\n    y = g(x)\n    return compute_value\n"
    rows = [
        (1, "s", BODY + "The third reader frees the bl", "en"),
        (2, "s", BODY + "The third reader frees the block.", "en"),
        (3, "s", code.rstrip()[:-2], None),  # ends like an identifier that nothing else holds
        (4, "s", code + "\ndef h(x):\n    return f(compute_value)", None),
        (5, None, None, None),
        (6, "s", "", None),
        (7, "s", " \n", None),
        (8, "s", BODY * 3000 + "The last reader is cut in the mid", "en"),
        (9, "s", BODY + "The third reader frees the bl", "en"),
    ]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "evidence")
    got = {r.doc_id: r.evidence for r in cut_texts(df).collect()}
    assert set(got) == {1, 3, 8, 9}
    assert got[3] == ["prefix", "word"]
    rates = {r.source: (r.n_texts, r.n_cut) for r in truncation_rates(df).collect()}
    assert rates == {"s": (8, 4), None: (1, 0)}
    assert cut_texts(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("text", ["\n" * 200_000 + "a b c d e f", "a b c d e f" + " " * 200_000, "a b c d e f " + "�" * 50_000, "x" * 200_000])
def test_long_runs_take_no_time(text):
    import time

    began = time.time()
    end_of(text)
    assert time.time() - began < 2


def test_all_texts_take_part_in_the_prefix_join(spark):
    items = "- первый пункт из списка\n- второй"
    told = BODY + "The reader is told of it in section 3."
    plain = "The fourth reader takes the last block of the inner queue."
    rows = [
        (1, "s", items, "ru"),  # less than 40 letters
        (2, "s", items + " пункт.", "ru"),
        (3, "s", told, "en"),  # seems finished
        (4, "t", told + "2 of the same book.", "en"),
        (5, "s", BODY + "- item\n- second item \n", "en"),  # no prefix of itself
        (6, "s", plain, "en"),
        (7, "s", plain + " It is empty then.", "en"),
        (8, "s", "See the", "en"),  # few words
        (9, "s", "See the reader of the inner queue.", "en"),
        (10, "s", BODY + "- item\n- second item…", "en"),
        (11, "s", BODY + "The third reader frees the bl", "en"),
        (12, "s", BODY + "The third reader frees the block.", "en"),
    ]
    got = {r.doc_id: r.evidence for r in cut_texts(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: ["prefix"], 3: ["prefix"], 10: ["end"], 11: ["end", "prefix"]}


@pytest.mark.parametrize(
    ("tail", "rest", "want"),
    [
        ("the bl", "ock.", True),
        ("section 3.", "2 of it", True),
        ("the block.", " The next", False),
        ("the block.", "\n\nThe next", False),
        ("归档。", "下次", False),
        ("归", "档。", True),
        ("Refs: #4711", " and others", True),
        ("}", "\n\nint g() {", False),
    ],
)
def test_goes_on(tail, rest, want):
    assert goes_on(tail, rest) is want
