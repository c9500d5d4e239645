"""p8_found: passages of reference items in documents."""

import random

import __spark_entry__
import pytest

from spanloom.llm.contain import RUN, Patterns, contained_items, head, held, stock_heads, words


def prose(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_scan_finds_every_run():
    r = random.Random(3)
    items = [[str(r.randrange(6)) for _ in range(12)] for _ in range(3)]
    p = Patterns(items)
    text = [str(r.randrange(7)) for _ in range(3000)]
    at, _ = p.scan(p.numbers(text))
    runs = {tuple(i[k : k + RUN]) for i in items for k in range(len(i) - RUN + 1)}
    assert at.tolist() == [k for k in range(len(text) - RUN + 1) if tuple(text[k : k + RUN]) in runs]
    assert len(at)


def test_two_fifths_in_order_and_one_place():
    item, other = prose(1, 50), prose(2, 200)
    p = Patterns([item])
    part = item[10:30]
    cases = {
        "whole": other[:80] + item + other[80:],
        "two fifths": other[:80] + part + other[80:],
        "less": other[:80] + part[:-1] + other[80:],
        "single words changed": other[:80] + [w if k % 8 else "zz" for k, w in enumerate(item)] + other[80:],
        "other order": [w for k in range(25, -1, -5) for w in item[k : k + 4]],
        "scattered": [w for k in range(0, 50, 5) for w in item[k : k + 4] + other[k * 3 : k * 3 + 15]],
    }
    found = {d for d, _ in held(p, [" ".join(t) for t in cases.values()])}
    assert [n for k, n in enumerate(cases) if k in found] == ["whole", "two fifths", "single words changed"]


def test_case_marks_and_spacing_do_not_matter():
    item = prose(1, 40)
    p = Patterns([item, words("每个字符都单独算作一个词并且按顺序比较")])
    texts = [None, "", "> " + "\n> ".join(w.upper() + "," for w in item), "“每个字符，都单独算作一个词，并且”"]
    assert sorted(held(p, texts)) == [(2, 0), (3, 1)]


def test_stock_instruction_does_not_count(spark):
    rows = [(k, f"Read it and answer. Be brief. {' '.join(prose(k, 9))}.") for k in range(4)] + [(9, "Read this. " + " ".join(prose(9, 9))), (10, None), (11, "")]
    stock = stock_heads(spark.createDataFrame(rows, "item_id int, text string"), "text")
    assert stock == {"read it and answer", "be brief"}
    assert all("answer" not in head(t, stock)[1] for _, t in rows[:4]) and head(rows[4][1], stock)[1] == rows[4][1]


@pytest.mark.parametrize("shard_words", [1_000_000, 20])
def test_tables(spark, shard_words):
    items = [(k, " ".join(prose(k, 15)), "x") for k in range(5)] + [(0, " ".join(prose(0, 15)), "x"), (7, None, None), (8, "", None), (9, "short", None)]
    docs = [(k, "pre " + " ".join(prose(k, 15)) + " post", "y") for k in range(5)] + [(0, "pre " + " ".join(prose(0, 15)) + " post", "y"), (None, None, None), (20, "", None), (21, "word " * 100_000, None), (None, " ".join(prose(2, 15)), None)]
    docs, items = spark.createDataFrame(docs, "doc_id int, text string, item_id string"), spark.createDataFrame(items, "item_id int, text string, doc_id string")
    got = contained_items(docs, items, shard_words=shard_words).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(k, k) for k in range(5)] + [(None, 2)], key=repr)
    assert contained_items(docs.limit(0), items).count() == 0 and contained_items(docs, items.limit(0)).count() == 0


def test_query_is_registered():
    assert "p8_found" in __spark_entry__.queries()
