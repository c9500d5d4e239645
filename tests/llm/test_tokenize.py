"""Decoding of id ranges through the offsets that encode_column keeps."""

import numpy as np
import pytest

import __spark_entry__
from spanloom.llm.tokenize import decode, decode_range, decode_windows, default_ranks, encode_column, encoder

TEXTS = ["", "plain words, it's 12 o'clock", "𝔘𝔫𝔦 🧪🧬 漢字かな\r\n\té é ", "🏴‍☠️" * 9, "  \n\n x", " ꙮ�\x00?"]


def parts(text):
    enc = encoder(default_ranks())
    ids, _, pieces, _ = enc.encode([text])
    return ids.tolist(), np.cumsum([len(p) for p in pieces]), np.array([len(enc[p]) for p in pieces], np.int64)


@pytest.mark.parametrize("text", TEXTS)
def test_every_range_gives_the_characters_it_touches(text):
    ids, ends, counts = parts(text)
    known = {i: b for b, i in encoder(default_ranks()).ranks.items()}
    owner = [k for k, c in enumerate(text) for _ in c.encode()]  # of each byte, its character
    at = np.cumsum([0, *(len(known[i]) for i in ids)])
    for first in range(len(ids)):
        for last in range(first + 1, len(ids) + 1):
            a, b = owner[at[first]], owner[at[last] - 1] + 1
            assert decode_range(ids, ends, counts, first, last, default_ranks()) == (a, b, text[a:b])


def test_a_cut_character_is_not_lost():
    text = "ꙮ𒀱"
    ids, ends, counts = parts(text)
    assert len(ids) > 2 and "�" in decode(ids[:1], default_ranks())
    assert decode_range(ids, ends, counts, 0, 1, default_ranks())[2] == "ꙮ"


def test_bounds():
    ids, ends, counts = parts("some words")
    assert decode_range(ids, ends, counts, 0, 0, default_ranks()) == (0, 0, "")
    assert decode_range(ids, ends, counts, len(ids), len(ids), default_ranks()) == (10, 10, "")
    with pytest.raises(ValueError):
        decode_range(ids, ends, counts, 0, len(ids) + 1, default_ranks())


def joined(windows):
    text = ""
    for w in windows:
        assert w.location_start <= len(text) and w.location_end - w.location_start == len(w.text)
        text = text[: w.location_start] + w.text
    return text


def test_windows_round_trip(spark):
    rows = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "k int, t string")
    got = {r.k: r for r in decode_windows(encode_column(rows, "k", "t", offsets=True), "k", 3).collect()}
    assert {k: joined(r.windows) for k, r in got.items()} == {**dict(enumerate(TEXTS)), 99: ""}


def test_query_round_trip(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    ids = {r.doc_id: r.ids for r in __spark_entry__.queries()["p7_ids"](spark, d).collect()}
    got = __spark_entry__.queries()["p7_windows"](spark, d).collect()
    assert {r.doc_id: joined(r.windows) for r in got} == texts
    assert {r.doc_id: r.ids for r in got} == ids


def test_an_empty_range_has_a_place():
    text = "ab ꙮ𒀱 cd"
    ids, ends, counts = parts(text)
    known = {i: b for b, i in encoder(default_ranks()).ranks.items()}
    at = np.cumsum([0, *(len(known[i]) for i in ids)])
    for k in range(len(ids) + 1):
        begun = sum(b & 0xC0 != 0x80 for b in text.encode()[: at[k]])
        assert decode_range(ids, ends, counts, k, k, default_ranks()) == (begun, begun, "")


def test_new_letters_and_numbers_before_and_after_a_contraction():
    from tokenizers import Tokenizer

    from spanloom.llm.tokenize import NEW_LETTERS, NEW_NUMBERS, tokenizer_dir

    known = Tokenizer.from_file(f"{tokenizer_dir()}/byte_bpe_50k.json")
    enc = encoder(default_ranks())
    for first, last in NEW_LETTERS + NEW_NUMBERS:
        for c in (first, last):
            for text in (chr(c) + "'s", "it's" + chr(c), "a" + chr(c) + "1"):
                assert enc.encode([text])[0].tolist() == known.encode(text, add_special_tokens=False).ids, hex(c)


def test_odd_tables(spark):
    empty = encode_column(spark.createDataFrame([], "k long, t string"), "k", "t")
    assert empty.count() == 0
    rows = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "x" * 100_000, 3)], "k long, t string, ids int")
    got = [(r.k, len(r.ids)) for r in encode_column(rows, "k", "t").collect()]
    assert len(got) == 4 and (None, 2) in got and got.count((1, 0)) == 2
