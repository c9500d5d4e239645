"""Attack matching, effects, reports and file sources."""

import html
import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import attack, causal, reports
from spanloom.sources import files
from spanloom.sources.durable import shared_folder

ATTACKS = "example_id long, type string, expected_text string, generated_text string"


@pytest.mark.parametrize("chars", [8_000_000, 4])
def test_any_answer(spark, chars):
    rows = [(1, "key", "abc", "xx bcd abc"), (2, "key", "bcd", "none"), (3, "name", "abc", "bcd"), (4, "key", None, None), (5, "key", "", "abc"), (6, "key", "zz", "ＡＢＣ abc"), (6, "key", "zz", "ＡＢＣ abc")]
    got = {r.example_id: r.n_values for r in attack.any_answer_hits(spark.createDataFrame(rows, ATTACKS), chars=chars).collect()}
    assert got == {1: 2, 5: 1, 6: 1}
    assert attack.any_answer_hits(spark.createDataFrame([], ATTACKS)).count() == 0


def test_matcher():
    m = attack.Matcher(["he", "she", "", "hers"])
    assert sorted(m.find("ushers")) == [(1, 3, "she"), (2, 3, "he"), (2, 5, "hers")]
    assert m.first(None) is None and attack.Matcher(["ABC"], True).first("x ＡＢＣ")[2] == "abc"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    out = []
    for i in range(800):
        x = r.gauss(0, 1)
        treated = int(r.random() < 1 / (1 + 2.7 ** (-x)))
        out.append((f"k{i}", treated, int(r.random() < 0.2 + 0.3 * treated + 0.1 * (x > 0)), x, r.random()))
    return spark.createDataFrame(out, "key string, treated int, outcome int, x double, y double").cache()


def test_nearest_equals_brute_force(rows):
    scored = causal.propensity(rows, ["x", "y"])
    got = causal.nearest(scored, "key").collect()
    for r in got[::37]:
        others = [o for o in got if o.treated != r.treated]
        least = min(abs(o.score - r.score) for o in others)
        assert r.matched_outcome in {o.outcome for o in others if abs(abs(o.score - r.score) - least) < 1e-12}


def test_effects_find_the_planted_one(rows):
    out = dict(causal.effects(rows, "key", ["x", "y"]))
    for name in ("matching", "stratification", "weighting", "refute_subset", "refute_random_cause"):
        assert 0.15 < out[name] < 0.45, (name, out)
    assert abs(out["refute_placebo"]) < 0.15
    assert causal.matched_effect(rows.filter("treated = 1"), "key", ["x"]) is None


def test_placebo_keeps_the_arms(rows):
    assert causal.placebo(rows, "key").agg(F.sum("treated"), F.count("*")).first() == rows.agg(F.sum("treated"), F.count("*")).first()


def mark(content, records):
    out, at = "", 0
    for i, (a, b, kind) in enumerate(sorted(records, key=lambda r: r[:2])):
        if 0 <= a < len(content):
            a, b2 = max(a, at), min(b, len(content))
            if b2 > a:
                out += html.escape(content[at:a]) + f'<span id="span-{i}" class="pii {kind}" title="{kind}" data-start="{sorted(records, key=lambda r: r[:2])[i][0]}">{html.escape(content[a:b2])}</span>'
                at = b2
    return out + html.escape(content[at:])


@pytest.mark.parametrize("records", [[], [(0, 3, "key")], [(2, 5, "key"), (4, 8, "name")], [(8, 99, "key"), (-1, 2, "name")], [(50, 60, "key"), (1, 2, "key")]])
def test_html(spark, records):
    content = "a<b>&\"c'd😀f"
    df = spark.createDataFrame([(content, [(k, a, b) for a, b, k in records])], "c string, r array<struct<piiType: string, location_start: int, location_end: int>>")
    assert df.select(reports.html(F.col("c"), F.col("r"))).first()[0] == mark(content, records)
    if records == [(0, 3, "key")]:
        assert df.select(reports.terminal(F.col("c"), F.col("r"), 4)).first()[0] == "\x1b[33ma<b\x1b[0m>"


def test_shapes_and_ratings(spark):
    one = reports.normalise_shapes(spark.createDataFrame([(1, "t", "key", 0, 1, "v")], "id long, text string, piiType string, location_start int, location_end int, value string")).first()
    assert (one.id, one.path, one.text, len(one.records)) == (1, "", "t", 1)
    bare = reports.normalise_shapes(spark.createDataFrame([("p",)], "file_path string")).first()
    assert (bare.id, bare.path, bare.text, bare.records) == (None, "p", None, [])
    ratings = spark.createDataFrame([("s", "f", 1, 1), ("s", "f", 3, 2), ("s", "f", 9, 3)], "sample string, file string, rating int, rated_at int")
    assert [r.rating for r in reports.latest_ratings(ratings).collect()] == [3]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "c.txt").write_text("one\ntwo\n")
    (tmp_path / "d.csv").write_text("1,2\n3,4\n")
    (tmp_path / "e.pkl").write_bytes(b"x")
    for name in ("a.json", "b.jsonl", "c.txt", "d.csv"):
        assert files.load_file(spark, str(tmp_path / name)).count() == 2
    with pytest.raises(ValueError):
        files.load_file(spark, str(tmp_path / "e.pkl"))
    with pytest.raises(FileNotFoundError):
        files.load_file(spark, str(tmp_path / "f.json"))
    for n in (10, 9, 100):
        (tmp_path / f"part{n}.jsonl").write_text("{}\n")
    assert [p.rpartition("/")[2] for p in files.find_files(str(tmp_path))] == ["b.jsonl", "part9.jsonl", "part10.jsonl", "part100.jsonl"]
    assert files.read_folder(spark, str(tmp_path / "*.json")).select("stem").distinct().first()[0] == "a"


def test_json_in_and_out(spark, tmp_path):
    path = files.save_json({"a": [1]}, str(tmp_path / "x"))
    assert path.endswith("x.json") and json.load(open(path)) == {"a": [1]}
    (tmp_path / "broken.json").write_text('[{"a": 1}, {"a": 2}, {"a"')
    assert files.load_json_safe(str(tmp_path / "broken.json")) == [{"a": 1}, {"a": 2}]
    assert json.loads((tmp_path / "broken.json").read_text()) == [{"a": 1}, {"a": 2}]
    assert files.load_json_safe(str(tmp_path / "none.json")) == {}
    assert files.save_jsonl(spark.range(3), str(tmp_path / "y")).endswith(".jsonl") and spark.read.json(str(tmp_path / "y.jsonl")).count() == 3


def test_stages_blobs_and_sources(spark, tmp_path, monkeypatch):
    import gzip

    made = []

    def make():
        made.append(1)
        return spark.range(5)

    for config in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2}):
        assert files.stage(spark, str(tmp_path / "stages"), "s", config, make).count() == 5
    assert len(made) == 2
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "one.gz").write_bytes(gzip.compress("é".encode()))
    (tmp_path / "blobs" / "two").write_bytes(b"plain")
    (tmp_path / "blobs" / "bad").write_bytes(b"\xff\xfe")
    assert {r.blobId: r.content for r in files.read_blobs(spark, str(tmp_path / "blobs")).collect()} == {"one": "é", "two": "plain", "bad": None}
    assert files.fuller_cache(spark.range(2), spark.range(3)).count() == 3 and files.fuller_cache(None, None) is None
    train, held = files.text_source(spark.range(2000).select(F.col("id").cast("string").alias("words")))
    assert train.count() + held.count() == 2000 and 50 < held.count() < 160
    monkeypatch.delenv("SOME_TOKEN", raising=False)
    with pytest.raises(ValueError):
        files.credentials("SOME_TOKEN")
    monkeypatch.setenv("SOME_TOKEN", "x")
    assert files.credentials("SOME_TOKEN") == {"SOME_TOKEN": "x"}
    files.save_pages(spark.createDataFrame([("<p>",)], "body string"), "body", str(tmp_path / "pages"))
    assert shared_folder(spark)
