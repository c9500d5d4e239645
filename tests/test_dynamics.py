"""confidence_variability: dynamics over checkpoints joined with attack hits."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from spanloom.operators import dynamics

WHEN = datetime.datetime(2025, 1, 1)
PREDICTIONS = "example_id long, checkpoint string, type string, expected_words string, predicted_words string, pred_token_probs array<double>, evaluated_at timestamp"
ATTACKS = "example_id long, type string, expected_text string, middle_start int, generated_text string"


def test_by_hand(spark):
    rows = [
        (1, "base_model", "key", "abc", None, [0.2, 0.4], WHEN),
        (1, "base_model", "key", "abc", None, [0.2, 0.4], WHEN),  # delivered twice
        (1, "epoch-1", "key", "abc", "x", [0.9], WHEN),
        (1, "epoch-2", "key", "abc", "x", None, WHEN),
        (1, "epoch-3", "key", "abc", "x", [], WHEN),
        (1, "base_model", "name", "Ann", "x", [0.5, None], WHEN),  # another span of the same file
        (2, "base_model", "name", "Bo", "x", [1.0], WHEN),
        (3, "base_model", "name", "Cy", "x", None, WHEN),
    ]
    attacks = [(1, "key", "abc", 0, None), (1, "key", "abc", 0, "xxabc"), (1, "name", "Ann", 5, "ann"), (2, "name", "Bo", 1, None), (9, "name", "Di", 1, "Di")]
    spans = dynamics.confidence_variability(spark.createDataFrame(rows, PREDICTIONS))
    out = dynamics.with_hits(spans, dynamics.own_hits(spark.createDataFrame(attacks, ATTACKS)))
    assert sorted(map(tuple, out.collect()), key=str) == [
        (1, "key", "abc", 2, 0.6, 0.3, True),
        (1, "name", "Ann", 1, 0.5, 0.0, False),
        (2, "name", "Bo", 1, 1.0, 0.0, False),
        (3, "name", "Cy", 0, None, None, False),
    ]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_equals_sql(spark, scale):
    d = f"/root/testdata/{scale}"
    con = duckdb.connect()
    for t in ("dynamic_predictions", "attack_predictions"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = sorted(con.execute(__spark_entry__.oracle_sql()["confidence_variability"]).fetchall())
    got = sorted(map(tuple, __spark_entry__.queries()["confidence_variability"](spark, d).collect()))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a[:4] + a[6:] == b[:4] + b[6:]
        assert all(math.isclose(x, y, abs_tol=2e-9) for x, y in zip(a[4:6], b[4:6]))


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
