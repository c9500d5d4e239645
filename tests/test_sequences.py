"""Token sequences, ranks, quantiles, metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.quantiles import exact_quantiles
from spanloom.functions.ranking import ranked, running_before
from spanloom.functions.text import rank_key
from spanloom.operators import covariates, metrics, sequences

IDS = "id long, input_ids array<int>"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    return spark.createDataFrame([(i, [r.randrange(900) for _ in range(r.choice([0, 1, 2, 3, 40, 130]))]) for i in range(150)], IDS).cache()


def test_ranks_equal_windows(spark):
    df = spark.range(3000).withColumns({"g": F.when(F.col("id") % 3 > 0, F.lit("hot")), "o": rank_key(F.col("id"))})
    got = {r.id: r for r in running_before(ranked(df, ["g"], "o", "rank"), ["g"], "o", F.col("id"), "sum").collect()}
    for g in ("hot", None):
        total = 0
        for n, r in enumerate(sorted((x for x in got.values() if x.g == g), key=lambda x: x.o), 1):
            assert (r.rank, r["sum"]) == (n, total)
            total += r.id


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [0.1 * i * i for i in range(1000)], [5.0] * 900 + [1.0, 9.0], [None, 1.0, None, 3.0]])
def test_quantiles_equal_numpy(spark, values):
    known = [v for v in values if v is not None]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", [0, 0.25, 0.5, 0.75, 1])
    assert np.allclose(got, np.quantile(known, [0, 0.25, 0.5, 0.75, 1]))
    assert exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_fim_keeps_length_and_tokens(rows):
    out = rows.withColumn("made", sequences.fim(F.col("input_ids"), F.col("id"))).collect()
    marks = {sequences.PREFIX, sequences.SUFFIX, sequences.MIDDLE}
    touched = [r for r in out if r.made != r.input_ids]
    assert 40 < len(touched) < 110
    for r in touched:
        assert sum(t in marks for t in r.made) == 3
        lost = len(r.input_ids) - (len(r.made) - 3)
        assert 0 <= lost <= 3
        kept = [t for t in r.made if t not in marks]
        assert not list((np.array(sorted(kept)) < 0).nonzero()[0]) and all(kept.count(t) <= r.input_ids.count(t) for t in set(kept))
    assert any(r.made[0] == sequences.SUFFIX for r in touched) and any(r.made[0] == sequences.PREFIX for r in touched)


@pytest.mark.parametrize(("batch", "partitions"), [(None, 1), (50, 1), (50, 6)])
def test_pack_equals_concatenation(rows, batch, partitions):
    import hashlib

    ordered = sorted(rows.collect(), key=lambda r: hashlib.md5(f"{r.id}:42".encode()).hexdigest())
    want = {}
    step = batch or len(ordered)
    for b in range(0, len(ordered), step):
        joined = [t for r in ordered[b : b + step] for t in r.input_ids]
        for k in range(len(joined) // 64):
            want[b // step, k] = joined[64 * k : 64 * k + 64]
    got = {(r.batch, r.block): r.input_ids for r in sequences.pack(rows.repartition(partitions), ["id"], 64, batch).collect()}
    assert got == want


def test_pad_and_batches(rows):
    out = sequences.pad(sequences.batches(rows, ["id"], 32), pad_id=7).collect()
    by = {}
    for r in out:
        by.setdefault(r.batch, []).append(r)
    assert sorted(map(len, by.values())) == [22, 32, 32, 32, 32]
    for group in by.values():
        assert len({len(r.input_ids) for r in group}) == 1
        for r in group:
            assert len(r.labels) == len(r.attention_mask) == len(r.input_ids) and r.labels.count(sequences.PAD_LABEL) == r.attention_mask.count(0)


def test_prompts(spark):
    df = spark.createDataFrame([(1, list(range(100)), [500, 501], list(range(200, 300))), (2, [], [5], []), (3, [1], list(range(64)), [2])], "id long, prefix_ids array<int>, middle_ids array<int>, suffix_ids array<int>")
    out = {r.id: r for r in sequences.prompts(df, ["id"], 64).collect()}
    assert len(out[1].input_ids) == 64 and out[1].input_ids[-2:] == [500, 501] and out[1].input_ids[out[1].middle_start] == sequences.MIDDLE
    assert 99 in out[1].input_ids and 200 in out[1].input_ids and len(out[2].input_ids) == 4 and out[3].input_ids is None
    attack = {r.id: r for r in sequences.prompts(df, ["id"], 64, missing=20).collect()}
    assert attack[1].input_ids[-1] == sequences.MIDDLE and attack[1].middle_start == len(attack[1].input_ids) == 64 - 2 - 20


def test_block_size_and_checkpoints():
    assert sequences.block_size(None, 10**9, 2048) == 1024 and sequences.block_size(4096, 2048, 2048) == 2048 and sequences.block_size(512, 2048, 2048) == 512
    assert [c for c, _ in sequences.checkpoints(2)] == ["base_model", "epoch-1", "epoch-2"]


def test_metrics(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    a = lambda *v: F.array(*map(F.lit, v))
    hits = one(metrics.shifted_hits(a(2, 3, 9), a(-100, 2, 3)))
    assert (hits.correct, hits.total) == (2, 2)
    assert one(metrics.span_hits(a(1, 2, 3), a(2, 3, 4), F.lit(1)))["total"] == 2
    assert np.allclose(one(metrics.true_probabilities(F.array(a(1000.0, 1001.0), a(0.0, 0.0)), a(1, 0))), [1 / (1 + math.exp(-1)), 0.5])
    assert one(metrics.perplexity(F.lit(1000.0))) == math.inf and abs(one(metrics.perplexity(F.lit(1.0))) - math.e) < 1e-12
    assert one(metrics.cut_answer(F.lit("a</s>b<fim_end>c"))) == "a</s>b" and one(metrics.cut_answer(F.lit("abc"))) == "abc"


def test_format_code(spark):
    code = "<s>package a . b ; class C { void f ( ) { g ( ) ; } }</s>"
    want = "package a.b ;\nclass C {\n    void f ( ) {\n        g ( ) ;\n    }\n}"
    assert spark.range(1).select(covariates.format_code(F.lit(code))).first()[0] == want
    assert spark.range(1).select(covariates.depth(F.lit("f(a[b{c}])"))).first()[0] == 3


def test_classify_by_hand(spark):
    df = spark.createDataFrame([(0.9, 0.0), (0.1, 0.0), (0.5, 0.9), (0.6, 0.3), (0.4, 0.3), (None, None)], "confidence double, variability double")
    got = [r["class"] for r in covariates.classify(df).collect()]
    assert got == ["easy", "hard", "ambiguous", "ambiguous", "ambiguous", None]


def test_validators_and_labels(spark):
    from spanloom.operators.detect import validators

    values = ["+1 310-555-0199", "123-45-6789", "a woman", "12/31/1999", "none"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(*[c.alias(n) for n, c in validators(F.col("v")).items()]).collect()
    assert [r.phone_number for r in got] == [True, False, False, False, False] and [r.ssn for r in got] == [False, True, False, False, False]
    assert [r.gender for r in got] == [False, False, True, False, False] and [r.date_of_birth for r in got] == [False, False, False, True, False]
    row = sequences.plain_labels(spark.createDataFrame([(1, [4, 5])], IDS)).first()
    assert row.labels == [4, 5] and row.attention_mask == [1, 1]
