"""Training dynamics and attack hits, keyed by span: example_id, type and expected text.

Defined results: a row delivered twice counts once; a prediction without probabilities has no mean and counts in no
checkpoint; a span without an attack, or with a null answer only, isn't hit; an attack on a span that has no dynamics
gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ranking import ranked
from spanloom.functions.text import rank_key

SPAN = ["example_id", "type", "expected_words"]

#: The means are the same in any order of summation down to this many decimals.
DECIMALS = 9


def confidence_variability(predictions: DataFrame) -> DataFrame:
    """Mean and population deviation over the checkpoints of each prediction's mean probability."""
    probs = F.filter("pred_token_probs", lambda p: p.isNotNull())
    mean = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p) / F.nullif(F.size(probs), F.lit(0))
    return (
        predictions.select(*SPAN, "checkpoint", "predicted_words", "evaluated_at", "pred_token_probs")
        .distinct()
        .withColumn("mean", mean)
        .groupBy(*SPAN)
        .agg(
            F.count("mean").alias("n_predictions"),
            F.round(F.avg("mean"), DECIMALS).alias("confidence"),
            F.round(F.stddev_pop("mean"), DECIMALS).alias("variability"),
        )
    )


def own_hits(attacks: DataFrame) -> DataFrame:
    """A5: whether any answer for a span holds the span's own text."""
    hit = F.coalesce(F.contains("generated_text", "expected_text"), F.lit(False))
    return attacks.groupBy("example_id", "type", "expected_text").agg(F.max(hit).alias("attack_hit"))


def with_hits(dynamics: DataFrame, hits: DataFrame) -> DataFrame:
    """The dynamics of each span with its hit flag."""
    d, h = dynamics.alias("d"), hits.alias("h")
    same = F.lit(True)
    for mine, other in zip(SPAN, ("example_id", "type", "expected_text")):
        same = same & F.col(f"d.{mine}").eqNullSafe(F.col(f"h.{other}"))
    return d.join(h, same, "left").select("d.*", F.coalesce("h.attack_hit", F.lit(False)).alias("attack_hit"))


#: Edges of the histogram as repeated addition of a tenth gives them; a value at an edge lies above it.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def without_predictions(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Samples (id) that have no prediction; a caller that needs all of them checks that there are none."""
    return samples.select("id").distinct().join(predictions.select(F.col("example_id").alias("id")).distinct(), "id", "left_anti")


def by_type(dynamics: DataFrame) -> DataFrame:
    """Spans and mean confidence and variability of each type."""
    return dynamics.groupBy("type").agg(F.count("confidence").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg("variability"), 6).alias("mean_variability"))


def histogram(dynamics: DataFrame, column: str, divisor: int = 1200) -> DataFrame:
    """Spans of each type in each tenth of [0, 1], the last one closed, with their share of `divisor`."""
    x = F.col(column)
    bin_ = F.lit(None).cast("int")
    for i in range(10):
        inside = (x >= F.lit(EDGES[i])) & ((x < F.lit(EDGES[i + 1])) if i < 9 else (x <= F.lit(EDGES[10])))
        bin_ = F.when(inside, i).otherwise(bin_)
    counted = dynamics.withColumn("bin", bin_).filter("bin is not null").groupBy("type", "bin").agg(F.count("*").alias("n"))
    return counted.withColumn("rate", F.round(F.col("n") / divisor, 2))


def downsample(dynamics: DataFrame, key: list[str], share: float = 0.1, cells: int = 30, seed: int = 42) -> DataFrame:
    """Of each cell of a grid over (variability, confidence) a share of the spans, at least one, by the hash of the key."""
    known = dynamics.filter("variability is not null and confidence is not null")
    edges = known.agg(*[f(c).alias(f"{n}_{c}") for c in ("variability", "confidence") for n, f in (("low", F.min), ("high", F.max))]).first()

    def cell(c: str):
        low, high = edges[f"low_{c}"], edges[f"high_{c}"]
        if low is None or high == low:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(high - low) * cells), F.lit(cells - 1)).cast("int")

    placed = known.withColumns({"x": cell("variability"), "y": cell("confidence"), "order": rank_key(*[F.col(k) for k in key], seed=seed)})
    ranks = ranked(placed, ["x", "y"], "order", "nth")
    sizes = placed.groupBy("x", "y").agg(F.count("*").alias("size"))
    keep = F.greatest(F.floor(F.col("size") * share), F.lit(1))
    return ranks.join(sizes, ["x", "y"]).filter(F.col("nth") <= keep).select(*dynamics.columns, "x", "y")


def loss_curve(states: DataFrame, key: list[str], state: str) -> DataFrame:
    """The entries of trainer states (JSON) that have a loss and an epoch."""
    schema = "struct<log_history: array<struct<epoch: double, grad_norm: double, learning_rate: double, loss: double, step: bigint>>>"
    entries = states.select(*key, F.explode(F.from_json(state, schema)["log_history"]).alias("e"))
    return entries.filter("e.loss is not null and e.epoch is not null").select(*key, "e.epoch", "e.step", "e.loss")
