"""Backends: what takes the place of models. Each is a plain function that a caller may exchange.

detector   files -> spans          spanloom.operators.detect.rule_spans
judge      records -> scores       spanloom.operators.judge.rubric_judge, stored_judge
tokenizer  text column -> ids      spanloom.operators.sequences.hash_tokens
metrics    code column -> columns  spanloom.operators.covariates.function_metrics, tree_metrics
model      sequences -> predictions, here: a simulator whose answers depend on the key and the seed alone
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import draw
from spanloom.operators.sequences import VOCABULARY


def simulate(rows: DataFrame, key: list[str], expected: str, skill: float = 0.6, seed: int = 42) -> DataFrame:
    """(key, predicted_ids, probs): each expected token with its probability; where that is below 1 - skill the prediction is
    the next token of the vocabulary instead. Rows without expected tokens give empty lists."""
    k = [F.col(c) for c in key]
    probs = F.transform(F.col(expected), lambda _, i: draw(*k, i, seed=seed))
    wrong = lambda t, p: F.when(p >= 1 - skill, t).otherwise(((t + 1) % VOCABULARY).cast("int"))
    return rows.withColumn("probs", probs).select(*key, expected, F.zip_with(expected, "probs", wrong).alias("predicted_ids"), "probs")
