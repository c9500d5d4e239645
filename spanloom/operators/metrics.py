"""Model evaluation: accuracies, probabilities, perplexity, summaries, answers cut at stop marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100
STOPPERS = ["<fim_end>", "</s>", "<|endoftext|>"]


def shifted_hits(predicted: Column, labels: Column) -> Column:
    """struct<correct, total>: the prediction at a place is for the label of the next one; ignored labels don't count."""
    n = F.least(F.size(predicted), F.size(labels)) - 1
    pairs = F.arrays_zip(F.slice(predicted, F.lit(1), F.greatest(n, F.lit(0))).alias("p"), F.slice(labels, F.lit(2), F.greatest(n, F.lit(0))).alias("l"))
    counted = F.filter(pairs, lambda x: x["l"] != IGNORED)
    return F.struct(F.size(F.filter(counted, lambda x: x["p"] == x["l"])).alias("correct"), F.size(counted).alias("total"))


def span_hits(predicted: Column, labels: Column, start: Column) -> Column:
    """The same for the labels from `start` (the place before the first one) on, within the sequence."""
    at = F.sequence(F.lit(0), F.size(labels) - 1)
    own = F.filter(F.when(F.size(labels) > 0, at).otherwise(F.expr("cast(array() as array<int>)")), lambda i: start + i < F.size(predicted))
    right = F.filter(own, lambda i: F.get(predicted, start + i) == F.get(labels, i))
    return F.struct(F.size(right).alias("correct"), F.size(own).alias("total"))


def ratio(correct: Column, total: Column) -> Column:
    return F.when(total > 0, correct / total).otherwise(F.lit(0.0))


def true_probabilities(logits: Column, labels: Column) -> Column:
    """At each place the probability of the label, by a softmax that can't overflow."""

    def one(row: Column, label: Column) -> Column:
        top = F.array_max(row)
        total = F.aggregate(row, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.exp(F.get(row, label) - top) / total

    return F.zip_with(logits, labels, one)


def perplexity(loss: Column) -> Column:
    """E to the loss, infinite where that overflows."""
    return F.when(loss > 709.0, F.lit(float("inf"))).otherwise(F.exp(loss))


def accuracy_by(rows: DataFrame, checkpoint: str, kind: str) -> DataFrame:
    """Correct, total and accuracy per checkpoint, for each type and over all (type null)."""
    sums = rows.rollup(checkpoint, kind).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.grouping_id().alias("level"))
    return sums.filter("level < 2").drop("level").withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("total")), 6))


SUMMARY = r"^(\S+) - (Test|train) accuracy: ([0-9.]+) correct: (\d+) total: (\d+)\s*$"


def parse_summary(lines: DataFrame, line: str = "line") -> DataFrame:
    """E5 backwards: checkpoint, split, accuracy, correct and total of each line; broken lines give no row."""
    part = lambda i: F.regexp_extract(line, SUMMARY, i)
    good = lines.filter(F.col(line).rlike(SUMMARY))
    rest = [c for c in lines.columns if c != line]
    return good.select(*rest, part(1).alias("checkpoint"), F.lower(part(2)).alias("split"), part(3).cast("double").alias("accuracy"), part(4).cast("long").alias("correct"), part(5).cast("long").alias("total"))


def first_of_type(rows: DataFrame, kind: str, n: int, *order: str) -> DataFrame:
    """The first rows of each type. Rows beyond the n-th are dropped before types meet: each value of the leading order
    column keeps at most n rows first."""
    lead = Window.partitionBy(kind, order[0]).orderBy(*order[1:])
    few = rows.withColumn("nth", F.row_number().over(lead)).filter(F.col("nth") <= n).drop("nth")
    return few.withColumn("nth", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col("nth") <= n)


def cut_answer(text: Column, stoppers: list[str] = STOPPERS) -> Column:
    """The text before a stop mark, the first of the list that occurs at all."""
    out = text
    for mark in reversed(stoppers):
        out = F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, 1)).otherwise(out)
    return out


def attack_summary(attacks: DataFrame) -> DataFrame:
    """Answers given, questions asked and their share."""
    sums = attacks.distinct().agg(F.count("generated_text").alias("generated_count"), F.count("*").alias("total"))
    return sums.withColumn("rate", F.round(ratio(F.col("generated_count"), F.col("total")), 6))
