"""Sampling and splitting of judged spans; every order is a hash of the span's key, so that runs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.ranking import ranked
from spanloom.functions.text import rank_key

KEY = ["id", "location_start", "location_end"]
N_TRAIN, N_VAL = 1200, 150


def distinct_spans(records: DataFrame) -> DataFrame:
    """One row per span, type and value: the best score of those delivered."""
    return records.groupBy(*KEY, "piiType", "value").agg(F.max("score").alias("score"))


def stratified_split(records: DataFrame, n_train: int = N_TRAIN, n_val: int = N_VAL, min_score: int | None = None, seed: int = 42) -> DataFrame:
    """Per type shuffled; the first go to train, the next to val, all others to test."""
    rows = records if min_score is None else records.filter(F.col("score") >= min_score)
    order = ranked(rows.withColumn("order", rank_key(*[F.col(c) for c in [*KEY, "piiType", "value"]], seed=seed)), ["piiType"], "order", "rank")
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return order.withColumn("split", split).drop("order", "rank")


def one_per_file(records: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """Of each file and type the best span, of each type at most cap of them, the best first; no file in two types."""
    shuffled = rank_key(*[F.col(c) for c in [*KEY, "piiType", "value"]], seed=seed)
    best = Window.partitionBy("id").orderBy(F.desc_nulls_last("score"), shuffled)
    single = records.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")
    # the best first: the inverted score leads the order key
    order = F.concat(F.lpad(F.hex(255 - F.greatest(F.least(F.coalesce("score", F.lit(0)), F.lit(255)), F.lit(0))), 2, "0"), shuffled)
    return ranked(single.withColumn("order", F.lower(order)), ["piiType"], "order", "rank").filter(F.col("rank") <= cap).drop("order", "rank")


def enrich(records: DataFrame, files: DataFrame) -> DataFrame:
    """With the text of each span's file; spans of unknown files fall out."""
    texts = files.select(F.col("fileId").alias("id"), F.col("content").alias("text")).dropDuplicates(["id"])
    return records.join(texts, "id")


def duplicates(records: DataFrame) -> DataFrame:
    """Span keys that occur more than once."""
    return records.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")


def ratio_split(records: DataFrame, min_score: int = 80, cap: int = 1000, seed: int = 42) -> DataFrame:
    """P5: spans from a score on, one per file, at most cap per type, eight tenths to train and one each to val and test."""
    chosen = one_per_file(records.filter(F.col("score") >= min_score), cap, seed)
    order = ranked(chosen.withColumn("order", rank_key(*[F.col(c) for c in [*KEY, "piiType", "value"]], F.lit("ratio"), seed=seed)), ["piiType"], "order", "rank")
    sizes = order.groupBy("piiType").agg(F.count("*").alias("size"))
    share = F.col("rank") / F.col("size")
    return order.join(sizes, "piiType").withColumn("split", F.when(share <= 0.8, "train").when(share <= 0.9, "val").otherwise("test")).drop("order", "rank", "size")


def first_n(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """At most the first n rows of an order; all of them without a limit."""
    return rows if n is None else rows.orderBy(*order).limit(n)
