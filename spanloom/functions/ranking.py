"""Ranks and running sums within groups of any size.

A window over a whole group would put a group that holds a third of all rows into one task. Here rows are first put into
buckets by the beginning of their order key (a hexadecimal hash, hence even), the buckets' totals are summed, and only the
rows of one bucket meet in one window. The table of bucket totals has at most 16^DIGITS rows for each group and is joined
by its key; whether it is small enough to broadcast is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def _bucketed(df: DataFrame, groups: list[str], order: str, amount: Column) -> tuple[DataFrame, list[str]]:
    marked = df.withColumns({"_bucket": F.substring(order, 1, DIGITS), "_amount": amount})
    totals = marked.groupBy(*groups, "_bucket").agg(F.sum("_amount").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*groups).orderBy("_bucket")) - F.col("_total")
    keys = [*groups, "_bucket"]
    offsets = totals.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], before.alias("_before"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & marked[k].eqNullSafe(offsets[f"_o{i}"])
    return marked.join(offsets, same).drop(*[f"_o{i}" for i in range(len(keys))]), keys


def ranked(df: DataFrame, groups: list[str], order: str, name: str) -> DataFrame:
    """Adds the rank from 1 within groups by the hash column `order`, whose values differ between rows."""
    rows, keys = _bucketed(df, groups, order, F.lit(1))
    return rows.withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(order))).drop("_bucket", "_amount", "_before")


def running_before(df: DataFrame, groups: list[str], order: str, amount: Column, name: str) -> DataFrame:
    """Adds the sum of `amount` over all rows of the group before this one in the order of the hash column."""
    rows, keys = _bucketed(df, groups, order, amount)
    own = F.sum("_amount").over(Window.partitionBy(*keys).orderBy(order)) - F.col("_amount")
    return rows.withColumn(name, F.col("_before") + own).drop("_bucket", "_amount", "_before")
