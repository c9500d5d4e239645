"""Exact quantiles without gathering a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles by linear interpolation between neighbours; null values don't count, and without values all are None.

    Three passes: count and range, a histogram of BUCKETS equal ranges (that many numbers reach the driver), and the sorted
    rows of the buckets that hold the neighbours. Ties only make one bucket larger, never the others."""
    values = df.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    n, low, high = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    if low == high:
        return [low] * len(shares)
    bucket = F.least(F.floor((F.col("x") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    marked = values.withColumn("b", bucket)
    counts = {r["b"]: r["n"] for r in marked.groupBy("b").agg(F.count("*").alias("n")).collect()}
    before, start = 0, {}
    for b in sorted(counts):
        start[b] = before
        before += counts[b]
    wanted = sorted({p for s in shares for p in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    homes = {p: max(b for b in start if start[b] <= p) for p in wanted}
    # equal values count once with their number, so that a bucket of ties is one row
    own = marked.filter(F.col("b").isin(sorted(set(homes.values())))).groupBy("b", "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("x"))
    rows = own.withColumns({"upto": upto, "first": upto - F.col("n")})
    hit = F.lit(False)
    for p, b in homes.items():
        hit = hit | ((F.col("b") == b) & (F.col("first") <= p - start[b]) & (F.col("upto") > p - start[b]))
    found = rows.filter(hit).collect()
    at = {p: next(r["x"] for r in found if r["b"] == b and r["first"] <= p - start[b] < r["upto"]) for p, b in homes.items()}
    out = []
    for s in shares:
        place = s * (n - 1)
        a, b = at[math.floor(place)], at[math.ceil(place)]
        out.append(a + (b - a) * (place - math.floor(place)))
    return out
