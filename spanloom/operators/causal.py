"""Effects of training dynamics on leakage: correlations, propensity scores, matching, refuters.

Rows have a key, `treated` and `outcome` (0 or 1) and numeric covariates. Everything random is a hash of the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import ArithmeticException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.ranking import ranked
from spanloom.functions.text import draw, rank_key
from spanloom.sources.durable import written

COVARIATES = ["t_token_counts", "t_n_ast_nodes", "t_complexity", "t_nloc"]
#: Ranges of the propensity score that meet in one window.
BUCKETS = 1024


def correlations(rows: DataFrame, cells: list[str], x: str = "treated", y: str = "outcome") -> DataFrame:
    """Pearson, Spearman (of mid-ranks) and Kendall's tau-b per cell. For two flags all three are the phi coefficient,
    which the counts of the four combinations give; so nothing has to be sorted."""
    one, two = F.col(x).cast("double"), F.col(y).cast("double")
    n = rows.groupBy(*cells).agg(*[F.sum(((one == a) & (two == b)).cast("double")).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    a, b, c, d = (F.col(f"n{i}") for i in ("11", "10", "01", "00"))
    scale = F.sqrt((a + b) * (c + d) * (a + c) * (b + d))
    phi = F.when(scale > 0, F.round((a * d - b * c) / scale, 6))
    return n.select(*cells, *[phi.alias(f"{name}_corr") for name in ("pearson", "spearman", "kendall")])


def naive_effect(rows: DataFrame, cells: list[str]) -> DataFrame:
    """The difference of the mean outcomes."""
    mean = lambda v: F.avg(F.when(F.col("treated") == v, F.col("outcome")))
    return rows.groupBy(*cells).agg(F.count("*").alias("n"), F.round(mean(1) - mean(0), 6).alias("effect"))


def propensity(rows: DataFrame, covariates: list[str] = COVARIATES, rounds: int = 12) -> DataFrame:
    """`score`, the probability of treatment, by a logistic model over standardised covariates. Newton steps: each is one
    aggregate of as many sums as the covariates have pairs, whatever the number of rows."""
    import numpy as np

    stats = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(covariates) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    x = [F.lit(1.0)] + [((F.col(c) - F.lit(stats[f"m{i}"] or 0.0)) / F.lit(stats[f"s{i}"] or 1.0)) for i, c in enumerate(covariates)]
    k = len(x)
    w = np.zeros(k)

    def score(weights: np.ndarray) -> Column:
        z = F.lit(0.0)
        for own, column in zip(weights.tolist(), x):
            z = z + F.lit(own) * column
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))

    for _ in range(rounds):
        p = score(w)
        sums = [F.sum((F.col("treated") - p) * x[i]).alias(f"g{i}") for i in range(k)]
        sums += [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        got = rows.agg(*sums).first()
        if got["g0"] is None:
            break
        gradient = np.array([got[f"g{i}"] for i in range(k)]) - 1e-6 * w
        hessian = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + 1e-6 * np.eye(k)
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return rows.withColumn("score", F.round(score(w), 12))


def nearest(rows: DataFrame, key: str) -> DataFrame:
    """Each row with the outcome of the other arm's row whose score is nearest (the smaller one among equals, then by key).
    Neighbours are looked for within ranges of the score; what lies beyond a range comes from a table of one row per range."""
    order = [F.col("score"), F.col(key)]
    own = rows.withColumn("b", F.least(F.floor(F.col("score") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    point = lambda arm: F.when(F.col("treated") == arm, F.struct("score", key, "outcome"))
    edges = own.groupBy("b").agg(*[f(point(arm)).alias(f"{n}{arm}") for arm in (0, 1) for n, f in (("first", F.min), ("last", F.max))])
    past = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # over at most BUCKETS rows
    ahead = Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select("b", *[F.last(f"last{arm}", True).over(past).alias(f"past{arm}") for arm in (0, 1)], *[F.first(f"first{arm}", True).over(ahead).alias(f"ahead{arm}") for arm in (0, 1)])
    within = Window.partitionBy("b").orderBy(*order)
    back, forth = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(1, Window.unboundedFollowing)
    marked = own.join(edges, "b").withColumns({f"{n}{arm}": F.coalesce(F.last(point(arm), True).over(back) if n == "before" else F.first(point(arm), True).over(forth), F.col(f"{'past' if n == 'before' else 'ahead'}{arm}")) for arm in (0, 1) for n in ("before", "after")})
    pick = lambda n: F.when(F.col("treated") == 1, F.col(f"{n}0")).otherwise(F.col(f"{n}1"))
    both = marked.select(*rows.columns, pick("before").alias("_before"), pick("after").alias("_after"))
    closer = F.when(F.col("_after").isNull() | (F.col("score") - F.col("_before.score") <= F.col("_after.score") - F.col("score")), F.col("_before.outcome")).otherwise(F.col("_after.outcome"))
    return both.withColumn("matched_outcome", F.when(F.col("_before").isNull(), F.col("_after.outcome")).otherwise(closer)).drop("_before", "_after")


def matched_effect(rows: DataFrame, key: str, covariates: list[str] = COVARIATES) -> float | None:
    """The average treatment effect by matching in both directions, with replacement; None where an arm is empty."""
    scored = written(propensity(written(rows, "cell"), covariates), "scored")
    gain = F.when(F.col("treated") == 1, F.col("outcome") - F.col("matched_outcome")).otherwise(F.col("matched_outcome") - F.col("outcome"))
    return nearest(scored, key).agg(F.round(F.avg(gain), 6)).first()[0]


def stratified_effect(rows: DataFrame, covariates: list[str] = COVARIATES, strata: int = 5) -> float | None:
    """Mean difference within equal ranges of the score, weighted by their rows; ranges with one arm only are left out."""
    own = propensity(rows, covariates).withColumn("stratum", F.least(F.floor(F.col("score") * strata), F.lit(strata - 1)))
    mean = lambda v: F.avg(F.when(F.col("treated") == v, F.col("outcome")))
    cells = own.groupBy("stratum").agg(F.count("*").alias("n"), (mean(1) - mean(0)).alias("d")).filter("d is not null")
    return cells.agg(F.round(F.try_divide(F.sum(F.col("n") * F.col("d")), F.sum("n")), 6)).first()[0]


def weighted_effect(rows: DataFrame, covariates: list[str] = COVARIATES) -> float | None:
    """The difference of means weighted by the inverse probability of the arm."""
    t, s = F.col("treated"), F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
    one, two = t / s, (1 - t) / (1 - s)
    own = propensity(rows, covariates)
    return own.agg(F.round(F.try_divide(F.sum(one * F.col("outcome")), F.sum(one)) - F.try_divide(F.sum(two * F.col("outcome")), F.sum(two)), 6)).first()[0]


def placebo(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Treatment exchanged between rows by two hash orders; an effect should vanish."""
    order = rows.withColumns({"_one": rank_key(F.col(key), F.lit("from"), seed=seed), "_two": rank_key(F.col(key), F.lit("to"), seed=seed), "_all": F.lit(0)})
    given = ranked(order.select("_one", "treated", "_all"), ["_all"], "_one", "_rank").select("_rank", "treated")
    taken = ranked(order.drop("treated"), ["_all"], "_two", "_rank")
    return taken.join(given, "_rank").drop("_rank", "_one", "_two", "_all")


def subset(rows: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """A share of the rows, by hash."""
    return rows.filter(draw(F.col(key), F.lit("subset"), seed=seed) < share)


def random_cause(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One more covariate that has nothing to do with anything."""
    return rows.withColumn("random_cause", draw(F.col(key), F.lit("cause"), seed=seed))


def unobserved_cause(rows: DataFrame, key: str, strength: float = 0.05, seed: int = 42) -> DataFrame:
    """A hidden flag that sets treatment and outcome of a small share of the rows alike."""
    hit, value = draw(F.col(key), F.lit("hidden"), seed=seed) < strength, (draw(F.col(key), F.lit("value"), seed=seed) < 0.5).cast("int")
    return rows.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c in ("treated", "outcome")})


def effects(rows: DataFrame, key: str, covariates: list[str] = COVARIATES) -> list[tuple[str, float | None]]:
    """K11-K13 for one cell: each estimate by its name; one that fails is None, as the others go on."""
    made: dict[str, Callable[[], float | None]] = {
        "matching": lambda: matched_effect(rows, key, covariates),
        "stratification": lambda: stratified_effect(rows, covariates),
        "weighting": lambda: weighted_effect(rows, covariates),
        "refute_placebo": lambda: matched_effect(placebo(rows, key), key, covariates),
        "refute_subset": lambda: matched_effect(subset(rows, key), key, covariates),
        "refute_random_cause": lambda: matched_effect(random_cause(rows, key), key, [*covariates, "random_cause"]),
        "refute_unobserved_cause": lambda: matched_effect(unobserved_cause(rows, key), key, covariates),
    }
    out = []
    for name, make in made.items():
        try:
            out.append((name, make()))
        except (ArithmeticError, ArithmeticException, ValueError):  # a singular model or an empty arm
            out.append((name, None))
    return out


def long_form(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key and value."""
    return rows.unpivot(keys, [F.col(v).cast("double").alias(v) for v in values], "measure", "value")


def describe(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, deviation, least and greatest of each group."""
    x = F.col(value)
    return rows.groupBy(group).agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.round(F.min(x), 4).alias("min"), F.round(F.max(x), 4).alias("max"))
