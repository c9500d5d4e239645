"""Judging of spans: prompts, cache keys, lenient parsing of answers, and the fold over types.

Records are rows with id, piiType, value, location_start, location_end, detectedBy and content. A judge is a function from
records to records with `score` and `reason`; the default is a rubric, another one joins stored scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.ranking import running_before
from spanloom.functions.text import entropy, rank_key, window
from spanloom.operators.checks import passed
from spanloom.sources.durable import written

#: Order in which types are judged, context on either side, score from which a span counts.
ORDER = ["ip_address", "key", "password", "email", "name", "username"]
REACH = {kind: 500 for kind in ORDER}
THRESHOLD = {"password": 95, "ip_address": 95, "key": 90, "email": 90, "name": 90, "username": 90}
#: Spans above the threshold after which a type is done.
ENOUGH = 1800

#: What each type's judge is told.
RUBRIC = {
    "email": "Score how likely the value is the address of a person rather than a placeholder or a role.",
    "ip_address": "Score how likely the value is a public address in use rather than a version or an example.",
    "key": "Score how likely the value is a working key or token rather than a placeholder, a digest or an identifier.",
    "name": "Score how likely the value is the full name of a person rather than a product, a place or a class.",
    "password": "Score how likely the value is a password in use rather than a placeholder or a variable.",
    "username": "Score how likely the value is the account name of a person rather than an identifier.",
}
ANSWER = 'Answer with JSON: {"score": 0 to 100, "reason": one sentence}.'
#: Words near a span that speak for its type.
SIGNS = {"email": "mail|contact|author", "ip_address": "host|addr|server|dns", "key": "key|token|secret|auth", "name": "author|name|owner|by ", "password": "pass|pwd|login", "username": "user|login|account"}


def contexts(records: DataFrame) -> DataFrame:
    """The text around each span."""
    reach = F.lit(0)
    for kind, n in REACH.items():
        reach = F.when(F.col("piiType") == kind, n).otherwise(reach)
    return records.withColumn("context", window(F.col("content"), F.col("location_start"), F.col("location_end"), reach))


def by_kind(texts: dict[str, str]) -> Column:
    out = F.lit("")
    for kind, text in texts.items():
        out = F.when(F.col("piiType") == kind, text).otherwise(out)
    return out


def prompts(records: DataFrame, model: str = "judge", temperature: float = 0.0) -> DataFrame:
    """Instructions, prompt and the key under which an answer is cached."""
    text = F.concat(F.lit("Type: "), F.col("piiType"), F.lit("\nValue: "), F.col("value"), F.lit("\nContext:\n"), F.col("context"))
    rows = contexts(records).withColumns({"instructions": F.concat(by_kind(RUBRIC), F.lit(" " + ANSWER)), "prompt": text})
    return rows.withColumn("cache_key", F.md5(F.concat_ws(":", F.lit(model), "instructions", "prompt", F.lit(str(temperature)))))


def with_cache(records: DataFrame, cache: DataFrame, bypass: tuple[str, ...] = ()) -> DataFrame:
    """Stored score and reason by cache key; types in bypass are always judged anew."""
    stored = cache.dropDuplicates(["cache_key"]).withColumnsRenamed({"score": "cached_score", "reason": "cached_reason"})
    joined = records.join(stored, "cache_key", "left")
    return joined.withColumns({c: F.when(~F.col("piiType").isin(list(bypass)) if bypass else F.lit(True), F.col(c)) for c in ("cached_score", "cached_reason")})


def rubric_judge(records: DataFrame) -> DataFrame:
    """R9, the default backend: points for signs of the type near the value, for variety and for length."""
    sign = F.lit(False)
    for kind, words in SIGNS.items():
        sign = sign | ((F.col("piiType") == kind) & F.lower("context").rlike(words))
    score = 50 + 25 * sign.cast("int") + 15 * (entropy(F.col("value")) >= 2.5).cast("int") + 10 * (F.length("value") >= 8).cast("int")
    return contexts(records).withColumns({"score": score, "reason": F.lit("rubric")})


def stored_judge(scores: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A backend that replays scores by span; a span without one gets 0."""

    def judge(records: DataFrame) -> DataFrame:
        best = scores.groupBy("id", "piiType", "location_start", "location_end").agg(F.max("score").alias("score"), F.max("reason").alias("reason"))
        return records.join(best, ["id", "piiType", "location_start", "location_end"], "left").withColumn("score", F.coalesce("score", F.lit(0)))

    return judge


def parse_answer(text: Column) -> Column:
    """struct<score, reason> of an answer: JSON, JSON in a fence, a score and a reason anywhere, else 0 and the text."""
    schema = "struct<score: int, reason: string>"
    plain = F.from_json(text, schema)
    fenced = F.from_json(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), schema)
    loose_score = F.regexp_extract(text, r'"score":\s*(\d+)', 1)
    loose_reason = F.regexp_extract(text, r'"reason":\s*"([^"]*)"', 1)
    loose = text.rlike(r'"score":\s*\d+') & text.rlike(r'"reason":\s*"[^"]*"')
    return (
        F.when(plain["score"].isNotNull(), plain)
        .when(fenced["score"].isNotNull(), fenced)
        .when(loose, F.struct(loose_score.try_cast("int").alias("score"), loose_reason.alias("reason")))
        .otherwise(F.struct(F.lit(0).alias("score"), text.alias("reason")))
    )


def in_place(records: DataFrame) -> Column:
    """Whether the content holds the value at its span."""
    return F.substring("content", F.col("location_start") + 1, F.greatest(F.col("location_end") - F.col("location_start"), F.lit(0))) == F.col("value")


def prefiltered(records: DataFrame) -> DataFrame:
    """Spans at their place that pass the check of their type."""
    return passed(records.filter((F.col("location_start") >= 0) & in_place(records)))


def order_key() -> Column:
    """Pattern hits first among keys, then shuffled by hash; hexadecimal, so that it can be bucketed."""
    late = F.when((F.col("piiType") == "key") & (F.col("detectedBy") != "regex"), "f").otherwise("0")
    return F.concat(late, rank_key(*map(F.col, ("id", "location_start", "location_end", "value"))))


def fold(records: DataFrame, judge: Callable[[DataFrame], DataFrame] = rubric_judge, enough: int = ENOUGH) -> DataFrame:
    """Types in their order; a file that has a span above the threshold gives no later one; a type ends
    after `enough` spans above it. Judged spans below the threshold stay. One plan per type, cut after each."""
    spark = records.sparkSession
    used = spark.createDataFrame([], "id long")
    out: list[DataFrame] = []
    for kind in ORDER:
        left = records.filter(F.col("piiType") == kind).join(used, "id", "left_anti")
        judged = judge(left).withColumns({"above": (F.col("score") >= THRESHOLD[kind]).cast("int"), "order": order_key()})
        earlier = Window.partitionBy("id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
        single = judged.withColumn("seen", F.coalesce(F.max("above").over(earlier), F.lit(0))).filter("seen = 0")
        counted = running_before(single, ["piiType"], "order", F.col("above"), "before")
        kept = written(counted.filter(F.col("before") < enough).select("id", "piiType", "location_start", "location_end", "value", "detectedBy", "score", "above"), "judged")
        used = used.union(kept.filter("above = 1").select("id")).distinct()
        out.append(kept)
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def counters(records: DataFrame, judged: DataFrame) -> DataFrame:
    """Per type the spans seen, out of place, judged and above the threshold."""
    seen = records.groupBy("piiType").agg(F.count("*").alias("n_all"), F.sum(F.when((F.col("location_start") >= 0) & in_place(records), 0).otherwise(1)).alias("n_missing"))
    done = judged.groupBy("piiType").agg(F.count("*").alias("n_judged"), F.sum("above").alias("n_above"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return seen.join(done, "piiType", "left").select("piiType", "n_all", "n_missing", zero("n_judged"), zero("n_above"))
