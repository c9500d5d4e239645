"""Merging, deduplicating, relocating and cleaning of span records.

Records are rows of files: fileId, content and the fields of a record. Defined results: a null value counts as empty; an
empty value can't be relocated (-1, -1); files without records stay without rows here and keep their row in keep_files().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import BLANKS
from spanloom.operators.detect import has_digit, like_date, parses_as_ip

#: The types that records may have.
TYPES = [
    "email", "ip_address", "key", "name", "username", "password", "phone_number", "credit_card", "address", "ssn", "gender", "date_of_birth",
    "ID", "age", "nationality", "medical", "bank_account", "license_plate", "url",
]
#: How far from its place a value is looked for, nearest reach first.
REACHES = (20, 100)


def explode_records(files: DataFrame) -> DataFrame:
    """One row per record of each file, rows delivered twice once."""
    record = F.col("r")
    fields = ["piiId", "piiType", "location_start", "location_end", "value", "detectedBy", "isHumanReviewed"]
    rows = files.select("fileId", "content", F.explode("piiRecords").alias("r"))
    return rows.select("fileId", "content", *[record[f].alias(f) for f in fields]).distinct()


def strip_value(records: DataFrame) -> DataFrame:
    """M1: values without blanks at both ends, spans moved along."""
    value = F.coalesce("value", F.lit(""))
    bare = F.regexp_replace(value, rf"\A{BLANKS}+|{BLANKS}+\z", "")
    lead = F.length(value) - F.length(F.regexp_replace(value, rf"\A{BLANKS}+", ""))
    lead = F.when(F.length(bare) > 0, lead).otherwise(0)
    start = F.col("location_start") + lead
    return records.withColumns({"location_start": start, "location_end": start + F.length(bare), "value": bare})


def first_wins(records: DataFrame) -> DataFrame:
    """M2: of the records of a file with equal place and value, whatever their type, the first one."""
    order = Window.partitionBy("fileId", "location_start", "location_end", "value").orderBy("piiId", "piiType", "detectedBy")
    return records.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def relocate(records: DataFrame) -> DataFrame:
    """M3: spans at which the content holds the value: where they are, else the first place within 20, else within 100
    characters; (-1, -1) if there is none."""
    value, content = F.coalesce("value", F.lit("")), F.coalesce("content", F.lit(""))
    start, end = F.col("location_start"), F.col("location_end")
    exact = (start >= 0) & (F.substring(content, start + 1, F.greatest(end - start, F.lit(0))) == value)
    found = F.when(value == "", F.lit(-1)).when(exact, start)
    for reach in REACHES:
        low = F.greatest(start - reach, F.lit(0))
        high = F.least(end + reach, F.length(content))
        at = F.call_function("locate", value, F.substring(content, low + 1, F.greatest(high - low, F.lit(0))))
        found = found.when(at > 0, low + at - 1)
    place = F.coalesce(found, F.lit(-1))
    return records.withColumns({"location_start": place, "location_end": F.when(place < 0, F.lit(-1)).otherwise(place + F.length(value))})


def clean(records: DataFrame) -> DataFrame:
    """M4: records of a plausible length and form."""
    value, kind = F.coalesce("value", F.lit("")), F.coalesce("piiType", F.lit(""))
    size = F.length(value)
    good = (size >= 4) & (size <= 300)
    good = good & ((kind != "name") | value.contains(" ")) & ((kind != "key") | (size >= 9))
    return records.filter(good & ((kind != "ip_address") | (has_digit(value) & parses_as_ip(value) & ~like_date(value))))


def valid_type(kind: Column) -> Column:
    """M5: the type's present name, or null where it is none."""
    named = F.when(F.lower(kind) == "bigcode_key", F.lit("key")).otherwise(kind)
    return F.when(named.isin(TYPES), named)


def merge_records(one: DataFrame, two: DataFrame) -> DataFrame:
    """M6: the records of two detectors for the same files: first wins, types checked, places checked, numbered anew."""
    both = one.withColumn("piiId", F.col("piiId").cast("long")).unionByName(two.withColumn("piiId", F.col("piiId") + F.lit(1 << 32)))
    checked = relocate(first_wins(both).withColumn("piiType", valid_type(F.col("piiType"))).filter("piiType is not null"))
    order = Window.partitionBy("fileId").orderBy("piiId", "location_start", "piiType")
    return checked.withColumn("piiId", F.row_number().over(order) - 1)


def merge_files(one: DataFrame, two: DataFrame, only_with_records: bool = True) -> DataFrame:
    """M7: files of either side, the records of files on both sides joined; (fileId, side, records)."""
    a = one.select("fileId", F.col("piiRecords").alias("a"), F.lit(True).alias("in_one")).dropDuplicates(["fileId"])
    b = two.select("fileId", F.col("piiRecords").alias("b"), F.lit(True).alias("in_two")).dropDuplicates(["fileId"])
    none = F.filter("a", lambda x: F.lit(False))
    both = a.join(b, "fileId", "full_outer")
    side = F.when(F.col("in_one") & F.col("in_two"), "both").when(F.col("in_one"), "one").otherwise("two")
    records = F.concat(F.coalesce("a", none, F.filter("b", lambda x: F.lit(False))), F.coalesce("b", F.filter("a", lambda x: F.lit(False))))
    merged = both.select("fileId", side.alias("side"), F.coalesce(records, F.col("a"), F.col("b")).alias("records"))
    return merged.filter(F.coalesce(F.size("records"), F.lit(0)) > 0) if only_with_records else merged


def by_type(records: DataFrame) -> DataFrame:
    """M8: files and records of each type."""
    return records.groupBy("piiType").agg(F.count("*").alias("n_records"), F.countDistinct("fileId").alias("n_files"))


def merge_clean(files: DataFrame) -> DataFrame:
    """M9: strip, first wins, relocate, clean; the records that remain, numbered as they came."""
    return clean(relocate(first_wins(strip_value(explode_records(files)))))


def reductions(files: DataFrame) -> DataFrame:
    """The counts before and after each step and the share that cleaning took away, in percent."""
    before = explode_records(files)
    merged = relocate(first_wins(strip_value(before)))
    names = ("n_before", "n_merged", "n_clean")
    mark = lambda df, name: df.select(*[F.lit(int(n == name)).cast("long").alias(n) for n in names])
    steps = mark(before, "n_before").union(mark(merged, "n_merged")).union(mark(clean(merged), "n_clean"))
    counts = steps.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    share = F.when(F.col("n_merged") > 0, F.round(100.0 * (F.col("n_merged") - F.col("n_clean")) / F.col("n_merged"), 2)).otherwise(0.0)
    return counts.withColumn("reduction", share)
