"""Reports: texts with marked spans, tables of records, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: V7: class and terminal colour of each type, and those of any other.
COLOURS = {"email": 31, "ip_address": 32, "key": 33, "name": 34, "password": 35, "username": 36, "phone_number": 91, "address": 92, "ID": 93}
OTHER_COLOUR = 37


def colour(kind: Column) -> Column:
    out = F.lit(OTHER_COLOUR)
    for name, code in COLOURS.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def highlighted(content: Column, records: Column, mark, plain) -> Column:
    """The text with marked spans: records by start; those without a start, or behind what is marked already, are skipped but
    keep their number; ends are held within the text. mark(i, record, text) and plain(text) give the pieces."""
    size = F.length(content)
    order = F.array_sort(records, lambda a, b: F.when(a["location_start"] < b["location_start"], -1).when(a["location_start"] > b["location_start"], 1).when(a["location_end"] < b["location_end"], -1).when(a["location_end"] > b["location_end"], 1).otherwise(0))
    known = F.filter(order, lambda r: r["location_start"].isNotNull() & r["location_end"].isNotNull())

    def step(acc: Column, r: Column) -> Column:
        a, b = F.greatest(r["location_start"], acc["at"]), F.least(r["location_end"], size)
        good = (r["location_start"] >= 0) & (r["location_start"] < size) & (b > a)
        piece = F.concat(plain(F.substring(content, acc["at"] + 1, a - acc["at"])), mark(acc["i"], r, F.substring(content, a + 1, b - a)))
        return F.struct((acc["i"] + 1).alias("i"), F.when(good, b).otherwise(acc["at"]).alias("at"), F.when(good, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit("").alias("out"))
    end = lambda acc: F.concat(acc["out"], plain(F.substring(content, acc["at"] + 1, F.greatest(size - acc["at"], F.lit(0)))))
    return F.aggregate(known, start, step, end)


def html(content: Column, records: Column) -> Column:
    """V1."""
    kind = lambda r: F.coalesce(r["piiType"], F.lit("other"))
    mark = lambda i, r, text: F.concat(F.lit('<span id="span-'), i.cast("string"), F.lit('" class="pii '), escape(kind(r)), F.lit('" title="'), escape(kind(r)), F.lit('" data-start="'), r["location_start"].cast("string"), F.lit('">'), escape(text), F.lit("</span>"))
    return highlighted(content, records, mark, escape)


def terminal(content: Column, records: Column, most: int | None = None) -> Column:
    """V2: with colour codes; a report shows the first `most` characters."""
    mark = lambda i, r, text: F.concat(F.lit("\x1b["), colour(r["piiType"]).cast("string"), F.lit("m"), text, F.lit("\x1b[0m"))
    shown = content if most is None else F.substring(content, 1, most)
    return highlighted(shown, records, mark, lambda x: x)


def record_lines(records: DataFrame) -> DataFrame:
    """V3: a line of each record's fields, the score with two decimals, the reason where there is one."""
    score = F.when(F.col("score").isNotNull(), F.format_string(" score %.2f", F.col("score").cast("double"))).otherwise("")
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" because: "), F.col("reason"))).otherwise("")
    line = F.concat(F.lit("["), F.coalesce("piiType", F.lit("?")), F.lit("] "), F.coalesce("value", F.lit("")), F.lit(" ("), F.col("location_start").cast("string"), F.lit("-"), F.col("location_end").cast("string"), F.lit(")"), score, reason)
    return records.withColumn("line", line)


def report_page(title: str, body: Column) -> Column:
    """V5: a page around a marked text."""
    style = "".join(f".{kind}{{background:hsl({37 * i % 360},80%,85%)}}" for i, kind in enumerate(COLOURS))
    return F.concat(F.lit(f"<!doctype html><meta charset=utf-8><title>{title}</title><style>{style}</style><pre>"), body, F.lit("</pre>"))


def normalise_shapes(rows: DataFrame) -> DataFrame:
    """V4: one shape (id, path, text, records) of rows that call these fields differently or lack some."""
    have = set(rows.columns)
    first = lambda *names, default=None: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(default))
    lists = [F.col(n) for n in ("piiRecords", "records", "locations") if n in have]
    fields = "array<struct<piiType: string, location_start: int, location_end: int, value: string>>"
    if lists:
        records = F.transform(lists[0] if len(lists) == 1 else F.coalesce(*lists), lambda r: F.struct(r["piiType"].alias("piiType"), r["location_start"].alias("location_start"), r["location_end"].alias("location_end"), r["value"].alias("value")))
    elif {"piiType", "location_start", "location_end", "value"} <= have:
        records = F.array(F.struct("piiType", "location_start", "location_end", "value"))
    else:
        records = F.array().cast(fields)
    text = first("text", "content") if have & {"text", "content"} else F.lit(None).cast("string")
    return rows.select(
        first("id", "fileId", "example_id").cast("long").alias("id") if have & {"id", "fileId", "example_id"} else F.lit(None).cast("long").alias("id"),
        (first("path", "file_path", default="") if have & {"path", "file_path"} else F.lit("")).alias("path"),
        text.alias("text"),
        F.coalesce(records, F.array().cast(fields)).alias("records"),
    )


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """V6: the last rating of each sample and file, from 1 to 3; others are dropped."""
    good = ratings.filter(F.col("rating").between(1, 3))
    return good.groupBy("sample", "file").agg(F.max_by("rating", "rated_at").alias("rating"))
