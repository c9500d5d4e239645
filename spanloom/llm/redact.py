"""Placeholders in the place of spans: the strings around them stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows

#: What stands for a credential: letters and an underscore, which are safe inside any literal, URL or settings line.
PLACEHOLDER = "REDACTED"


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced; of overlapping spans the first (the longest of those that begin there) counts."""
    parts, last = [], 0
    for a, b, word in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= last:
            parts += [text[last:a], word]
            last = b
    return "".join(parts) + text[last:]


def redacted_strings(files: DataFrame, spans: DataFrame, word: str | None = None) -> DataFrame:
    """(fileId, field, piiId, text) of each string that holds a span, with `word` (a column of spans; without it
    PLACEHOLDER) in the place of each. Spans are gathered per file, never per source, so that no group outgrows a file."""
    label = F.col(word) if word else F.lit(PLACEHOLDER)
    by_file = spans.groupBy("fileId").agg(F.collect_set(F.struct("field", "piiId", "location_start", "location_end", label.alias("word"))).alias("spans"))
    source = files.select("fileId", "content", F.expr("transform(piiRecords, p -> named_struct('piiId', p.piiId, 'value', p.value, 'notes', p.notes))").alias("records"))

    def rows(columns):
        for k, content, records, own in zip(columns["fileId"], columns["content"], columns["records"], columns["spans"]):
            strings: dict[tuple[str, int], list] = {}
            for s in own:
                strings.setdefault((s["field"], s["piiId"]), []).append((s["location_start"], s["location_end"], s["word"]))
            seen = set()
            for (field, pii), marks in sorted(strings.items()):
                for text in [content] if field == "content" else [r[field] for r in records or () if r and r["piiId"] == pii]:
                    if text and (field, pii) not in seen and len(text) >= max(b for _, b, _ in marks):
                        seen.add((field, pii))
                        yield k, field, pii, replaced(text, marks)

    return map_rows(source.join(by_file, "fileId"), rows, "fileId long, field string, piiId int, text string").dropDuplicates(["fileId", "field", "piiId"])
