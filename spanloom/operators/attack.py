"""Leakage by extraction attacks: which answers hold known values.

Defined results: null and empty expected texts are found nowhere; null answers hold nothing; rows delivered twice count
once; a type without answers has the rate 0.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of expected texts in one automaton; more of them take further passes over the answers.
SHARD_CHARS = 8_000_000


def normalise(text: str, ignore_case: bool = False) -> str:
    """A1: compatibility forms unified; lower case on demand. Plain ASCII needs no work."""
    out = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return out.lower() if ignore_case else out


class Matcher:
    """A2: all occurrences of many patterns, overlapping ones too, as (start, inclusive end, pattern)."""

    def __init__(self, patterns: Iterable[str], ignore_case: bool = False):
        self.ignore_case = ignore_case
        self.own = ahocorasick.Automaton()
        for p in {normalise(x, ignore_case) for x in patterns if x}:
            self.own.add_word(p, p)
        if len(self.own):
            self.own.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[int, int, str]]:
        if text and len(self.own):
            for end, p in self.own.iter(normalise(text, self.ignore_case)):
                yield end - len(p) + 1, end, p

    def first(self, text: str | None) -> tuple[int, int, str] | None:
        return next(self.find(text), None)


_MATCHERS: dict[str, dict[str, Matcher]] = {}


def matchers_of(name: str, patterns: list[tuple[str, str]], ignore_case: bool) -> dict[str, Matcher]:
    """One matcher for each type, built once per worker process."""
    if name not in _MATCHERS:
        by_type: dict[str, list[str]] = {}
        for kind, p in patterns:
            by_type.setdefault(kind, []).append(p)
        _MATCHERS.clear()
        _MATCHERS[name] = {k: Matcher(v, ignore_case) for k, v in by_type.items()}
    return _MATCHERS[name]


def shards(patterns: DataFrame, chars: int) -> Iterator[list[tuple[str, str]]]:
    part, size = [], 0
    for kind, p in patterns.toLocalIterator():
        if part and size + len(p) > chars:
            yield part
            part, size = [], 0
        part.append((kind, p))
        size += len(p)
    if part:
        yield part


def any_answer_hits(attacks: DataFrame, ignore_case: bool = False, chars: int = SHARD_CHARS) -> DataFrame:
    """A3, A4: (example_id, type, expected_text, n_values): how many expected texts of the same type a row's answers hold.
    The automata are broadcast in shards of bounded size."""
    rows = attacks.select("example_id", "type", "expected_text", "generated_text").distinct()
    patterns = rows.select("type", "expected_text").filter("expected_text <> ''").distinct()
    schema = "example_id long, type string, expected_text string, hit string"
    passes = []
    for part in shards(patterns, chars):
        shared = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part))

        def run(batches, shared=shared):
            known = matchers_of(*shared.value, ignore_case)
            for batch in batches:
                out = []
                for k, kind, expected, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind in known:
                        out += [(k, kind, expected, p) for p in {p for _, _, p in known[kind].find(text)}]
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["example_id", "type", "expected_text", "hit"])

        passes.append(rows.mapInArrow(run, schema))
    found = rows.sparkSession.createDataFrame([], schema)
    for more in passes:
        found = found.union(more)
    return found.groupBy("example_id", "type", "expected_text").agg(F.countDistinct("hit").alias("n_values"))


def own_answer_hits(attacks: DataFrame) -> DataFrame:
    """A5: per type the distinct values and files whose own text their answer holds."""
    hit = F.contains("generated_text", "expected_text")
    return attacks.distinct().filter(hit & (F.col("expected_text") != "")).groupBy("type").agg(F.countDistinct("expected_text").alias("n_values"), F.countDistinct("example_id").alias("n_files"))


def hit_rates(spans: DataFrame) -> DataFrame:
    """Of the spans (type, attack_hit) of each type the hits, in percent."""
    hits = F.sum(F.col("attack_hit").cast("int"))
    return spans.groupBy("type").agg(F.count("*").alias("n"), hits.alias("n_hits"), F.round(100.0 * hits / F.count("*"), 2).alias("rate"))
