"""Text in the regular-expression dialect of the JVM, and random draws that depend on keys alone.

Dialect: patterns are written for Java with `(?Umd)`, that is Unicode classes, `^` and `$` at line ends, and `\\n` as the
only line end; `\\x08` stands for a backspace in a class and `\\p{IsHan}` for Chinese characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that span extraction puts into a text; in the input they count as blanks.
OPEN, CLOSE = "\x01", "\x02"
FLAGS = "(?Umd)"
#: White space as Unicode knows it.
BLANKS = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern with three groups (before, value, after) as array<struct<start, end, value>>, offsets in
    code points from 0. Matches don't overlap; what the first and third group hold is consumed. Null gives null."""
    clean = F.translate(text, OPEN + CLOSE, "  ")
    pieces = F.split(F.regexp_replace(clean, F.lit(FLAGS + pattern), F.lit(f"$1{OPEN}$2{CLOSE}$3")), OPEN)
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")

    def step(acc: Column, piece: Column) -> Column:
        value = F.substring_index(piece, CLOSE, 1)
        own = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(value)).alias("end"), value.alias("value"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.array_append(acc["found"], own).alias("found"))

    first = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), none.alias("found"))
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when(text.isNotNull(), F.aggregate(rest, first, step, lambda acc: acc["found"]))


def draw(*key: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the key, the seed and nothing else."""
    parts = [c if isinstance(c, Column) else F.lit(c) for c in key]
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rank_key(*key: Column | str, seed: int = 42) -> Column:
    """A text by which rows can be shuffled: the same for the same key."""
    parts = [c if isinstance(c, Column) else F.lit(c) for c in key]
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed))))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(F.length(text) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(
        F.when(text.isNotNull(), F.lit(0.0))
    )


def window(text: Column, start: Column, end: Column, reach: int) -> Column:
    """The text around a span, so many characters on either side."""
    low = F.greatest(start - reach, F.lit(0))
    return F.substring(text, low + 1, F.least(end + reach, F.length(text)) - low)
