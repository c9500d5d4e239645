"""SQL fragments that several queries share."""

from __future__ import annotations

#: A file delivered twice counts once.
FILES = "files AS (SELECT DISTINCT fileId, content, language, repoName, path, extension, lengthBytes FROM code_files)"
RECORDS = """records AS (
    SELECT DISTINCT fileId, content, r.piiId AS piiId, r.piiType AS piiType, r.location_start AS location_start, r.location_end AS location_end,
        r."value" AS "value", r.detectedBy AS detectedBy, r.isHumanReviewed AS isHumanReviewed
    FROM (SELECT fileId, content, unnest(piiRecords) AS r FROM code_files)
)"""
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def find_spans(name: str, pattern: str, source: str = "files", column: str = "content", key: str = "fileId") -> str:
    """A chain of CTEs that ends in `name` (key, s, e, v, context column): all matches of a pattern with three groups."""
    return f"""
    {name}_p AS (
        SELECT {key}, {column}, string_split(regexp_replace(translate({column}, chr(1) || chr(2), '  '), {lit(pattern)},
            '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS p FROM {source}
    ), {name}_i AS (SELECT {key}, {column}, p, unnest(range(2, len(p) + 1)) AS i FROM {name}_p),
    {name}_s AS (
        SELECT {key}, {column}, list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::BIGINT - (i - 2) AS s, split_part(p[i], chr(2), 1) AS v FROM {name}_i
    ), {name} AS (SELECT DISTINCT {key}, {column}, s, s + length(v) AS e, v FROM {name}_s WHERE v <> '')"""


def draw(key: str, seed: int = 42) -> str:
    """The same number as functions.text.draw; key is an SQL expression of parts joined by ':'."""
    return f"(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT / 4294967296.0)"


def rank_key(key: str, seed: int = 42) -> str:
    return f"md5({key} || ':{seed}')"
