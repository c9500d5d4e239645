"""Queries of the span detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import detect
from spanloom.plans.sql import BLANK, FILES, find_spans, lit
from spanloom.sources.parquet import table

COLUMNS = ["fileId", "location_start", "location_end", "value"]


def _detector(kind):
    def query(spark, sf_dir):
        return detect.find_spans(table(spark, sf_dir, "code_files"), kind).select(*COLUMNS)

    return query


def rule_spans(spark, sf_dir):
    return detect.rule_spans(table(spark, sf_dir, "code_files")).select("piiType", *COLUMNS)


def union_numbered(spark, sf_dir):
    return detect.search(table(spark, sf_dir, "code_files")).select("fileId", "piiId", "piiType", "detectedBy", "location_start", "location_end", "value")


def stats(spark, sf_dir):
    return detect.detector_stats(detect.search(table(spark, sf_dir, "code_files")))


def java_spans(spark, sf_dir):
    """The search behind its language gate."""
    files = detect.only_language(table(spark, sf_dir, "code_files"), "java")
    return detect.search(files).groupBy("fileId").agg(F.count("*").alias("n_records"))


def chunk_windows(spark, sf_dir):
    return detect.chunks(table(spark, sf_dir, "code_files"), 128)


def edge(text: str) -> str:
    """A class of the JVM's dialect in that of the oracle."""
    return text.replace(r"\x08", r"\x{8}").replace(r"\p{IsHan}", r"\p{Han}").replace(r"\s", BLANK[1:-1])


EMAIL_SQL = (
    rf"(?m)(^|[{edge('\\x08\\s@,?!;:)(')}'\".\p{{Han}}<])([^{edge('\\x08\\s@?!;,:)(')}'\"<]+@[^{edge('\\x08\\s@!?;,/')}]*[^{edge('\\x08\\s@?!;,/:)(')}'\">.]\.\p{{L}}[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+)"
    rf"($|[{edge('\\x08\\s@,?!;:)(')}'\".\p{{Han}}>])"
)
IP_SQL = "(?m)" + edge(detect.IP)
WORDY = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
DATES_SQL = " OR ".join(f"regexp_matches(v, {lit(rf'\A(?:[{edge(detect.EDGE)}])?{form}(?:$|[{edge(detect.EDGE_AFTER)}])')})" for form in detect.DATES)
QUAD = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
IP_FILTER = f"""
    regexp_matches(v, '[0-9]') AND NOT ({DATES_SQL})
    AND NOT (length(v) = 7 AND length(v) - length(replace(v, '.', '')) = 3
        AND NOT regexp_matches(lower(substr(content, greatest(s - 100, 0) + 1, least(e + 100, length(content)) - greatest(s - 100, 0))), 'dns|server'))
    AND (regexp_full_match(v, {lit(QUAD)}) OR (contains(v, ':') AND (NOT contains(v, '.') OR regexp_matches(v, {lit(':' + QUAD + '$')}))))"""
LUHN = """(SELECT sum(CASE WHEN (length(v) - i) % 2 = 1 THEN (CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END) ELSE d END)
    FROM (SELECT i, substr(v, i, 1)::INTEGER AS d FROM (SELECT unnest(range(1, length(v) + 1)) AS i))) % 10 = 0"""
OUT = "SELECT fileId, s AS location_start, e AS location_end, v AS \"value\""


def sql_of(kind: str) -> tuple[str, str]:
    """(pattern, filter) of a detector for the oracle."""
    return {
        "email": (EMAIL_SQL, "true"),
        "ip_address": (IP_SQL, IP_FILTER),
        "key": (detect.KEY, "true"),
        "credit_card": (detect.CARD, LUHN),
        "gender": (detect.GENDER, "true"),
    }[kind]


def detector_sql(kind: str) -> str:
    pattern, good = sql_of(kind)
    return f"WITH {FILES}, {find_spans('f', pattern)} {OUT} FROM f WHERE {good}"


def all_ctes() -> str:
    parts = [FILES]
    for kind in detect.ENABLED:
        parts.append(find_spans(kind, sql_of(kind)[0]))
    for kind, pattern in detect.RULES.items():
        parts.append(find_spans(f"rule_{kind}", pattern))
    rows = [f"SELECT fileId, '{k}' AS piiType, 'regex' AS detectedBy, {n} AS detector, s, e, v FROM {k} WHERE {sql_of(k)[1]}" for n, k in enumerate(detect.ENABLED)]
    rows += [f"SELECT fileId, '{k}', 'rule', {len(detect.ENABLED)}, s, e, v FROM rule_{k}" for k in detect.RULES]
    return ", ".join(parts) + ", found AS (" + " UNION ALL ".join(rows) + ")"


QUERIES = {f"detect_{name}_spans": _detector(kind) for name, kind in (("email", "email"), ("ip", "ip_address"), ("key", "key"), ("card", "credit_card"), ("gender", "gender"))}
QUERIES |= {"rule_token_spans": rule_spans, "detect_union_numbered": union_numbered, "detector_stats": stats, "search_java": java_spans, "ner_chunks": chunk_windows}
SQL = {f"detect_{name}_spans": detector_sql(kind) for name, kind in (("email", "email"), ("ip", "ip_address"), ("key", "key"), ("card", "credit_card"), ("gender", "gender"))}
_RULES = " UNION ALL ".join(f"SELECT '{k}' AS piiType, fileId, s AS location_start, e AS location_end, v AS \"value\" FROM rule_{k}" for k in detect.RULES)
SQL |= {
    "rule_token_spans": f"WITH {FILES}, {', '.join(find_spans(f'rule_{k}', p) for k, p in detect.RULES.items())} {_RULES}",
    "detect_union_numbered": f"""WITH {all_ctes()} SELECT fileId, row_number() OVER (PARTITION BY fileId ORDER BY detector, s, e, piiType) - 1 AS piiId,
        piiType, detectedBy, s AS location_start, e AS location_end, v AS "value" FROM found""",
    "detector_stats": f"WITH {all_ctes()} SELECT piiType, detectedBy, count(*) AS n FROM found GROUP BY ALL",
    "search_java": f"WITH {all_ctes()} SELECT fileId, count(*) AS n_records FROM found WHERE fileId IN (SELECT fileId FROM files WHERE lower(language) = 'java') GROUP BY ALL",
    "ner_chunks": f"""WITH {FILES}, {find_spans('t', rf'()({WORDY}+|[^{WORDY[1:-1]}{BLANK[1:-1]}])()')},
        n AS (SELECT fileId, s, e, row_number() OVER (PARTITION BY fileId ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY fileId) AS size FROM t),
        c AS (SELECT DISTINCT fileId, size, unnest(range(0, (greatest(ceil((size - 118) / 64.0), 0)::BIGINT) + 1)) AS chunk FROM n)
        SELECT c.fileId, c.chunk, a.s AS char_start, b.e AS char_end FROM c JOIN n a ON a.fileId = c.fileId AND a.k = c.chunk * 64
        JOIN n b ON b.fileId = c.fileId AND b.k = least(c.chunk * 64 + 118, c.size) - 1""",
}
