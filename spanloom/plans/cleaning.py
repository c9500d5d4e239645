"""Queries of the record operators and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.text import entropy
from spanloom.operators import checks, detect, records
from spanloom.plans.detectors import DATES_SQL, QUAD, all_ctes
from spanloom.plans.sql import BLANK, RECORDS, lit
from spanloom.sources.parquet import table

FIELDS = ["fileId", "piiId", "piiType", "location_start", "location_end", "value", "detectedBy"]


def _records(spark, sf_dir):
    return records.explode_records(table(spark, sf_dir, "code_files"))


def stripped(spark, sf_dir):
    return records.strip_value(_records(spark, sf_dir)).select(*FIELDS).distinct()


def dedupe_first_wins(spark, sf_dir):
    return records.first_wins(_records(spark, sf_dir)).select(*FIELDS)


def relocate_values(spark, sf_dir):
    return records.relocate(_records(spark, sf_dir)).select(*FIELDS).distinct()


def clean_records(spark, sf_dir):
    return records.clean(_records(spark, sf_dir)).select(*FIELDS).distinct()


def merge_detectors(spark, sf_dir):
    """The stored records merged with those of the pattern detectors."""
    files = table(spark, sf_dir, "code_files")
    found = detect.search(files).join(files.select("fileId", "content").dropDuplicates(["fileId"]), "fileId").withColumn("isHumanReviewed", F.lit(False))
    return records.merge_records(records.explode_records(files), found.withColumn("piiId", F.col("piiId").cast("int"))).select(*FIELDS)


def merge_full_outer(spark, sf_dir):
    """Java files against files over 2000 bytes: one side, the other, or both."""
    files = table(spark, sf_dir, "code_files")
    return records.merge_files(files.filter("language = 'Java'"), files.filter("lengthBytes > 2000"), False).select("fileId", "side", F.coalesce(F.size("records"), F.lit(0)).alias("n_records"))


def merge_clean(spark, sf_dir):
    return records.merge_clean(table(spark, sf_dir, "code_files")).select(*FIELDS)


def records_by_type(spark, sf_dir):
    return records.by_type(records.merge_clean(table(spark, sf_dir, "code_files")))


def merge_reductions(spark, sf_dir):
    return records.reductions(table(spark, sf_dir, "code_files"))


def record_detectors(spark, sf_dir):
    return detect.detector_stats(_records(spark, sf_dir))


def _checked(kind):
    def query(spark, sf_dir):
        rows = checks.passed(_records(spark, sf_dir).filter(F.col("piiType") == kind))
        return rows.select("fileId", "piiId", F.col("value").alias("checked"), F.col("location_start").alias("checked_start"), F.col("location_end").alias("checked_end")).distinct()

    return query


def entropy_tokens(spark, sf_dir):
    return _records(spark, sf_dir).select("value").filter("value is not null").distinct().select("value", F.round(entropy(F.col("value")), 6).alias("entropy"))


OUT = 'fileId, piiId, piiType, location_start, location_end, "value", detectedBy'
STRIP = f"""stripped AS (SELECT fileId, content, piiId, piiType, detectedBy, location_start + lead AS location_start, location_start + lead + length(bare) AS location_end, bare AS "value"
    FROM (SELECT *, regexp_replace(v, {lit(rf'^{BLANK}+|{BLANK}+$')}, '', 'g') AS bare,
        CASE WHEN regexp_full_match(v, {lit(BLANK + '*')}) THEN 0 ELSE length(v) - length(regexp_replace(v, {lit(rf'^{BLANK}+')}, '')) END AS lead
        FROM (SELECT *, coalesce("value", '') AS v FROM records)))"""


def first(name: str, source: str) -> str:
    return f"""{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY fileId, location_start, location_end, "value" ORDER BY piiId, piiType, detectedBy) = 1)"""


def moved(name: str, source: str) -> str:
    reach = lambda n: f"instr(substr(c, greatest(location_start - {n}, 0) + 1, greatest(least(location_end + {n}, length(c)) - greatest(location_start - {n}, 0), 0)), v)"
    return f"""{name} AS (SELECT * EXCLUDE (place, v, c) REPLACE (place AS location_start, CASE WHEN place < 0 THEN -1 ELSE place + length(v) END AS location_end) FROM (
        SELECT *, CASE WHEN v = '' THEN -1 WHEN location_start >= 0 AND substr(c, location_start + 1, greatest(location_end - location_start, 0)) = v THEN location_start
            WHEN {reach(20)} > 0 THEN greatest(location_start - 20, 0) + {reach(20)} - 1 WHEN {reach(100)} > 0 THEN greatest(location_start - 100, 0) + {reach(100)} - 1 ELSE -1 END AS place
        FROM (SELECT *, coalesce("value", '') AS v, coalesce(content, '') AS c FROM {source})))"""


PARSES = f"(regexp_full_match(v, {lit(QUAD)}) OR (contains(v, ':') AND (NOT contains(v, '.') OR regexp_matches(v, {lit(':' + QUAD + '$')}))))"


def cleaned(name: str, source: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (v) FROM (SELECT *, coalesce("value", '') AS v FROM {source}) WHERE length(v) BETWEEN 4 AND 300
        AND (piiType IS NULL OR NOT (piiType = 'name' AND NOT contains(v, ' ')) AND NOT (piiType = 'key' AND length(v) < 9)
            AND NOT (piiType = 'ip_address' AND NOT (regexp_matches(v, '[0-9]') AND {PARSES} AND NOT ({DATES_SQL})))))"""


CHAIN = f"{RECORDS}, {STRIP}, {first('once', 'stripped')}, {moved('placed', 'once')}, {cleaned('kept', 'placed')}"
TYPE_LIST = ", ".join(lit(t) for t in records.TYPES)


def strip_sql(marks: str, kind: str) -> str:
    return f"""b AS (SELECT *, CASE WHEN ok THEN bare END AS c, CASE WHEN ok THEN s0 ELSE location_start END AS cs, CASE WHEN ok THEN e0 ELSE location_end END AS ce FROM (
        SELECT *, s0 >= 0 AND e0 > s0 AND regexp_matches(bare, {lit(f'[^{BLANK[1:-1]}]')}) AS ok FROM (
        SELECT *, location_start + length(v) - length(ahead) AS s0, location_end - (length(v) - length(regexp_replace(v, {lit(marks + '+$')}, ''))) AS e0, regexp_replace(ahead, {lit(marks + '+$')}, '') AS bare
        FROM (SELECT *, regexp_replace(v, {lit('^' + marks + '+')}, '') AS ahead FROM (SELECT *, coalesce("value", '') AS v, coalesce(content, '') AS t FROM records WHERE piiType = {lit(kind)})))))"""


QUOTES_SQL = """h AS (SELECT *, length(c) // 2 AS half FROM b), q AS (SELECT *, greatest(cs - 10, 0) AS low,
        substr(t, greatest(cs - 10, 0) + 1, greatest(cs + half - greatest(cs - 10, 0), 0)) AS l, substr(t, greatest(ce - half, 0) + 1, greatest(least(length(t), ce + 10) - (ce - half), 0)) AS r FROM h),
    p AS (SELECT *, length(regexp_extract(reverse(l), '^[^''"]*')) + 1 AS fl, length(regexp_extract(r, '^[^''"]*')) + 1 AS fr FROM q),
    z AS (SELECT * REPLACE (CASE WHEN same THEN substr(t, low + length(l) - fl + 2, greatest(ce - half + fr - 1 - (low + length(l) - fl + 1), 0)) ELSE c END AS c,
        CASE WHEN same THEN low + length(l) - fl + 1 ELSE cs END AS cs, CASE WHEN same THEN ce - half + fr - 1 ELSE ce END AS ce)
        FROM (SELECT *, c IS NOT NULL AND fl <= length(l) AND fr <= length(r) AND substr(reverse(l), fl, 1) = substr(r, fr, 1) AS same FROM p))"""
ENTROPY_SQL = """coalesce(list_sum(list_transform(list_distinct(string_split({v}, '')), lambda ch: -((length({v}) - length(replace({v}, ch, ''))) / length({v})::DOUBLE)
    * log2((length({v}) - length(replace({v}, ch, ''))) / length({v})::DOUBLE))), 0.0)"""
#: The marks that are stripped, in the oracle's dialect.
MARKS = BLANK[:-1] + r":：;,.。'\"<>\[\](){}]"
NUMBER = "list_reduce(list_transform(string_split(c, '.'), lambda x: coalesce(try_cast(x AS BIGINT), 0)), lambda a, x: a * 256 + x)"
PRIVATE = " OR ".join(f"{NUMBER} BETWEEN {checks.as_number(a)} AND {checks.as_number(b)}" for a, b in checks.NOT_PUBLIC)
FORM = {
    "email": "NOT contains(c, '..') AND NOT starts_with(c, '.') AND NOT ends_with(c, '.') AND length(c) - length(replace(c, '@', '')) = 1 AND split_part(c, '@', 1) <> '' AND split_part(c, '@', 2) <> '' AND NOT starts_with(split_part(c, '@', 2), '.') AND NOT ends_with(split_part(c, '@', 2), '.') AND NOT regexp_matches(c, '[ /()]')",
    "ip_address": f"(regexp_full_match(c, {lit(QUAD)}) AND NOT ({PRIVATE}))",
    "key": f"NOT regexp_matches(c, {lit(rf'''[\\/,;'"<>{{}}\[\](){BLANK[1:-1]}]''')}) AND length(c) >= 16 AND len(list_distinct(string_split(c, ''))) >= 8 AND {ENTROPY_SQL.format(v='c')} >= 3.0",
    "name": r"regexp_full_match(c, '(?:[a-zA-Z]\.?|[a-zA-Z]+)(?:(?:[ .-]|, )(?:[a-zA-Z]\.?|[a-zA-Z]+))+')",
    "password": f"regexp_full_match(c, '[!-~]{{8,}}') AND lower(c) NOT IN ({', '.join(map(lit, checks.FALSE_PASSWORDS))})",
    "username": f"regexp_full_match(c, '[A-Za-z0-9_-]{{6,}}') AND lower(c) NOT IN ({', '.join(map(lit, checks.FALSE_USERNAMES))})",
}


def check_sql(kind: str) -> str:
    marks, quoted, _ = checks.CHECKS[kind]
    source, extra = ("z", ", " + QUOTES_SQL) if quoted else ("b", "")
    return f"""WITH {RECORDS}, {strip_sql(BLANK if marks == checks.BLANKS else MARKS, kind)}{extra}
        SELECT DISTINCT fileId, piiId, c AS checked, cs AS checked_start, ce AS checked_end FROM {source} WHERE c IS NOT NULL AND {FORM[kind]}"""


NAMES = {"email": "email", "ip_address": "ip", "key": "key", "name": "name", "password": "password", "username": "username"}
QUERIES = {f.__name__: f for f in (dedupe_first_wins, relocate_values, clean_records, merge_full_outer, merge_clean, records_by_type, merge_reductions, entropy_tokens)}
QUERIES |= {"strip_values": stripped, "merge_detectors": merge_detectors, "record_detectors": record_detectors} | {f"quickcheck_{NAMES[k]}": _checked(k) for k in checks.CHECKS}
SQL = {
    "strip_values": f"WITH {RECORDS}, {STRIP} SELECT DISTINCT {OUT} FROM stripped",
    "dedupe_first_wins": f"WITH {RECORDS}, {first('once', 'records')} SELECT {OUT} FROM once",
    "relocate_values": f"WITH {RECORDS}, {moved('placed', 'records')} SELECT DISTINCT {OUT} FROM placed",
    "clean_records": f"WITH {RECORDS}, {cleaned('kept', 'records')} SELECT DISTINCT {OUT} FROM kept",
    "merge_detectors": f"""WITH {RECORDS}, {all_ctes()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY fileId ORDER BY detector, s, e, piiType) - 1 AS k FROM found),
        both_ AS (SELECT fileId, content, piiId::BIGINT AS piiId, piiType, location_start, location_end, "value", detectedBy FROM records
            UNION ALL SELECT r.fileId, f.content, k + 4294967296, piiType, s, e, v, detectedBy FROM ranked r JOIN files f ON f.fileId = r.fileId),
        {first('once', 'both_')}, typed AS (SELECT * REPLACE (CASE WHEN lower(piiType) = 'bigcode_key' THEN 'key' ELSE piiType END AS piiType) FROM once WHERE lower(piiType) = 'bigcode_key' OR piiType IN ({TYPE_LIST})),
        {moved('placed', 'typed')}
        SELECT * REPLACE (row_number() OVER (PARTITION BY fileId ORDER BY piiId, location_start, piiType) - 1 AS piiId) FROM (SELECT {OUT} FROM placed)""",
    "merge_full_outer": """WITH f AS (SELECT DISTINCT fileId, language, lengthBytes, len(piiRecords) AS n FROM code_files),
        a AS (SELECT fileId, n FROM f WHERE language = 'Java'), b AS (SELECT fileId, n FROM f WHERE lengthBytes > 2000)
        SELECT coalesce(a.fileId, b.fileId) AS fileId, CASE WHEN a.fileId IS NULL THEN 'two' WHEN b.fileId IS NULL THEN 'one' ELSE 'both' END AS side,
            coalesce(a.n, 0) + coalesce(b.n, 0) AS n_records FROM a FULL JOIN b ON a.fileId = b.fileId""",
    "merge_clean": f"WITH {CHAIN} SELECT {OUT} FROM kept",
    "records_by_type": f"WITH {CHAIN} SELECT piiType, count(*) AS n_records, count(DISTINCT fileId) AS n_files FROM kept GROUP BY ALL",
    "merge_reductions": f"""WITH {CHAIN}, n AS (SELECT (SELECT count(*) FROM records) AS n_before, (SELECT count(*) FROM placed) AS n_merged, (SELECT count(*) FROM kept) AS n_clean)
        SELECT *, CASE WHEN n_merged > 0 THEN round(100.0 * (n_merged - n_clean) / n_merged, 2) ELSE 0.0 END AS reduction FROM n""",
    "record_detectors": f"WITH {RECORDS} SELECT piiType, detectedBy, count(*) AS n FROM records GROUP BY ALL",
    "entropy_tokens": f"""WITH {RECORDS} SELECT DISTINCT "value", round(CASE WHEN "value" = '' THEN 0.0 ELSE {ENTROPY_SQL.format(v='"value"')} END, 6) AS entropy FROM records WHERE "value" IS NOT NULL""",
} | {f"quickcheck_{NAMES[k]}": check_sql(k) for k in checks.CHECKS}
