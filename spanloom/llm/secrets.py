"""Credentials in source code, record values and notes: literal index, owner counts, confirmation, automaton re-scan.

1. Candidates. Every text is read once for literals that look like credentials: values of known providers, private
   keys, passwords in URLs, what follows an authorization scheme, and values assigned to names that speak of secrets.
2. Owners. The literals of all files are counted by distinct owner (repository). A literal that SHARED or more owners
   use is a placeholder that examples hand on, not somebody's secret; templates and masked values are none either.
3. Confirmation. What is left and has the structure of a credential (its own format, or enough variety of characters
   under a telling name) is confirmed.
4. Re-scan. Aho-Corasick automata over the confirmed literals run over every content, value and note, so that a
   secret is also found where nothing around it speaks of one. The confirmed set is cut into shards of at most
   SHARD_CHARS characters; each shard is one broadcast of bounded size, and each pass reads the texts once.

Positions are code points of the string itself. Overlapping hits give the longest literal.

Defined results: null and empty texts hold nothing; null records and null values are skipped; a file delivered twice
counts once; texts of any length are read whole; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows, written

#: A literal that so many owners share is a placeholder.
SHARED = 12
#: Characters of confirmed literals in one broadcast automaton (about 25 bytes of memory each).
SHARD_CHARS = 8_000_000

#: Public formats of provider credentials.
PROVIDERS = [
    r"AKIA[0-9A-Z]{16}",
    r"ASIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{40,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"xox[abprs]-[A-Za-z0-9-]{20,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"ya29\.[A-Za-z0-9_-]{20,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"npm_[A-Za-z0-9]{36}",
    r"LTAI[A-Za-z0-9]{16,20}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
]
PROVIDER = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(PROVIDERS) + r")(?![A-Za-z0-9])")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN ).)*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
URL_PASSWORD = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'<>]+:([^\s@/\"'<>]+)@[\w.-]")
SCHEME = re.compile(r"\b(?:Bearer|Basic|Token|Digest)\s+([A-Za-z0-9+/_.=~-]{12,})")
#: Names that speak of secrets: the last part of the name, without marks between words.
SECRET_NAME = (
    r"(?:pass(?:word|wd|phrase|code)?|passwd|pwd|kennwort|passwort|mot_?de_?passe|contrase(?:ñ|n)a|senha|secret|token|bearer|credentials?"
    r"|(?:api|access|signing|private|secret|auth|encryption|master|account|service|shared|cloud|client|webhook)[-_. ]?(?:key|secret|token|id)|smtp[-_.]?pass)"
)
ASSIGNED = re.compile(
    r"(?i)(?<![A-Za-z0-9])(?P<name>[\w.-]{0,40}?" + SECRET_NAME + r")"
    r"(?:\"|')?\s*(?:\]\s*)?(?:\)\s*)?(?::=|=>|=|:|,|\s)\s*(?:"
    r"\"(?P<dq>(?:[^\"\\\n]|\\.)+)\"|'(?P<sq>(?:[^'\\\n]|\\.)+)'|(?P<raw>[^\s\"'<>{}()\[\],;][^\s\"'<>,;]*))"
)
TAGGED = re.compile(r"(?i)<(?P<name>[\w.-]{0,40}?" + SECRET_NAME + r")>(?P<raw>[^<\s]+)</|(?:key|name)=\"(?P<name2>[\w.-]{0,40}?" + SECRET_NAME + r")\"(?:\s+value=\"|>)(?P<raw2>[^\"<\s]+)[\"<]")
#: Remarks about a credential, in notes and comments: the literal that ends the remark.
REMARK = re.compile(
    r"(?i)\b(?:(?:rotate|revoke|(?:todo:? )?(?:remove|delete|drop))|(?:still )?valid(?: on \w+)?:|(?:leaked|expired|current|new|old|use|with)?[ ]?"
    r"(?:pw|pass(?:word|wd|phrase)?|passwort|kennwort|token|login|secret|credentials?|creds?|key)(?:(?: (?:for|on|of) \w+)?:| is:?)?)\s+(\S{6,})(?=\s*(?:today|now|soon|\*/|-->|$))",
    re.M,
)
COMMENT = re.compile(r"(?:^|[\s;{}])(?://|#|/\*|\*|--|<!--|;)[^\n]*", re.M)

#: Words of which placeholders are made.
PLACEHOLDER_WORD = re.compile(r"(?i)(?:your|example|sample|dummy|change[-_ ]?me|replace|insert|redacted|placeholder|todo|fixme|secret[-_]?here|none|null|test123|foo|bar|xxx)")
TEMPLATE = re.compile(r"\$\{|\$\(|\{\{|%\(|%s|<[^>]*>|^\$[A-Za-z_]|^env:|^vault:|^file:|^ref\+|^ssm:|^arn:|^\*+$|^[xX*.#-]+$|\.\.\.|…|^@|^getenv|^process\.env|^os\.environ")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def variety(text: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def placeholder(literal: str) -> bool:
    if TEMPLATE.search(literal) or len(set(literal)) < 4:
        return True
    return bool(PLACEHOLDER_WORD.search(literal)) and variety(literal) < 3.7 and not re.search(r"\d{3}", literal)


def telling(literal: str) -> bool:
    """Whether a value under a telling name has the structure of a credential: long enough, of mixed characters and
    neither a path, a dotted name, a call nor plain words."""
    if not 6 <= len(literal) <= 4000 or placeholder(literal):
        return False
    if re.fullmatch(r"[\d.,:+-]+|[A-Za-z_][\w.]*\(.*|https?://.*|[a-z]+(?:[._ /:-][a-z]+)*", literal):
        return False
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    if re.fullmatch(r"/[\w./-]*", literal) and not (kinds == 4 and len(literal) > 20):
        return False
    if not re.search(r"\d", literal) and (kinds < 3 or len(literal) < 16 or re.fullmatch(r"[\w.]+", literal)):
        return False
    if re.fullmatch(r"[a-z]+(?:[A-Z][a-z]*)*\d{0,2}|[A-Z][a-z]+(?:[A-Z][a-z]*)*\d{0,2}|[a-z_]+\d{0,2}|[A-Z_]+\d{0,2}", literal):
        return False
    return kinds >= 2 and variety(literal) >= 2.3


#: Parts of which each match of the patterns above holds at least one, in lower case: only their lines are looked at.
NAME_PARTS = ["pass", "pwd", "kennwort", "contrase", "senha", "secret", "token", "bearer", "credential", "key", "mot", "_id", ".id", "-id", "cloudid", "clientid", "accountid"]
SCHEME_PARTS = ["bearer", "basic", "token", "digest"]
REMARK_PARTS = ["rotate", "revoke", "remove", "delete", "drop", "valid", "pw", "pass", "kennwort", "token", "login", "secret", "cred", "key"]
PROVIDER_PARTS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "k_live_", "k_test_", "xox", "AIza", "ya29.", "SG.", "npm_", "LTAI", "eyJ"]


def lines_with(lower: str, text: str, parts: list[str]) -> list[str]:
    """The lines of a text that hold one of the parts, in order."""
    starts = set()
    for part in parts:
        at = lower.find(part)
        while at >= 0:
            starts.add(lower.rfind("\n", 0, at) + 1)
            at = lower.find("\n", at)
            if at >= 0:
                at = lower.find(part, at)
    out = []
    for a in sorted(starts):
        b = lower.find("\n", a)
        out.append(text[a : b if b >= 0 else len(text)])
    return out


def candidates(text: str, remarks: bool = False):
    """(literal, whether its own format confirms it) of a text."""
    if "PRIVATE KEY" in text:
        for m in PRIVATE_KEY.finditer(text):
            if len(re.sub(r"\\n|\s", "", m[0])) >= 150:
                yield m[0], True
    if any(part in text for part in PROVIDER_PARTS):
        for m in PROVIDER.finditer(text):
            if not placeholder(m[0]):
                yield m[0], True
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for line in lines_with(lower, text, ["://"]):
        for m in URL_PASSWORD.finditer(line):
            if telling(m[1]):
                yield m[1], False
    for line in lines_with(lower, text, SCHEME_PARTS):
        for m in SCHEME.finditer(line):
            if telling(m[1]):
                yield m[1].rstrip("."), False
    for line in lines_with(lower, text, NAME_PARTS):
        for m in ASSIGNED.finditer(line):
            literal = m["dq"] or m["sq"] or m["raw"]
            if not any(c.isdigit() or not c.isalnum() for c in literal) or " " in literal:
                continue
            if m["raw"] is not None and not raw_value(line, m):
                continue
            if telling(literal):
                yield literal, False
        if "<" in line:
            for m in TAGGED.finditer(line):
                if telling(literal := m["raw"] or m["raw2"]):
                    yield literal, False
    for line in lines_with(lower, text, REMARK_PARTS):
        for m in REMARK.finditer(line):
            literal = m[1].strip("\"'`")
            if telling(literal) and (remarks or COMMENT.match(line[: m.end()].strip())):
                yield literal, False


def raw_value(text: str, m: re.Match) -> bool:
    """An unquoted value counts where it fills the rest of a settings line, not where it is an expression."""
    left = text.rfind("\n", 0, m.start()) + 1
    right = text.find("\n", m.end())
    rest = text[m.end() : right if right >= 0 else len(text)].strip()
    before = text[left : m.start()].strip()
    sep = text[m.end("name") : m.start("raw")].strip()
    literal = m["raw"]
    if rest not in ("", ",", "\\") or sep not in (":", "=") or before not in ("", "-", "export", "#", "//", "set"):
        return False
    return not re.search(r"[()\[\]]|\w->\w", literal) and not (re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", literal) and not re.search(r"\d\D*\d\D*\d", literal))


class Scanner:
    """An automaton over confirmed literals; hits must not continue inside a longer word."""

    def __init__(self, literals: list[str]):
        self.own = ahocorasick.Automaton()
        for literal in literals:
            self.own.add_word(literal, len(literal))
        self.empty = not literals
        if literals:
            self.own.make_automaton()

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        if not text or self.empty:
            return []
        found = []
        for end, size in self.own.iter(text):
            a, b = end - size + 1, end + 1
            if (a and joins(text[a - 1], text[a])) or (b < len(text) and joins(text[b - 1], text[b])):
                if not (a > 1 and text[a - 2 : a] in ("\\n", "\\t", "\\r")):
                    continue
            found.append((a, b))
        return found


def joins(x: str, y: str) -> bool:
    return (x.isalnum() or x == "_") and (y.isalnum() or y == "_")


def longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without those inside or overlapping a longer one."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s)):
        if all(b <= x or y <= a for x, y in kept):
            kept.append((a, b))
    return sorted(kept)


RECORDS = "transform(piiRecords, p -> named_struct('piiId', p.piiId, 'value', p.value, 'notes', p.notes))"


def strings(file: str | None, records: list | None):
    """(field, piiId, text) of each string of a file."""
    if file:
        yield "content", -1, file
    for r in records or ():
        for field in ("value", "notes"):
            if r and r[field]:
                yield field, r["piiId"], r[field]


def confirmed_literals(files: DataFrame) -> DataFrame:
    """(literal) of the confirmed credentials of all files."""

    def found(columns):
        for owner, content, records in zip(columns["owner"], columns["content"], columns["records"]):
            seen = {}
            for field, _, text in strings(content, records):
                if field != "value":
                    for literal, sure in candidates(text, field == "notes"):
                        seen[literal] = seen.get(literal, False) or sure
            for literal, sure in seen.items():
                yield literal, owner, sure

    rows = map_rows(files.select(F.coalesce("repoName", F.lit("")).alias("owner"), "content", F.expr(RECORDS).alias("records")), found, "literal string, owner string, sure boolean")
    # a literal that a third of all files use is reduced to one row per owner before its owners are counted
    once = rows.groupBy("literal", "owner").agg(F.max("sure").alias("sure"))
    counted = once.groupBy("literal").agg(F.count("*").alias("owners"), F.max("sure").alias("sure"))
    return counted.filter((F.col("owners") < SHARED) | F.col("sure")).select("literal")


def shards(literals: DataFrame, chars: int = SHARD_CHARS):
    """Lists of literals whose lengths add up to at most chars each, without holding more than one list."""
    part: list[str] = []
    size = 0
    for row in literals.toLocalIterator(prefetchPartitions=True):
        if size + len(row[0]) > chars and part:
            yield part
            part, size = [], 0
        part.append(row[0])
        size += len(row[0])
    if part:
        yield part


def secret_spans(files: DataFrame) -> DataFrame:
    """(fileId, field, piiId, location_start, location_end) of each credential."""
    spark = files.sparkSession
    literals = written(confirmed_literals(files), "literals")
    schema = "fileId long, field string, piiId int, location_start int, location_end int"
    source = files.select("fileId", "content", F.expr(RECORDS).alias("records"))
    passes = []
    for part in shards(literals):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, part))

        def rows(columns, shared=shared):
            scanner = scanner_of(*shared.value)
            for k, content, records in zip(columns["fileId"], columns["content"], columns["records"]):
                for field, pii, text in strings(content, records):
                    for a, b in longest(scanner.spans(text)):
                        yield k, field, pii, a, b

        passes.append(map_rows(source, rows, schema))
    if not passes:
        return spark.createDataFrame([], schema)
    found = passes[0]
    for more in passes[1:]:
        found = found.union(more)
    found = found.distinct()
    return found if len(passes) == 1 else across_shards(found)


def across_shards(found: DataFrame) -> DataFrame:
    """Drops spans that lie inside a longer one found in another pass; all spans of one string come together."""
    key = ["fileId", "field", "piiId"]
    spans = found.groupBy(*key).agg(F.collect_set(F.struct("location_start", "location_end")).alias("s"))
    inside = lambda x: F.exists("s", lambda y: (y["location_start"] <= x["location_start"]) & (y["location_end"] >= x["location_end"]) & (y != x))
    kept = spans.select(*key, F.explode(F.filter("s", lambda x: ~inside(x))).alias("x"))
    return kept.select(*key, "x.location_start", "x.location_end")


_SCANNERS: dict[str, Scanner] = {}


def scanner_of(name: str, literals: list[str]) -> Scanner:
    """The automaton of a shard, built once per worker process."""
    if name not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name] = Scanner(literals)
    return _SCANNERS[name]
