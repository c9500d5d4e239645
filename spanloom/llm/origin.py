"""Source files that nobody wrote by hand here: tool output, minified scripts, third-party copies and data.

One Aho-Corasick automaton holds every notice phrase and runs once over each text. A hit counts where a reader would
take it for a notice: in a comment line or an annotation and outside string literals, so that code which merely prints,
stores or discusses such a phrase isn't taken for tool output. Path rules cover vendored directories, build output and
minified or generated suffixes; they name directories at the place where tools put them, so that a package called
`vendor` or `generated` below hand-written sources is no evidence. Two measures over the whole text find what has no
notice: the share of the text in long lines without blanks (minified), and the share of lines that hold literals only
(data stored as code).

Defined results: a file without content (null, empty or blank) is no case, whatever its path; a null path is judged by
content alone; a file delivered twice gives one row; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from spanloom.llm.common import map_rows

GENERATED, THIRD_PARTY, MINIFIED, DATA = "generated", "third_party", "minified", "data"

#: Phrases of generation notices, in lower case.
NOTICES = {
    "code generated by": GENERATED,
    "generated code": GENERATED,
    "do not edit": GENERATED,
    "do not modify": GENERATED,
    "@generated": GENERATED,
    "<auto-generated": GENERATED,
    "autogenerated": GENERATED,
    "auto-generated": GENERATED,
    "automatically created by": GENERATED,
    "automatically generated": GENERATED,
    "this file was generated": GENERATED,
    "this file is generated": GENERATED,
    "generated from ": GENERATED,
    "generated by ": GENERATED,
    "automatisch erzeugt": GENERATED,
    "automatisch generiert": GENERATED,
    "généré automatiquement": GENERATED,
    "generado automáticamente": GENERATED,
    "gerado automaticamente": GENERATED,
    "自动生成": GENERATED,
    "自動生成": GENERATED,
    "vendored copy of": THIRD_PARTY,
    "vendored from": THIRD_PARTY,
    "copied from the upstream": THIRD_PARTY,
    "imported unchanged": THIRD_PARTY,
    "(upstream:": THIRD_PARTY,
    "third-party code": THIRD_PARTY,
    "/*! ": THIRD_PARTY,
    "@license": THIRD_PARTY,
}
#: Phrases that prose also uses; they need a sign of a notice in the same comment line.
LOOSE = {"do not edit", "do not modify", "generated code", "generated from ", "generated by ", "auto-generated", "autogenerated", "automatically generated"}
SIGN = re.compile(r"do not (?:edit|modify|change)|will be (?:lost|overwritten)|^\W*(?:auto-?)?generated (?:by|from)\b|\d+\.\d+|\.(?:g4|xsd|idl|proto|y|l|wsdl)\b")
#: `/*! name v1.2.3` is the banner that minifiers keep.
BANNER = re.compile(r"/\*! ?[\w.@/-]+ v\d")
COMMENT = re.compile(r"\s*(?://|/\*|\*|#(?!define|include|if|pragma)|--|<!--|;|%|'''|\"\"\"|@generated\b)")

#: Directories into which package managers put other people's sources, anywhere in a path.
PACKAGE_DIRS = {"node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "third_party", "third-party", "thirdparty", "3rdparty", "pods", "carthage"}
VENDORED = re.compile(r"^(?:vendor|vendors|deps|extern|external|externals)/[^/]+/")
TOOL_DIR = re.compile(r"^(?:.*/)?(?:generated-sources|generated-test-sources)/|^(?:[\w-]+/)?(?:build|target|out|bin|obj)/generated/|^(?:src/)?(?:gen|autogen)/")
TOOL_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.g\.\w+|\.g4\.\w+|\.designer\.cs|_generated\.\w+|\.generated\.\w+)$", re.I)
LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock)$", re.I)
MIN_NAME = re.compile(r"[.-](?:min|bundle|packed)\.(?:js|css|mjs)$", re.I)

#: A line of so many characters, of which so few are blanks outside quotes, is minified; so many of a file's characters.
LONG_LINE, MIN_BLANKS, MIN_SHARE = 180, 0.06, 0.6
QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
#: A literal, alone or in a bracketed row of literals.
LITERAL = r"""(?:[-+]?(?:0x[0-9a-f]+|\d[\d_.]*(?:e[-+]?\d+)?)[a-z]?|"[^"\n]*"|'[^'\n]*'|true|false|null|none|nil)"""
DATA_LINE = re.compile(rf"^[\s\[({{]*(?:{LITERAL}[\s,;:\])}}+\\]*[\s\[({{]*)+$", re.I)
#: Share of the lines that are literals only, of at least so many of them; settings files in which literals are the form.
DATA_SHARE, DATA_LINES = 0.7, 4
#: JSON and the like are data by nature, not data stored as code.
CONFIG = re.compile(r"\.(?:json|ya?ml|xml|properties|toml|ini|csv|txt|md)$", re.I)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    own = ahocorasick.Automaton()
    for phrase in NOTICES:
        own.add_word(phrase, phrase)
    own.make_automaton()
    return own


def by_path(path: str | None) -> str | None:
    if not path:
        return None
    parts = path.split("/")
    if not PACKAGE_DIRS.isdisjoint(p.lower() for p in parts[:-1]) or VENDORED.match(path):
        return THIRD_PARTY
    if TOOL_DIR.match(path) or TOOL_NAME.search(path) or LOCK_NAME.search(path):
        return GENERATED
    if MIN_NAME.search(path):
        return MINIFIED
    return None


def in_string(before: str) -> bool:
    """Whether the end of this beginning of a line stands inside a string literal."""
    return bool(re.search(r"[\"'`]", re.sub(QUOTED, "", before)))


def by_notice(content: str) -> str | None:
    lower = content.lower()
    if len(lower) != len(content):  # a few characters have longer lower-case forms
        content = lower
    for end, phrase in automaton().iter(lower):
        start = end - len(phrase) + 1
        left = lower.rfind("\n", 0, start) + 1
        right = lower.find("\n", end)
        line = lower[left : right if right >= 0 else len(lower)]
        if left == 0:
            line = line.lstrip("﻿")
        if phrase == "/*! ":
            if BANNER.match(lower, start) and not line[: line.find(phrase)].strip():
                return THIRD_PARTY
            continue
        if not COMMENT.match(line) or in_string(line[: line.find(phrase)]):
            continue
        if phrase in LOOSE and not SIGN.search(line):
            continue
        return NOTICES[phrase]
    return None


def minified(content: str) -> bool:
    long = sum(len(line) for line in content.split("\n") if len(line) >= LONG_LINE and is_dense(line))
    return long >= MIN_SHARE * len(content.strip())


def is_dense(line: str) -> bool:
    bare = QUOTED.sub('""', line)
    return len(bare) >= LONG_LINE / 2 and sum(map(str.isspace, bare)) <= MIN_BLANKS * len(bare)


def data_rows(content: str) -> bool:
    lines = [line for line in content.split("\n") if line.strip()]
    if len(lines) < DATA_LINES:
        return False
    hits = sum(len(line) for line in lines if DATA_LINE.match(line))
    return hits >= DATA_SHARE * sum(map(len, lines))


def origin(path: str | None, content: str | None) -> str | None:
    """Why a file isn't hand-written, or None."""
    if not content or not content.strip().strip("﻿"):
        return None
    return (
        by_path(path)
        or by_notice(content)
        or (MINIFIED if minified(content) else None)
        or (DATA if not CONFIG.search(path or "") and data_rows(content) else None)
    )


def foreign_files(files: DataFrame, key: str = "fileId", path: str = "path", content: str = "content") -> DataFrame:
    """(key, origin) of each file that isn't hand-written; texts are read where they lie, only keys are shuffled."""

    def rows(columns):
        for k, p, c in zip(columns[key], columns[path], columns[content]):
            if why := origin(p, c):
                yield k, why

    kind = dict(files.dtypes)[key]
    found = map_rows(files.select(key, path, content), rows, f"`{key}` {kind}, origin string")
    return found.dropDuplicates([key])
