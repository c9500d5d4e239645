"""Personal information in free text: labelers vote, expectation-maximisation weighs them, a classifier decides.

1. Gazetteers. Given and family names are counted over all files where the text itself names a person (an author tag, a
   column of a record, a remark), against the names of products and the like in other such places.
2. Labelers. Every candidate span (by the shapes of each type, and by the places of step 1) gets a vote of each labeler:
   shape, gazetteer, place before it, what follows it, kind of the string around it, and the records' own labels.
3. Aggregation. Candidates are counted by type and votes over the whole corpus; expectation-maximisation estimates for each
   type how often cases occur and how reliable each labeler is, from the counts of all rows.
4. Classifier. A logistic model over the votes and pairs of votes is trained on the resulting probabilities and decides each
   span. What it sees is the table of vote patterns, whose size depends on the labelers and not on the data.

Positions are code points of the string itself. Wrongly decoded letters inside names and streets count as letters.

Defined results: null and empty strings hold nothing; null records are skipped; a file delivered twice counts once; texts
are read whole; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows, written
from spanloom.llm.secrets import RECORDS, strings

TYPES = ["email", "phone_number", "ID", "address", "name"]
#: Names in the gazetteers, most frequent first; the number bounds their broadcast. A name beyond it lacks one vote.
GAZETTEER = 200_000

# Shapes. W is a capitalised word, in which any character beyond ASCII counts as a letter.
_U, _L = r"(?:[A-Z]|[^\x00-\x7f\s])", r"(?:[A-Za-z]|[^\x00-\x7f\s])"
W = rf"{_U}{_L}+"
FULL_NAME = rf"{W}(?:(?: [A-Z]\.)? {W}(?:-{W})?|(?:-{W})?, {W})"
NAME = re.compile(rf"(?<![\w@./-])(?={_U})(?P<name>{FULL_NAME})(?![\w@])")

LOCAL = r"[A-Za-z0-9][\w.+-]*"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
DOT = r"(?:\.|\s+dot\s+|\s?\(dot\)\s?|\s?\[dot\]\s?)"
AT = r"(?:@|\s?\(at\)\s?|\s?\[at\]\s?|\s+at\s+)"
EMAIL = re.compile(rf"(?<![\w.+/@-])(?P<local>{LOCAL})(?P<at>{AT})(?P<domain>{LABEL}(?:{DOT}{LABEL})+)(?![\w@])")
PHONE = re.compile(
    r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]\d{2,5}){1,5}|00[1-9]\d{9,12}|0\d{2,4}[ /-]\d{5,8}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4})(?![\w-]|\.\d)"
)
IDENTITY = re.compile(
    r"(?<![\w.+/-])(?:\d{3}-\d{2}-\d{4}|\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|\d{2} \d{3} \d{3} \d{3}|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[A-Z]{1,2}\d{7})(?![\w+/=-]|\.\d| \d{2})"
)
#: Words for streets in the languages of the corpus.
STREET_EN = r"(?:Street|St\.?|Lane|Ln\.?|Avenue|Ave\.?|Road|Rd\.?|Court|Ct\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Way|Place|Square|Terrace)"
STREET_DE = r"(?:stra\S{1,4}e|str\.|weg|gasse|platz|allee|-Allee|-Stra\S{1,4}e|-Weg|-Platz|-Ring)"
STREET_FR = r"(?:rue|avenue|all\S{1,4}e|boulevard|chemin|place|impasse|quai)"
STREET_ES = r"(?:Calle|Avenida|Plaza|Paseo|Carrera|Rua|Travessa|Camino)"
TOWN = rf"{W}(?:-{W})*"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:\d{{1,5}}[a-z]? {W}(?: {W})? {STREET_EN}(?: (?:Apt|Suite|Unit|Floor)\.? \w+)?, {TOWN},? (?:[A-Z]{{2}} )?\d{{4,6}}"
    rf"|(?:{W} )?{_U}{_L}*(?:{STREET_DE}) \d{{1,5}} ?[a-z]?, (?:[A-Z]{{1,2}}-)?\d{{4,6}} {TOWN}"
    rf"|\d{{1,5}}[a-z]?,? {STREET_FR}(?: (?:du|de|de la|des|de l'))? ?{W}(?: {W})?, (?:[A-Z]{{1,2}}-)?\d{{4,6}} {TOWN}"
    rf"|{STREET_ES}(?: (?:de|del|da|do|de la))? {W}(?: {W})?,? \d{{1,5}}[a-z]?, (?:[A-Z]{{1,2}}-)?\d{{4,6}} {TOWN})(?![\w-])"
)

#: Mailboxes of nobody in particular.
ROLES = set("noreply no-reply donotreply support info admin administrator postmaster webmaster hostmaster root sales contact help helpdesk abuse security git svn hg user username mail mailer daemon mailer-daemon test example foo bar me you someone nobody service team office billing jobs hr press news newsletter".split())
FILE_ENDING = re.compile(r"(?i)\.(?:png|jpe?g|gif|svg|webp|js|css|ts|py|java|go|c|h|json|xml|ya?ml|zip|jar|md|txt|local|localhost)$|^\d|\.\d")

# Places. Each type has keys and remarks that announce it, and others that announce something else.
PERSON_KEY = r"(?:approver|owner|card[_ .-]?holder|recipient|(?:full|first|last|sur|user's |real)?[_ .-]?name|author|maintainer|customer|employee|person|patient|reviewer|assignee|signed[_ .-]off[_ .-]by)"
KEYED = r"[\"'\])>]*\s*(?:[:=,(]|value=)+\s*[\"'(<]*$"
PLACES = {
    "name": (
        re.compile(rf"(?i)(?:@author|\bauthor:?|\bmaintainer:?|\bcreated by|\bwritten by|\bthanks to|\bthanks to [^\n]{{3,40}} and|\bask|\bbug:|\breviewer:|\bsame person as|\basked|\bsee also|\bapproved by|\bcopyright(?: \(c\)| ©| .{{1,3}})?(?: \d{{4}}(?:-\d{{4}})?)?,?)\s+$|\b{PERSON_KEY}{KEYED}|VALUES \(\d+, ['\"]$|[\"'=:]\s*\d+;$|^\d+;$"),
        re.compile(rf"(?i)(?:font|theme|title|label|product|release|style|banner|brand|project|asset|skin|palette|game|album|font[-_.]family){KEYED}|(?i:\bthe)\s+$"),
    ),
    "email": (
        re.compile(rf"(?i)(?:mailto:|\bmail of|\breported by|\breviewer:|\bsame person as|\basked|\bsee also|<|\(|e-?mail:?)\s*$|(?:contact|e-?mail|mail[-_.]?to|recipient|author|owner|to|from|cc){KEYED}|;$"),
        re.compile(rf"(?i)(?:remote|repo(?:sitory)?|origin|url|pkg|package|asset|image|host|upstream|endpoint|clone){KEYED}|://[^\s\"']*$"),
    ),
    "phone_number": (
        re.compile(rf"(?i)(?:\bphone|\bcall|\btel\.?:?|\bfax|\bmobile|\breviewer:|\bsame person as|\basked|\bsee also)\s*$|(?:hotline|fax|phone|tel(?:ephone)?|mobile|cell|call){KEYED}|;$|', ['\"]$"),
        re.compile(rf"(?i)(?:isbn|part[_ .-]?no|build[_ .-]?(?:number|no)?|serial|version|revision|oid|port|id|code){KEYED}"),
    ),
    "ID": (
        re.compile(rf"(?i)(?:national id|passport(?: no\.?)?|ssn|tax id|id no\.?|insurance no\.?|reviewer:|same person as|asked|see also)\s*:?\s*$|(?:ssn|passport[_ .-]?(?:no|number)?|tax[_ .-]?id|national[_ .-]?id|social[_ .-]security|identity|dni|nif|nir|steuer[_ .-]?id|insurance){KEYED}|;$|', ['\"]$"),
        re.compile(rf"(?i)(?:isbn|part[_ .-]?no|build[_ .-]?(?:number|no)?|serial|version|revision|oid|sku|model|code|commit|hash){KEYED}"),
    ),
    "address": (
        re.compile(rf"(?i)(?:\bfrom|\bwent to|\bto|\breviewer:|\bsame person as|\basked|\bsee also|\blives at)\s+$|(?:address|ship[_ .-]?to|street|residence|home){KEYED}|;$"),
        re.compile(rf"(?i)(?:theme|title|label|font|path){KEYED}"),
    ),
}
#: What follows a case in remarks and rows, and what follows something else.
AFTER = re.compile(r"^(?:[\"'`;,)>?.\]]|\s*$|\s*\n| in the same repo| about this| cannot log in| from | and | on \d| <| \(|</|\*/| -->)")
AFTER_NOT = re.compile(r"^(?: \d|,? ?(?:Authors|Inc|Ltd|GmbH|Foundation|Team|Project|Group|Company|Tileset|Theme|Release|Neo)\b|:\w|[/@\\])")
OPAQUE = re.compile(r"^[A-Za-z0-9+/=\s\"\\]{60,}$")


def parts(name: str) -> tuple[str, list[str]]:
    """(given name, family names) of a written name, in lower case."""
    if "," in name:
        family, _, given = name.partition(", ")
    else:
        words = name.split(" ")
        given, family = words[0], words[-1]
    return given.casefold(), [x.casefold() for x in family.split("-")]


def record_labels(records: list | None) -> dict[str, str]:
    """What the records call the strings they hold: a weak labeler."""
    out = {}
    for r in records or ():
        if r and r["value"] and r["piiType"]:
            out[r["value"].strip(" \"'\t\n.,;:()<>")] = r["piiType"]
    return out


LABELS = {"email": "email", "name": "name", "phone_number": "phone_number", "address": "address", "ID": "ID"}


def name_evidence(columns):
    """(kind, word, good, bad): given and family names at places that name a person or something else."""
    good_at, bad_at = PLACES["name"]
    count: dict[tuple[str, str], list[int]] = {}
    for content, records in zip(columns["content"], columns["records"]):
        for field, _, text in strings(content, records):
            if field == "value":
                continue
            for m in NAME.finditer(text):
                before = text[max(0, m.start() - 60) : m.start()].rsplit("\n", 1)[-1]
                good, bad = bool(good_at.search(before)), bool(bad_at.search(before)) or bool(AFTER_NOT.match(text[m.end() : m.end() + 12]))
                if good != bad:
                    given, family = parts(m["name"])
                    for key in [("given", given), *(("family", f) for f in family)]:
                        own = count.setdefault(key, [0, 0])
                        own[bad] += 1
    for (kind, word), (good, bad) in count.items():
        yield kind, word, good, bad


def gazetteers(files: DataFrame) -> dict[str, set[str]]:
    """The names that stand at least twice, and mostly, where persons are named."""
    source = files.select("content", F.expr(RECORDS).alias("records"))
    counted = map_rows(source, name_evidence, "kind string, word string, good long, bad long").groupBy("kind", "word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    kept = counted.filter("good >= 2 and good > 2 * bad").orderBy(F.desc("good"), "kind", "word").limit(GAZETTEER)
    out: dict[str, set[str]] = {"given": set(), "family": set()}
    for row in kept.toLocalIterator():
        out[row["kind"]].add(row["word"])
    return out


def vote(good: bool, bad: bool = False) -> int:
    return -1 if bad else int(good)


def place_votes(kind: str, text: str, a: int, b: int) -> tuple[int, int, int]:
    """Votes of what stands before, of what follows, and of the literal around the span."""
    before = text[max(0, a - 80) : a].rsplit("\n", 1)[-1]
    after = text[b : b + 24]
    good_at, bad_at = PLACES[kind]
    left, right = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    line = text[left : right if right >= 0 else len(text)]
    return (
        vote(bool(good_at.search(before)), bool(bad_at.search(before))),
        vote(bool(AFTER.match(after)), bool(AFTER_NOT.match(after))),
        vote(False, len(line) > 60 and bool(OPAQUE.match(line.strip(" ;,+")))),
    )


def person_in(local: str, known: dict[str, set[str]]) -> bool:
    words = [w for w in re.split(r"[._+\d-]+", local.casefold()) if w]
    return any(w in known["given"] or w in known["family"] or w[1:] in known["family"] for w in words)


def spans_of(text: str, known: dict[str, set[str]], labels: dict[str, str]):
    """(type, start, end, votes) of each candidate. The votes are those of the shape, the gazetteer, the place before, the
    place after, the literal around, and the records."""
    taken: list[tuple[int, int]] = []

    def made(kind: str, a: int, b: int, shape: int, gazetteer: int):
        before, after, around = place_votes(kind, text, a, b)
        label = labels.get(text[a:b])
        return kind, a, b, (shape, gazetteer, before, after, around, vote(label == LABELS[kind], label is not None and label != LABELS[kind]))

    if "@" in text or "at" in text:
        for m in EMAIL.finditer(text):
            local, domain = m["local"], re.sub(DOT, ".", m["domain"])
            if m["at"].strip() == "at" and not re.search(r"\W", m["domain"]):
                continue
            plain = m["at"].strip() != "at"
            # " at " also stands in prose: without a spelled-out dot a person's name must speak for an address
            if not plain and "dot" not in m["domain"].split() and not person_in(local, known) and not PLACES["email"][0].search(text[max(0, m.start() - 80) : m.start()].rsplit("\n", 1)[-1]):
                continue
            bad = local.casefold() in ROLES or bool(FILE_ENDING.search(domain)) or text[m.end() : m.end() + 1] in (":", "/") and m["at"] == "@" and bool(re.match(r":\w", text[m.end() : m.end() + 2]))
            taken.append(m.span())
            yield made("email", *m.span(), vote(plain, bad), vote(person_in(local, known)))
    if re.search(r"\d{4}", text) or re.search(r"\d\d \d\d", text):
        for m in ADDRESS.finditer(text):
            taken.append(m.span())
            yield made("address", *m.span(), 1, 0)
        for kind, shape in (("phone_number", PHONE), ("ID", IDENTITY)):
            for m in shape.finditer(text):
                if any(a < m.end() and m.start() < b for a, b in taken):
                    continue
                if kind == "ID" or len(re.sub(r"\D", "", m[0])) >= 9:
                    taken.append(m.span())
                    yield made(kind, *m.span(), shape_of(kind, m[0]), 0)
    for m in NAME.finditer(text):
        given, family = parts(m["name"])
        gazetteer = (given in known["given"]) + any(f in known["family"] for f in family)
        a, b = m.span()
        before = text[max(0, a - 80) : a].rsplit("\n", 1)[-1]
        if gazetteer or PLACES["name"][0].search(before):
            if not any(x < b and a < y for x, y in taken):
                yield made("name", a, b, vote(given in known["given"], given not in known["given"]), vote(any(f in known["family"] for f in family), not gazetteer))


def shape_of(kind: str, value: str) -> int:
    """How telling a number's own form is: 1 if hardly anything else looks like it."""
    if kind == "phone_number":
        return vote(value[0] in "+(" or value.startswith("00") or bool(re.match(r"\d{3}[-. ]555", value)))
    return vote(" " in value or bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{8}[A-Z]", value)))


def code(kind: str, votes: tuple[int, ...]) -> str:
    return kind + ":" + "".join("-0+"[v + 1] for v in votes)


def decode(pattern: str) -> tuple[str, np.ndarray]:
    kind, _, votes = pattern.partition(":")
    return kind, np.array(["-0+".index(v) - 1 for v in votes])


def reliabilities(votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns: (probability of each pattern, share of cases, P(vote | case) by labeler,
    vote and class). It starts from the mean vote, so that labelers which agree gain weight."""
    n, k = votes.shape
    p = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    table = np.zeros((k, 3, 2))
    for _ in range(rounds):
        cases = np.stack([weight * (1 - p), weight * p], 1)
        total = cases.sum(0) + 1e-9
        prior = (total[1] + 1) / (total.sum() + 2)
        for j in range(k):
            for v in (-1, 0, 1):
                table[j, v + 1] = (cases[votes[:, j] == v].sum(0) + 0.5) / (total + 1.5)
        logit = np.log(prior / (1 - prior)) + sum(np.log(table[j, votes[:, j] + 1, 1] / table[j, votes[:, j] + 1, 0]) for j in range(k))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, float(prior), table


def features(votes: np.ndarray) -> np.ndarray:
    """Bias, each vote as two flags, and the products of the flags of two labelers."""
    flags = np.concatenate([votes == 1, votes == -1], 1).astype(float)
    pairs = [flags[:, i] * flags[:, j] for i in range(flags.shape[1]) for j in range(i + 1, flags.shape[1])]
    return np.column_stack([np.ones(len(votes)), flags, *pairs])


def classifier(votes: np.ndarray, weight: np.ndarray, p: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic model fitted to the probabilities, by gradient steps with a small penalty."""
    x = features(votes)
    share = np.sqrt(weight) / np.sqrt(weight).sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (share * (q - p)) + 1e-4 * w)
    return w


def candidates(files: DataFrame, known: dict[str, set[str]]) -> DataFrame:
    """(fileId, field, piiId, location_start, location_end, piiType, pattern) of each candidate span."""
    shared = files.sparkSession.sparkContext.broadcast(known)

    def rows(columns):
        for k, content, records in zip(columns["fileId"], columns["content"], columns["records"]):
            labels = record_labels(records)
            for field, pii, text in strings(content, records):
                for kind, a, b, votes in spans_of(text, shared.value, labels if field == "content" else {}):
                    yield k, field, pii, a, b, kind, code(kind, votes)

    records = F.expr("transform(piiRecords, p -> named_struct('piiId', p.piiId, 'value', p.value, 'notes', p.notes, 'piiType', p.piiType))")
    schema = "fileId long, field string, piiId int, location_start int, location_end int, piiType string, pattern string"
    return map_rows(files.select("fileId", "content", records.alias("records")), rows, schema).distinct()


def decide(patterns: dict[str, int]) -> dict[str, float]:
    """The probability that each vote pattern is a case, by the classifier trained on the aggregated votes."""
    out = {}
    for kind in TYPES:
        own = sorted(p for p in patterns if p.startswith(kind + ":"))
        if own:
            votes = np.array([decode(p)[1] for p in own])
            weight = np.array([patterns[p] for p in own], float)
            p, _, _ = reliabilities(votes, weight)
            w = classifier(votes, weight, p)
            out |= dict(zip(own, (1 / (1 + np.exp(-np.clip(features(votes) @ w, -30, 30)))).tolist()))
    return out


def personal_spans(files: DataFrame) -> DataFrame:
    """(fileId, field, piiId, location_start, location_end, piiType) of each item of personal information."""
    found = written(candidates(files, gazetteers(files)), "candidates")
    # at most one row for each combination of votes: bounded by the labelers, not by the data
    counts = {r["pattern"]: r["n"] for r in found.groupBy("pattern").agg(F.count("*").alias("n")).toLocalIterator()}
    good = [p for p, probability in decide(counts).items() if probability >= 0.5]
    return found.filter(F.col("pattern").isin(good)).drop("pattern").distinct() if good else found.drop("pattern").limit(0)
