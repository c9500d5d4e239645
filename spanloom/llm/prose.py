"""Natural language in comments and string literals: extraction, one classification per distinct span, shares of files.

Comments (neighbouring line comments joined) and string literals are cut out by the lexical rules of the file's kind.
Wrongly decoded passages are first read as they were written. Spans are deduplicated by their 128-bit hash, each distinct
span is classified once, and its label is joined back to the files that hold it. A span that very many files hold (a
licence header) is a hot key of that join: labels of spans in more than HOT files, at most one for every HOT spans of the
corpus, are broadcast, all others are joined by hash.

Running prose: sentences with the function words of a language, not names, keys, paths, queries or short remarks.
Words are runs of letters between blanks; Chinese and Japanese count characters.

Defined results: null and empty contents have no prose; a file delivered twice counts once; long texts are read whole;
unknown kinds of files are read by the rules of C; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows, written
from spanloom.llm.encoding import Model, as_written, training_lines

#: Words (characters for Chinese and Japanese) of running prose that make a language of a file.
MIN_WORDS, MIN_CHARS = 15, 30
#: A span of fewer words (characters) is a remark, not running prose.
SPAN_WORDS, SPAN_CHARS = 6, 8
#: So many of its words are no names (German nouns look like names).
SPAN_LOWER, SPAN_LOWER_DE = 6, 4
#: Labels of spans in more files are broadcast.
HOT = 10_000

LANGUAGES = ["de", "en", "es", "fr", "ja", "pt", "ru", "zh"]

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as with be on by this are from at or an not when while then if but all has which its can after before must next only no so than under you may was will were does every without what how where there would these they",
    "de": "der die das und den dem des ein eine einen ist nicht mit für auf von zu im wenn weil am bei nach dass aber auch sich es ohne vor oder wird bis als zur zum aus über nur noch sehr er sie kann siehe solange sobald bevor",
    "fr": "le la les de des du et un une est que qui dans pour avec sur ne pas ce cette au aux en par plus si car mais ou lorsque sans après avant l d il elle sont être même voir dès tant chaque quand n qu",
    "es": "el la los las de del y un una es que en por con para no se al lo su como más si pero o cuando sin antes después hay aunque porque este esta salvo cada mientras también primero véase durante aun",
    "pt": "o a os as de do da dos das e um uma é que em no na por com para não se ao à como mais mas ou quando sem antes após depois há embora porque este esta exceto cada enquanto também primeiro veja durante mesmo pelo",
}
#: Letters and endings that tell the languages apart, with the weight of each.
LETTER_VOTES = {
    "ã": {"pt": 2}, "õ": {"pt": 2}, "ñ": {"es": 2}, "¿": {"es": 2}, "¡": {"es": 2}, "è": {"fr": 2}, "û": {"fr": 2}, "î": {"fr": 2}, "ï": {"fr": 1},
    "œ": {"fr": 2}, "ù": {"fr": 2}, "ë": {"fr": 1}, "ê": {"fr": 1, "pt": 1}, "ô": {"fr": 1, "pt": 1}, "â": {"fr": 1, "pt": 1}, "ç": {"fr": 1, "pt": 1},
    "à": {"fr": 1, "pt": 0.5}, "é": {"fr": 1, "es": 0.5, "pt": 0.5}, "á": {"es": 1, "pt": 1}, "í": {"es": 1, "pt": 1}, "ó": {"es": 1, "pt": 1},
    "ú": {"es": 1, "pt": 1}, "ß": {"de": 2}, "ä": {"de": 2}, "ö": {"de": 2}, "ü": {"de": 1},
}
ENDING_VOTES = {"ción": "es", "ciones": "es", "ção": "pt", "ções": "pt", "ário": "pt", "ung": "de", "lich": "de", "eux": "fr", "ée": "fr", "ées": "fr"}
VOTES: dict[str, dict[str, float]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        VOTES.setdefault(_word, {})[_language] = 1.0
for _votes in VOTES.values():
    for _language in list(_votes):
        _votes[_language] = 2.0 / len(_votes)  # a word of one language alone says more
ENDINGS = re.compile("(?:" + "|".join(ENDING_VOTES) + ")$")

QUERY = re.compile(r"(?i)^\s*(?:select\b.*\bfrom|insert\s+into|update\s+\w+\s+set|delete\s+from|create\s+(?:table|index)|alter\s+table|with\s+\w+\s+as)\b", re.S)
LETTERS = re.compile(r"[^\W\d_�]+(?:['’][^\W\d_]+)*|[^\W\d_]*�[\w�]*")
HAN, KANA, CYRILLIC = re.compile(r"[㐀-䶿一-鿿]"), re.compile(r"[぀-ゟ゠-ヿ]"), re.compile(r"[Ѐ-ӿ]")
CASED = re.compile(r"[a-z][A-Z]|_")

STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
C_LIKE = re.compile(rf"(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)|(?P<str>{STRING}|`(?:[^`\\]|\\.)*`)", re.S)
PYTHON = re.compile(rf"(?P<block>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|(?P<line>#[^\n]*)|(?P<str>{STRING})", re.S)
HASH = re.compile(rf"(?P<line>(?:^|(?<=\s))[#!][^\n]*)|(?P<str>{STRING})|(?P<value>(?<=[:=])[ \t]*[^\s\"'|>\[{{][^\n]*)", re.M)
MARKUP = re.compile(r"(?P<block><!--.*?(?:-->|\Z))|(?P<str>\"[^\"<>]*\")|(?P<value>(?<=>)[^<>]+(?=<))", re.S)
KINDS = {
    "py": PYTHON, "sh": HASH, "yml": HASH, "yaml": HASH, "properties": HASH, "toml": HASH, "ini": HASH, "rb": HASH,
    "xml": MARKUP, "html": MARKUP, "htm": MARKUP, "svg": MARKUP,
}
#: Marks that begin the lines of a comment.
EDGE = re.compile(r"^\s*(?:/\*+!?|\*+/?|//+!?|#+!?|<!--|--+|;+|\"\"\"|''')?[ \t]?|\s*(?:\*+/|-->|\"\"\"|''')\s*$", re.M)


def kind_of(path: str | None, extension: str | None) -> re.Pattern:
    for name in (extension, re.sub(r"\.(?:orig|bak|old)$", "", path or "").rpartition(".")[2]):
        if name and name.lower() in KINDS:
            return KINDS[name.lower()]
    return C_LIKE


def spans(text: str, rules: re.Pattern) -> list[str]:
    """The comments and literals of a text, without their marks; line comments below each other make one span."""
    out: list[str] = []
    run: list[str] = []
    end = -1
    for m in rules.finditer(text):
        piece, how = m[0], m.lastgroup
        if how == "line":
            if run and text[end : m.start()].strip(" \t") not in ("\n", "\r\n"):
                out.append("\n".join(run))
                run = []
            run.append(piece)
            end = m.end()
            continue
        if run:
            out.append("\n".join(run))
            run = []
        out.append(piece if how == "block" else piece.strip().strip("\"'`"))
    if run:
        out.append("\n".join(run))
    cleaned = (EDGE.sub("", s) for s in out)
    return [s for s in (re.sub(r"\\[nrt]|\s+", " ", c).strip() for c in cleaned) if len(s) >= SPAN_CHARS and not s.isdigit()]


def classify(span: str) -> tuple[str | None, int]:
    """(language, words or characters) of a span of running prose, or (None, 0)."""
    kana, han = len(KANA.findall(span)), len(HAN.findall(span))
    if kana + han >= SPAN_CHARS:
        return ("ja" if kana * 8 > han else "zh"), kana + han
    if QUERY.search(span):
        return None, 0
    votes: Counter[str] = Counter()
    count = 0
    for sentence in re.split(r"(?<=[.!?:])\s+", span):
        tokens = [t for t in sentence.split() if LETTERS.search(t)]
        words = [w for t in tokens if not re.search(r"[@/\\=<>{}$]|\w\.\w|://", t) for w in [LETTERS.search(t)[0]]]
        plain = [w for w in words if not CASED.search(w)]
        if len(words) < SPAN_WORDS or len(plain) < 0.6 * len(tokens):
            continue
        own: Counter[str] = Counter()
        if sum(bool(CYRILLIC.search(w)) for w in plain) * 2 > len(plain):
            own["ru"] = 99
        else:
            for w in plain:
                low = w.lower().replace("’", "'")
                for part in low.split("'"):
                    own.update(VOTES.get(part, {}))
                if "'" in low:
                    own["fr" if low.index("'") <= 2 else "en"] += 1
                for c in low:
                    if c in LETTER_VOTES:
                        own.update(LETTER_VOTES[c])
                if m := ENDINGS.search(low):
                    own[ENDING_VOTES[m[0]]] += 1
        if not own:
            continue
        best = max(sorted(own), key=own.get)
        # names and places are written with capitals, in German all nouns
        lower = sum(not w[0].isupper() for w in plain[1:]) + 1
        if own[best] >= 3 and lower >= (SPAN_LOWER_DE if best == "de" else SPAN_LOWER):
            votes.update(own)
            count += len(words)
    if not votes:
        return None, 0
    return max(sorted(votes), key=votes.get), count


def prose_spans(files: DataFrame, model: Model | None = None) -> DataFrame:
    """(fileId, h, n, size, bytes, span): each distinct span of each file, how often it stands there, the bytes it takes
    there, and the bytes of the file. h is the 128-bit hash of the span."""
    import hashlib

    shared = files.sparkSession.sparkContext.broadcast(model or Model(training_lines(files, "content")))

    def rows(columns):
        texts = list(columns["content"])
        marked = [i for i, t in enumerate(texts) if t and not t.isascii()]
        for i, (at, states) in zip(marked, shared.value.label([texts[i] for i in marked])):
            if states.any():
                texts[i] = as_written(texts[i], at, states, shared.value.names)
        for k, path, ext, text in zip(columns["fileId"], columns["path"], columns["extension"], texts):
            if text:
                size = len(text.encode("utf-8", "surrogatepass"))
                for span, n in Counter(spans(text, kind_of(path, ext))).items():
                    raw = span.encode("utf-8", "surrogatepass")
                    yield k, hashlib.md5(raw).digest(), n, size, n * len(raw), raw.decode("utf-8", "replace")

    source = files.select("fileId", "path", "extension", "content")
    return map_rows(source, rows, "fileId long, h binary, n int, size int, bytes long, span string")


def labelled_spans(files: DataFrame, model: Model | None = None) -> DataFrame:
    """(fileId, lang, words, bytes, size) of the prose spans of each file; spans of no language are left out."""
    found = written(prose_spans(files, model), "spans")

    def labels(columns):
        for h, n, span in zip(columns["h"], columns["files"], columns["span"]):
            language, words = classify(span)
            if language:
                yield h, n, language, words

    distinct = found.groupBy("h").agg(F.count("*").alias("files"), F.min("span").alias("span"))
    label = written(map_rows(distinct, labels, "h binary, files long, lang string, words int"), "labels")
    uses = found.select("fileId", "h", "n", "size", "bytes").dropDuplicates(["fileId", "h"])
    hot, rest = label.filter(F.col("files") > HOT).select("h", "lang", "words"), label.filter(F.col("files") <= HOT).select("h", "lang", "words")
    # hot spans leave the uses before these are shuffled by hash
    marked = uses.join(F.broadcast(hot.withColumnsRenamed({"lang": "hot_lang", "words": "hot_words"})), "h", "left")
    by_hash = marked.filter("hot_lang is null").join(rest, "h").select("fileId", "lang", F.col("words") * F.col("n"), "bytes", "size")
    return marked.filter("hot_lang is not null").select("fileId", "hot_lang", F.col("hot_words") * F.col("n"), "bytes", "size").union(by_hash).toDF("fileId", "lang", "words", "bytes", "size")


def file_languages(files: DataFrame, model: Model | None = None) -> DataFrame:
    """(fileId, lang, words, share): the languages of each file with enough running prose, and their share of its bytes."""
    total = labelled_spans(files, model).groupBy("fileId", "lang").agg(F.sum("words").alias("words"), F.round(F.sum("bytes") / F.max("size"), 6).alias("share"))
    return total.filter(F.col("words") >= F.when(F.col("lang").isin("zh", "ja"), MIN_CHARS).otherwise(MIN_WORDS))
