"""Texts cut off by a field limit or in transfer.

Three kinds of evidence over all rows:

1. Prefix self-join. All distinct texts (without blanks at the end and without a mark put after a cut) are range-partitioned
   and sorted by value; a text is a strict prefix of a longer one exactly if the next distinct text begins with it. Rows at
   partition borders are joined with the first row of the next partition. Equal texts are collapsed first, so that a hot
   text costs one row.
2. Field limits. Per source, a length (in code points or in UTF-8 bytes) at which at least LIMIT_ROWS rows and half of all
   rows of that length or more pile up.
3. The end itself: open (inside a word, a sentence, a statement), finished, or unsure, by the last line of the text.

A text is cut if its end is open; if its end is unsure and (1), (2) or an unknown last word speaks for a cut; if its end
seems finished, but by (1) the next longer text goes on inside the word or sentence (goes_on). Else a finished end is no
case: who ends a sentence at the exact limit has lost nothing that can be seen.

Defined results: null, empty and blank texts are no case; neither are texts of fewer than SHORT words; repeated texts give
one row per document; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows, written

OPEN, UNSURE, DONE = "open", "unsure", "done"
#: The state of a text of too few words; it counts as a longer copy of others only.
FEW = "few"
#: So many rows of a source make a length a limit.
LIMIT_ROWS = 5
#: Texts of fewer words, or without a mark of fewer bytes, are short, not cut.
SHORT, SHORT_CHARS = 5, 40

#: Letters kept on both sides of the place where a longer text goes on.
AROUND = 40

#: What is put after a cut, or is left of such a mark.
MARK = re.compile(r"(?:\[truncated\]|\(truncated\)|\[\.\.\.\]|\[…\]|…|\.\.\.|&hel(?:lip;?|li?)?|�)$")
CJK = "぀-ヿ㐀-䶿一-鿿"
#: The end of a finished sentence, with closing marks after it.
FULL_STOP = re.compile(r"[.!?。！？؟।][\"'”’»›)\]}*_`]*$")
FOOTER = re.compile(r"^(?:EOF|\(.*\)|[—–-]{1,2} the .*|[A-Z][\w-]*(?: \w+)?: \S+|```+|~~~+|-{3,}|={3,}|\*{3,}|<[^<>]+>|<\|[^|]+\|>)$")
CODE = re.compile(r"[;{}]\s*$|^\s*(?:return|import|from|def|class|func|function|var|let|const|if|for|while|public|private|static|package|#include)\b.*|^\s*[\w.]+\s*(?::=|=|\+=)\s*\S", re.M)
CODE_LINE = re.compile(r"^(?:\s{2,}|\t)|[(){};=\[\]]|\w_\w")
WORDS = re.compile(rf"[{CJK}]|[^\W_{CJK}]+")
SUBWORD = re.compile(r"[A-Z]?[^\W\dA-Z_]+|[A-Z]+(?![^\W\dA-Z_])")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")


def without_mark(text: str) -> str:
    bare = text.rstrip()
    m = MARK.search(bare[-20:])
    return bare[: len(bare) - len(m[0])].rstrip("�").rstrip() if m else text


def last_word(text: str) -> str:
    """The letters that end the text, as far as one subword of an identifier goes; empty where it ends otherwise."""
    found = SUBWORD.findall(text[-80:])
    return found[-1].lower() if found and text.endswith(found[-1]) and len(found[-1]) > 1 and text[-1] < "֐" else ""


def prose_end(line: str, text: str) -> str:
    """The end of a text whose last line is prose."""
    if FULL_STOP.search(line):
        return DONE
    bare = line.strip()
    if FOOTER.match(bare):
        return DONE
    words = WORDS.findall(bare)
    item = re.match(r"^(?:[-*+•]|\d+[.)])\s", bare)
    if bare.startswith("#"):
        return OPEN if len(text) > len(line) else UNSURE
    if re.match(r"^@\w+", bare):
        return OPEN
    own = re.split(rf"(?<=[.!?:])\s+|(?<=[。！？])", bare)[-1]
    if len(own) < len(bare) and own:
        return OPEN  # a sentence was begun after a finished one
    if bare.endswith((":", ",", "、", "，", "；", ";")):
        return OPEN if bare[-1] != ":" else UNSURE
    if re.search(rf"[{CJK}]", bare):
        return OPEN if len(words) >= 6 else UNSURE
    if len(words) > SHORT:
        return OPEN
    # a few words: begun like the finished sentences (or items) before them, or a remark of its own
    begun = bare[item.end() :] if item else bare
    earlier = text[: -len(line)].rstrip().split("\n")
    if item:
        earlier = [x for x in earlier if re.match(r"\s*(?:[-*+•]|\d+[.)])\s", x)]
    finished = any(FULL_STOP.search(x.rstrip()) for x in earlier)
    return OPEN if begun[:1].isupper() and len(words) > 1 and finished else UNSURE


def by_indentation(text: str) -> bool:
    """Whether the last line that isn't indented opens a block by indentation, not by a brace."""
    for line in reversed(text.split("\n")):
        if line.strip() and line[0] not in " \t":
            return bool(re.match(r"(?:async )?def |class \w+[^{]*:\s*$", line))
    return False


def code_end(text: str, line: str) -> str:
    """The end of a text whose last line is code."""
    bare = line.rstrip()
    last = STRING.sub('""', bare).strip()
    if re.search(r"[\"'`]", last.replace('""', "")) and not re.search(r"\w'\w", last):
        return OPEN  # an unfinished string
    indented = by_indentation(text)
    if text.count('"""') % 2 or not indented and (text.rfind("/*") > text.rfind("*/") or text.rfind("<!--") > text.rfind("-->")):
        return OPEN  # inside a docstring or comment
    if last.count("(") > last.count(")") or last.count("[") > last.count("]"):
        return OPEN
    if bare.lstrip().startswith(("//", "#", "*", "--")):
        return prose_end(bare.lstrip().lstrip("/#*- "), text)
    if re.search(r"[-+*/%=,.&|<(\[:]$", last) and not re.search(r"(?:\+\+|--|\*/|:)$", last):
        return OPEN
    closed = text.count(";\n") + text.count("{\n") + text.count("}\n") + text.count(";\r") + text.count("{\r") + text.count("}\r")
    if closed >= max(2, text.count("\n") / 4) and not indented:
        opened, shut = text.count("{"), text.count("}")
        if last.endswith("}"):
            return DONE if opened <= shut or opened < 2 else UNSURE
        return UNSURE if last.endswith((";", "*/", ">")) else OPEN if last else UNSURE
    return UNSURE


def few_words(text: str) -> bool:
    """Whether a text has fewer than SHORT words; most show at their end that they have more."""
    return len(WORDS.findall(text[-300:])) < SHORT and (len(text) <= 300 or len(WORDS.findall(text)) < SHORT)


def end_of(text: str | None) -> str:
    """Whether a text ends inside a word, sentence or statement."""
    if not text or not text.strip():
        return DONE
    bare = without_mark(text).rstrip()
    marked = len(bare) < len(text.rstrip())
    if few_words(bare) or not marked and len(bare.encode("utf-8", "surrogatepass")) < SHORT_CHARS:
        return DONE
    if bare.endswith(("<fim_end>", "|>", "```")):
        return DONE
    line = bare.rsplit("\n", 1)[-1]
    alone = "\n\n" in bare[-len(line) - 3 : -len(line)] if len(bare) > len(line) else False
    if alone and FOOTER.match(line.strip()):
        return DONE
    if alone and text.rstrip().endswith("...") and line.islower() and len(line) < 30 and len(WORDS.findall(line)) > 1:
        return DONE  # "and so on..." closes a text, it doesn't break off
    if re.fullmatch(r"(?:<[^<>\s]+>\s*|\[[A-Z]+\]\s*)+", line):
        return DONE  # a row of special tokens
    tail = bare[-3000:].split("\n")[-8:]
    if FULL_STOP.search(line) and len(WORDS.findall(line)) >= 4 and not CODE_LINE.search(line):
        return DONE
    code = sum(bool(CODE.search(x)) for x in tail if x.strip()) * 2 > sum(bool(x.strip()) for x in tail)
    inside = "/*" in bare and bare.rfind("/*") > bare.rfind("*/") or bare.count('"""') % 2 == 1
    own = bool(CODE.search(line)) and bool(CODE_LINE.search(line))
    state = code_end(bare, line) if code or inside or own else prose_end(line, bare)
    if marked and state == UNSURE:
        return OPEN
    return state


def goes_on(tail: str, rest: str) -> bool:
    """Whether a text that ends with tail, and of which a longer one goes on with rest, ends inside a word or a sentence."""
    end, following = tail[-1], rest[0]
    if following.isalnum() or following == "_":
        return end.isalnum() or end == "_" or end in ".-'’@/" and (following.islower() or following.isdigit())
    return not FULL_STOP.search(tail) and bool(re.match(r"[ \t]*[,;]", rest) or rest.lstrip(" \t")[:1].islower())


def strict_prefixes(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """(h, tail, rest) of the texts (h, bare) that are strict prefixes of another one: h names equal texts, tail is their end,
    rest is what the next longer text goes on with, both to AROUND letters. The range partitions take their number from
    spark.sql.shuffle.partitions unless parts is given."""
    by_range = texts.repartitionByRange(*([parts] if parts else []), "bare").sortWithinPartitions("bare")

    def run(batches):
        from pyspark import TaskContext

        part, first, prev, out = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            for h, bare in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first is None:
                    first = bare
                elif bare.startswith(prev[1]) and len(bare) > len(prev[1]):
                    out.append((part, prev[0], None, None, prev[1][-AROUND:], bare[len(prev[1]) :][:AROUND]))
                prev = (h, bare)
        if prev is not None:
            out.append((part, prev[0], first, prev[1], prev[1][-AROUND:], None))
            types = (pa.int32(), pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "h", "first", "last", "tail", "rest"])

    rows = by_range.mapInArrow(run, "part int, h long, first string, last string, tail string, rest string")
    inside = rows.filter("last is null").select("h", "tail", "rest")
    # one row per partition: as many as the shuffle has partitions, whatever the number of texts
    edge = rows.filter("last is not null").withColumn("next", F.lead("first").over(Window.orderBy("part")))
    across = edge.filter(F.col("next").startswith(F.col("last")) & (F.length("next") > F.length("last"))).select(
        "h", "tail", F.col("next").substr(F.length("last") + 1, F.lit(AROUND)).alias("rest")
    )
    return inside.union(across)


def source_limits(documents: DataFrame) -> DataFrame:
    """(source, unit, size) of each field limit."""
    sizes = documents.filter("text <> ''").select("source", F.explode(F.create_map(F.lit("char"), F.length("text"), F.lit("byte"), F.octet_length("text"))).alias("unit", "size"))
    counted = sizes.groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    above = Window.partitionBy("source", "unit").orderBy(F.desc("size"))
    return counted.withColumn("over", F.sum("n").over(above)).filter((F.col("n") >= LIMIT_ROWS) & (2 * F.col("n") >= F.col("over"))).select("source", "unit", "size")


def interior_words(columns):
    """(word, rows) of the subwords before each text's last one."""
    count: Counter[str] = Counter()
    for t in columns["text"]:
        if t:
            bare = without_mark(t).rstrip()
            words = {w.lower() for w in set(SUBWORD.findall(bare[: len(bare) - len(last_word(bare))]))}
            count.update(words)
    yield from count.items()


def cut_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, evidence) of each text that was cut."""
    docs = documents.select("doc_id", "source", "text").filter("text is not null and text <> ''")

    def states(columns):
        for k, s, t in zip(columns["doc_id"], columns["source"], columns["text"]):
            if bare := without_mark(t).rstrip():
                state = end_of(t)
                word = last_word(bare) if state == UNSURE else None
                yield k, s, FEW if state == DONE and few_words(bare) else state, word, len(t), len(t.encode("utf-8", "surrogatepass")), bare

    schema = "doc_id long, source string, state string, word string, char int, byte int, bare string"
    ends = written(map_rows(docs, states, schema).withColumn("h", F.xxhash64("bare")), "ends")
    sure = ends.filter(F.col("state") == OPEN).select("doc_id", "source", F.lit("end").alias("evidence"))
    unsure = ends.filter(F.col("state") == UNSURE)

    at_limit = unsure.select("doc_id", "source", F.explode(F.create_map(F.lit("char"), F.col("char"), F.lit("byte"), F.col("byte"))).alias("unit", "size")).join(
        source_limits(docs), ["source", "unit", "size"], "left_semi"
    )
    def on(columns):
        return ((h, goes_on(tail, rest)) for h, tail, rest in zip(columns["h"], columns["tail"], columns["rest"]))

    longer = map_rows(strict_prefixes(ends.select("h", "bare").distinct()), on, "h long, inside boolean")
    own = ends.select("doc_id", "source", "state", "h").join(longer, "h")
    prefixes = own.filter(F.col("state").isin(OPEN, UNSURE) | (F.col("state") == DONE) & F.col("inside"))
    known = map_rows(docs.select("text"), interior_words, "word string, n long").select("word").distinct()
    # one row per distinct last word; a word that a third of the texts ends on is one row here
    strange = unsure.filter("word <> ''").select("word").distinct().join(known, "word", "left_anti")
    broken = unsure.join(strange, "word", "left_semi")

    pick = lambda df, why: df.select("doc_id", "source", F.lit(why).alias("evidence"))
    found = sure.union(pick(prefixes, "prefix")).union(pick(at_limit, "limit")).union(pick(broken, "word"))
    return found.groupBy("doc_id").agg(F.first("source").alias("source"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, rate) of every source; texts that are null count in n_texts."""
    cut = cut_texts(documents).select("doc_id", F.lit(1).alias("cut"))
    joined = documents.select("doc_id", "source").join(cut, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n_texts"), F.count("cut").alias("n_cut"), F.round(F.avg(F.coalesce("cut", F.lit(0))), 6).alias("rate"))
