"""Passages of reference items in documents.

Both sides become words (letters and digits; each Han character or kana alone), without case, punctuation or marks. All
runs of RUN item words are patterns of a Wu-Manber scan over word numbers: the table of shifts is indexed by the hash of
the last BLOCK words of the window, a shift of 0 leads to the comparison of the whole window. The scan goes over one array of
words for a batch of texts, in many lanes at once. What it hits is joined, per document and item, into the chain that
covers most of the item's words in the item's order and in one place.

Defined results: a null or empty text holds nothing; an opening sentence that STOCK or more items share is no part of an
item; an item of fewer than RUN words names no passage and gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from spanloom.llm.common import map_rows, mix

RUN, BLOCK = 4, 2
#: An opening sentence of so many items is an instruction.
STOCK = 3
#: Share of an item's words that makes a case; TESTDATA.md fixes it.
SHARE = 0.4
#: In one place: from one run to the next at most so many words, on either side alike up to SLIP; up to SINGLE changed
#: words between two runs count as held.
GAP, SLIP, SINGLE = 12, 3, 2
TABLE_BITS = 18
#: Words of items in one pass, about 100 bytes of tables each.
SHARD_WORDS = 1_000_000
LANE = 512

IDEOGRAM = "぀-ヿ㐀-䶿一-鿿"
WORD = re.compile(rf"[{IDEOGRAM}]|[^\W_{IDEOGRAM}]+")
UNSEEN = re.compile("[­​-‍⁠﻿]")
SENTENCE = re.compile(r"\s*(\S.*?[.!?:。！？：])(?=\s|[A-Z㐀-鿿])", re.S)


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", UNSEEN.sub("", text))
    return WORD.findall(text.casefold())


def head(text: str, stock: frozenset[str] | set[str]) -> tuple[str, str]:
    """(opening sentence in words, rest) of a text behind the stock sentences that open it; ("", text) without a sentence."""
    while m := SENTENCE.match(text):
        own = " ".join(words(m[0]))
        if own not in stock:
            return own, text
        text = text[m.end() :]
    return "", text


def stock_heads(items: DataFrame, text: str) -> set[str]:
    """The opening sentences that at least STOCK items share, also behind others of that kind; counted over all items."""
    known: set[str] = set()
    while True:
        heads = map_rows(items.select(text), lambda columns, stock=frozenset(known): ((h,) for t in columns[text] if t and (h := head(t, stock)[0])), "head string")
        new = {r["head"] for r in heads.groupBy("head").count().filter(f"count >= {STOCK}").toLocalIterator()}
        if not new:
            return known
        known |= new


class Patterns:
    """The scan's tables for a list of items' words."""

    def __init__(self, items: list[list[str]]):
        self.number = {w: n for n, w in enumerate(dict.fromkeys(w for item in items for w in item), 1)}
        self.sizes = np.array([len(i) for i in items], np.int64)
        views = np.lib.stride_tricks.sliding_window_view
        runs = [views(self.numbers(i), RUN) if len(i) >= RUN else np.empty((0, RUN), np.int64) for i in items]
        owner = np.repeat(np.arange(len(items)), [len(r) for r in runs])
        at = np.concatenate([np.empty(0, np.int64), *(np.arange(len(r)) for r in runs)])
        grid = np.concatenate([np.empty((0, RUN), np.int64), *runs])
        code = self.codes(grid, RUN - 1)
        order = np.argsort(code, kind="stable")
        self.code, first = np.unique(code[order], return_index=True)
        self.owner, self.at = owner[order], at[order]
        self.first = np.append(first, len(code))
        self.shift = np.full(1 << TABLE_BITS, RUN - BLOCK + 1, np.int64)
        for end in range(BLOCK - 1, RUN):
            np.minimum.at(self.shift, self.blocks(grid[:, end - 1], grid[:, end]), RUN - 1 - end)

    def numbers(self, text: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in text], np.int64)

    @staticmethod
    def blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix((a << 32) | b) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def codes(self, rows: np.ndarray, last: int) -> np.ndarray:
        """One number for each row's RUN words up to column last, by a 64-bit hash."""
        code = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(last - RUN + 1, last + 1):
                code = mix(code * np.uint64(31) + rows[:, k].astype(np.uint64) + np.uint64(1))
        return code

    def scan(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (position of the first word, index into code) of a run in an array of word numbers."""
        n = len(text)
        if n < RUN or not len(self.code):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        block = np.concatenate([[0], self.blocks(text[:-1], text[1:])])
        shift = self.shift[block]
        pos = np.arange(RUN - 1, n, LANE)
        stop = np.minimum(pos + LANE, n)
        ends = []
        while len(pos):
            step = shift[pos]
            ends.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            more = pos < stop
            pos, stop = pos[more], stop[more]
        end = np.sort(np.concatenate(ends))
        code = self.codes(text[end[:, None] + np.arange(1 - RUN, 1)], RUN - 1) if len(end) else np.empty(0, np.uint64)
        which = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        hit = self.code[which] == code
        return end[hit] - RUN + 1, which[hit]


def chain(text_at: list[int], item_at: list[int], enough: float) -> bool:
    """Whether runs at these positions, sorted by text_at, chain up to enough of the item's words."""
    best: list[int] = []
    near = 0
    for b, (i, j) in enumerate(zip(text_at, item_at)):
        top = RUN
        while text_at[near] < i - GAP:
            near += 1
        for a in range(b - 1, near - 1, -1):
            di, dj = i - text_at[a], j - item_at[a]
            if di > 0 and 0 < dj <= GAP and -SLIP <= di - dj <= SLIP:
                gain = dj if max(di, dj) <= RUN + SINGLE else RUN
                if di < dj and di < RUN:
                    gain = di
                if best[a] + gain > top:
                    top = best[a] + gain
        if top >= enough:
            return True
        best.append(top)
    return False


def held(patterns: Patterns, texts: list[str | None]) -> list[tuple[int, int]]:
    """(index of the text, index of the item) of each item held."""
    found = [words(t) if t else [] for t in texts]
    sizes = np.array([len(f) + RUN for f in found], np.int64)
    if not len(sizes):
        return []
    ends = np.cumsum(sizes)
    get, gap = patterns.number.get, [0] * RUN  # 0, which no pattern has, keeps runs from crossing texts
    text = np.fromiter((n for f in found for n in (*(get(w, 0) for w in f), *gap)), np.int64, int(ends[-1]))
    at, which = patterns.scan(text)
    if not len(at):
        return []
    many = patterns.first[which + 1] - patterns.first[which]
    post = np.repeat(patterns.first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(at, many)
    item, item_at = patterns.owner[post], patterns.at[post]
    pair = np.searchsorted(ends, at, side="right") * len(patterns.sizes) + item
    # no chain covers more than all hits of a pair together do
    order = np.lexsort((item_at, pair))
    p, j = pair[order], item_at[order]
    reach = np.where(np.append(True, p[1:] != p[:-1]), RUN, np.minimum(np.diff(j, prepend=0), RUN + SINGLE))
    starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    keys = p[starts]
    keys = keys[np.add.reduceat(reach, starts) >= SHARE * patterns.sizes[keys % len(patterns.sizes)]]
    keep = np.isin(pair, keys)
    groups: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    for k, i, j in zip(pair[keep].tolist(), at[keep].tolist(), item_at[keep].tolist()):
        groups[k][0].append(i)
        groups[k][1].append(j)
    n = len(patterns.sizes)
    return [divmod(k, n) for k, (i, j) in groups.items() if chain(i, j, SHARE * patterns.sizes[k % n])]


def shards(items: DataFrame, item: str, text: str, stock: set[str], most: int):
    """Lists of (item, words) of at most `most` words each, without holding more than one list."""
    part, size = [], 0
    for row in items.toLocalIterator():
        own = words(head(row[text], stock)[1])
        if part and size + len(own) > most:
            yield part
            part, size = [], 0
        part.append((row[item], own))
        size += len(own)
    if part:
        yield part


_PATTERNS: dict[str, Patterns] = {}


def patterns_of(name: str, items: list[list[str]]) -> Patterns:
    """The tables of a shard, built once per worker process."""
    if name not in _PATTERNS:
        _PATTERNS.clear()
        _PATTERNS[name] = Patterns(items)
    return _PATTERNS[name]


def contained_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, item) of each document that holds at least SHARE of an item's words. Items are broadcast in shards of at most
    shard_words words; each shard is one pass over the documents."""
    spark = documents.sparkSession
    own = items.select(item, text).filter(f"`{text}` <> ''").distinct()
    stock = stock_heads(own, text)
    schema = f"`{key}` {dict(documents.dtypes)[key]}, `{item}` {dict(items.dtypes)[item]}"
    found = spark.createDataFrame([], schema)
    for part in shards(own, item, text, stock, shard_words):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [i for i, _ in part], [w for _, w in part]))

        def pairs(columns, shared=shared):
            name, ids, texts = shared.value
            for d, i in held(patterns_of(name, texts), columns[text]):
                yield columns[key][d], ids[i]

        found = found.union(map_rows(documents.select(key, text), pairs, schema))
    return found.distinct()
