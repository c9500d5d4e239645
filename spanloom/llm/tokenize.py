"""Encoding of whole corpora with a byte-level BPE vocabulary.

Pre-tokenisation runs over one array of code points for a whole batch of texts and uses no regular expression:
each code point gets a class, word boundaries follow from neighbouring classes, and the only context-dependent part
(contractions, whose letters would otherwise join a word) is an automaton whose transition functions are composed by
an associative scan. Almost all functions are constant, that is they forget the state before, so the scan is only
run where they are not. The slices between boundaries feed pair merging through a cache per worker process.

Defined results: a null text and an empty text give an empty list; a text is never shortened; repeated texts give
equal lists; an empty table gives an empty table; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import SLICE_BYTES

OTHER, LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, END = range(7)

#: The Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: The contractions that the public pattern names.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


#: Letters and numbers of Unicode 16, which the public tokenizers know and the interpreter may not yet.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def class_table() -> np.ndarray:
    """Class of each code point."""
    table = np.zeros(0x110001, np.uint8)
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    table[:-1][kinds == ord("L")] = LETTER
    table[:-1][kinds == ord("N")] = NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[WHITE_SPACE] = BLANK
    table[32] = SPACE
    table[39] = APOSTROPHE
    table[-1] = END
    return table


# States of the contraction automaton while it reads code points: outside, after an apostrophe that may open a
# contraction, after its first letter where two are needed, and right after a whole contraction.
OUT, OPEN, R, V, L, DONE = range(6)
STATES = 6


def transitions() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The transition function (state -> state) of each letter that takes part in a contraction, and of any other."""
    step = {c: np.zeros(STATES, np.uint8) for c in {x for word in CONTRACTIONS for x in word[1:]}}
    for word in CONTRACTIONS:
        if len(word) == 2:
            step[word[1]][OPEN] = DONE
        else:
            middle = {"r": R, "v": V, "l": L}[word[1]]
            step[word[1]][OPEN] = middle
            step[word[2]][middle] = DONE
    return step, np.zeros(STATES, np.uint8)


def scan_segments(functions: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Inclusive scan under composition, by doubling, within the segments that begin at heads (whose functions are
    constant, so that nothing before them matters): row i becomes f_i after ... after f_head."""
    out, reach = functions.copy(), 1
    start = np.maximum.accumulate(np.where(heads, np.arange(len(out)), 0))
    while True:
        at = np.flatnonzero(np.arange(len(out)) - reach >= start)
        if not len(at):
            return out
        out[at] = np.take_along_axis(out[at], out[at - reach], axis=1)
        reach *= 2


def boundaries(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point. cls has END at separators, which are pieces that callers drop."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    before = np.concatenate([[END], cls[:-1]]).astype(np.uint8)
    after = np.concatenate([cls[1:], [END]]).astype(np.uint8)
    white = (cls == BLANK) | (cls == SPACE)
    white_before = (before == BLANK) | (before == SPACE)
    mark = (cls == OTHER) | (cls == APOSTROPHE)
    mark_before = (before == OTHER) | (before == APOSTROPHE)
    begin = cls != before
    begin &= ~(mark & mark_before)
    begin[white & white_before] = False
    # a single U+0020 before a word, number or mark belongs to it; other white space before one stands alone
    begin[~white & (before == SPACE) & (cls != END)] = False
    solid_after = ~((after == BLANK) | (after == SPACE) | (after == END))
    begin[white & solid_after] = True
    begin[white & ~white_before] = True
    begin[cls == END] = True
    begin[before == END] = True

    # contractions: positions whose function is not constant, and the apostrophes that start them
    opening = np.flatnonzero((cls == APOSTROPHE) & ~mark_before & (before != SPACE) & (after == LETTER))
    if len(opening):
        at = np.unique(np.concatenate([opening, opening + 1, opening + 2]))
        at = at[at < n]
        step, other = transitions()
        functions = np.tile(other, (len(at), 1))
        letters = cp[at]
        for char, function in step.items():
            functions[letters == ord(char)] = function
        opens = np.isin(at, opening)
        functions[opens] = OPEN
        heads = opens | np.concatenate([[True], np.diff(at) != 1])
        state = scan_segments(functions, heads)[:, OUT]
        done = at[state == DONE]
        long = np.isin(done - 1, opening, invert=True)
        for ends, size in ((done[~long], 2), (done[long], 3)):
            begin[ends - size + 1] = True
            for k in range(1, size):
                begin[ends - size + 1 + k] = False
            nxt = ends + 1
            nxt = nxt[nxt < n]
            # what follows a contraction is a new piece, unless it is white space with rules of its own
            begin[nxt[~white[nxt]]] = True
        plain = np.setdiff1d(opening, np.concatenate([done[~long] - 1, done[long] - 2]), assume_unique=True)
        begin[plain + 1] = True
    return begin


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pair merging of one piece, lowest rank first and leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 300:
        return merge_long(parts, ranks)
    rank, none = ranks.get, 1 << 60
    pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) != none:
        at = pairs.index(best)
        both = parts[at] + parts[at + 1]
        parts[at : at + 2] = [both]
        del pairs[at]
        if at:
            pairs[at - 1] = rank(parts[at - 1] + both, none)
        if at < len(pairs):
            pairs[at] = rank(both + parts[at + 1], none)
    return [ranks[p] for p in parts]


def merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces in O(n log n): a heap of pairs over a linked list."""
    import heapq

    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive: list[bytes | None] = list(parts)
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j < 0 or alive[i] != a or alive[j] != b:
            continue
        alive[i], alive[j] = a + b, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (r := ranks.get(alive[x] + alive[y])) is not None:
                heapq.heappush(heap, (r, x, alive[x], alive[y]))
    return [ranks[p] for p in alive if p is not None]


class Encoder(dict):
    """piece -> ids, filled on demand; at most max_cached pieces are kept."""

    def __init__(self, rank_lines: bytes, max_cached: int = 1_000_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        self.classes = class_table()
        self.max_cached = max_cached

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= self.max_cached:
            self.clear()
        ids = merge(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) < 200:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """All ids, the number of ids of each text, the pieces, and the number of pieces of each text."""
        joined = "\n".join(t or "" for t in texts)
        sizes = np.array([len(t or "") for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1  # of each text; a separator stands there, but after the last
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.classes[cp]
        cls[ends[:-1]] = END
        starts = np.flatnonzero(boundaries(cp, cls))
        keep = cls[starts] != END
        stops = np.append(starts[1:], len(cp))[keep]
        starts = starts[keep]
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        found = list(map(self.__getitem__, pieces))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        owner = np.searchsorted(ends, starts, side="left")
        n = len(texts)
        return ids, np.bincount(owner, counts, n).astype(np.int64), pieces, np.bincount(owner, minlength=n)


_ENCODERS: dict[str, Encoder] = {}


def encoder(rank_file: str, rank_lines: bytes | None = None) -> Encoder:
    """The encoder of a vocabulary, one per process; on executors rank_lines holds the file, which lies with the driver."""
    if rank_file not in _ENCODERS:
        if rank_lines is None:
            with open(rank_file, "rb") as f:
                rank_lines = f.read()
        _ENCODERS[rank_file] = Encoder(rank_lines)
    return _ENCODERS[rank_file]


def shipped(spark, rank_file: str):
    """The vocabulary file as a broadcast: below 2 MB for each public vocabulary, whatever the corpus."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def tokenizer_dir() -> str:
    """Where the public vocabularies lie: SPANLOOM_TOKENIZERS, else the installed package, else /opt/tokenizers."""
    if own := os.environ.get("SPANLOOM_TOKENIZERS"):
        return own
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def default_ranks() -> str:
    return os.path.join(tokenizer_dir(), "byte_bpe_50k.tiktoken")


def encode_column(
    df: DataFrame, key: str, text: str, rank_file: str | None = None, offsets: bool = False, batch_chars: int = 2_000_000
) -> DataFrame:
    """(key, ids) for each row of df; with offsets also piece_ends, the code-point end of each pre-token, and
    piece_ids, how many ids each of them gave, from which decode_range() finds the text of any id range."""
    rank_file = rank_file or default_ranks()
    source = df.select(key, text)
    kind = dict(source.dtypes)[key]
    schema = f"`{key}` {kind}, ids array<int>" + (", piece_ends array<int>, piece_ids array<int>" if offsets else "")

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.astype(np.int32)))

    ranks = shipped(df.sparkSession, rank_file)

    def run(batches):
        enc = encoder(rank_file, ranks.value)
        for batch in batches:
            step = max(1, int(batch.num_rows * batch_chars / max(batch_chars, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, counts, pieces, per = enc.encode(part.column(1).to_pylist())
                columns = [part.column(0), lists(ids, counts)]
                if offsets:
                    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
                    first = np.repeat(np.cumsum(per) - per, per)
                    total = np.cumsum(size)
                    columns.append(lists(total - np.append(0, total)[first], per))
                    columns.append(lists(np.fromiter((len(enc[p]) for p in pieces), np.int64, len(pieces)), per))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "piece_ends", "piece_ids"][: len(columns)])

    return source.mapInArrow(run, schema)


def bytes_of(rank_file: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in one array, and where those of each id begin (and the last end)."""
    enc = encoder(rank_file)
    if not hasattr(enc, "bytes_of"):
        known = {i: b for b, i in enc.ranks.items()}
        each = [known.get(i, b"") for i in range(max(known) + 1)]
        enc.bytes_of = np.frombuffer(b"".join(each), np.uint8), np.cumsum([0, *map(len, each)])
    return enc.bytes_of


def id_bytes(ids: np.ndarray, rank_file: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a run of ids, and where those of each begin (and the last end)."""
    blob, starts = bytes_of(rank_file)
    size = starts[ids + 1] - starts[ids]
    at = np.append(0, np.cumsum(size))
    return blob[np.repeat(starts[ids] - at[:-1], size) + np.arange(at[-1])], at


def decode(ids: list[int], rank_file: str) -> str:
    """The text of a whole text's ids; for a part of them, which may cut a character, there is decode_range()."""
    return id_bytes(np.array(ids, np.int64), rank_file)[0].tobytes().decode("utf-8", "replace")


def decode_range(
    ids: list[int], piece_ends: np.ndarray, piece_ids: np.ndarray, first: int, last: int, rank_file: str
) -> tuple[int, int, str]:
    """Where ids[first:last] stand in the text, as code points, and the text there: every character of which they hold
    a byte, so that one that the range cuts is given whole. Only the pre-tokens that the range touches are decoded."""
    if not 0 <= first <= last <= len(ids):
        raise ValueError(f"no range of {len(ids)} ids: {first} to {last}")
    if first == last == len(ids):
        end = int(piece_ends[-1]) if len(piece_ends) else 0
        return end, end, ""
    id_ends = np.cumsum(piece_ids)
    a = int(np.searchsorted(id_ends, first, side="right"))
    b = int(np.searchsorted(id_ends, max(last, first + 1), side="left"))
    low = int(id_ends[a - 1]) if a else 0
    own = np.array(ids[low : int(id_ends[b])], np.int64)
    starts = np.append(0, piece_ends)[a : b + 1]
    start, end, text = decode_ranges(own, starts, id_ends[a : b + 1] - low, np.array([first - low]), np.array([last - low]), rank_file)
    return int(start[0]), int(end[0]), text[0].decode("utf-8")


def decode_ranges(
    ids: np.ndarray, piece_starts: np.ndarray, id_ends: np.ndarray, first: np.ndarray, last: np.ndarray, rank_file: str
) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """decode_range() of many ranges over the ids of one or more texts. piece_starts: the code point at which each
    pre-token begins in its own text; id_ends: where its ids end among all of ids. No range begins at the end of ids."""
    data, at = id_bytes(ids, rank_file)
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead)  # of each byte, its character, counted from 1
    begins = np.append(np.flatnonzero(lead), len(data))
    piece = np.searchsorted(id_ends, first, side="right")
    origin = char[at[np.where(piece > 0, id_ends[piece - 1], 0)]]
    a, b = char[at[first]], char[at[np.maximum(last, 1)] - 1]
    cut = ~lead[at[first]] & (first == last)  # an empty range inside a character stands after it
    a = a + cut
    b = np.where(first == last, a - 1, b)
    start = piece_starts[piece] + a - origin
    raw = data.tobytes()
    return start, start + b - a + 1, [raw[x:y] for x, y in zip(begins[a - 1].tolist(), begins[b].tolist())]


def decode_windows(df: DataFrame, key: str, size: int, rank_file: str | None = None) -> DataFrame:
    """The rows of encode_column(offsets=True) with windows, the consecutive runs of size ids (the last may be shorter),
    each with its id range, its code-point range and its text. A character cut between two windows stands in both."""
    rank_file = rank_file or default_ranks()
    names = [key, "ids", "piece_ends", "piece_ids"]
    window = "struct<first: int, last: int, location_start: int, location_end: int, text: string>"
    schema = f"`{key}` {dict(df.dtypes)[key]}, ids array<int>, piece_ends array<int>, piece_ids array<int>, windows array<{window}>"

    def windows(part: pa.RecordBatch) -> pa.ListArray:
        ids, ends, counts = (part.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
        n_ids, n_pieces = (part.column(k).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
        starts = np.append(0, ends[:-1])[: len(ends)]
        starts[(np.cumsum(n_pieces) - n_pieces)[n_pieces > 0]] = 0
        many = -(-n_ids // size)
        own = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * size
        stop = np.minimum(own + size, np.repeat(n_ids, many))
        base = np.repeat(np.cumsum(n_ids) - n_ids, many)
        if len(own):
            a, b, text = decode_ranges(ids, starts, np.cumsum(counts), base + own, base + stop, rank_file)
        else:
            a, b, text = own, own, []
        columns = [*(pa.array(x.astype(np.int32)) for x in (own, stop, a, b)), pa.array(text, pa.binary()).cast(pa.string())]
        rows = pa.StructArray.from_arrays(columns, names=["first", "last", "location_start", "location_end", "text"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), rows)

    ranks = shipped(df.sparkSession, rank_file)

    def run(batches):
        encoder(rank_file, ranks.value)
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(SLICE_BYTES, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([*part.columns, windows(part)], names=[*names, "windows"])

    return df.select(*names).mapInArrow(run, schema)
