"""Passages that were decoded with the wrong character encoding: a Hidden Markov model over the non-ASCII characters.

States: one for clean text and one for each pair (true encoding, encoding it was read with). A state emits a character
given the one before it (or the kind of an ASCII character before it). The emissions of a pair are those of clean text
sent through the pair: a bounded sample of lines that are clean beyond doubt, plus the letter inventories of the
scripts, is encoded with the one encoding, decoded with the other and counted. Unseen characters of clean text fall back
to classes of characters, so that correct text in a script that the sample doesn't hold stays clean.

ASCII characters look alike in every state (no encoding of the model changes them), hence they only advance the gaps;
a file without other characters can't have left the clean state, because each pair turns each non-ASCII character into
at least one non-ASCII character. Viterbi runs over all files of a batch at once, one step per position.

Each labelled stretch gets its state's inverse transform; where bytes were lost (U+FFFD) or the inverse isn't valid, the
text stays as it is and counts as not restorable.

Defined results: null and empty contents are no case; a file delivered twice gives one row; a text of any length is
labelled whole; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows

#: Lines of the training sample; the number bounds what is sent to the driver and the model's tables.
TRAIN_LINES = 20_000
#: Log-probabilities of leaving clean text, of returning to it, and of characters that a state doesn't emit.
LEAVE, RETURN, STAY = -14.0, -3.0, -0.05
NEVER, RARE = -25.0, -13.0

#: (true encoding, encodings it is read with)
PAIRS = {
    "utf-8": ["latin-1", "cp1252", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "gb18030", "cp932", "big5", "euc-kr"],
    "utf-8 twice": ["latin-1", "cp1252"],
    "cp1252": ["utf-8", "cp437", "cp850", "mac-roman", "cp1250", "cp1251", "koi8-r", "cp866"],
    "gb18030": ["latin-1", "cp1252", "utf-8", "cp1251", "big5", "cp932", "euc-kr", "mac-roman"],
    "cp932": ["latin-1", "cp1252", "utf-8", "gb18030", "mac-roman"],
    "euc-jp": ["latin-1", "utf-8", "cp932", "gb18030"],
    "cp1251": ["latin-1", "utf-8", "koi8-r", "cp866", "mac-roman"],
    "koi8-r": ["latin-1", "utf-8", "cp1251", "cp866"],
    "cp866": ["cp1252", "utf-8", "cp1251", "koi8-r"],
    "cp850": ["cp1252", "utf-8", "cp1251"],
    "mac-roman": ["cp1252", "utf-8"],
}
MULTI = {"utf-8", "gb18030", "cp932", "big5", "euc-kr", "euc-jp"}
STATES = [(true, read) for true, reads in PAIRS.items() for read in reads]

#: Letters of European alphabets beyond ASCII, and marks of clean text.
LOWER = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœąćęłńóśźżčďěňřšťůžőűğışđ"
UPPER = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒĄĆĘŁŃŚŹŻČĎĚŇŘŠŤŮŽŐŰĞİŞĐ"
MARKS = "©®«»¿¡“”„‘’‚–—…•§°€£→←✓−×·"


@lru_cache(maxsize=None)
def byte_table(read: str) -> list[str]:
    """What a single-byte encoding makes of each byte; undefined bytes become control characters, as readers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def garble(text: str, true: str, read: str) -> str | None:
    """What becomes of a text in the one encoding when it is read with the other."""
    if true == "utf-8 twice":
        once = garble(text, "utf-8", read)
        return garble(once, "utf-8", read)
    try:
        data = text.encode(true)
    except UnicodeEncodeError:
        return None
    if read in MULTI:
        return data.decode(read, "replace")
    table = byte_table(read)
    return "".join(table[b] for b in data)


@lru_cache(maxsize=None)
def char_table(read: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(byte_table(read))))}


def restore(text: str, true: str, read: str) -> str | None:
    """The inverse of garble(), or None where something was lost."""
    if "�" in text:
        return None
    if true == "utf-8 twice":
        once = restore(text, "utf-8", read)
        return None if once is None else restore(once, "utf-8", read)
    try:
        if read in MULTI:
            data = text.encode(read)
        else:
            table = char_table(read)
            data = bytes(table[c] for c in text)
        return data.decode(true)
    except (UnicodeError, KeyError):
        return None


# Classes of characters, for clean text that the sample doesn't hold.
CLASSES = ["low", "up", "digit", "blank", "punct", "llow", "lup", "greek", "cyrlow", "cyrup", "han", "rare", "kana", "cjkp", "half", "letter", "mark", "sym", "c1", "box", "lost", "pua", "zero"]
CLASS = {c: i for i, c in enumerate(CLASSES)}
#: How many characters a class has, roughly: a class emits each of them alike.
SIZE = {"llow": 60, "lup": 60, "greek": 60, "cyrlow": 40, "cyrup": 40, "han": 4000, "rare": 20000, "kana": 160, "cjkp": 80, "half": 60, "letter": 300, "mark": 40, "sym": 300, "c1": 32, "box": 128, "lost": 1, "pua": 6400, "zero": 20}


@lru_cache(maxsize=None)
def level_one() -> frozenset[str]:
    """The common ideographs: first levels of the national character sets of China and Japan."""
    chinese = {bytes([a, b]).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)}
    japanese = {bytes([a + 0xA0, b + 0xA0]).decode("euc-jp", "ignore") for a in range(16, 48) for b in range(1, 95)}
    return frozenset(chinese | japanese) - {""}


@lru_cache(maxsize=None)
def class_of(c: str) -> int:
    o = ord(c)
    if o < 128:
        return CLASS["low" if c.islower() else "up" if c.isupper() else "digit" if c.isdigit() else "blank" if c in " \t\n\r" else "punct"]
    if o < 0xA0:
        return CLASS["c1"]
    if c in MARKS:
        return CLASS["mark"]
    if o == 0xFFFD:
        return CLASS["lost"]
    if 0x4E00 <= o < 0xA000:
        return CLASS["han" if c in level_one() else "rare"]
    if 0x3400 <= o < 0x4E00 or o >= 0x20000:
        return CLASS["rare"] if unicodedata.category(c) == "Lo" else CLASS["sym"]
    if 0x3040 <= o < 0x3100:
        return CLASS["kana"]
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        return CLASS["cjkp"]
    if 0xFF61 <= o < 0xFFEF:
        return CLASS["half"]
    if 0x400 <= o < 0x530:
        return CLASS["cyrlow" if c.islower() else "cyrup"]
    if 0x370 <= o < 0x400:
        return CLASS["greek"]
    if 0x2500 <= o < 0x25A0:
        return CLASS["box"]
    if 0xE000 <= o < 0xF900:
        return CLASS["pua"]
    if c in "​‌‍⁠﻿️‎‏":
        return CLASS["zero"]
    kind = unicodedata.category(c)
    if kind[0] == "L" and (o < 0x250 or 0x1E00 <= o < 0x1F00):
        return CLASS["llow" if c.islower() else "lup"] if c not in "ªºƒˆ" else CLASS["sym"]
    return CLASS["letter"] if kind[0] in "LM" else CLASS["sym"]


def class_prior() -> np.ndarray:
    """log P(class | class before) in clean text, by hand: scripts keep to themselves, case follows words."""
    n = len(CLASSES)
    p = np.full((n, n), 1e-7)

    def put(before: str, after: str, value: float) -> None:
        for b in before.split():
            for a in after.split():
                p[CLASS[b], CLASS[a]] = value

    ascii_ = "low up digit blank punct"
    put(ascii_, "mark", 3e-3)
    put(ascii_, "zero sym", 3e-5)
    put("low up", "sym", 1e-6)
    put("low", "llow", 0.03)
    put("up", "llow lup", 0.02)
    put("blank punct", "llow", 5e-3)
    put("blank punct", "lup", 5e-3)
    put("blank punct low up digit", "han kana", 5e-3)
    put("blank punct low up digit", "rare", 1e-4)
    put("blank punct", "cyrlow cyrup", 5e-3)
    put("blank punct", "greek letter", 1e-3)
    put("low up digit blank punct", "cjkp", 2e-3)
    put("blank punct", "lost box", 1e-5)
    put("blank punct", "half pua", 1e-6)
    put("llow lup", "llow", 0.02)
    put("lup", "lup", 0.02)
    put("llow lup", "mark", 3e-3)
    put("cyrlow cyrup", "cyrlow", 0.8)
    put("cyrup", "cyrup", 0.05)
    put("cyrlow", "cyrup", 1e-5)
    put("cyrlow cyrup greek letter", "mark", 3e-3)
    put("greek", "greek", 0.8)
    put("letter", "letter", 0.9)
    put("han kana cjkp", "han", 0.5)
    put("han kana cjkp", "kana cjkp", 0.3)
    put("han kana cjkp rare", "rare", 0.01)
    put("rare", "han kana cjkp", 0.3)
    put("han kana", "mark", 3e-3)
    put("mark", "mark llow lup cyrlow cyrup greek letter han kana cjkp", 0.02)
    put("sym box pua", "sym box", 0.1)
    put("sym", "zero mark", 0.05)
    put("zero", "sym letter cyrup cyrlow lup llow han kana zero mark", 0.05)
    put("box", "box", 0.8)
    put("pua", "pua", 0.5)
    put("half", "half", 0.5)
    put("lost", "lost", 1e-4)
    return np.log(p)


def seeds(line: str) -> bool:
    """Whether a line is clean beyond doubt: expected letters only, at places where such letters stand."""
    if line.isascii() or len(line) > 400:
        return False
    before = " "
    rare = ideographs = 0
    for c in line:
        k = CLASSES[class_of(c)]
        if ord(c) >= 128:
            if k in ("c1", "lost", "box", "sym", "pua", "half", "greek", "letter"):
                return False
            if k in ("llow", "lup") and c not in LOWER + UPPER:
                return False
            if k == "lup" and (before.islower() or not before.isascii() and before.isalpha()):
                return False
            if k == "cyrup" and before.islower():
                return False
            if k.startswith("cyr") and (not "А" <= c <= "я" and c not in "ёЁ" or before.isascii() and before.isalpha()):
                return False
            if k == "llow" and not before.isascii() and before not in "çéèêãíóáúñàâôûüöäîïœæëâùß’":
                return False
            ideographs += k in ("han", "rare")
            rare += k == "rare"
        before = c
    return rare * 20 <= ideographs


def inventory() -> list[tuple[str, float]]:
    """(text, weight): the letters of the scripts in plain surroundings, for emissions that the sample lacks."""
    out = [(f"a{c}b {c}a", 0.2) for c in LOWER] + [(f" {c}a", 0.2) for c in UPPER]
    russian = [chr(c) for c in range(0x430, 0x450)] + ["ё"]
    out += [(f"а{c}а{c}о {c}и", 0.3) for c in russian] + [(f" {c.upper()}о", 0.3) for c in russian]
    common = sorted(level_one())
    out += [("".join(common[i : i + 40]), 0.05) for i in range(0, len(common), 40)]
    kana = [chr(c) for c in range(0x3041, 0x3094)] + [chr(c) for c in range(0x30A1, 0x30F7)] + ["ー"]
    out += [(f"の{c}{c}を", 0.2) for c in kana]
    out += [("。、，．：；（）「」", 1.0)]
    return out


class Model:
    """Emission tables: codes of (character before, character) and of single characters, one column per state."""

    def __init__(self, lines: list[str]):
        weights: dict[float, list[str]] = defaultdict(list)
        weights[1.0] += lines
        for text, weight in inventory():
            weights[weight].append(text)
        texts = {w: "\n".join(x) for w, x in weights.items()}
        self.names = [("clean", "clean"), *STATES]
        n = len(self.names)
        counted = [emissions(texts, true, read) for true, read in self.names]
        self.pairs = np.unique(np.concatenate([c for c, _ in counted]))
        self.singles = np.unique(self.pairs & 0x1FFFFF)
        rows = np.searchsorted(self.singles, self.pairs & 0x1FFFFF)
        self.single = np.full((len(self.singles) + 1, n), NEVER, np.float32)
        self.pair = np.full((len(self.pairs), n), NEVER, np.float32)
        before = np.unique(self.pairs >> 21, return_inverse=True)[1]
        for s, (codes, weight) in enumerate(counted):
            w = np.zeros(len(self.pairs))
            w[np.searchsorted(self.pairs, codes)] = weight
            alone = np.bincount(rows, w, len(self.singles))
            with np.errstate(divide="ignore"):
                single = np.where(alone > 0, np.maximum(np.log(alone / max(alone.sum(), 1e-9)) - 1.5, RARE), NEVER)
                mixed = 0.9 * w / (np.bincount(before, w)[before] + 2.0) + 0.1 * np.exp(single[rows])
                self.pair[:, s] = np.where(w > 0, np.log(mixed), single[rows] if s else NEVER)  # clean text has its classes
            self.single[:-1, s] = single
        self.prior = class_prior()
        self.sizes = np.log(np.array([SIZE.get(c, 1) for c in CLASSES]))

    def sequence(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the non-ASCII characters, and their emissions (position x state)."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.flatnonzero(cp >= 128)
        cur = cp[at]
        prev = np.where(at > 0, cp[np.maximum(at - 1, 0)], 10)
        kinds = CLASS_CACHE(np.unique(np.concatenate([cur, prev])))
        k_cur, k_prev = kinds(cur), kinds(prev)
        code = np.where(prev >= 128, prev, 1 + k_prev) << 21 | cur
        i = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        seen = self.pairs[i] == code
        j = np.searchsorted(self.singles, cur)
        j = np.where((j < len(self.singles)) & (self.singles[np.minimum(j, len(self.singles) - 1)] == cur), j, len(self.singles))
        out = np.where(seen[:, None], self.pair[i], self.single[j] - 1.0)
        by_class = (self.prior[k_prev, k_cur] - self.sizes[k_cur]).astype(np.float32)
        out[:, 0] = np.where(seen, np.maximum(self.pair[i, 0], by_class), by_class)
        return at, out

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, states) of the non-ASCII characters of each text, by the Viterbi algorithm."""
        made = [self.sequence(t) for t in texts]
        order = np.argsort([-len(a) for a, _ in made], kind="stable")
        result: list = [None] * len(texts)
        for at in range(0, len(order), 64):
            block = order[at : at + 64]
            size = max(len(made[i][0]) for i in block)
            if not size:
                for i in block:
                    result[i] = (made[i][0], np.zeros(0, np.int64))
                continue
            lengths = np.array([len(made[i][0]) for i in block])
            n = len(self.names)
            came = np.zeros((size, len(block), n), bool)  # whether the best way left or entered clean text here
            who = np.zeros((size, len(block)), np.int16)
            score = np.full((len(block), n), -np.inf, np.float32)
            score[:, 0] = 0.0
            final = np.zeros((len(block), n), np.float32)
            for t in range(size):
                live = int(np.searchsorted(-lengths, -t, side="left"))  # blocks are sorted by length
                e = np.stack([made[i][1][t] for i in block[:live]])
                old = score[:live]
                best = old[:, 1:].argmax(1) + 1
                back = old[np.arange(live), best] + RETURN
                enter = old[:, :1] + LEAVE
                stay = old + STAY
                stay[:, 0] = old[:, 0]
                new = np.maximum(stay, enter)
                came[t, :live] = enter > stay
                came[t, :live, 0] = back > old[:, 0]
                who[t, :live] = best
                new[:, 0] = np.maximum(old[:, 0], back)
                score[:live] = new + e
                done = np.flatnonzero(lengths[:live] == t + 1)
                final[done] = score[done]
            for k, i in enumerate(block):
                states = np.zeros(lengths[k], np.int64)
                if lengths[k]:
                    ending = final[k].copy()
                    ending[1:] += RETURN
                    s = int(ending.argmax())
                    for t in range(lengths[k] - 1, -1, -1):
                        states[t] = s
                        if came[t, k, s]:
                            s = int(who[t, k]) if s == 0 else 0
                result[i] = (made[i][0], self.changed(texts[i], made[i][0], states))
        return result

    def changed(self, text: str, at: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The states without those pairs whose inverse would leave this text as it is."""
        used = set(states.tolist()) - {0}
        for s in used:
            parts = [text[a:b] for a, b, q in stretches(text, at, states) if q == s]
            if all(restore(x, *self.names[s]) == x for x in parts):
                states = np.where(states == s, 0, states)
        return states


def emissions(texts: dict[float, str], true: str, read: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (what stands before, character) that a state emits over the weighted texts, and their weights."""
    all_codes, all_weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for weight, text in texts.items():
        cp = np.frombuffer(garble_known(text, true, read).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.flatnonzero(cp >= 128)
        if not len(at):
            continue
        prev = np.where(at > 0, cp[np.maximum(at - 1, 0)], 10)
        codes, count = np.unique(before_code(prev) << 21 | cp[at], return_counts=True)
        all_codes.append(codes)
        all_weights.append(count * weight)
    codes, where = np.unique(np.concatenate(all_codes), return_inverse=True)
    return codes, np.bincount(where, np.concatenate(all_weights), len(codes))


def before_code(prev: np.ndarray) -> np.ndarray:
    """A character beyond ASCII stands for itself, an ASCII character for its class."""
    return np.where(prev >= 128, prev, 1 + CLASS_CACHE(np.unique(prev))(prev))


class CLASS_CACHE:
    """Classes of many code points at once."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.kind = np.array([class_of(chr(c)) for c in known.tolist()], np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return self.kind[np.searchsorted(self.known, values)]


def garble_known(text: str, true: str, read: str) -> str:
    """garble() without the characters that the encoding doesn't know; clean text stays as it is."""
    if true == "clean":
        return text
    if not true.startswith("utf-8"):
        text = text.encode(true, "ignore").decode(true)
    return garble(text, true, read) or ""


def stretches(text: str, at: np.ndarray, states: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, state) of the runs of one pair, a run per line; ASCII next to a run belongs to it."""
    out: list[tuple[int, int, int]] = []
    open_ = None
    for p, s in zip(at.tolist(), states.tolist()):
        if open_ and (s != open_[2] or "\n" in text[open_[1] : p]):
            out.append(open_)
            open_ = None
        if s:
            open_ = (open_[0] if open_ else p, p + 1, s)
    if open_:
        out.append(open_)
    return out


def repaired(text: str, at: np.ndarray, states: np.ndarray, names: list) -> tuple[str, bool]:
    """The text with every stretch restored, and whether nothing was lost."""
    parts, last, whole = [], 0, True
    for a, b, s in stretches(text, at, states):
        true, read = names[s]
        # in some encodings the second byte of a character looks like ASCII
        candidates = (text[a : b + 1], text[a:b]) if b < len(text) and text[b] != "\n" and true in ("cp932", "gb18030") else (text[a:b],)
        for piece in candidates:
            if (good := restore(piece, true, read)) is not None:
                parts += [text[last:a], good]
                last = a + len(piece)
                break
        else:
            whole = False
    return "".join(parts) + text[last:], whole


def training_lines(files: DataFrame, content: str, lines: int = TRAIN_LINES) -> list[str]:
    """A bounded sample of lines that are clean beyond doubt, the same for the same rows in any order."""

    def clean(columns):
        for text in columns[content]:
            if text and not text.isascii():
                yield from ((x,) for x in {y.strip() for y in text.split("\n")} if seeds(x))

    found = map_rows(files.select(content), clean, "line string").distinct()
    return [r[0] for r in found.orderBy(F.xxhash64("line"), "line").limit(lines).collect()]


def mend_files(files: DataFrame, key: str = "fileId", content: str = "content", model: Model | None = None) -> DataFrame:
    """(key, pairs, restorable, content) of each garbled file: the encoding pairs, whether nothing was lost, and the
    content with every restorable stretch restored."""
    shared = files.sparkSession.sparkContext.broadcast(model or Model(training_lines(files, content)))
    kind = dict(files.dtypes)[key]
    schema = f"`{key}` {kind}, pairs array<string>, restorable boolean, content string"
    found = map_rows(files.select(key, content), lambda columns: mended(shared.value, columns[key], columns[content]), schema)
    return found.dropDuplicates([key])


def mended(model: Model, keys: list, texts: list[str | None]):
    """Rows of mend_files() for a slice of a batch."""
    own = [(k, t) for k, t in zip(keys, texts) if t and not t.isascii()]
    for (k, t), (at, states) in zip(own, model.label([t for _, t in own])):
        if states.any():
            fixed, whole = repaired(t, at, states, model.names)
            yield k, sorted({" read as ".join(model.names[s]) for s in set(states.tolist()) - {0}}), whole, fixed


#: Stand-ins of the script in which a text was written, where its bytes are lost.
FILLER = {"gb18030": "的", "cp932": "の", "euc-jp": "の", "cp1251": "о", "koi8-r": "о", "cp866": "о"}


def as_written(text: str, at: np.ndarray, states: np.ndarray, names: list) -> str:
    """repaired(), but stretches that can't be restored are inverted as far as possible: lost characters become fillers
    of the script that was written, so that length, words and language stay near those of the lost text."""
    parts, last = [], 0
    for a, b, s in stretches(text, at, states):
        true, read = names[s]
        piece = text[a:b]
        if (good := restore(piece, true, read)) is None:
            if true == "utf-8 twice":
                good = piece
            elif read == "utf-8":
                good = filled(piece, true)
            else:
                table = char_table(read) if read not in MULTI else {}
                data = piece.encode(read, "ignore") if read in MULTI else bytes(table[c] for c in piece if c in table)
                good = data.decode(true, "ignore")
        parts += [text[last:a], good]
        last = b
    return "".join(parts) + text[last:]


def filled(piece: str, true: str) -> str:
    """A stretch read as UTF-8 with replacement: each run of lost bytes becomes as many fillers as it had characters."""
    filler = FILLER.get(true)
    if filler is None:
        return piece
    wide = 2 if true in ("gb18030", "cp932", "euc-jp") else 1
    out, run = [], 0
    for c in piece + "\0":
        if ord(c) >= 128:
            run += 1 if c == "�" else len(c.encode("utf-8", "surrogatepass"))
        else:
            out += [filler * max(run // wide, run > 0), c]
            run = 0
    return "".join(out)[:-1]
