"""Text decoded with a wrong character encoding: finding it and bringing the original back.

Characters are mapped back to the bytes of the encoding that was wrongly assumed. A byte-structure automaton finds the maximal spans of those
bytes that are well formed in the encoding that was meant, and only these spans are decoded. How plausible a reading is is told by
counts of neighbouring characters in the whole corpus, kept in a hashed table of fixed size.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyq.llm.lookalike import rewriter

#: Cells of each of the two hashed tables of character pairs, whatever the corpus: what is collected and broadcast is bounded by it. The
#: lesser of a pair's two cells is its count, so chance meetings hardly show.
CELLS = 1 << 20
_HASHES = ((2654435761, 40503), (2246822519, 3266489917))
_SHIFT = 12

#: Encodings wrongly assumed, one byte per character. "latin" takes what windows-1252 and ISO 8859-1 make of a byte.
ASSUMED = ("latin", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "iso8859_2")
#: Encodings meant, several bytes per character, and the structure of a character that is not ASCII.
WIDE = {
    "cp932": rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf]",
    "euc_kr": rb"[\xa1-\xfe][\xa1-\xfe]",
    "gb18030": rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][\x30-\x39][\x81-\xfe][\x30-\x39]",
    "big5": rb"[\xa1-\xf9][\x40-\x7e\xa1-\xfe]",
    "euc_jp": rb"[\xa1-\xfe][\xa1-\xfe]|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe][\xa1-\xfe]",
}
#: Encodings meant, one byte per character.
NARROW = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp857", "cp866", "mac_roman", "koi8_r", "iso8859_2", "cp1256", "cp737", "iso8859_5", "cp874")
#: Encodings wrongly assumed, several bytes per character.
ASSUMED_WIDE = ("gb18030", "cp932", "euc_kr", "big5")

_UTF8 = rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
_utf8_bytes = re.compile(_UTF8)
_utf8_cut = re.compile(rb"[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2}")
#: Signs that an original is lost: replacement characters, also when these were decoded wrongly in turn, and control characters.
LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]|锟斤|斤拷|ï¿½|пїЅ|∩┐╜|´┐¢|ÔøΩ|я┐╜|嚙踝|占쏙")
#: A run of characters that a codepage can show, without spaces and not all ASCII.
_SHOWN = "\x80-\u052f\u2010-\u2122\u2190-\u25ff\ufb01\ufb02"
_SHOWN_ASCII = "\x00-\x08\x0b-\x1f!-\x7f"
_word = re.compile(f"(?<![{_SHOWN_ASCII}{_SHOWN}])[{_SHOWN_ASCII}]*+[{_SHOWN}][{_SHOWN_ASCII}{_SHOWN}]*")
_high = re.compile(r"[^\x00-\x7f]")
_ASCII = "".join(map(chr, range(128)))
#: Characters that a codepage can show.
_narrow_high = re.compile("[\x80-\u052f\u2010-\u2122\u2190-\u25ff\u02c6-\u02dd\ufb01\ufb02]")
_wide_high = re.compile("[\u3000-\u9fff\uac00-\ud7a3\ufa00-\uffef]")
#: Signs that texts use by themselves, away from letters.
_signs_alone = re.compile("[\x00-@\\[-`{-\x7f€£¥×±°§©®™½¼¾²³¹№…–—“”‘’„«»•·÷→←↑↓ªº]*")
#: Nats by which a reading must beat the text as it stands: at all, and for each character that it changes.
MARGIN, MARGIN_EACH, MARGIN_NARROW = 2.0, 0.5, 2.5
#: Characters of texts whose tokens are looked at together, and the new tokens from which on that pays.
SIFTED_CHARS, SIFTED_LEAST = 1 << 19, 32
#: Nats by which sums of many tokens may differ from those of one token, a wide margin over what rounding makes.
SLACK = 0.01
#: Share of the corpus that the common pairs hold, which a sound reading has on average, and the frequent ones, of which no garbled token is made throughout.
COMMON_MASS, FREQUENT_MASS = 0.995, 0.97


def _bytes_of(name: str) -> dict[str, int]:
    """Character to byte. Bytes without a character come out of most decoders as the control characters of the same number."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode("cp1252" if name == "latin" else name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    if name == "latin":
        out |= {chr(b): b for b in range(128, 256) if chr(b) not in out}
    return out


def _pattern(table: dict[str, int]) -> re.Pattern:
    """The UTF-8 automaton over the characters that stand for its bytes."""
    at: dict[int, str] = {}
    for c, b in table.items():
        at[b] = at.get(b, "") + c

    def chars(a: int, z: int) -> str:
        return "[" + re.escape("".join(at.get(b, "") for b in range(a, z + 1))) + "]"

    c = chars(0x80, 0xBF)
    two, three, four = chars(0xC2, 0xDF), chars(0xE0, 0xEF), chars(0xF0, 0xF4)
    return re.compile(f"(?:{two}{c}|{three}{c}{c}|{four}{c}{c}{c})+")


def pair_counts(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring characters in the cells of both tables, line ends standing for both ends of a text."""
    return np.concatenate([np.bincount(c, minlength=CELLS) for c in _cells(_codes("\n" + "\n".join(texts) + "\n"))])


def _cells(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Cells of neighbouring characters in both tables."""
    a, b = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    return ((((a * p + b * q) & 0xFFFFFFFF) >> _SHIFT).astype(np.int64) for p, q in _HASHES)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Pairs(dict):
    """Log likelihood of a pair of characters, looked up in the two tables once."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Those of all neighbours in an array of characters."""
        first, second = (t[c] for t, c in zip(self.tables, _cells(codes), strict=True))
        return np.minimum(first, second).astype(np.float64)

    def __missing__(self, pair: str) -> float:
        if len(self) > 2_000_000:
            self.clear()
        a, b = map(ord, pair)
        value = min(float(t[((a * p + b * q) & 0xFFFFFFFF) >> _SHIFT]) for t, (p, q) in zip(self.tables, _HASHES, strict=True))
        self[pair] = value
        return value


class Codes(dict):
    """Bytes of a character in an East Asian encoding; a byte that is in no UTF-8 where it has none of one or two bytes."""

    def __init__(self, name: str):
        self.name = name

    def __missing__(self, c: str) -> bytes:
        try:
            b = c.encode(self.name)
        except UnicodeEncodeError:
            b = b"\xff"
        # no UTF-8 is read as a four-byte character of GB18030: its third byte would stand alone
        self[c] = b = b"\xff" if self.name == "gb18030" and len(b) == 4 else b
        return b


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """Start, end and, with a neighbour on both sides, the characters of each token that is not ASCII; line ends stand around the text."""
    padded = f"\n{text}\n"
    return [(a, z, padded[a - 1 : z + 1]) for m in _word.finditer(padded) for a, z in [m.span()]]


def _decoded(data: bytes, a: int, z: int, meant: str, one: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """Start, end and reading of what a well-formed span holds."""
    while a < z:
        try:
            a, k, new = z, a, data[a:z].decode(meant)
            end = z
        except UnicodeDecodeError as e:
            # well formed but no character: the span goes on after it
            end, k = a + e.start, a
            new, a = data[k:end].decode(meant), one.match(data, end).end()
        if not new.isascii():
            yield k, end, new


class Sieve:
    """Tells of many tokens at once in which pairs of encodings they may read better, by sums over arrays.

    It errs on the side of keeping only: a neighbour that no codepage shows counts as if it made the most common pair, and what is kept is still read
    by itself. So the results are those without it.
    """

    def __init__(self, pairs: Pairs, assumed: dict[str, dict[str, int]], wide: dict[str, re.Pattern], common: float, frequent: float, unseen: float):
        self.of, self.common, self.frequent, self.unseen, self.wide = pairs.of, common, frequent, unseen, wide
        meant = {n: [bytes([b]).decode(n, "ignore") for b in range(256)] for n in NARROW}
        chars = sorted({"\n", " ", *(c for t in assumed.values() for c in t), *(c for cs in meant.values() for c in cs if c)})
        at = {c: k for k, c in enumerate(chars)}
        #: Numbers of all characters that codepages show, then that of any other, then that of a byte without a character.
        self.other, bad, self.size = len(chars), len(chars) + 1, len(chars) + 2
        self.numbers = np.full(1 << 16, self.other, dtype=np.int32)
        self.numbers[[ord(c) for c in chars]] = range(len(chars))
        codes = np.array([ord(c) for c in chars], dtype=np.uint32)
        each = np.full((self.size, self.size), min(float(t.max()) for t in pairs.tables))
        each[:-2, :-2] = pairs.of(np.stack([np.repeat(codes, len(codes)), np.tile(codes, len(codes))], axis=1).reshape(-1))[::2].reshape(len(codes), -1)
        each[bad], each[:, bad] = -1e6, -1e6
        self.pairs = each.astype(np.float32).reshape(-1)
        self.bytes: dict[str, np.ndarray] = {}
        #: For each assumed encoding and each meant one of one byte per character: the number of the character that a numbered one is read as.
        self.read: dict[str, dict[str, np.ndarray]] = {}
        for name, table in assumed.items():
            self.bytes[name] = byte = np.full(self.size, -1, dtype=np.int16)
            byte[[at[c] for c in table]] = list(table.values())
            self.read[name] = {n: np.where(byte < 0, bad, np.array([at[c] if c else bad for c in cs])[byte]).astype(np.int32) for n, cs in meant.items()}

    def hopes(self, keys: list[str]) -> list[set[tuple[str, str]]]:
        """For each token, with a neighbour on both sides, all pairs of encodings in which it reads better, and perhaps more."""
        codes = _codes("".join(keys))
        size = np.array([len(k) for k in keys])
        starts = np.cumsum(size) - size
        inner = np.ones(len(codes), dtype=bool)
        inner[starts] = inner[starts + size - 1] = False
        pairs = np.zeros(len(codes))
        pairs[:-1] = self.of(codes)
        pairs[starts + size - 1] = 0.0  # from one token to the next; no pair is above it
        # tokens of frequent pairs only are not tried at all
        todo = np.minimum.reduceat(pairs, starts) < self.frequent
        numbers = self.numbers[np.minimum(codes, 0xFFFF)]
        numbers[codes > 0xFFFF] = self.other
        out: list[set[tuple[str, str]]] = [set() for _ in keys]
        before: list[np.ndarray] = []
        for assumed, byte in self.bytes.items():
            data = byte[numbers]
            data[~inner] = 0
            new = todo.copy()
            for other in before:  # most encodings agree on most bytes
                new &= np.logical_or.reduceat(data != other, starts)
            before.append(data)
            valid = new & (np.minimum.reduceat(data, starts) >= 0)
            for some, found in ((valid, self._narrow(valid, size, numbers, pairs, inner, self.read[assumed])), (new, self._wide(new, size, codes, pairs, inner, data))):
                where = np.flatnonzero(some)
                for meant, hits in found:
                    for k in where[hits].tolist():
                        out[k].add((assumed, meant))
        return out

    def _narrow(self, some: np.ndarray, size: np.ndarray, numbers: np.ndarray, pairs: np.ndarray, inner: np.ndarray, read: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray]]:
        """Encodings of one byte per character, and which of some tokens may have a reading in it."""
        if not some.any():
            return
        part = np.repeat(some, size)
        numbers, inner, size = numbers[part], inner[part], size[some]
        starts = np.cumsum(size) - size
        slack = SLACK + 1e-5 * size
        floor = np.add.reduceat(pairs[part], starts) + MARGIN - slack
        least = np.maximum(floor + MARGIN_NARROW, self.common * (size - 1) - slack)
        outer, last = np.flatnonzero(~inner), starts + size - 1
        for name, to in read.items():
            new = to[numbers]
            new[outer] = numbers[outer]
            cells = new * self.size
            cells[:-1] += new[1:]
            value = self.pairs[cells]
            value[last] = 0.0
            value = np.add.reduceat(value, starts, dtype=np.float64)
            if (hit := value > least).any():
                changed = np.add.reduceat((new != numbers).view(np.uint8), starts, dtype=np.int64)
                yield name, np.flatnonzero(hit & (changed > 0) & (value > floor + MARGIN_NARROW * changed))

    def _wide(self, some: np.ndarray, size: np.ndarray, codes: np.ndarray, pairs: np.ndarray, inner: np.ndarray, data: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Encodings of several bytes per character, and which of some tokens may have a reading in it."""
        high = (codes > 0x7F) & inner
        enough = np.add.reduceat(high.view(np.uint8), np.cumsum(size) - size, dtype=np.int64) > 1
        where = np.flatnonzero(enough[some])
        some = some & enough
        if not len(where):
            return
        part = np.repeat(some, size)
        codes, inner, data, high, size = codes[part], inner[part], data[part], high[part], size[some]
        starts = np.cumsum(size) - size
        token = np.repeat(np.arange(len(size)), size)
        text = codes.tobytes().decode("utf-32-le", "surrogatepass")
        # 255 is in no character of these encodings
        line = np.where(inner & (data >= 0), data, 0xFF).astype(np.uint8).tobytes()
        sums, highs = (np.concatenate([[0], np.cumsum(x)]) for x in (pairs[part], high))
        place = np.arange(len(codes))
        # the high characters around a place, or the neighbours of its token
        previous = np.maximum.accumulate(np.where(high | ~inner, place, -1))
        following = np.minimum.accumulate(np.where(high | ~inner, place, len(codes))[::-1])[::-1]
        for name, (spans, one) in self.wide.items():
            found = np.array([m.span() for m in spans.finditer(line)], dtype=np.int64).reshape(-1, 2)
            found = found[highs[found[:, 1]] - highs[found[:, 0]] > 1]
            pieces = [x for a, z in found.tolist() for x in _decoded(line, a, z, name, one)]
            if not pieces:
                continue
            a, z = np.array([x[0] for x in pieces]), np.array([x[1] for x in pieces])
            length = np.array([len(x[2]) for x in pieces])
            new = _codes("".join([text[i - 1] + x + text[j] for i, j, x in pieces]))
            ends = np.cumsum(length + 2)
            value = np.zeros(len(new))
            value[:-1] = self.of(new)
            value[ends - 1] = 0.0
            value = np.add.reduceat(value, ends - length - 2)
            left, right = previous[a - 1], following[z]
            margin = MARGIN + MARGIN_EACH * length + (inner[left].astype(int) + inner[right]) * self.unseen
            length += a - 1 - left + right - z  # with the ASCII around it
            gain = value - (sums[z] - sums[a - 1])
            whole = value + (sums[a - 1] - sums[left]) + (sums[right] - sums[z])
            slack = SLACK + 1e-9 * len(codes)
            yield name, where[token[a[(highs[z] - highs[a] > 1) & (gain > margin - slack) & (whole > self.common * (length + 1) - slack)]]]


class Repairer:
    """Repairs texts by the pair counts of a corpus. Tokens are remembered, as a corpus repeats them.

    A text that only has look-alike characters in it is not garbled: every reading must also beat the text's usual form.
    """

    def __init__(self, counts: np.ndarray):
        total = max(1.0, float(counts.sum()) / 2)
        first, second = counts[:CELLS], counts[CELLS:]
        self.pairs = Pairs([np.log((x + 0.3) / total) for x in (first, second)])
        self.unseen = -math.log(0.3 / total)
        ordered = np.sort(first[first > 0])[::-1].astype(np.float64)
        # the count from which up pairs hold most of the corpus: a sound reading has such pairs
        mass = np.cumsum(ordered)
        at = lambda share: math.log((ordered[min(len(ordered) - 1, np.searchsorted(mass, share * total))] if len(ordered) else 1.0) / total)
        self.common, self.frequent = at(COMMON_MASS), at(FREQUENT_MASS)
        self.form = rewriter().form
        self.known: dict[str, list[tuple[str, float]]] = {}
        self.texts: dict[str, str] = {}
        self.assumed = [(n, t, _pattern(t)) for n in ASSUMED for t in [_bytes_of(n)]]
        # most texts have no pair at all that could begin such a span in any of the encodings
        lead, cont = ("[" + re.escape("".join(sorted({c for _, t, _ in self.assumed for c, b in t.items() if a <= b <= z}))) + "]" for a, z in ((0xC2, 0xF4), (0x80, 0xBF)))
        self.may_start = re.compile(lead + cont)
        self.codes = {n: Codes(n) for n in ASSUMED_WIDE}
        self.sieve: Sieve | None = None
        #: Pairs of encodings in which the tokens of the texts at hand may read better, with their neighbours.
        self.hopes: dict[str, set[tuple[str, str]]] = {}
        #: Their tokens, and for each text the encodings as which UTF-8 may have been read there.
        self.tokens: dict[str, list[tuple[int, int, str]]] = {}
        self.narrow: dict[str, set[str]] = {}
        self.wider: dict[str, set[str]] = {}
        self.wide = {n: (re.compile(b"(?:" + p + b")(?:" + p + b"|[\x00-\x7f])*"), re.compile(b"(?:" + p + b"|[\x00-\x7f])")) for n, p in WIDE.items()}

    def likely(self, text: str) -> float:
        """Log likelihood of the pairs of neighbouring characters."""
        pairs = self.pairs
        return sum([pairs[text[k : k + 2]] for k in range(len(text) - 1)])

    def beats(self, text: str, floor: float) -> bool:
        """Whether the log likelihood is above a floor. No pair adds to it, so most readings are told by their first pairs."""
        pairs, total = self.pairs, 0.0
        for k in range(len(text) - 1):
            total += pairs[text[k : k + 2]]
            if total <= floor:
                return False
        return True

    def gain(self, left: str, old: str, new: str, right: str, margin: float) -> float:
        """By how much a reading beats the text as it stands and in its usual form; 0 if not by the margin, or if it is no text itself."""
        n = len(left) + len(new) + len(right) - 1
        if n < 1:
            return 0.0  # no neighbours that could tell
        value = self.likely(left + new + right)
        if value < self.common * n:
            return 0.0
        gain = value - self.likely(left + old + right)
        if gain <= margin or LOST.search(new):
            return 0.0
        usual = self.form(old)
        if usual != old:
            m = len(left) + len(usual) + len(right) - 1
            same = self.likely(left + usual + right)
            if m and same / m > value / n - 1.0:
                return 0.0
        return gain

    def repair(self, text: str) -> str:
        """The text with every span restored that reads better in the encoding that was meant."""
        if text.isascii():
            return text
        if (done := self.texts.get(text)) is None:
            done = self._repair(text)
            self._remember(text, done)
        return done

    def _remember(self, text: str, done: str) -> None:
        if len(text) <= 80:
            if len(self.texts) > 100_000:
                self.texts.clear()  # only a memory of results: they are found again
            self.texts[text] = done

    def repair_all(self, texts: list[str]) -> list[str]:
        """What ``repair`` makes of each text; the tokens of many texts are looked at together first."""
        out: list[str] = []
        at = 0
        while at < len(texts):
            begin, n = at, 0
            while at < len(texts) and (n + len(texts[at]) <= SIFTED_CHARS or at == begin):
                n += len(texts[at])
                at += 1
            some = texts[begin:at]
            if n > SIFTED_CHARS:  # a text beyond that is read token by token
                out += map(self.repair, some)
                continue
            done = {t: self.texts.get(t, "") for t in some if not t.isascii()}
            now = {t: {t: None} for t, new in done.items() if not new}
            while now:
                self._sift([next(reversed(seen)) for seen in now.values()])
                for t, seen in list(now.items()):
                    done[t] = new = self._step(next(reversed(seen)))
                    if new in seen:
                        self._remember(t, new)
                        del now[t]
                    else:
                        seen[new] = None
            out += [done.get(t, t) for t in some]
        return out

    def _sift(self, texts: list[str]) -> None:
        """Remember of tokens that they have no reading, or in which encodings to look for it."""
        keys: dict[str, None] = {}
        self.tokens = {text: _tokens(text) for text in texts if _narrow_high.search(text)}
        for found in self.tokens.values():
            for _, _, key in found:
                if key not in self.known:
                    keys[key] = None
        self.hopes = {}
        if len(keys) >= SIFTED_LEAST:
            if self.sieve is None:
                self.sieve = Sieve(self.pairs, {n: t for n, t, _ in self.assumed}, self.wide, self.common, self.frequent, self.unseen)
            self.hopes = dict(zip(keys, self.sieve.hopes(list(keys)), strict=True))
        self.narrow = self._utf8_hopes([t for t in texts if self.may_start.search(t)], self._narrow_pieces)
        self.wider = self._utf8_hopes([t for t in texts if _wide_high.search(t)], self._wide_pieces)

    def _utf8_hopes(self, texts: list[str], found: Callable[[str], Iterator[tuple[str, list[tuple[int, int, str]], np.ndarray | float, list[bool]]]]) -> dict[str, set[str]]:
        """For each text the encodings as which UTF-8 was read there by what its pairs tell, and perhaps more; none if the texts are few.

        ``found`` gives for each encoding the pieces of the joined texts that may be readings, with start and end, the margins, and which are kept whatever the pairs tell.
        """
        if len(texts) < SIFTED_LEAST:
            return {}
        whole = "\n" + "\n".join(texts) + "\n"
        codes = _codes(whole)
        size = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(size)  # of each text, its line end with it
        sums = np.concatenate([[0.0], np.cumsum(self.pairs.of(codes))])
        slack = SLACK + 1e-9 * len(codes)
        out: dict[str, set[str]] = {t: set() for t in texts}
        for name, pieces, margin, sure in found(whole):
            a, z = np.array([x[0] for x in pieces]), np.array([x[1] for x in pieces])
            n = np.array([len(x[2]) for x in pieces]) + 1
            new = _codes("".join([whole[i - 1] + x + whole[j] for i, j, x in pieces]))
            last = np.cumsum(n + 1) - 1
            value = np.zeros(len(new))
            value[:-1] = self.pairs.of(new)
            value[last] = 0.0
            value = np.add.reduceat(value, last - n)
            hit = (value > self.common * n - slack) & (value - (sums[z] - sums[a - 1]) > margin - slack) | np.array(sure)
            for k in np.unique(np.searchsorted(ends, a[hit] - 1, "right")).tolist():
                out[texts[k]].add(name)
        return out

    def _narrow_pieces(self, whole: str) -> Iterator[tuple[str, list[tuple[int, int, str]], float, list[bool]]]:
        twice: dict[str, bool] = {}
        for name, table, pattern in self.assumed:
            pieces, sure = [], []
            for m in pattern.finditer(whole):
                try:
                    new = bytes(map(table.__getitem__, m.group())).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if (again := twice.get(new)) is None:
                    again = twice[new] = len(new) >= 2 and self._twice(new)
                pieces.append((*m.span(), new))
                sure.append(again)
            if pieces:
                yield name, pieces, MARGIN, sure

    def _wide_pieces(self, whole: str) -> Iterator[tuple[str, list[tuple[int, int, str]], np.ndarray, list[bool]]]:
        lost = _codes(whole + "\n\n") == 0xFFFD
        for name, code in self.codes.items():
            parts = list(map(code.__getitem__, whole))
            data = b"".join(parts)
            spans = [m.span() for m in _utf8_bytes.finditer(data)]
            if not spans:
                continue
            owner = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
            i, j = np.array(spans).T
            a, z = owner[i], owner[j - 1] + 1
            # bytes of the outer characters that are not in the span; the line ends at both ends of the whole are in none
            before, rest = owner[i - 1] == a, owner[j] == z - 1
            tail = rest & (np.frombuffer(data, np.uint8)[j] < 0x80)
            pieces = [(x, y, data[k:n].decode() + (chr(data[n]) if t else "")) for x, y, (k, n), t in zip(a.tolist(), z.tolist(), spans, tail.tolist(), strict=True)]
            length = np.array([len(x[2]) for x in pieces]) - tail
            # what stands near a lost sign is always looked at by itself
            yield name, pieces, MARGIN + MARGIN_EACH * length + (before.astype(int) + (rest & ~tail)) * self.unseen, (lost[a - 1] | lost[z] | lost[z + 1] | lost[z + 2]).tolist()

    def garbled(self, text: str) -> bool:
        """Whether at least one character of the text is wrong."""
        return LOST.search(text) is not None or self.repair(text) != text

    def _repair(self, text: str) -> str:
        seen: set[str] = set()
        while text not in seen:  # a text may have been decoded wrongly more than once
            seen.add(text)
            text = self._step(text)
        return text

    def _step(self, text: str) -> str:
        new = self._from_utf8(text) if self.may_start.search(text) else text
        if _narrow_high.search(text) and (other := self._from_narrow(text)) != text and (new == text or self.likely(f"\n{other}\n") > self.likely(f"\n{new}\n")):
            new = other
        if new == text and _wide_high.search(text):
            new = self._from_wide(text)
        return new

    def _from_utf8(self, text: str) -> str:
        best, most = text, 0.0
        padded = f"\n{text}\n"
        gains: dict[tuple[int, int, str], float] = {}  # most tables agree on most bytes
        hopes = self.narrow.get(text)
        for name, table, pattern in self.assumed:
            if hopes is not None and name not in hopes:
                continue
            parts, at, total = [], 1, 0.0
            for m in pattern.finditer(padded):
                try:
                    new = bytes(map(table.__getitem__, m.group())).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if (gain := gains.get(key := (m.start(), m.end(), new))) is None:
                    left = "\n" if m.start() == 1 else padded[m.start() - 1]
                    gain = gains[key] = self.gain(left, m.group(), new, padded[m.end()], MARGIN) or float(len(new) >= 2 and self._twice(new))
                if gain:
                    parts += [padded[at : m.start()], new]
                    at, total = m.end(), total + gain
            if total > most:
                best, most = "".join(parts) + padded[at:-1], total
        return best

    def _twice(self, text: str) -> bool:
        """Whether a reading is itself UTF-8 decoded wrongly throughout, which no text is by chance."""
        return any(p.fullmatch(text) for _, _, p in self.assumed)

    def _from_narrow(self, text: str) -> str:
        """Bytes of one encoding with one or two bytes per character that were read as another one."""
        padded = f"\n{text}\n"
        found: list[tuple[int, int]] = []
        totals: dict[str, float] = {}
        for start, end, key in self.tokens.get(text) or _tokens(text):
            if (readings := self.known.get(key)) is None:
                if len(self.known) > 200_000:
                    self.known.clear()  # only a memory of results: they are found again
                readings = self.known[key] = self._readings(key[0], key[1:-1], key[-1], self.hopes.get(key))
            found.append((start, end))
            for pair, gain in readings:
                totals[pair] = totals.get(pair, 0.0) + gain
        if not totals:
            return text
        best = max(sorted(totals), key=lambda pair: totals[pair])
        assumed, meant = best.split()
        table = next(t for n, t, _ in self.assumed if n == assumed)
        parts, at = [], 1
        for start, end in found:
            for a, z, new in self._spans(padded[start:end], table, meant):
                a, z = start + a, start + z
                # with one span of the text sure, the rest need only read better
                if self.likely(padded[a - 1] + new + padded[z]) > self.likely(padded[a - 1 : z + 1]):
                    parts += [padded[at:a], new]
                    at = z
        return "".join(parts) + padded[at:-1]

    def _spans(self, token: str, table: dict[str, int], meant: str) -> Iterator[tuple[int, int, str]]:
        """Start, end and reading of what a token holds in an encoding: the whole token in one of one byte per character, else its maximal well-formed spans."""
        if meant in self.wide:
            yield from self._wide_spans(token, table, bytes([table.get(c, 0xFF) for c in token]), meant)
            return
        try:
            yield 0, len(token), bytes([table[c] for c in token]).decode(meant)
        except (KeyError, UnicodeDecodeError):
            pass

    def _wide_spans(self, token: str, table: dict[str, int], data: bytes, meant: str) -> Iterator[tuple[int, int, str]]:
        spans, one = self.wide[meant]
        if (first := spans.search(data)) is None:
            return
        if first.end() - first.start() == len(data) and b"\xff" not in data:
            try:
                new = data.decode(meant)
            except UnicodeDecodeError:
                pass
            else:
                if not new.isascii():
                    yield 0, len(data), new
                return
        broken = [k for k, c in enumerate(token) if c not in table] if b"\xff" in data else []
        for low, high in zip([0, *(k + 1 for k in broken)], [*broken, len(data)], strict=True):
            for m in spans.finditer(data, low, high):
                yield from _decoded(data, *m.span(), meant, one)

    def _readings(self, left: str, token: str, right: str, hopes: set[tuple[str, str]] | None = None) -> list[tuple[str, float]]:
        """Pairs of encodings in which a token reads far better, with the gain. All are among ``hopes``, where these are given."""
        if hopes is not None and not hopes:
            return []
        if _signs_alone.fullmatch(token) or len(token) < 3 and token.isalpha():
            return []  # signs and single letters by themselves tell too little
        whole = left + token + right
        if min(self.likely(a + b) for a, b in zip(whole, whole[1:], strict=False)) >= self.frequent:
            return []
        out, n_high, seen = [], len(_high.findall(token)), set()
        before: dict[tuple[int, int], float] = {}

        def better(a: int, z: int, new: str, margin: float) -> float:
            """The gain of a reading of token[a:z]."""
            if (old := before.get((a, z))) is None:
                old = before[a, z] = self.likely(whole[a : z + 2])
            return self.gain(whole[a], token[a:z], new, whole[z + 1], margin) if self.beats(whole[a] + new + whole[z + 1], old + margin) else 0.0

        for assumed, table, _ in self.assumed:
            data = bytes([table.get(c, 0xFF) for c in token])
            if data in seen:
                continue  # most encodings agree on most bytes
            seen.add(data)
            for name in WIDE if n_high > 1 else ():
                if hopes is not None and (assumed, name) not in hopes:
                    continue
                total = 0.0
                for a, z, new in self._wide_spans(token, table, data, name):
                    if z - a < 2 or (a, z, new) in seen:
                        continue
                    seen.add((a, z, new))
                    if len(_high.findall(token[a:z])) < 2:
                        continue
                    # ASCII around it is read with it; a neighbour that is left over counts as a pair that is in no text
                    b, e = len(token[:a].rstrip(_ASCII)), len(token) - len(token[z:].lstrip(_ASCII))
                    margin = MARGIN + MARGIN_EACH * len(new) + ((b > 0) + (e < len(token))) * self.unseen
                    total += better(b, e, token[b:a] + new + token[z:e], margin)
                if total:
                    out.append((f"{assumed} {name}", total))
            if b"\xff" in data and any(c not in table for c in token):
                continue
            for name in NARROW:
                if hopes is not None and (assumed, name) not in hopes:
                    continue
                try:
                    new = data.decode(name)
                except UnicodeDecodeError:
                    continue
                if new == token or new in seen:
                    continue
                seen.add(new)
                changed = sum(x != y for x, y in zip(new, token, strict=True))
                if gain := better(0, len(token), new, MARGIN + MARGIN_NARROW * changed):
                    out.append((f"{assumed} {name}", gain))
        return out

    def _from_wide(self, text: str) -> str:
        """UTF-8 that was read as an East Asian encoding."""
        best, most = text, 0.0
        hopes = self.wider.get(text)
        for name in ASSUMED_WIDE:
            if hopes is not None and name not in hopes:
                continue
            # what cannot be encoded is "?" here and a break below, so no span is missed
            if not _utf8_bytes.search(text.encode(name, "replace")):
                continue
            code = self.codes[name]
            pieces = list(map(code.__getitem__, text))
            data = b"".join(pieces)
            if not (spans := [m.span() for m in _utf8_bytes.finditer(data)]):
                continue
            ends = list(itertools.accumulate(map(len, pieces)))
            owner = functools.partial(bisect.bisect_right, ends)  # the character that a byte belongs to
            parts, at, total = [], 0, 0.0
            for i, j in spans:
                a, z = owner(i), owner(j - 1) + 1
                if a < at:
                    continue
                new = data[i:j].decode("utf-8")
                # a sequence that breaks off before a lost sign goes with that sign
                if (cut := _utf8_cut.match(data, j)) and cut.end() < len(data) and text[owner(cut.end())] == "\ufffd":
                    j, z = cut.end(), owner(cut.end())
                left, right = text[a - 1 : a] or "\n", text[z : z + 1] or "\n"
                # bytes of the outer characters that are not in the span: ASCII stands for itself, others have lost their original
                before = i > 0 and owner(i - 1) == a and left != "\ufffd"
                rest = data[j : j + 1] if j < len(data) and owner(j) == z - 1 else b""
                tail = rest.decode() if rest.isascii() else ""
                after = bool(rest) and not tail and right != "\ufffd"
                # a lost sign tells nothing as a neighbour; one that the reading itself makes counts as a pair that is in no text
                margin = MARGIN + MARGIN_EACH * len(new) + (before + after) * self.unseen
                gain = self.gain(left.strip("\ufffd"), text[a:z], new + tail, right.strip("\ufffd"), margin)
                if gain:
                    parts += [text[at:a], "\ufffd" * before, new, tail, "\ufffd" * after]
                    at, total = z, total + gain
            if total > most:
                best, most = "".join(parts) + text[at:], total
        return best


@functools.lru_cache(maxsize=1)
def repairer(table: bytes) -> Repairer:
    """A repairer by these pair counts (float32), made once in each Python worker; what it remembers serves the worker's next tasks."""
    return Repairer(np.frombuffer(table, dtype=np.float32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * CELLS, dtype=np.int64)
    for b in batches:
        total += pair_counts([t for t in b.column(0).to_pylist() if t])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])


def corpus_counts(texts: DataFrame) -> np.ndarray:
    """Pair counts over the one string column of ``texts``; at most 2 * CELLS rows come to the driver."""
    rows = texts.mapInArrow(_count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * CELLS, dtype=np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def restore(nodes: DataFrame, keep: list[str], value: str, counts: np.ndarray | None = None) -> DataFrame:
    """The rows of ``nodes`` whose text is garbled: the columns ``keep``, restored (string) and lost (boolean).

    ``restored`` is the text with every span decoded anew that reads better so; ``lost`` says that characters remain whose original is gone.
    Rows whose text is sound, null or empty do not come out; equal rows come out as often as they came in. ``counts`` are pair counts of a corpus,
    by default those of all rows. ``keep`` may not name ``restored`` or ``lost``; other columns are not read.
    """
    if {"restored", "lost"} & set(keep):
        raise ValueError("keep may not hold restored or lost")
    if counts is None:
        counts = corpus_counts(nodes.select(F.col(value).alias("v")).filter("v is not null"))
    table = nodes.sparkSession.sparkContext.broadcast(counts.astype(np.float32).tobytes())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair_all = repairer(table.value).repair_all
        for f in frames:
            old = f[f.columns[-1]].tolist()
            new = repair_all(old)
            lost = [LOST.search(n) is not None for n in new]
            f = f.iloc[:, :-1].assign(restored=new, lost=lost)
            yield f[[a != b or x for a, b, x in zip(old, new, lost, strict=True)]]

    # ASCII is the same in all these encodings, so such texts need not leave the JVM
    rows = nodes.select(*keep, F.col(value).alias("__v")).filter(F.col("__v").rlike(r"[^\x00-\x7f]"))
    schema = rows.drop("__v").schema.add("restored", "string").add("lost", "boolean")
    return rows.mapInPandas(run, schema)


def garbled_nodes(nodes: DataFrame, counts: np.ndarray | None = None) -> DataFrame:
    """doc_id, node_id, restored, lost of each garbled text node of a node table, once."""
    texts = nodes.filter("kind = 'text'").select("doc_id", "node_id", "value")
    return restore(texts, ["doc_id", "node_id"], "value", counts).dropDuplicates(["doc_id", "node_id"])
