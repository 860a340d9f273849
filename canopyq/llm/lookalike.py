"""One consistent form for text that looks the same but is written with different characters.

Characters and sequences that show the same are joined into transitive classes by union-find. In each class the member that the corpus
uses most often is the representative, one for each script that has a member; an ASCII member is always that of its script, so that plain texts are in
their one form as they stand. An automaton over all members rewrites a text greedily, the longest member first, to the representative in the script of the word.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of Cyrillic and Greek that show as the Latin letter beside them.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏ" "АВЕКМНОРСТХІЈЅУҺԌӀԚԜ", "aeopcyxijshdqwl" "ABEKMHOPCTXIJSYHGIQW", strict=True))
GREEK = dict(zip("αονρυχϲϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "aovpuxcj" "ABEZHIKMNOPTYXCJ", strict=True))
ARMENIAN = dict(zip("օսհոցզՕՏՍԼ", "ouhngqOSUL", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
#: Latin letters of phonetic writing that show as an everyday one, and small capitals of letters whose small form has the shape of the capital.
PHONETIC = dict(zip("ɡɑɩ", "gai", strict=True)) | {chr(k): n[-1].lower() for k in (*range(0x1D00, 0x1D23), *range(0xA730, 0xA732)) if (n := unicodedata.name(chr(k), "")).startswith("LATIN LETTER SMALL CAPITAL ") and n[-2:-1] == " " and n[-1] in "COSUVWXZ"}
TABLES = (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, PHONETIC)
#: Of these, the letters of everyday alphabets: only they leave open which script a word is in.
COMMON = frozenset("аеорсухАВЕКМНОРСТХУ" "αονρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
#: Characters that show nothing.
INVISIBLE = "\u00ad\u034f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff"
#: Characters that show only a space.
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"
#: Marks of the full width that Chinese and Japanese writing uses itself.
CJK_MARKS = "！（），．：；？［］｛｝～｜＂＇"
_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>", "<small>")
#: Numbers of one or several letters.
_ROMAN = "Ⅰ-ⅿ"
_LIGATURES = _ROMAN + "ﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳŉ"

_latin = "A-Za-zª-ºÀ-ÖØ-öø-ʯḀ-ỿ"
_cyrillic, _greek, _armenian, _cherokee = "Ѐ-ԯ", "Ͱ-Ͽἀ-῾", "Ա-֏", "Ꭰ-Ᏽꭰ-ꮿ"
_others = _cyrillic + _greek + _armenian + _cherokee
_mark = "\u0300-\u036f"
_thin = f"[{INVISIBLE}{_mark}]"
_ranges_of = {"latin": _latin, "cyrillic": _cyrillic, "greek": _greek, "armenian": _armenian, "cherokee": _cherokee}
_is = {name: re.compile(f"[{x}]") for name, x in _ranges_of.items()}
SCRIPTS = tuple(_ranges_of)
_mixed = re.compile("|".join(f"[{x}]{_thin}*[{''.join(y for y in _ranges_of.values() if y != x)}]" for x in _ranges_of.values()))
_letters = re.compile(f"[{_latin}{_others}{_mark}{INVISIBLE}]+")
#: Look-alike letters that everyday alphabets do not have: in a word of look-alikes only, they tell of another script.
_RARE = "".join(sorted(set().union(*TABLES[:2]) - COMMON))
_rare = re.compile(f"[{_RARE}]")
_foreign = re.compile(f"[{_others}]")
_emoji = re.compile("[\U0001f000-\U0001faff☀-➿️⃣↔-⇿⬀-⯿]")
_virama = re.compile("[्্੍્୍்్್്්᯲]")
#: Arabic letters that join to the letter after them: only there does a non-joiner show.
_joining = re.compile("[بتثجحخسشصضطظعغفقكکلمنهيیئپچگڤىہھ]")
_arabic = re.compile("[؀-ۿݐ-ݿ]")
_invisible = re.compile(f"[{INVISIBLE}]")


def _ranges(points: list[int]) -> str:
    """A character class of the points."""
    out, k = [], 0
    while k < len(points):
        z = k
        while z + 1 < len(points) and points[z + 1] == points[z] + 1:
            z += 1
        a, b = (re.escape(chr(points[i])) for i in (k, z))
        out.append(a if k == z else f"{a}-{b}")
        k = z + 1
    return "".join(out)


@functools.cache
def folded() -> dict[str, str]:
    """Characters of another width or form, and what they show, by the Unicode data; marks of Chinese and Japanese writing stay."""
    out = {}
    ligature = re.compile(f"[{_LIGATURES}]")
    for k in range(128, sys.maxunicode + 1):
        c = chr(k)
        d = unicodedata.decomposition(c)
        if not d or c in CJK_MARKS or c == "\u3000":
            continue
        if d.startswith(_TAGS) or ligature.match(c) or not d.startswith("<") and unicodedata.normalize("NFC", c) != c:
            shown = unicodedata.normalize("NFKC", c)
            if shown != c and not shown.isspace() and not (d.startswith("<small>") and not shown.isascii()):
                out[c] = shown
    return out


@functools.cache
def _all_suspects() -> frozenset[str]:
    """All characters that can be a case by themselves or with the one before them."""
    composing = set()
    for k in range(128, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(k)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.combining(c := chr(int(parts[1], 16))) and unicodedata.normalize("NFC", chr(k)) == chr(k):
            composing.add(c)
    nothing = re.compile(f"[{INVISIBLE}{SPACES}{HYPHENS}]")
    plain = {chr(k) for k in range(128, 0x10000) if nothing.match(chr(k))}
    return frozenset({*folded(), *composing, *plain, *PHONETIC, *map(chr, range(0x1100, 0x1200))})


@functools.cache
def suspects(low: int = 0, high: int = sys.maxunicode + 1) -> str:
    """A character class of the suspects between two code points."""
    return _ranges(sorted(k for k in map(ord, _all_suspects()) if low <= k < high))


@functools.lru_cache(maxsize=4)
def _coarse(odd: str = "") -> str:
    """A class of few ranges that holds all suspects and the odd characters: a long class is slow in the JVM."""
    points = sorted({ord(c) for c in (*_all_suspects(), *odd)})
    out: list[list[int]] = []
    for k in points:
        if out and k - out[-1][1] <= 32 and not (out[-1][1] < 0xC0 < k or out[-1][1] <= 0x36F < k):
            out[-1][1] = k
        else:
            out.append([k, k])
    return "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in out)


def may_change(value: Column, odd: str = "") -> Column:
    """Whether a value can be a case at all, told without Python: a suspect character, one of ``odd``, or letters of two of the scripts that share shapes."""
    holds = lambda names: value.rlike(f"[{''.join(_ranges_of[n] for n in names)}]")
    two = F.lit(False)
    for k, name in enumerate(SCRIPTS[:-1]):
        two = two | (holds([name]) & holds(SCRIPTS[k + 1 :]))
    return value.rlike(r"[^\x00-\x7f]") & (value.rlike(f"[{_coarse(odd)}]") | (holds(SCRIPTS[1:]) & (value.rlike(f"[{_RARE}]") | two)))


@dataclass
class Classes:
    """Union-find over strings; each class keeps its members."""

    parent: dict[str, str] = field(default_factory=dict)

    def find(self, s: str) -> str:
        self.parent.setdefault(s, s)
        root = s
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for s in self.parent:
            by.setdefault(self.find(s), []).append(s)
        return [sorted(m) for m in by.values()]


@functools.lru_cache(maxsize=1 << 16)
def script(s: str) -> str:
    """The script of a member of a class, or "" where it belongs to none of the three that share letters."""
    for name, pattern in _is.items():
        if pattern.search(s):
            return name
    return ""


@functools.cache
def classes() -> list[list[str]]:
    """The transitive look-alike classes, by Unicode data and the tables above."""
    c = Classes()
    for table in (*TABLES, folded()):
        for a, b in table.items():
            c.join(a, b)
    for k in range(128, sys.maxunicode + 1):
        s = chr(k)
        d = unicodedata.decomposition(s)
        if d and not d.startswith("<") and not 0xAC00 <= k < 0xD7A4 and unicodedata.normalize("NFC", s) == s:
            for form in {unicodedata.normalize("NFD", s), "".join(chr(int(x, 16)) for x in d.split())}:
                c.join(form, s)
    # a letter with an accent looks like the look-alike of its base with that accent
    for s in [m for m in c.parent if len(m) == 2]:
        for table in TABLES[:2]:
            for a, b in table.items():
                if s[0] == b and (unicodedata.normalize("NFC", a + s[1]) == a + s[1]):
                    c.join(a + s[1], s)
    return c.members()


class Rewriter:
    """Rewrites texts. counts: how often the corpus has a member; without it, the usual form (composed, plain) counts as the commonest."""

    def __init__(self, counts: dict[str, int] | None = None):
        counts = counts or {}
        usual = lambda m: (not m.isascii(), -counts.get(m, 0), m in folded() or m in PHONETIC, unicodedata.normalize("NFC", m) != m, len(m), m)
        odd: set[str] = set()
        known = _all_suspects()
        self.best: list[dict[str, str]] = []
        self.automaton = ahocorasick.Automaton()
        self.by: dict[str, int] = {}
        self.own: dict[str, str | None] = {}
        for k, members in enumerate(classes()):
            best: dict[str, str] = {}
            for m in sorted(members, key=usual):
                best.setdefault(script(m), m)
            self.best.append(best)
            odd.update(m[-1] for m in members if m != best[script(m)] and m[-1] > "\x7f" and known.isdisjoint(m) and (len(m) == 1 or unicodedata.category(m[-1])[0] == "M"))
            for m in members:
                self.by[m] = k
                self.automaton.add_word(m, (k, len(m)))
        self.automaton.make_automaton()
        # a class within the first plane is a bitmap; with others it would be tried range by range
        #: Characters of members that are usual elsewhere but not the representative here.
        self.odd = "".join(sorted(odd))
        low, high = (_ranges(sorted(k for k in map(ord, odd) if (k < 0x10000) == first)) for first in (True, False))
        self.single = re.compile(f"[{suspects(0, 0x10000)}{low}]")
        self.beyond = re.compile(f"[{suspects(0x10000)}{high}]")

    def form(self, text: str) -> str:
        """The text in its one form."""
        if text.isascii():
            return text
        seen: set[str] = set()
        while text not in seen:  # a rewritten word can tell the script of its neighbours
            seen.add(text)
            new = text
            if self.single.search(new) or (max(new, default="") > "\uffff" and self.beyond.search(new)):
                new = unicodedata.normalize("NFC", self._spelled(self._shown(new)))
            new = self._scripts(new)
            if new == text:
                break
            text = new
        return text

    def _shown(self, text: str) -> str:
        """Without characters that show nothing, and with plain spaces and hyphens. What a script or an emoji needs stays."""
        out = []
        for k, c in enumerate(text):
            if _invisible.match(c):
                if not needed(text, k):
                    continue
            elif c in HYPHENS:
                c = "-"
            elif c != " " and not c.isascii() and _space.match(c):
                c = " "
            out.append(c)
        return "".join(out)

    def _spelled(self, text: str) -> str:
        """The longest members first, from left to right, each to the representative in its own script; a match that ends inside a longer cluster is none."""
        parts, at = [], 0
        for end, (k, n) in self.automaton.iter_long(text):
            start = end + 1 - n
            m = text[start : end + 1]
            best = self.best[k]
            new = best[own] if (own := script(m)) else next((best[x] for x in (*SCRIPTS, "") if x in best), m)
            if new != m:
                parts += [text[at:start], new]
                at = end + 1
        return "".join(parts) + text[at:]

    def _scripts(self, text: str) -> str:
        """Letters of look-alike scripts to the script of their word."""
        if not _foreign.search(text) or not (_is["latin"].search(text) or _rare.search(text) or _mixed.search(text)):
            return text
        votes = dict.fromkeys(SCRIPTS, 0)
        words = [(m.start(), m.group(), self._votes(m.group())) for m in _letters.finditer(text)]
        for _, _, v in words:
            if sum(x > 0 for x in v.values()) == 1:
                for s, x in v.items():
                    votes[s] += x > 0
        out, at = [], 0
        for start, word, v in words:
            present = {s for c in word if (s := script(c))}
            if not present:
                continue
            own = max(v, key=lambda s: (v[s], s in present and sum(script(c) == s for c in word), votes[s]))
            if not any(v.values()):  # every letter could be of either script: the other words say which
                around = max(votes, key=lambda s: votes[s])
                if votes[around] and (len(present) > 1 or not any(votes[s] for s in present)) and all(around in self.best[self.by[c]] for c in word if c in self.by and script(c)):
                    own = around
                elif len(present) == 1 and not any(votes.values()) and len(word) > 2 and _rare.search(word):
                    own = "latin"
                elif len(present) == 1:
                    continue
            elif len(present) == 1:
                continue
            new = "".join(self.best[self.by[c]].get(own, c) if script(c) not in ("", own) and c in self.by else c for c in word)
            if new != word:
                out += [text[at:start], new]
                at = start + len(word)
        return "".join(out) + text[at:]

    def _votes(self, word: str) -> dict[str, int]:
        """Letters of a word that only one script can show."""
        v = dict.fromkeys(SCRIPTS, 0)
        for c in word:
            if (s := self._own(c)) is not None:
                v[s] += 1
        return v

    def _own(self, c: str) -> str | None:
        """The script of a letter that no other script can show."""
        if c not in self.own:
            s = script(c)
            self.own[c] = s if s and not any(c in t for t in TABLES) and not self._twin(c) else None
        return self.own[c]


    def _twin(self, c: str) -> bool:
        """Whether a Latin letter shows as a letter of another everyday alphabet."""
        k = self.by.get(c)
        return k is not None and any(m in COMMON for m in self.best[k].values())


@functools.lru_cache(maxsize=2)
def rewriter(counts: tuple[tuple[str, int], ...] = ()) -> Rewriter:
    """A rewriter by these counts, made once in each Python worker."""
    return Rewriter(dict(counts))


_space = re.compile(f"[{SPACES}]")


def needed(text: str, k: int) -> bool:
    """Whether the script or the emoji needs the invisible character at k: joiners between emoji, after a virama, between Arabic letters."""
    c = text[k]
    if c not in "\u200c\u200d" or not 0 < k < len(text) - 1:
        return False
    before, after = text[k - 1], text[k + 1]
    if c == "\u200d" and _emoji.match(before) and _emoji.match(after) or before == "\ufe0f" and _emoji.match(after):
        return True
    if before == "\U0001f3fb" or "\U0001f3fb" <= before <= "\U0001f3ff":
        return True
    if _virama.match(before):
        return True
    return c == "\u200c" and _joining.match(before) is not None and _arabic.match(after) is not None


class MemberCounts:
    """Counts of all members of classes in texts."""

    def __init__(self, members: list[str]):
        self.ones = sorted(ord(m) for m in members if len(m) == 1)
        self.pairs = {(ord(m[0]) << 32) | ord(m[1]): m for m in members if len(m) == 2}
        self.longer = {m: 0 for m in members if len(m) > 2}
        self.find = ahocorasick.Automaton()
        for m in self.longer:
            self.find.add_word(m, m)
        self.find.make_automaton()
        self.keys = np.array(sorted(self.pairs), dtype=np.uint64)
        # of all neighbours only those are looked up whose second character ends a pair, and whose first one begins one
        self.place = np.zeros(0x110000, dtype=np.uint8)
        self.place[[ord(m[0]) for m in self.pairs.values()]] = 1
        self.place[[ord(m[1]) for m in self.pairs.values()]] |= 2
        self.single, self.double = np.zeros(0x110000, dtype=np.int64), np.zeros(len(self.keys), dtype=np.int64)

    def add(self, texts: list[str]) -> None:
        text = "\n".join(texts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(codes):
            return
        found = np.bincount(codes)
        self.single[: len(found)] += found
        at = self.place[codes]
        marks = np.flatnonzero(at[:-1] & (at[1:] >> 1))
        both = (codes[marks].astype(np.uint64) << np.uint64(32)) | codes[marks + 1].astype(np.uint64)
        at = np.searchsorted(self.keys, both)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == both
        self.double += np.bincount(at[hit], minlength=len(self.keys))
        for _, m in self.find.iter(text):
            self.longer[m] += 1

    def counts(self) -> dict[str, int]:
        out = {chr(k): int(self.single[k]) for k in self.ones if self.single[k]}
        out |= {self.pairs[int(k)]: int(n) for k, n in zip(self.keys, self.double, strict=True) if n}
        return out | {m: n for m, n in self.longer.items() if n}


def _count(members: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = MemberCounts(members)
    for b in batches:
        counter.add([t for t in b.column(0).to_pylist() if t])
    out = counter.counts()
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["member", "n"])


def member_counts(texts: DataFrame) -> dict[str, int]:
    """How often each member of a class occurs in the one string column of ``texts``. There are as many rows as members, whatever the corpus."""
    members = [m for c in classes() for m in c]
    rows = texts.mapInArrow(lambda it: _count(members, it), "member string, n long").groupBy("member").agg(F.sum("n").alias("n")).collect()
    return {r.member: r.n for r in rows}


def consistent(values: DataFrame, keep: list[str], value: str, counts: dict[str, int] | None = None, only_changed: bool = False) -> DataFrame:
    """One row per row of ``values``: the columns ``keep`` and ``form``, the value in its one consistent form.

    Null stays null and an empty value empty; equal rows come out as often as they came in. With ``only_changed`` only rows whose value is
    not in that form come out. ``counts`` are the members' counts, by default those of ``values``. ``keep`` may not name ``form``; other columns
    are not read.
    """
    if "form" in keep:
        raise ValueError("keep may not hold form")
    if counts is None:
        counts = member_counts(values.select(F.col(value).alias("v")).filter("v is not null"))
    # one row per member of a class at most: some 20 000
    counted = tuple(sorted(counts.items()))
    shared = values.sparkSession.sparkContext.broadcast(counted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = rewriter(shared.value).form
        for f in frames:
            old = f[f.columns[-1]].tolist()
            f = f.iloc[:, :-1].assign(form=[form(t) for t in old])
            yield f[[a != b for a, b in zip(old, f["form"], strict=True)]] if only_changed else f

    rows = values.select(*keep, F.col(value).alias("__v"))
    schema = rows.drop("__v").schema.add("form", "string")
    may = may_change(F.col("__v"), rewriter(counted).odd)
    changed = rows.filter(may).mapInPandas(run, schema)
    if only_changed:
        return changed
    return changed.unionByName(rows.filter(~F.coalesce(may, F.lit(False))).withColumnRenamed("__v", "form"))
