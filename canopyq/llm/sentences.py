"""Sentence units of texts in many languages and scripts.

The boundary rules are compiled into a finite transducer. Signs, brackets, quotes and line starts become symbols by rules on the few characters around them; a
symbol may hold only on a condition on the transducer's state. The state says whether a bracket or quotation is open, whether the sentence
began with a small letter, whether an address is being written, and what kind of line this is. What only the text further on can tell, whether a
bracket or quote closes in the same paragraph, is found from the end of the text backwards. A long text is cut into chunks: each chunk is the function from the state
before it to the state after it, the functions are composed by a parallel prefix scan, and every chunk then writes its boundaries from its own
starting state. So a text has the same units whole and in chunks, whatever the size of either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters beyond which a text is processed in chunks of about CHUNK_CHARS; it changes how the work is spread, not the units.
LONG_CHARS, CHUNK_CHARS = 16384, 8192
#: Characters of the words before a sign that its rules look at: more than any word they know has.
WORD, WORDS = 40, 128
#: Kinds of lines: blank, plain, plain but looking like an item, one of a list.
BLANK, PLAIN, ITEM, LISTED = range(4)

# Abbreviations after which a sentence goes on.
GOES_ON = frozenset(
    "dr mr mrs ms prof st no nr cf vs fig figs approx e.g i.e viz op ed eds vol pp p ch sec gen col sgt capt rev hon gov sen rep "
    "p.ex p.ej sra sr srta dra ud uds núm aprox pág env m mme mlle mm av bd "
    "np ul tzw tzn al pl str godz hr fr frl abb abs bd bzw ca d.h z.b u.a s.o vgl evtl ggf str "
    "ok örn yak bkz sn doç ths ts tp gs pgs sig sigg dott cfr pag ing avv "
    "v.v т.е ул напр руб им г гг рис стр см д-р проф т.к тыс млн млрд "
    "π.χ αρ δηλ σελ κ κα δρ श्री डॉ रु द ص د م أ a.m p.m".split()
)
#: Abbreviations that can end a sentence; after those in the second list only before a capital.
ENDS = frozenset("etc usw ecc itd itp т.д т.п др κ.λπ κτλ kg km cm mm g".split())
ENDS_BEFORE_CAPITAL = frozenset("vb jr inc ltd co corp bros u.s".split())
#: What follows a quotation that the sentence goes on after.
SAID = re.compile(
    r"\s*(?:said|says|asked|replied|answered|cried|added|wrote|dit|disse|dijo|dice|preguntó|respondió|répondit|demanda|sagte|fragte|antwortete|rief|powiedzia|odpowiedzia|zapyta|dedi|diye|сказал|спросил|ответил|говорит"
    r"|라고|이라고|하고|고 |nói|hỏi|कहा|गफ़्त|گفت|پرسید|είπε|ρώτησε|قال|سأل|ha detto|chiese|perguntou|respondeu|他这样说|她这样说|[他她我](?:这样)?[说道问]|と|って)"
)
#: Words after which a number and a point are an ordinal.
DETERMINERS = frozenset("der die das den dem des am im vom zum zur ein eine einen einem einer the el la los las le les il lo gli o a os as".split())

#: Of a bracket or quotation: 0 at the start of a unit, 1 inside, 2 and 3 in a bracket opened at the start and inside, 4 and 5 in a quotation alike.
# Next of each, "|" where a unit ends. o bracket opens, c bracket closes, q quote opens, e quote closes, Q quote
# either way, t sentence end, X end and closing signs, l the same before a small letter, s the same before "said".
TABLE = {
    "o": "2 3 2 3 4 5",
    "c": "0 1 1 1 4 5",
    "q": "4 5 2 3 4 5",
    "e": "0 1 2 3 1 1",
    "Q": "4 5 2 3 1 1",
    "t": "0| 0| 2 3 4| 5",
    "X": "0| 0| 0| 1 0| 0|",
    "l": "0| 1 0| 1 0| 1",
    "s": "1 1 1 1 1 1",
}
DELTA = {k: [(int(x[0]), x.endswith("|")) for x in row.split()] for k, row in TABLE.items()}
#: What a line start makes of the kind of the line before: bullet, number, blank line, other. A number needs a blank line or another item before it.
LINES = {"bullet": [LISTED] * 4, "number": [LISTED, ITEM, LISTED, LISTED], "blank": [BLANK] * 4, "plain": [PLAIN] * 4}
#: States: open bracket or quotation, small beginning, address, kind of line.
STATES = 6 * 2 * 2 * 4
START = 0  # a text begins as after a blank line
#: Conditions of a symbol: the sentence began with a small letter; no address is being written.
SMALL, BARE, NEVER = "small", "bare", "never"

_EVENT = re.compile(r"[.!?。！？｡।॥።፧؟۔…‼⁇⁈⁉‽]+|[;;]|[(\[{（【「『“„«\"”»」』)\]}）】]")
_CLOSERS = re.compile(r"(?:[)\]}）】」』》〉”’»›\"']|[“«](?=[\s,.;:!?)\]]|$))*")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "“": "”", "„": "“”", "«": "»", '"': '"'}
_QUOTES = frozenset("“„«\"”»「『」』")
_BULLET = re.compile(r"[ \t]*[-*•·‣▪●○◦–—][ \t]+\S")
_NUMBERED = re.compile(r"[ \t]*(?:\(?\d{1,3}[.)]|[①-⑳])[ \t]+\S")
_break = re.compile(r"\r?\n[ \t 　]*(?:\r?\n[ \t 　]*)+|\r\r+")
_line = re.compile(r"\r?\n|\r")
_token = re.compile(r"[^\s()\[\]“”„«»\"',!?…]*$")
_next = re.compile(r"\s*(\S?)")
_start = re.compile(r"(?:[.!?…][)\]\"'”»]*\s+|\n\s*\n\s*|\A)[(\[\"'“„«]?([^\W\d_])")
_cut = re.compile(r"(?<=\s)(?=\S)|(?<=\w)(?=\w)")
_gap = re.compile(r"(?<=\s)(?=\S)")
_thai = re.compile(r"(?<=[฀-๿])[  ]+(?=[฀-๿])")
_address = re.compile(r"https?://|www\.|(?<=\S)@(?=\S)", re.I)
_white = re.compile(r"\s")
_blank = re.compile(r"[^\S\r\n]*(?=[\r\n]|\Z)")
_around = re.compile(r"\S{0,64}\s*\S{0,64}\s*\S{0,64}")
_CLOSING = "".join(dict.fromkeys("".join(_PAIRS.values())))


class Ahead:
    """Where the next paragraph ends and the next closing signs stand, each looked for once. ``beyond``: signs that come after ``high`` in the paragraph there."""

    def __init__(self, text: str, high: int, beyond: frozenset[str]):
        self.text, self.high, self.beyond = text, high, beyond
        self.end, self.next = -1, {}

    def paragraph(self, i: int) -> int:
        if self.end < i:
            m = _break.search(self.text, i, self.high)
            self.end = m.start() if m else self.high + 1
        return self.end

    def sign(self, c: str, i: int) -> int:
        if (k := self.next.get(c, -1)) < i:
            k = self.text.find(c, i, self.high)
            self.next[c] = k = self.high + 1 if k < 0 else k
        return k

    def closes(self, i: int, signs: str) -> bool:
        """Whether one of the signs comes after i in the same paragraph."""
        end = self.paragraph(i)
        return any(self.sign(c, i + 1) < end for c in signs) or end > self.high and not self.beyond.isdisjoint(signs)


def _opens(text: str, i: int, ch: str, ahead: Ahead) -> bool:
    """Whether a bracket or quote at i closes again in the same paragraph."""
    if i + 1 >= len(text) or text[i + 1].isspace() or (ch == "(" and i and text[i - 1] in ":;-=8"):
        return False
    return ahead.closes(i, _PAIRS[ch])


def _ends(text: str, a: int, z: int, after: int, low: int) -> bool | str:
    """Whether the signs text[a:z] end a sentence, closing signs going on to `after`; or the condition on which they do. Text before `low` may be cut off."""
    run = text[a:z]
    m = _next.match(text, after)
    spaced, nxt = m.start(1) > after, m.group(1)
    small = nxt.islower() and not text[m.end() : m.end() + 1].isupper()  # a brand may begin with a small letter
    if run in (";", ";"):  # the Greek question mark
        return a > 0 and "Ͱ" <= text[a - 1] <= "῿" and not "Ѐ" <= text[a - 1] <= "ỿ" and (spaced or not nxt or after > z)
    if not nxt:
        return True
    if set(run) <= {".", "…"} and run != ".":
        before = text[a - 1] if a else " "
        if before.isspace() and spaced and "。" not in text[max(0, a - 2) : z]:
            return False
        return spaced or not (nxt.isalnum() and nxt.isascii()) or nxt.isupper()
    if run != ".":
        return spaced or after > z or not nxt.isascii() or nxt.isupper() or not nxt.isalnum()
    token = _token.search(text, max(0, a - WORD), a).group()
    word = token.lower()
    if not spaced and after == z:
        if not nxt.isalpha():
            return nxt in "(“„«\"•" and len(word) > 1 and word.isalpha()
        # no space: two sentences run together, unless it is a name, a number or an address
        plain = len(token) > 1 and token.isalpha() and word not in GOES_ON
        follows = text[z + 1 : z + 2]
        return plain and (nxt.isupper() and follows.islower() and token[-1].islower() or not (nxt.isascii() or nxt.islower() or nxt.isupper()) and not token.isascii())
    if len(token) == 1 and token.isalpha() and (token.isupper() or token.islower()) and after == z:
        return False  # an initial
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token) and word not in ENDS and token[0].isupper() and after == z:
        return False
    if word in GOES_ON and after == z:
        return False
    if word in ENDS_BEFORE_CAPITAL and after == z:
        return (SMALL if small else True) if nxt.isalpha() else nxt in _QUOTES or nxt == "("
    if token.isdigit() and len(token) < 4 and after == z:
        head = text[max(0, a - len(token) - WORD) : a - len(token)].split()
        last = head[-1].lower().strip("“„«\"(") if head else ""
        if last.rstrip(".") in GOES_ON and last.endswith("."):
            return not nxt.isdigit() and (SMALL if small else True)
        if small:
            return SMALL if token != "1" else False
        return last not in DETERMINERS if nxt.isupper() else token != "1" or nxt.islower()
    if not nxt.isupper() and nxt.isalpha() and not (nxt.islower() and not small) and (known := _in_address(text, low, a)) is not False:
        return BARE if known is None else NEVER
    return True


def _in_address(text: str, low: int, a: int) -> bool | None:
    """Whether an address is being written at a; None if no white space since low and none before a tells."""
    start = a
    while start > low and not text[start - 1].isspace():
        start -= 1
    m = _address.search(text, start, a + 8)
    if m and m.start() < a:
        return True
    return None if start == low > 0 and not text[low - 1].isspace() else False


def symbols(text: str, low: int, high: int, beyond: frozenset[str] = frozenset(), cut_off: bool = False) -> list[tuple[str, int, int, str | None]]:
    """(symbol, start, end, condition) of the events that begin in [low, high), in order; a unit that ends at one ends at its end.

    beyond: closing signs that come after high in the paragraph there. cut_off: the text goes on before text[0].
    """
    out = _lines(text, low, high, cut_off) + _events(text, low, high, Ahead(text, high, beyond))
    if low or high < len(text) or any(c == SMALL for _, _, _, c in out):
        out += _beginnings(text, low, high, cut_off)
    if high < len(text) and (known := _in_address(text, low, high)) is not None:
        out.append(("address" if known else "bare", high, high, None))
    out.sort(key=lambda x: (x[1], x[0] not in LINES))
    return out


def _lines(text: str, low: int, high: int, cut_off: bool) -> list[tuple[str, int, int, str | None]]:
    out = []
    starts = [low] if low < high and (not (low or cut_off) or low and text[low - 1] in "\r\n") else []
    starts += [m.end() for m in _line.finditer(text, low, high)]
    for k in starts:
        if k < min(high, len(text)):
            kind = "blank" if _blank.match(text, k) else "bullet" if _BULLET.match(text, k) else "number" if _NUMBERED.match(text, k) else "plain"
            out.append((kind, k, k, None))
    return out


def _beginnings(text: str, low: int, high: int, cut_off: bool) -> list[tuple[str, int, int, str | None]]:
    """The first letters of sentences, small or not."""
    return [("small" if m.group(1).islower() else "big", m.start(1), m.start(1), None) for m in _start.finditer(text) if low <= m.start(1) < high and not (cut_off and m.start(1) == m.start() == 0)]


def _events(text: str, low: int, high: int, ahead: Ahead) -> list[tuple[str, int, int, str | None]]:
    k = low
    found = []
    while m := _EVENT.search(text, k, high):
        a, z = m.span()
        ch = m.group()
        k = z
        if ch in _PAIRS and ch != '"':
            if ch in "“«" and a and not text[a - 1].isspace() and (z >= len(text) or not text[z].isalnum()):
                found.append(("e", a, z, None))
            elif _opens(text, a, ch, ahead):
                found.append(("q" if ch in _QUOTES else "o", a, z, None))
        elif ch == '"':
            if not (a and text[a - 1].isdigit()):
                closes = a > 0 and not text[a - 1].isspace() and text[a - 1] not in "([{（" and (z >= len(text) or not text[z].isalnum())
                if closes or _opens(text, a, ch, ahead):
                    found.append(("e" if closes else "Q", a, z, None))
        elif ch in "”»」』":
            found.append(("e", a, z, None))
        elif ch in ")]}）】":
            found.append(("c", a, z, None))
        else:
            after = _CLOSERS.match(text, z).end()
            if ch == "." and text[z : z + 1].isspace() is False and after > z and text[z] == "'" and text[after : after + 1].isalpha():
                after = z
            if ends := _ends(text, a, z, after, low):
                condition = ends if isinstance(ends, str) else None
                if condition == NEVER:
                    pass
                elif after == z:
                    found.append(("t", a, z, condition))
                else:
                    nxt = _next.match(text, after).group(1)
                    quote = any(c in _QUOTES or c in "“'’" for c in text[z:after])
                    found.append(("s" if quote and SAID.match(text, after) else "l" if nxt.islower() else "X", a, after, condition))
                k = after
    for m in _thai.finditer(text, low):
        if m.start() >= high:
            break
        found.append(("t", m.start(), m.start(), None))
    return found


def _packed(opened: int, small: int, address: int, line: int) -> int:
    return opened + 6 * (small + 2 * (address + 2 * line))


def run(text: str, marks: list[tuple[str, int, int, str | None]], low: int, high: int, state: int = START) -> tuple[int, list[int]]:
    """State after the symbols of [low, high) and the ends of units in it."""
    rest, opened = divmod(state, 6)
    small, address, line = rest & 1, rest >> 1 & 1, rest >> 2
    at, ends = low, []
    for symbol, a, z, condition in marks:
        if symbol in LINES:
            before, line = line, LINES[symbol][line]
            if LISTED in (before, line) or line == BLANK:
                ends.append(a)
                opened, at = 0, max(at, a)
        elif symbol in ("small", "big"):
            small = symbol == "small"
        elif symbol in ("address", "bare"):
            address = symbol == "address"
        elif line != LISTED and (condition is None or (small if condition == SMALL else not address)):
            if opened < 2 and text[at:a].strip():
                opened = 1
            opened, cut = DELTA[symbol][opened]
            if cut:
                ends.append(z)
            at = max(at, z)
    if opened < 2 and line != LISTED and text[at:high].strip():
        opened = 1
    return _packed(opened, int(small), int(address), line), ends


def function(text: str, marks: list[tuple[str, int, int, str | None]], low: int, high: int) -> bytes:
    """A chunk as a function: the state after it for each state before it."""
    return bytes(run(text, marks, low, high, s)[0] for s in range(STATES))


def compose(f: bytes, g: bytes) -> bytes:
    """First f, then g. It is associative, so functions of chunks can be scanned in any grouping."""
    return f.translate(g.ljust(256, b"\0"))


def scan(functions: list[bytes]) -> list[int]:
    """The starting state of each chunk, by a prefix scan of the composed functions with doubling strides."""
    sums, stride = list(functions), 1
    while stride < len(sums):
        sums = [compose(sums[k - stride], sums[k]) if k >= stride else sums[k] for k in range(len(sums))]
        stride *= 2
    return [START] + [f[START] for f in sums[:-1]]


def spans(text: str, ends: list[int], low: int = 0) -> list[tuple[int, int]]:
    """Units between the ends, without outer white space; a unit of nothing but signs goes with the one before it."""
    out, at = [], low
    for e in [*ends, len(text)]:
        piece = text[at:e]
        if body := piece.strip():
            a = at + len(piece) - len(piece.lstrip())
            out.append((a, a + len(body)))
        at = max(at, e)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit of a text, in code points."""
    return spans(text, run(text, symbols(text, 0, len(text)), 0, len(text))[1])


def cuts(text: str, size: int) -> list[tuple[int, int]]:
    """Chunks of about `size` characters that begin at a word, or else inside one, never among signs."""
    at = [0]
    while len(text) - at[-1] > size:
        k = at[-1] + size
        m = _gap.search(text, k, k + size) or _cut.search(text, k)
        if not m:
            break
        at.append(m.start())
    return list(zip(at, [*at[1:], len(text)], strict=True))


def _short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [sentences(t) if t else [] for t in f["__t"]]
        f = f.drop(columns="__t").loc[f.index.repeat([len(x) for x in found])]
        f["sent_start"] = [a for x in found for a, _ in x]
        f["sent_end"] = [z for x in found for _, z in x]
        yield f


_CHUNK = "h string, n int, low int, high int, base int, piece string, beyond string"


def pieces(text: str, size: int) -> list[tuple[int, int, int, int, str, str]]:
    """n, low, high, base, the characters around that its rules look at, and the closing signs beyond it, of each chunk."""
    out, beyond = [], frozenset()
    for n, (a, z) in reversed(list(enumerate(cuts(text, size)))):
        base = a
        while base and (text[base - 1].isspace() or text[base - 1] in ")]\"'”»"):
            base -= 1
        base = max(0, base - WORDS)
        out.append((n, a, z, base, text[base : _around.match(text, z).end()], "".join(sorted(beyond))))
        # from the end backwards: a sign in this chunk before a paragraph ends, else one beyond it if none ends in it
        ends = _break.search(text, a, z)
        here = {c for c in _CLOSING if 0 <= text.find(c, a, ends.start() if ends else z)}
        beyond = frozenset(here if ends else here | beyond)
    return out[::-1]


def _chunks(size: int):
    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for h, t in zip(f["h"], f["t"], strict=True):
                yield pd.DataFrame([(h, *p) for p in pieces(t, size)], columns=["h", "n", "low", "high", "base", "piece", "beyond"])

    return make


def _marks(piece: str, low: int, high: int, base: int, beyond: str) -> list[tuple[str, int, int, str | None]]:
    return symbols(piece, low - base, high - base, frozenset(beyond), base > 0)


def _functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        made = [function(p, _marks(p, a, z, b, x), a - b, z - b) for p, a, z, b, x in zip(f["piece"], f["low"], f["high"], f["base"], f["beyond"], strict=True)]
        yield pd.DataFrame({"h": f["h"], "n": f["n"], "f": made})


def _starts(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("n")
    return pd.DataFrame({"h": f["h"], "n": f["n"], "state": scan([bytes(x) for x in f["f"]])})


def _boundaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for h, p, a, z, b, x, s in zip(f["h"], f["piece"], f["low"], f["high"], f["base"], f["beyond"], f["state"], strict=True):
            out += [(h, e + b) for e in run(p, _marks(p, a, z, b, x), a - b, z - b, s)[1]]
        yield pd.DataFrame(out, columns=["h", "e"])


def _units(f: pd.DataFrame) -> pd.DataFrame:
    t, ends = f["t"].iloc[0], f["ends"].iloc[0]
    found = spans(t, sorted(ends if ends is not None else []))
    return pd.DataFrame({"h": f["h"].iloc[0], "a": [a for a, _ in found], "z": [z for _, z in found]})


def split_sentences(docs: DataFrame, keep: list[str], text: str = "text", long_chars: int = LONG_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per sentence unit of the texts of ``docs``: the columns ``keep``, sent_start and sent_end (offsets in code points).

    Together the units hold all characters but white space. Null, empty and blank texts give no row; equal rows come out as often as they
    came in. A text of more than ``long_chars`` characters is cut into chunks that are spread over the tasks. ``keep`` may not name sent_start or
    sent_end; other columns of ``docs`` are not read.
    """
    if {"sent_start", "sent_end"} & set(keep):
        raise ValueError("keep may not hold sent_start or sent_end")
    docs = docs.select(*keep, F.col(text).alias("__t")).filter("__t is not null")
    schema = T.StructType([*docs.drop("__t").schema.fields, T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType())])
    is_long = F.length("__t") > long_chars
    short = docs.filter(~is_long).mapInPandas(_short, schema)
    long = docs.filter(is_long).withColumn("__h", F.sha2("__t", 256))
    distinct = long.select(F.col("__h").alias("h"), F.col("__t").alias("t")).dropDuplicates(["h"])
    chunks = distinct.mapInPandas(_chunks(chunk_chars), _CHUNK).repartition(F.col("h"), F.col("n"))
    states = chunks.mapInPandas(_functions, "h string, n int, f binary").groupBy("h").applyInPandas(_starts, "h string, n int, state int")
    ends = chunks.join(states, ["h", "n"]).mapInPandas(_boundaries, "h string, e int").groupBy("h").agg(F.collect_list("e").alias("ends"))
    units = distinct.join(ends, "h", "left").groupBy("h").applyInPandas(_units, "h string, a int, z int")
    out = long.select(*keep, "__h").join(units.select(F.col("h").alias("__h"), F.col("a").alias("__a"), F.col("z").alias("__z")), "__h")
    return short.unionByName(out.select(*keep, F.col("__a").alias("sent_start"), F.col("__z").alias("sent_end")))
