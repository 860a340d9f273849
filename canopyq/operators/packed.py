"""Splitting of fields that hold several values in one string.

Ordinary characters of a field are masked, which leaves its delimiter skeleton. How a skeleton splits is resolved once for each distinct
skeleton; the rule is a list of token spans, which built-in functions then cut out of every field that has this skeleton.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.session import cut

#: Bytes of rules up to which they are broadcast, measured first; beyond, they are joined by a shuffle.
BROADCAST_RULES = 4 << 20
#: Parts over which the fields of one skeleton are spread where rules are not broadcast.
SALTS = 32

_BLANK = r"\t\n\r\u000b\f \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085"
_DOUBLE = r'&quot;|&#0*34;|&#[xX]0*22;|&[lr]dquo;|\\"'
_SINGLE = r"&apos;|&#0*39;|&#[xX]0*27;|&[lr]squo;|\\'"
_MARKS = r""",;|·•/、，；｜#\[\]"'“”„‘’«»"""
#: One token: a quote in any spelling, a mark, a white-space character, a run of digits, another character reference, or a run of anything else.
#: No group is repeated: the JVM would match a long one by recursion.
TOKEN = rf"{_DOUBLE}|{_SINGLE}|[{_MARKS}]|[{_BLANK}]|[0-9]+|&#?[A-Za-z0-9]+;|[^{_MARKS}{_BLANK}0-9&\\]+|[&\\]"

_CLOSES = {'"': '"', "'": "'", "“": "”“", "„": "“”", "‘": "’", "«": "»", "»": "«"}
#: Separators wherever they stand outside quotes.
_STRONG = ";|·•、，；｜\n\t"
_SPACES = " \n\t"


def tokens(value: Column) -> Column:
    """The tokens of a field; together they are the field."""
    return F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0))


def skeleton(toks: Column) -> Column:
    """One symbol per token: w ordinary, 0 digits, a quote, mark or kind of white space as itself."""

    def symbol(t: Column) -> Column:
        return (
            F.when(t.rlike(rf"^(?:{_DOUBLE})$"), F.lit('"'))
            .when(t.rlike(rf"^(?:{_SINGLE})$"), F.lit("'"))
            .when(t.rlike(r"^[0-9]"), F.lit("0"))
            .when(t.isin("\n", "\r", "\u2028", "\u2029", "\u0085"), F.lit("\n"))
            .when(t == "\t", F.lit("\t"))
            .when(t.rlike(rf"^[{_BLANK}]$"), F.lit(" "))
            .when(t.rlike(rf"^[{_MARKS}]$"), t)
            .otherwise(F.lit("w"))
        )

    return F.array_join(F.transform(toks, symbol), "")


def symbols(value: str) -> tuple[list[str], str]:
    """Tokens and skeleton of one value, as the columns above give them."""
    toks = re.findall(TOKEN, value)
    out = []
    for t in toks:
        if re.fullmatch(_DOUBLE, t):
            out.append('"')
        elif re.fullmatch(_SINGLE, t):
            out.append("'")
        elif t[0] in "0123456789":
            out.append("0")
        elif t in "\n\r\u2028\u2029\u0085":
            out.append("\n")
        elif t == "\t":
            out.append("\t")
        elif re.fullmatch(f"[{_BLANK}]", t):
            out.append(" ")
        else:
            out.append(t if re.fullmatch(f"[{_MARKS}]", t) else "w")
    return toks, "".join(out)


def _trim(s: str, a: int, b: int) -> tuple[int, int]:
    while a < b and s[a] in _SPACES:
        a += 1
    while b > a and s[b - 1] in _SPACES:
        b -= 1
    return a, b


def _bare(s: str, a: int, b: int) -> tuple[int, int]:
    """Without outer white space and enclosing quotes."""
    a, b = _trim(s, a, b)
    while b - a >= 2 and s[b - 1] in _CLOSES.get(s[a], ""):
        a, b = _trim(s, a + 1, b - 1)
    return (b, b) if b - a == 1 and s[a] in "\"'" else (a, b)


def _closing(s: str, at: int, end: int) -> int:
    """Where the quote that opens at `at` closes, so that a separator or the end follows; -1 if nowhere."""
    ends = _CLOSES[s[at]]
    for k in range(at + 1, end):
        if s[k] in ends:
            n = k + 1
            while n < end and s[n] == " ":
                n += 1
            if n >= end or s[n] in _STRONG or s[n] == "," or (s[n] == "/" and n > k + 1):
                return k
    return -1


def resolve(s: str, names: bool) -> list[tuple[int, int]]:
    """Token spans of the values of a skeleton. names: a value may be a family name, a comma and a given name."""
    a, b = _bare(s, 0, len(s)) if s.strip(_SPACES)[:1] not in _CLOSES else _trim(s, 0, len(s))
    if b - a >= 2 and s[a] == "[" and s[b - 1] == "]":
        a, b = _trim(s, a + 1, b - 1)
    parts: list[tuple[int, int, str]] = []  # start, end, the separator after it
    start, k, tags = a, a, s[a : a + 1] == "#"
    while k < b:
        ch = s[k]
        fresh = not s[start:k].strip(_SPACES)
        if fresh and ch in _CLOSES and (c := _closing(s, k, b)) > 0:
            k = c + 1
            continue
        if ch in _STRONG:
            parts.append((start, k, ch))
        elif ch == ",":
            if 0 < k < b - 1 and s[k - 1] == "0" and s[k + 1] == "0":
                k += 1
                continue
            parts.append((start, k, ","))
        elif ch == "/" and s[max(a, k - 1)] in " /" and s[min(b - 1, k + 1)] in " /" or (tags and ch == " " and s[k + 1 : k + 2] == "#"):
            parts.append((start, k, ch))
        else:
            k += 1
            continue
        start = k = k + 1
    parts.append((start, b, ""))
    if names:
        parts = _whole_names(s, parts)
    return [(x, y) for x, y in (_bare(s, x, y) for x, y, _ in parts) if y > x]


def _whole_names(s: str, parts: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Put a family name and the given name after its comma together again: both are single words without quotes."""
    word = lambda p: (t := s[slice(*_trim(s, p[0], p[1]))]) and not set(t) & set(_CLOSES) and not set(t) & set(_SPACES)
    out, k = [], 0
    while k < len(parts):
        if parts[k][2] == "," and k + 1 < len(parts) and word(parts[k]) and word(parts[k + 1]):
            out.append((parts[k][0], parts[k + 1][1], parts[k + 1][2]))
            k += 2
        else:
            out.append(parts[k])
            k += 1
    return out


def _rules(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        spans = [[{"at": x, "n": y - x} for x, y in resolve(s, n)] for s, n in zip(f["skeleton"], f["names"], strict=True)]
        yield pd.DataFrame({"skeleton": f["skeleton"], "names": f["names"], "spans": spans})


def split_packed(fields: DataFrame, keep: list[str], value: str, names: Column, most_broadcast: int = BROADCAST_RULES) -> DataFrame:
    """One row per value in the fields of column ``value``: the columns ``keep``, pos (int, from 0) and item.

    ``names`` is a boolean column: values of the field may be names written family name first. Separators are ``;  |  ·  •  、  ，  ；``, tab
    and line end, a slash between spaces, a space before ``#`` in lists of tags, and a comma unless it is a decimal comma or stands inside a
    name. Quotes protect separators. Items lose outer white space, enclosing quotes in any spelling, and list brackets; empty items are
    dropped and not counted. Null, empty and blank fields give no row; a field with a single value gives one. Equal rows come out as often as they
    came in. ``keep`` may not name ``pos`` or ``item``; other columns of ``fields`` are not read.
    """
    if {"pos", "item"} & set(keep):
        raise ValueError("keep may not hold pos or item")
    f = fields.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(value).alias("v"), F.coalesce(names, F.lit(False)).alias("names")).filter("v is not null")
    f = f.withColumn("toks", tokens(F.col("v"))).withColumn("skeleton", skeleton(F.col("toks")))
    # fields of one value are most of all skeletons by rows but few by number: rules are far fewer than fields
    rules = cut(f.select("skeleton", "names").distinct().mapInPandas(_rules, "skeleton string, names boolean, spans array<struct<at:int,n:int>>"))
    size = rules.agg(F.sum(F.octet_length("skeleton") + 24 * F.size("spans") + 64)).first()[0] or 0
    if size <= most_broadcast:
        f = f.join(F.broadcast(rules), ["skeleton", "names"])
    else:
        # a skeleton that a third of all fields have is spread over parts, and the rules are repeated for each
        f = f.withColumn("part", F.pmod(F.xxhash64("v", *[f"k{i}" for i in range(len(keep))]), F.lit(SALTS)).cast("int"))
        f = f.join(rules.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["skeleton", "names", "part"])
    items = F.transform("spans", lambda s: F.array_join(F.slice("toks", s["at"] + 1, s["n"]), ""))
    return f.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.posexplode(items).alias("pos", "item"))


LIST_ATTRIBUTES = ("data-tags", "data-topics", "data-authors", "data-sizes")


def list_fields(nodes: DataFrame) -> DataFrame:
    """The list-valued attribute nodes: doc_id, node_id, name, value, each once, however often its page was delivered."""
    name, is_attribute = F.lower("name"), F.col("kind") == "attribute"
    data = is_attribute & name.isin(*LIST_ATTRIBUTES) & F.col("value").isNotNull()
    content = is_attribute & (name == "content") & F.col("value").isNotNull()
    meta = (F.col("kind") == "element") & (name == "meta") & (F.lower(F.trim(F.col("attrs")["name"])) == "keywords")
    # one pass: a content attribute meets its element under the element's id, which no attribute has
    rows = nodes.filter(data | content | meta).select("doc_id", F.when(content, F.col("parent_id")).otherwise(F.col("node_id")).alias("g"), F.when(~meta, F.struct("node_id", name.alias("name"), "value")).alias("x"), meta.alias("meta"), data.alias("data"))
    by = rows.groupBy("doc_id", "g").agg(F.collect_set("x").alias("xs"), F.max("meta").alias("meta"), F.max("data").alias("data"))
    return by.filter("data or meta").select("doc_id", F.explode("xs").alias("x")).select("doc_id", "x.node_id", "x.name", "x.value")


def packed_attributes(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, pos, item of every list-valued attribute of a node table (see ``split_packed``)."""
    return split_packed(cut(list_fields(nodes)), ["doc_id", "node_id"], "value", F.col("name") == "data-authors")
