"""Main body of pages: site templates are found as element subtrees that recur over the pages of a host, and removed.

Each page is read once in document order, and every subtree in it that holds text is hashed, from the text leaves (masked text under its element's name) up to
the body. The hashes are counted per host and over hosts. A second look at each page, at its tree and the hashes that recur but not
at its texts, deletes the outermost blocks that are template; in a block that stays it goes down to the blocks inside. The text nodes that remain are the main body.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.llm import residue
from canopyq.llm.lookalike import rewriter
from canopyq.session import cut

#: Pages of a host, or hosts, over which a subtree must recur to be a template, and shares of a host's pages, or of all hosts.
LEAST_PAGES, LEAST_HOSTS, PAGES_SHARE, HOSTS_SHARE = 3, 3, 0.02, 0.01
#: Share of a host's pages over which a whole block must recur that may be the body itself.
BODY_SHARE = 0.1
#: Recurring hashes up to which they are broadcast (9 bytes each, counted first); beyond, they are joined by a shuffle over SALTS parts of each.
MOST_BROADCAST, SALTS = 1_000_000, 32

# Element names by what they do.
BLOCKS = frozenset("div section article main aside form dialog nav header footer center menu address table tr td".split())
LISTS = frozenset("ul ol dl".split())
SIDES = frozenset("aside form dialog nav header footer menu address".split())
HIDDEN = frozenset("head noscript script style title template select option textarea svg iframe object".split())
CONTROLS = frozenset("button label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th".split())
CODE = frozenset(residue.CODE_ELEMENTS)
CREDITED = frozenset("p div span small address".split())

#: A date or a running number, as after the name of an author or user.
_stamp = re.compile(r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4})(?!\d)|#\d+")
_stop = re.compile(r"[.!?。！？।]")
#: Dates and years, which a template fills in; other numbers tell pages apart.
_dates = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|(?<!\d)(?:19|20)\d\d(?!\d)")
_digit = re.compile(r"\d")
_dotted = re.compile(r"[\w-]\.[\w-]")
_host = re.compile(r"[\w-]+(?:\.[\w-]+)+")

# what is kept of an element and of a text
BLOCK, HEADING, TITLE, WHOLE, SIDE, PARAGRAPH, CELL, CLASSED = (1 << k for k in range(8))
LINK, QUIET, LEFT_OUT = 1, 2, 4
# over what a hash recurs: hosts, pages of its host, so many of these that a body can be none
OF_HOSTS, OF_HOST, OF_MOST = 1, 2, 3
_P, _M = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Reader:
    """Reads pages; keeps what it made of texts that recur."""

    def __init__(self):
        self.rewrite = rewriter().form
        self.known: dict[str, tuple[int, bool, bool]] = {}
        self.tags: dict[str, tuple[int, bool, bool, bool, int]] = {}
        self.strong = {self.tag(name)[0] for name in ("strong", "b")}
        self.credited = {self.tag(name)[0] for name in CREDITED}

    def tag(self, name: str) -> tuple[int, bool, bool, bool, int]:
        """Hash of an element name, whether it is a link, code or a control, and its kind."""
        if (k := self.tags.get(name)) is None:
            kind = BLOCK * (name in BLOCKS) | HEADING * (name in HEADINGS) | TITLE * (name == "h1") | WHOLE * (name in LISTS) | SIDE * (name in SIDES) | PARAGRAPH * (name == "p") | CELL * (name in CELLS) 
            k = self.tags[name] = xxhash.xxh64_intdigest(name), name == "a", name in CODE, name in CONTROLS, kind
        return k

    def text(self, value: str) -> tuple[int, bool, bool]:
        """Hash of the masked text, whether it is residue, and whether it has the form of a line that names an author."""
        if (k := self.known.get(value)) is None:
            if len(self.known) > 100_000:
                self.known.clear()  # only a memory of results: they are found again
            form = value if value.isascii() else self.rewrite(value)
            mask, credit = " ".join(form.lower().split()), False
            if _dotted.search(mask):
                mask = _host.sub("@", mask)
            if _digit.search(mask):
                mask, credit = _dates.sub("0", mask), credited(form.strip())
            k = self.known[value] = xxhash.xxh64_intdigest(mask), residue.whole(form) not in ("", *residue.UNSURE), credit
        return k

    def read(self, rows: list[tuple[int, int, str, str | None, bool]]) -> tuple[list[int], bytes] | None:
        """The hashes of a page and its tree. rows: node_id, parent_id, tag (empty for a text), value, whether it has a class; in document order, each once."""
        at: dict[int, int] = {}
        up, kinds = array("i"), bytearray()
        # of each element: what holds its children (a text as its number, an element as its number inverted), the hash of its name
        kids: list[list[int]] = []
        names, link, code, control = [], [], [], []
        node, owner, size, what, leaf = array("i"), array("i"), array("i"), bytearray(), []
        for k, p, tag, value, classed in rows:
            e = at.get(p, -1)
            if tag:
                if e == -2 or tag in HIDDEN:
                    at[k] = -2
                    continue
                name, is_link, is_code, is_control, kind = self.tag(tag)
                at[k] = new = len(up)
                if e >= 0:
                    kids[e].append(~new)
                    is_link, is_code, is_control = is_link or link[e], is_code or code[e], is_control or control[e]
                up.append(e)
                kids.append([])
                names.append(name)
                link.append(is_link)
                code.append(is_code)
                control.append(is_control)
                kinds.append(kind | CLASSED * classed)
            elif e >= 0:
                h, bad, credit = self.text(value)
                kids[e].append(len(node))
                out = not code[e] and bad or credit and names[e] in self.credited or control[e]
                node.append(k)
                owner.append(e)
                size.append(len(value))
                what.append(LINK * link[e] | QUIET * (code[e] or kinds[e] & CELL > 0) | LEFT_OUT * bool(out))
                leaf.append((names[e] * _P + h) & _M)
        return self._tree(up, kinds, kids, names, node, owner, size, what, leaf) if len(node) else None

    def _tree(self, up, kinds, kids, names, node, owner, size, what, leaf) -> tuple[list[int], bytes]:
        """Hashes from the leaves up. An element with one child that holds text has that child's hash; slots point to the distinct hashes of the page. Cells and code have none."""
        slots: dict[int, int] = {}
        slot = slots.setdefault
        n = len(up)
        leaf_slot = array("i", [-1 if w & QUIET else slot(h, len(slots)) for h, w in zip(leaf, what, strict=True)])
        mine, lead, shape = [0] * n, array("i", [-1] * n), [0] * n
        own, links = array("i", [-1] * n), array("i", [-1] * n)
        # 2: all text is in links, 1: in links and headings, 0: neither
        only_links, loud, has_link = [0] * n, [False] * n, [False] * n
        for e in range(n - 1, -1, -1):
            first, h, count, linked, speaks, some, inner = -1, 0, 0, 2, False, False, []
            for c in kids[e]:
                if c >= 0:
                    t, x = c, leaf[c]
                    if what[c] & LINK:
                        some = True
                    else:
                        linked = min(linked, 1 if kinds[e] & HEADING or names[e] in self.strong else 0)
                    speaks = speaks or not what[c] & QUIET
                else:
                    c = ~c
                    if (t := lead[c]) < 0:
                        continue
                    x = mine[c]
                    linked, some = min(linked, only_links[c]), some or has_link[c]
                    speaks = speaks or loud[c]
                    inner.append(shape[c])
                if count == 0:
                    first, h = t, x
                else:
                    h = ((names[e] + h if count == 1 else h) * _P + x + 1) & _M
                count += 1
            if not count:
                continue
            lead[e], mine[e], loud[e] = first, h, speaks
            if speaks:
                own[e] = slot(h, len(slots))
            only_links[e], has_link[e] = linked, some
            if linked:
                # the subtree with the texts of its links and headings masked: names, and whether there is a class, repeats left out
                kind = kinds[e]
                h = (names[e] + (kind & CLASSED)) * _P & _M
                for x in dict.fromkeys(inner):
                    h = (h * _P + x + 7) & _M
                shape[e] = h
                if some and (kind & (BLOCK | PARAGRAPH) or kind & WHOLE and kind & CLASSED if linked == 2 else kind & BLOCK and kind & (SIDE | CLASSED)):
                    links[e] = slot(h, len(slots))
        # elements of a kind: their name and that of the element around their first text
        order: dict[tuple[int, int], int] = {}
        like = array("i", [order.setdefault((names[e], names[owner[t]]), len(order)) if t >= 0 else -1 for e, t in enumerate(lead)])
        blob = array("i", [n, len(node)]).tobytes() + b"".join(x.tobytes() for x in (up, lead, own, links, like, node, owner, size, leaf_slot)) + kinds + what
        return [h - (1 << 63) for h in slots], zlib.compress(blob, 1)


def credited(line: str) -> bool:
    """Whether a line is words without the end of a sentence, then a sign and a date or running number, and perhaps more such words."""
    m = _stamp.search(line, 3)
    return m is not None and not _stop.search(line, 0, m.start()) and not _stop.search(line, m.end()) and (m.end() == len(line) or line[m.end()].isspace()) and not (line[m.start() - 1].isascii() and line[m.start() - 1].isalnum())


def _main(up, like, prose, titles, blocks) -> list[bool]:
    """The elements that the main body is in: from the root down to the block that holds the page's own headline, else to those of one kind that hold most prose of the page's own."""
    n = len(up)
    kids: list[list[int]] = [[] for _ in range(n)]
    main = [u < 0 for u in up]
    for e in range(n):
        if up[e] >= 0 and blocks[e]:
            kids[up[e]].append(e)
    for e in range(n):
        if not main[e] or not kids[e]:
            continue
        if found := [c for c in kids[e] if titles[c]]:
            main[found[0]] = True
            continue
        kin: dict[int, int] = {}
        for c in kids[e]:
            kin[like[c]] = kin.get(like[c], 0) + prose[c]
        most = max(kin, key=lambda k: kin[k])
        if kin[most] > prose[e] - sum(kin.values()):
            for c in kids[e]:
                main[c] = like[c] == most
    return main


def decide(blob: bytes, flags: dict[int, int]) -> list[int]:
    """The text nodes of the main body of a page. flags: of the slots whose hash recurs, over what."""
    data = zlib.decompress(blob)
    n, m = array("i", data[:8])
    at = 8

    def ints(count: int) -> array:
        nonlocal at
        a = array("i")
        z = at + 4 * count
        a.frombytes(data[at:z])
        at = z
        return a

    up, lead, own, links, like = ints(n), ints(n), ints(n), ints(n), ints(n)
    node, owner, size, leaf_slot = ints(m), ints(m), ints(m), ints(m)
    kinds, what = data[at : at + n], data[at + n :]
    # a list without a class goes only as a whole, and so does a paragraph of more than links
    blocks = [bool(k & BLOCK or links[e] >= 0 or k & WHOLE and k & CLASSED) for e, k in enumerate(kinds)]
    block, side = list(blocks), [bool(k & (SIDE | CLASSED)) for k in kinds]
    # what an element has from those around it: whether a recurring block or a heading holds it
    covered, heading = [0] * n, [0] * n
    for e in range(n):
        u = up[e]
        covered[e] = max(covered[u] if u >= 0 else 0, flags.get(own[e], 0) if block[e] else 0)
        heading[e] = kinds[e] & (HEADING | TITLE) | (heading[u] if u >= 0 else 0)
    # of each element: leaves, recurring leaves, characters of prose of the page's own, its own headlines, and whether it is or holds a block
    leaves, again, prose, titles = ([0] * n for _ in range(4))
    recurs = [0 if what[t] & QUIET else max(covered[owner[t]], flags.get(leaf_slot[t], 0)) for t in range(m)]
    for t, e in enumerate(owner):
        if not what[t] & QUIET:
            leaves[e] += 1
            again[e] += recurs[t] > 0
        if heading[e] & TITLE:
            titles[e] += recurs[t] < OF_HOST or bool(what[t] & LEFT_OUT)
        elif recurs[t] < OF_HOST and not what[t] & LINK and not heading[e]:
            prose[e] += size[t]
    for e in range(n - 1, -1, -1):
        if (u := up[e]) >= 0:
            leaves[u] += leaves[e]
            again[u] += again[e]
            prose[u] += prose[e]
            titles[u] += titles[e]
            blocks[u] = blocks[u] or blocks[e]
    # a block goes if it recurs as a whole, in half of its leaves or as a shape of links; by its first leaf only if it is marked as one beside the text
    main = _main(up, like, prose, titles, blocks)
    gone = [False] * n
    for e in range(n):
        if up[e] >= 0 and gone[up[e]]:
            gone[e] = True
        elif (block[e] or kinds[e] & WHOLE) and leaves[e]:
            whole = flags.get(own[e], 0)
            if main[e] or not block[e]:
                gone[e] = whole == OF_MOST
            else:
                gone[e] = bool(whole or 2 * again[e] > leaves[e] or side[e] and (recurs[lead[e]] and leaves[e] > 1 or 2 * again[e] >= leaves[e]) or links[e] in flags)
    return [node[t] for t in range(m) if not what[t] & LEFT_OUT and not gone[owner[t]]]


@functools.cache
def _reader() -> Reader:
    """One reader for each Python worker."""
    return Reader()


_SCHEMA = "doc_id long, site string, hashes array<long>, tree binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by doc_id and node_id; a page may go on in the next batch. A page delivered again has its rows twice."""
    read = _reader().read
    doc, site, rows = None, None, []
    out: list[tuple] = []

    def close() -> None:
        if (page := read(rows)) is not None:
            out.append((doc, site, *page))

    def flush() -> pa.RecordBatch:
        made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, names=["doc_id", "site", "hashes", "tree"])

    for b in batches:
        for d, k, p, t, v, c, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if d != doc:
                if doc is not None:
                    close()
                doc, site, rows = d, None, []
            site = site or s  # on the root alone
            if not rows or rows[-1][0] != k:
                rows.append((k, p, t, v, c))
        if len(out) >= 500:
            yield flush()
    if doc is not None:
        close()
    if out:
        yield flush()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, nodes = [], []
        for doc, blob, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
            kept = decide(blob, {x >> 2: x & 3 for x in found or ()})
            docs += [doc] * len(kept)
            nodes += kept
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(nodes, pa.int32())], names=["doc_id", "node_id"])


def recurring(pages: DataFrame, least_pages: int = LEAST_PAGES, least_hosts: int = LEAST_HOSTS) -> tuple[DataFrame, DataFrame]:
    """k, flag of the hashes that recur over pages of their host (k is of host and hash), and k of those that recur over hosts. Pages without a site count as of no host."""
    at_least = lambda count, least, n, share: F.col(count) >= F.greatest(F.lit(least), F.ceil(F.col(n) * share))
    # a page has each of its hashes once, so rows are pages; a hot host or hash is added up before it is shuffled
    per_host = pages.filter("site is not null").select("site", F.explode("hashes").alias("h")).groupBy("h", "site").agg(F.count(F.lit(1)).alias("pages"))
    of_host = pages.filter("site is not null").groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    own = per_host.join(of_host, "site").filter(at_least("pages", least_pages, "n", PAGES_SHARE))
    own = own.select(_key(F.col("site"), F.col("h")).alias("k"), F.when(at_least("pages", least_pages, "n", BODY_SHARE), OF_MOST).otherwise(OF_HOST).cast("byte").alias("flag"))
    hosts = per_host.groupBy("h").agg(F.count(F.lit(1)).alias("hosts")).filter(F.col("hosts") >= least_hosts)
    far = hosts.crossJoin(F.broadcast(of_host.agg(F.count(F.lit(1)).alias("all")))).filter(at_least("hosts", least_hosts, "all", HOSTS_SHARE))
    return own, far.select(F.col("h").alias("k"))


def main_text_nodes(nodes: DataFrame, least_pages: int = LEAST_PAGES, least_hosts: int = LEAST_HOSTS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, node_id of the text nodes of each page's main body, each once.

    An empty table gives nothing. Null, empty and blank texts, template residue, text in head, noscript and form controls, and lines that name
    an author or user are never part of a body. Pages without a site count as no host, so only what recurs over hosts is deleted from them.
    """
    text = "kind = 'text' and value is not null and not coalesce(only_whitespace, false) and value <> ''"
    tag = F.when(F.col("kind") == "element", F.lower("name")).otherwise("").alias("t")
    has_class = F.coalesce(F.map_contains_key("attrs", F.lit("class")), F.lit(False)).alias("c")
    rows = nodes.filter(f"kind = 'element' or ({text})").select("doc_id", "node_id", "parent_id", tag, F.when(F.col("kind") == "text", F.col("value")).alias("v"), has_class, F.when(F.col("parent_id") == 0, F.col("site")).alias("site"))
    pages = cut(rows.repartition("doc_id").sortWithinPartitions("doc_id", "node_id").mapInArrow(_read, _SCHEMA))
    own, far = (cut(x) for x in recurring(pages, least_pages, least_hosts))
    own, far = own.withColumnRenamed("flag", "own"), far.withColumn("far", F.lit(OF_HOSTS))
    hashes = pages.select("doc_id", "site", F.posexplode("hashes").alias("slot", "h")).withColumn("k", _key(F.col("site"), F.col("h")))
    own_on, far_on = ["k"], ["h"]
    far = far.withColumnRenamed("k", "h")
    if own.count() + far.count() <= most_broadcast:
        own, far = F.broadcast(own), F.broadcast(far)
    else:
        # a hash on a third of all pages is spread over parts; only the few that recur are repeated for each
        hashes = hashes.withColumn("part", F.pmod("doc_id", F.lit(SALTS)).cast("int"))
        own, far = (x.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))) for x in (own, far))
        own_on, far_on = ["k", "part"], ["h", "part"]
    hashes = hashes.drop("site").join(own, own_on, "left").join(far, far_on, "left").filter("own is not null or far is not null")
    flags = hashes.groupBy("doc_id").agg(F.collect_list(F.col("slot") * 4 + F.coalesce("own", "far")).alias("found"))
    return pages.select("doc_id", "tree").join(flags, "doc_id", "left").select("doc_id", "tree", "found").mapInArrow(_decide, "doc_id long, node_id int")


def _key(site: Column, h: Column) -> Column:
    return F.xxhash64(site, h)
