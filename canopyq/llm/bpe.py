"""Encoding with a public byte-level BPE vocabulary, exact for text of any length.

Text is cut only where the pre-tokenizer must cut as well (``SAFE``), or, inside an unsplit run, at halves of
the run. Blocks are encoded in parallel and put together in a tree: at a join, a window of tokens on both sides is
encoded again and grows until its outermost tokens are those that both sides already had. Byte-level BPE is determined by the pairs
of neighbouring tokens, so an agreeing window makes the whole sequence the one that direct encoding gives.
"""

from __future__ import annotations

import base64
import functools
from dataclasses import dataclass

import regex

#: A pre-token always ends here: before white space after something else, before a mark after a letter or digit.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")
CLASS = regex.compile(r"(\s)|(\p{L})|(\p{N})|.", regex.S)
#: Bytes of an unsplit run that are encoded at once.
LEAF_BYTES = 4096
#: Tokens on each side of a join that are first encoded again.
FIRST_WINDOW = 4


def default_path() -> str:
    """The installed vocabulary file of byte_bpe_50k."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@functools.lru_cache(maxsize=4)
def load(path: str):
    """A tiktoken encoding without special tokens, made once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("canopyq", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def splitter(path: str):
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def join(enc, left: list[int], right: list[int]) -> list[int]:
    """Ids of the two byte strings of one unsplit run put together, from the ids of each."""
    if not left or not right:
        return left + right
    w = FIRST_WINDOW
    while True:
        a, b = min(w, len(left)), min(w, len(right))
        data = b"".join(enc.decode_single_token_bytes(t) for t in (*left[len(left) - a :], *right[:b]))
        mid = enc._encode_single_piece(data)
        if (a == len(left) or mid[0] == left[len(left) - a]) and (b == len(right) or mid[-1] == right[b - 1]):
            return left[: len(left) - a] + list(mid) + right[b:]
        w *= 2


def run_ids(enc, data: bytes) -> list[int]:
    """Ids of one unsplit run: leaves of LEAF_BYTES, joined pairwise, level by level."""
    if len(data) <= LEAF_BYTES:
        return list(enc._encode_single_piece(data))
    level = [list(enc._encode_single_piece(data[i : i + LEAF_BYTES])) for i in range(0, len(data), LEAF_BYTES)]
    while len(level) > 1:
        level = [join(enc, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def text_ids(path: str, text: str) -> list[int]:
    """Ids of a text of any form."""
    enc = load(path)
    if len(text) <= LEAF_BYTES:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for start, end, unsplit in spans(text, LEAF_BYTES):
        if not unsplit:
            ids += enc.encode_ordinary(text[start:end])
            continue
        for m in splitter(path).finditer(text, start, end):
            ids += run_ids(enc, m.group().encode("utf-8", "surrogatepass"))
    return ids


def spans(text: str, size: int) -> list[tuple[int, int, bool]]:
    """Stretches of about `size` characters that end at safe places; True for one that has no such place for so long."""
    out, start, n = [], 0, len(text)
    while start < n:
        if n - start <= size:
            out.append((start, n, False))
            break
        m = SAFE.search(text, start + size // 2, min(n, start + size + 2))
        if m:
            out.append((start, m.start(), False))
        else:
            m = SAFE.search(text, start + size)
            out.append((start, m.start() if m else n, True))
        start = out[-1][1]
    return out


@dataclass
class Block:
    """An encoded block; head and tail are the ids of its first and last pre-token. They are all its ids if it has only one."""

    ids: list[int]
    head: int
    tail: int
    pieces: int


def block(path: str, text: str) -> Block:
    """Encode one block of a long text."""
    pieces = [m.span() for m in splitter(path).finditer(text)]
    if not pieces:
        return Block([], 0, 0, 0)
    enc = load(path)
    of = lambda s: run_ids(enc, text[s[0] : s[1]].encode("utf-8", "surrogatepass"))
    head = of(pieces[0])
    if len(pieces) == 1:
        return Block(head, len(head), len(head), 1)
    # the last pre-token stays in the rest: white space before it splits differently at the end of a text
    return Block(head + text_ids(path, text[pieces[0][1] :]), len(head), len(of(pieces[-1])), len(pieces))


def unite(path: str, a: Block, b: Block, inside_run: bool) -> Block:
    """Put two neighbouring blocks together; inside_run: they were cut inside an unsplit run."""
    if not a.pieces or not b.pieces:
        return b if not a.pieces else a
    if not inside_run:
        return Block(a.ids + b.ids, a.head, b.tail, a.pieces + b.pieces)
    cut = len(a.ids) - a.tail
    mid = join(load(path), a.ids[cut:], b.ids[: b.head])
    head = len(mid) if a.pieces == 1 else a.head
    tail = len(mid) if b.pieces == 1 else b.tail
    return Block(a.ids[:cut] + mid + b.ids[b.head :], head, tail, a.pieces + b.pieces - 1)


def tree(path: str, blocks: list[Block], inside: list[bool]) -> list[int]:
    """Ids of a text from its blocks in order; inside[i]: block i begins inside a run that block i - 1 began."""
    level = list(zip(blocks, inside, strict=True))
    while len(level) > 1:
        level = [
            (unite(path, level[i][0], level[i + 1][0], level[i + 1][1]), level[i][1]) if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0][0].ids if level else []


def cuts(text: str, size: int) -> list[tuple[str, bool]]:
    """Blocks of a long text, each with whether it begins inside an unsplit run.

    A run without a safe place is halved until its parts have at most `size` characters. A cut inside a run has three characters of
    the same class on both sides, so the pre-tokenizer sees the run alike from either side; where there is no such place the run
    stays whole.
    """
    out: list[tuple[str, bool]] = []

    def alike(at: int) -> bool:
        near = text[max(0, at - 3) : at + 3]
        return len(near) == 6 and len({m.lastindex for m in CLASS.finditer(near)}) == 1

    def halves(start: int, end: int, inside: bool) -> None:
        todo = [(start, end, inside)]
        while todo:
            s, e, flag = todo.pop()
            mid = (s + e) // 2
            if e - s > size:
                for step in range((e - s) // 4):
                    at = mid + (step // 2 if step % 2 else -step // 2)
                    if alike(at):
                        todo += [(at, e, True), (s, at, flag)]
                        break
                else:
                    out.append((text[s:e], flag))
            else:
                out.append((text[s:e], flag))

    for s, e, unsplit in spans(text, size):
        if unsplit:
            halves(s, e, False)
        else:
            out.append((text[s:e], False))
    return out
