"""Tokens of HTML text. The lexer never fails; what is wrong with the tokens is for the tree builder to say."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Unicode White_Space, which differs from Python's str.isspace on U+001C to U+001F.
WHITE = "\t-\r \u0085   -     　"

START, END, SELF_CLOSE, CLOSE, ASSIGN, LITERAL, IDENTIFIER, TEXT, COMMENT = "StartTag EndTag TagCloseAndEnd TagClose AssignmentSign Literal Identifier Text Comment".split()

_start_name = re.compile(f"[^>/{WHITE}]*")
_end_name = re.compile(f"[^>{WHITE}]*")
_identifier = re.compile(f'[^<>/="{WHITE}]+')
_skipped = re.compile(f"[{WHITE}]+")
_tag_follows = re.compile(f"<[^{WHITE}]")
_script_ends = re.compile(f"</script(?=[>{WHITE}]|$)")
_quoted = {q: re.compile(rf"((?:[^\\{q}]|\\+[^\\])*)(?:{q}|\\*$)", re.S) for q in "\"'"}
_backslashes = re.compile(r"\\+")


def lex(text: str) -> Iterator[tuple[str, str]]:
    """Pairs of a token type and its text, in order. Comments come out too; nothing after an unterminated comment does."""
    at, end, in_tag, in_script = 0, len(text), False, False
    while at < end:
        ch = text[at]
        if ch == "<":
            if text.startswith("<!--", at):
                close = text.find("-->", at + 4)
                if close < 0:
                    return
                yield COMMENT, text[at + 4 : close]
                at = close + 3
                continue
            if text.startswith("/", at + 1):
                m = _end_name.match(text, at + 2)
                at, in_tag, in_script = m.end(), True, False
                yield END, m.group()
                continue
            if _tag_follows.match(text, at):
                m = _start_name.match(text, at + 1)
                at, in_tag = m.end(), True
                in_script = in_script or m.group() == "script"
                yield START, m.group()
                continue
        elif ch == ">":
            at, in_tag = at + 1, False
            yield CLOSE, ">"
            continue
        elif ch == "=":
            at += 1
            yield ASSIGN, "="
            continue
        elif ch == "/" and text.startswith(">", at + 1):
            at, in_tag, in_script = at + 2, False, False
            yield SELF_CLOSE, "/>"
            continue
        if not in_tag:
            m = (_script_ends if in_script else _tag_follows).search(text, at + 1)
            stop = m.start() if m else end
            yield TEXT, text[at:stop]
            at = stop
        elif ch in _quoted:
            m = _quoted[ch].match(text, at + 1)
            yield LITERAL, _backslashes.sub("", m.group(1))
            at = m.end()
        elif m := _identifier.match(text, at):
            yield IDENTIFIER, m.group()
            at = m.end()
        else:
            m = _skipped.match(text, at)
            at = m.end() if m else at + 1
