"""Trees from tokens, with three policies for end tags that do not match, and their rows in document order."""

from __future__ import annotations

from collections.abc import Callable

import re
from dataclasses import dataclass, field

from canopyq.html import lexer
from canopyq.html.lexer import WHITE, lex

#: Elements that have no end tag.
VOID = frozenset("meta link img input br hr col area base embed keygen param source track wbr".split())
POLICIES = ("error", "void", "close")
#: Decides on an end tag that does not match: open elements and the tag's name to the number of elements that it closes, or None to refuse it.
Handler = Callable[[list[str], str], "int | None"]
#: Sort order of node kinds; ranks 2 and 3 are kept for processing instructions and comments, which never occur.
RANK = {"document": 0, "element": 1, "text": 4, "attribute": 5}

_blank = re.compile(f"[{WHITE}]*")
_decimal = re.compile("&#([0-9]+);")


class ParseError(ValueError):
    """An input that has no tree; code names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(slots=True)
class Node:
    """An element (name, attrs, children) or a text (value)."""

    name: str | None = None
    value: str | None = None
    parent: Node | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)


def unescape(text: str) -> str:
    """Decimal references first, then the four named ones in turn, so that a doubly escaped text is unescaped twice."""
    if "&" not in text:
        return text

    def char(m: re.Match) -> str:
        n = int(m.group(1)[:12])
        if n >= 1 << 32:
            return ""
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            raise ParseError("UNSUPPORTED", f"character reference {m.group()} is no character")
        return chr(n)

    text = _decimal.sub(char, text)
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = text.replace(name, sign)
    return text


def escape(text: str) -> str:
    """The five signs that unescape reads."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(sign, name)
    return text


def only_white(text: str) -> bool:
    return _blank.fullmatch(text) is not None


def build(html: str, mismatch: str | Handler = "error") -> Node:
    """The root element of a text. Raises ParseError where there is none or the tokens make no sense.

    ``mismatch`` says what an end tag does whose name is not that of the current element: ``error`` refuses it, ``void`` lets it close the
    current element all the same, ``close`` also closes the parent if the name is the parent's and the parent is not the root. A function gets the
    names of the open elements, the root first, and the end tag's name, and says how many of them the tag closes; None refuses it. Text and
    elements outside the root, and comments, belong to no tree. Elements still open at the end are kept.
    """
    if mismatch not in POLICIES and not callable(mismatch):
        raise ValueError(f"mismatch is one of {POLICIES} or a function")
    root = here = None
    open_tag = False
    tokens = lex(html)
    pushed: tuple[str, str] | None = None
    while True:
        token, pushed = pushed or next(tokens, None), None
        if token is None:
            break
        kind, text = token
        if kind == lexer.TEXT:
            if open_tag:
                raise ParseError("TextBeforePreviousClosed", "text inside a tag")
            if here is not None:
                here.children.append(Node(value=unescape(text), parent=here))
            else:
                unescape(text)
        elif kind == lexer.START:
            if text == "!DOCTYPE":
                _skip_doctype(tokens)
                continue
            if open_tag:
                raise ParseError("OpenTagBeforePreviousClosed", "tag inside a tag")
            open_tag = True
            node = Node(name=text, parent=here)
            if here is not None:
                here.children.append(node)
            here = node
            root = root or node
        elif kind == lexer.CLOSE:
            if not open_tag:
                raise ParseError("TagClosedBeforeOpened", "close sign without an open tag")
            open_tag = False
            if here is not None and here.name in VOID:
                here = here.parent
        elif kind == lexer.END:
            if open_tag:
                raise ParseError("OpenTagBeforePreviousClosed", "tag inside a tag")
            open_tag = True
            if here is None:
                raise ParseError("UNSUPPORTED", f"end tag {text} after the root was closed")
            if here.name != text:
                if callable(mismatch):
                    here = _handled(mismatch, here, text)
                    continue
                if mismatch == "error":
                    raise ParseError("EndTagMismatch", f"end tag {text} does not match open tag {here.name}")
                if mismatch == "close" and here.parent is not None and here.parent is not root and here.parent.name == text:
                    here = here.parent
            here = here.parent
        elif kind == lexer.SELF_CLOSE:
            if not open_tag:
                raise ParseError("TagClosedBeforeOpened", "close sign without an open tag")
            open_tag = False
            if here is None:
                raise ParseError("UNSUPPORTED", "close sign after the root was closed")
            here = here.parent
        elif kind == lexer.IDENTIFIER:
            if not open_tag:
                raise ParseError("IdentifierOutsideTag", f"identifier {text} outside a tag")
            follows = next(tokens, None)
            if follows is None:
                raise ParseError("UnexpectedEndOfTokens", "input ends inside a tag")
            value = ""
            if follows[0] == lexer.ASSIGN:
                literal = next(tokens, None)
                if literal is None:
                    raise ParseError("UnexpectedEndOfTokens", "input ends inside a tag")
                if here is not None and literal[0] != lexer.LITERAL:
                    raise ParseError("MissingLiteralAfterAssignmentSign", "attribute value is not quoted")
                value = literal[1]
            else:
                pushed = follows
            if here is None:
                raise ParseError("UNSUPPORTED", f"attribute {text} after the root was closed")
            here.attrs[text] = value
    if root is None:
        raise ParseError("MissingRootNode", "no element in the input")
    return root


def _handled(handler: Handler, here: Node, name: str) -> Node | None:
    """The current element after a handler has said how many elements an end tag closes."""
    names, node = [], here
    while node is not None:
        names.append(node.name)
        node = node.parent
    count = handler(names[::-1], name)
    if count is None:
        raise ParseError("EndTagMismatch", f"end tag {name} does not match open tag {here.name}")
    if not 0 <= count <= len(names):
        raise ValueError(f"a handler closes between 0 and {len(names)} elements, not {count}")
    for _ in range(count):
        here = here.parent
    return here


def _skip_doctype(tokens) -> None:
    first = next(tokens, None)
    if first is None:
        raise ParseError("UnexpectedEndOfTokens", "input ends inside a tag")
    if first != (lexer.IDENTIFIER, "html"):
        raise ParseError("MissingHtmlAfterDoctype", "doctype names no html")
    for kind, _ in tokens:
        if kind == lexer.CLOSE:
            return
    raise ParseError("MissingTagCloseAfterDoctype", "doctype is not closed")


def rows(root: Node) -> list[tuple]:
    """(node_id, parent_id, kind, kind_rank, name, value, only_whitespace, level, last_desc, attrs), in document order.

    Ids are pre-order ranks with the attributes right after their element; 0 is the document. last_desc is the greatest id in the
    subtree. No recursion, so depth is no limit.
    """
    out: list[list] = [[0, None, "document", 0, None, None, None, 0, 0, None]]
    stack: list[tuple[Node | None, int, int]] = [(root, 0, 1)]
    while stack:
        node, parent, level = stack.pop()
        if node is None:  # the subtree of row `parent` is complete
            out[parent][8] = len(out) - 1
            continue
        at = len(out)
        if node.name is None:
            out.append([at, parent, "text", 4, None, node.value, only_white(node.value), level, at, None])
            continue
        out.append([at, parent, "element", 1, node.name, None, None, level, at, node.attrs])
        for name, value in node.attrs.items():
            k = len(out)
            out.append([k, at, "attribute", 5, name, value, None, level + 1, k, None])
        stack.append((None, at, 0))
        stack += [(child, at, level + 1) for child in reversed(node.children)]
    out[0][8] = len(out) - 1
    return [tuple(r) for r in out]
