"""Lexer and tree builder: shapes of trees, policies, errors."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from canopyq.html import lexer, tree
from canopyq.html.tree import ParseError, build, rows


def shape(node):
    return node.value if node.name is None else (node.name, node.attrs, [shape(c) for c in node.children])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<html><a class="beans"></a><b><ba/>yo</b></html>', ("html", {}, [("a", {"class": "beans"}, []), ("b", {}, [("ba", {}, []), "yo"])])),
        ('<a\nx="1"\ny="2"></a\n>', ("a", {"x": "1", "y": "2"}, [])),
        ("<script defer></script>", ("script", {"defer": ""}, [])),
        ('<script defer src="hi"></script>', ("script", {"defer": "", "src": "hi"}, [])),
        ("<div>foo > bar < baz</div>", ("div", {}, ["foo > bar < baz"])),
        ("<script>foo<bar></baz></script>", ("script", {}, ["foo<bar></baz>"])),
        ("<div>&amp;&quot;&#39;&lt;&gt;&#96;</div>", ("div", {}, ["&\"'<>`"])),
        ("<div>&amp;lt;&copy;&#x41;</div>", ("div", {}, ["<&copy;&#x41;"])),
        ('<a t="the cow says \\"moo\\"."></a>', ("a", {"t": 'the cow says "moo".'}, [])),
        ("<script json='{\"hello\":\"world\"}'></script>", ("script", {"json": '{"hello":"world"}'}, [])),
        ("<!DOCTYPE html><div></div>", ("div", {}, [])),
        ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML" "x.dtd"><div></div>', ("div", {}, [])),
        ("<!doctype html><div></div>", ("!doctype", {"html": ""}, [("div", {}, [])])),
        ("before<div>in</div>after<p>x</p>", ("div", {}, ["in"])),
        ("<div>a<!-- c -->b</div>", ("div", {}, ["a", "b"])),
        ("<div>a<!-- never closed", ("div", {}, ["a"])),
        ('<p a="1" a="2"></p>', ("p", {"a": "2"}, [])),
        ("<p>=x</p>", ("p", {}, ["x"])),
        ('<u><div></div foo="x"></u>', ("u", {"foo": "x"}, [("div", {}, [])])),
        ("<div>&#4294967296;x</div>", ("div", {}, ["x"])),
        ("<div><p>open", ("div", {}, [("p", {}, ["open"])])),
    ],
)
def test_trees(html, want):
    assert shape(build(html)) == want


def test_void_elements_have_no_children():
    root = build("<div>" + "".join(f"<{v}>" for v in sorted(tree.VOID)) + "</div>")
    assert [c.name for c in root.children] == sorted(tree.VOID)
    assert not any(c.children for c in root.children)


MISMATCHED = "<html><div><p>hello</div><b>x</b></html>"


def test_policies():
    with pytest.raises(ParseError) as e:
        build(MISMATCHED)
    assert e.value.code == "EndTagMismatch"
    assert shape(build(MISMATCHED, "void")) == ("html", {}, [("div", {}, [("p", {}, ["hello"]), ("b", {}, ["x"])])])
    assert shape(build(MISMATCHED, "close")) == ("html", {}, [("div", {}, [("p", {}, ["hello"])]), ("b", {}, ["x"])])
    with pytest.raises(ValueError, match="mismatch"):
        build("<a></a>", "other")


@pytest.mark.parametrize(
    ("html", "code"),
    [
        ("", "MissingRootNode"),
        ("text", "MissingRootNode"),
        ("<a href=x></a>", "MissingLiteralAfterAssignmentSign"),
        ("<div>></div>", "TagClosedBeforeOpened"),
        ("<a <b></b></a>", "OpenTagBeforePreviousClosed"),
        ("<a x", "UnexpectedEndOfTokens"),
        ("<!DOCTYPE svg><a></a>", "MissingHtmlAfterDoctype"),
        ("<!DOCTYPE html", "MissingTagCloseAfterDoctype"),
        ("<a></a></b>", "UNSUPPORTED"),
        ("<a>&#55296;</a>", "UNSUPPORTED"),
    ],
)
def test_errors(html, code):
    with pytest.raises(ParseError) as e:
        build(html)
    assert e.value.code == code


def test_rows_are_numbered_in_document_order():
    got = rows(build('<html id="x"><p>a</p><br></html>'))
    assert [(r[0], r[1], r[2], r[4], r[5], r[7], r[8]) for r in got] == [
        (0, None, "document", None, None, 0, 5),
        (1, 0, "element", "html", None, 1, 5),
        (2, 1, "attribute", "id", "x", 2, 2),
        (3, 1, "element", "p", None, 2, 4),
        (4, 3, "text", None, "a", 3, 4),
        (5, 1, "element", "br", None, 2, 5),
    ]


def test_depth_is_no_limit():
    deep = 20_000
    assert len(rows(build("<a>" * deep + "</a>" * deep))) == deep + 1


@given(st.text(alphabet="<>/=\"'ab !-\\&#;1\n ", max_size=60))
def test_any_text_is_a_tree_or_an_error(html):
    for policy in tree.POLICIES:
        try:
            got = rows(build(html, policy))
        except ParseError:
            continue
        assert [r[0] for r in got] == list(range(len(got)))
        assert all(r[8] >= r[0] for r in got)


@given(st.text(alphabet="<>&\"' ab", max_size=30))
def test_escaping_is_undone(text):
    assert tree.unescape(tree.escape(text.replace("&", "and"))) == text.replace("&", "and")


def test_white_space_is_unicode_white_space():
    assert tree.only_white(" \t 　 ")
    assert not tree.only_white("\x1c")
    assert [t for t, _ in lexer.lex("<a b>")] == [lexer.START, lexer.IDENTIFIER, lexer.CLOSE]


def test_a_handler_decides_on_mismatched_tags():
    def closes(names, tag):
        """Close up to the tag, ignore one that is not open, refuse one named x."""
        if tag == "x":
            return None
        return names[::-1].index(tag) + 1 if tag in names else 0

    shape = lambda node: (node.name, [shape(c) for c in node.children if c.name])
    root = tree.build("<html><div><p><b>1</div><i>2</i></q></html>", closes)
    assert shape(root) == ("html", [("div", [("p", [("b", [])])]), ("i", [])])
    with pytest.raises(tree.ParseError) as e:
        tree.build("<html><p></x></html>", closes)
    assert e.value.code == "EndTagMismatch"
    with pytest.raises(ValueError, match="handler"):
        tree.build("<html><p></q></html>", lambda names, tag: 9)
