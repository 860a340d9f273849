"""Atomic values over nodes, variables, comparisons of several items, and plans of range axes, on one small page."""

import pytest

from canopyq import api
from canopyq.sources.pages import html_nodes

PAGE = (
    "<html><body><div id='d1'><p>a</p><p>b</p><ul><li class='x'>1</li><li class='y'>2</li></ul></div>"
    "<div id='d2'><p>b</p><span lang='x'>q</span></div><div id='d3'></div></body></html>"
)


@pytest.fixture(scope="module")
def nodes(spark):
    return html_nodes(spark.createDataFrame([(1, PAGE)], "id long, html string"), "id", "html", "close").persist()


def values(nodes, expression, **options):
    """Values of atomic items, names and string values of nodes, in order."""
    return [r.value if r.kind != "element" else r.name for r in api.find(nodes, expression, **options).collect()]


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("//p ! string(.)", ["a", "b"]), ("for $x in //div return count($x/p)", ["0", "1", "2"]), ("//div/count(p)", ["0", "1", "2"]), ("//p/data(.)", ["a", "b"]),
        ("distinct-values(//p)", ["a", "b"]), ("sum(//li)", ["3"]), ("avg(//li)", ["1.5"]), ("max(//li)", ["2"]), ("min(//li)", ["1"]), ("sum(//x)", ["0"]), ("max(//x)", []),
        ("string-join(//p, ',')", ["a,b,b"]), ("string-join(//x, ',')", [""]), ("1 to count(//p)", ["1", "2", "3"]), ("5 to count(//p)", []), ("//p => count()", ["3"]),
        ("tokenize('a b  c')", ["a", "b", "c"]), ("tokenize(string-join(//p, '-'), '-')", ["a", "b"]), ("replace('abc', 'b', 'x')", ["axc"]), ("translate('abc', 'ab', 'x')", ["xc"]),
        ("abs(-3)", ["3"]), ("floor(2.5)", ["2"]), ("ceiling(2.5)", ["3"]), ("round(2.5)", ["3"]), ("name(//li)", ["li"]), ("//div/name(.)", ["div"]),
        ("count(//p/string(.))", ["3"]), ("exists(//x/string(.))", ["false"]), ("if (//p) then //p/string(.) else 'n'", ["a", "b"]), ("for $x in //div[p] return string-join($x/p, '+')", ["a+b", "b"]),
        ("Q{http://www.w3.org/2005/xpath-functions}contains('ab', 'a')", ["true"]), ("count(//p) instance of xs:integer", ["true"]), ("'x' instance of xs:integer", ["false"]),
        ("//p instance of map(*)", ["false"]), ("//div[1]/@id instance of attribute()", ["true"]),
    ],
)
def test_atomic_values(nodes, expression, want):
    assert values(nodes, expression) == want


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("//div[some $x in p, $y in p satisfies $x != $y]/@id", ["d1"]), ("//div[some $x in p, $y in span satisfies $x << $y]/@id", ["d2"]), ("every $x in //div, $y in $x/p satisfies $y = 'b'", ["false"]),
        ("every $x in //div, $y in $x/p satisfies string-length($y) = 1", ["true"]), ("for $x in //li, $y in //span return $x[@class = $y/@lang]/@class", ["x"]), ("for $x in //div return //p[.. is $x]", ["p", "p", "p"]),
        ("for $x in //ul, $y in $x/li return $y", ["li", "li"]),
    ],
)
def test_variables(nodes, expression, want):
    assert values(nodes, expression) == want


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("//div[p='b']/@id", ["d1", "d2"]), ("//div[p=('a','z')]/@id", ["d1"]), ("//div[p!='b']/@id", ["d1"]), ("//li[.=(1,5)]", ["li"]), ("//div[ul/li>1]/@id", ["d1"]), ("//div[ul/li>=3]/@id", []),
        ("//div[p=span]/@id", []), ("//div[p=../div/p]/@id", ["d1", "d2"]), ("//li[@class=('x','q')]/@class", ["x"]), ("//x[p='b']", []),
    ],
)
def test_comparisons_of_several_items_by_the_rules_of_w3c(nodes, expression, want):
    assert values(nodes, expression, spec=True) == want


@pytest.mark.parametrize("expression", ["//div[p='b']", "//div[p=('a','b')]", "//li[.=(1,5)]", "//div[p!='b']", "//div[ul/li>1]", "//div[p eq 'b']"])
def test_comparisons_of_several_items_are_errors_by_default(nodes, expression):
    with pytest.raises(Exception, match="XPTY0004"):
        values(nodes, expression)
    assert values(nodes, expression, mode="PERMISSIVE") == []
    assert [r.error_code for r in api.errors(nodes, expression).collect()] == ["XPTY0004"]


@pytest.mark.parametrize(
    ("test", "want"),
    [("self::document-node(element(html))", 1), ("self::document-node(element(div))", 0), ("//element(*, xs:string)", 0), ("//element(p, xs:untyped)", 3), ("//attribute(*, xs:untypedAtomic)", 6), ("//attribute(id, xs:string)", 0)],
)
def test_types_of_nodes(nodes, test, want):
    assert len(values(nodes, test)) == want


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("//div//li", ["li", "li"]), ("//li/ancestor::div", ["div"]), ("//li/ancestor-or-self::*", ["html", "body", "div", "ul", "li", "li"]), ("//p/following::li", ["li", "li"]), ("//li/preceding::p", ["p", "p"]),
        ("//ul/descendant-or-self::*", ["ul", "li", "li"]), ("//@class/ancestor::ul", ["ul"]), ("//@class/ancestor-or-self::attribute(class)", ["x", "y"]), ("//li/following::li", ["li"]), ("//div/ancestor::div", []),
    ],
)
def test_range_axes(nodes, expression, want):
    assert values(nodes, expression) == want


@pytest.mark.parametrize("expression", ["//div//li", "//li/ancestor::div", "//li/ancestor-or-self::*"])
def test_range_axes_are_no_join_within_documents(nodes, expression, capsys):
    api.find(nodes, expression, ordered=False).explain()
    assert "Join" not in capsys.readouterr().out


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("[//p, //li]?2", ["li", "li"]), ("[//p, //li]?*", ["p", "p", "li", "li", "p"]), ("array{//li}?2 ! string(.)", ["2"]), ("array{//li}(1)/@class", ["x"]), ("map{'a': //li, 'b': 1}?a", ["li", "li"]), ("map{'a': //li}('a')", ["li", "li"]),
        ("map{'a': //li}?c", []), ("(function($x) { count($x) })(//p)", ["3"]), ("let $f := function($x) { $x/@class } return $f(//li)", ["x", "y"]), ("count#1(//p)", ["3"]), ("//p => (function($x) { count($x) })()", ["3"]),
        ("let $f := contains(?, 'a') return $f(string(/html/body/div[1]/p[1]))", ["true"]), ("for-each(//li, function($x) { concat('n', $x) })", ["n1", "n2"]), ("let $a := [//p, //li] return $a?2/@class", ["x", "y"]),
        ("(//p ! string(.))[2]", ["b"]), ("let $n := 1, $f := function($x) { $x + $n } return $f(count(//p))", ["4"]), ("[1, 2]?3", None), ("//div[(function($x) { $x/li })(ul)]/@id", ["d1"]),
    ],
)
def test_functions_arrays_and_maps_over_nodes(nodes, expression, want):
    if want is None:
        with pytest.raises(Exception):  # noqa: B017
            values(nodes, expression)
    else:
        assert values(nodes, expression) == want
