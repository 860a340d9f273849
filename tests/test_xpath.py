"""Grammar round trips and results on small pages."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from canopyq import api
from canopyq.plans.compiler import UnsupportedError
from canopyq.sources.pages import html_nodes
from canopyq.xpath.parser import XPathSyntaxError, parse, unparse

SAME = [
    "/(chapter|appendix)", "((book/author[.=$a])[1], book[author=$a]/title)", 'fn:doc("bib.xml")/books/book[fn:count(./author)>1]', "book/(chapter|appendix)/section",
    "$products[price gt 100]", "$emp/bonus>0.25 * $emp/salary", "//hello//world", "//hello//parent::world", '//head//script[not(@src) and not(contains(., "gtag"))]',
    "for $x in 1 to 3 return $x * 2", "if (a) then b else c", "some $x in //p satisfies $x=1", "a => f(1, ?)", "[1, 2]", "f#2", "Q{u}f()", "*:n", "$m?key", "a!b", "a||b", "-1 + +2",
    "a except b", "x instance of element(a)*", "1 cast as xs:string?", "let $x := 1, $y := 2 return $x", "ancestor::*[1]", "/", "()", "a is b", "/html treat as document-node()", "'it''s'", ".5e3",
]


@pytest.mark.parametrize("text", SAME)
def test_round_trip(text):
    assert unparse(parse(text)) == text


@pytest.mark.parametrize("text", ["", "a[", "a b", "//", "f(", "1 +", "4294967296", "'open", "(: open"])
def test_syntax_errors(text):
    with pytest.raises(XPathSyntaxError):
        parse(text)


def test_lenient_ignores_the_rest():
    assert parse("a b", lenient=True) == parse("a")


@given(st.integers(0, 2**32 - 1))
def test_integers(n):
    assert parse(str(n)) == ("integer", str(n))


@given(st.text(max_size=20))
def test_strings(s):
    for quote in "'\"":
        t = ("string", s, quote)
        assert parse(unparse(t)) == t


@given(st.from_regex(r"[A-Z_a-z]+", fullmatch=True))
def test_names(n):
    assert unparse(parse(n)) == n


F2 = "<html><body><div><p>1</p><p>2</p><p>3</p></div><div><p>4</p><p>5</p><p>6</p></div></body></html>"
PAGES = {
    "F1": "<html><body></body></html>",
    "F2": F2,
    "F3": "<html><body><div><p>1</p><p>2</p><p>3</p></div></body><footer><div><form><p>4</p><p>5</p><p>6</p></form></div></footer></html>",
    "F4": "<html><body><span>1</span><span> 2 <span>3</span></span></body></html>",
    "F5": '<html><div> bad </div><div class="here"> good </div></html>',
    "F7": "<html><div> hello world </div><div> select me </div></html>",
    "F8": '<html><div class="nah"> hello world </div><div class="select me"> select me </div></html>',
    "F9": '<html><div> other </div><div> hello world </div><div class="hello" id="select"></div></html>',
    "F10": '<html><body><div id="1"><p>1</p></div><div id="2"><p>2</p></div><div><not-p>3</not-p></div></body></html>',
    "F12": '<html id="foo" class="bar" style="baz"></html>',
    "F15": '<html><div><div class="yes">y</div><div class="duplicate">Good info</div></div><div><div class="no">n</div><div class="duplicate">Bad info</div></div></html>',
}
KEYS = list(PAGES)


@pytest.fixture(scope="module")
def nodes(spark):
    df = html_nodes(spark.createDataFrame([(i, PAGES[k]) for i, k in enumerate(KEYS)], "id long, html string"), "id", "html").persist()
    yield df
    df.unpersist()


def run(nodes, page, expression, **options):
    rows = api.find(nodes.filter(f"doc_id = {KEYS.index(page)}"), expression, **options).collect()
    return rows


@pytest.mark.parametrize(
    ("page", "expression", "n"),
    [
        ("F1", "/html", 1), ("F2", "//p", 6), ("F3", "/html/footer/div//p", 3), ("F4", "/html/body//span", 3), ("F5", "/html/div[@class='here']", 1), ("F5", "//div[@class='here']", 1),
        ("F2", "//div/p[2]", 2), ("F2", "//p[2]", 2), ("F2", "(//p)[2]", 1), ("F7", "//div[contains(text(),'select')]", 1), ("F8", "//div[contains(@class,'select')]", 1),
        ("F9", "//div[contains(text(),//div[@id='select']/@class)]", 1), ("F10", "//body/parent::html", 1), ("F10", "//p/parent::div", 2), ("F10", "//p/..", 2), ("F12", "/html/attribute::*", 3),
        ("F2", "//text()", 6), ("F2", "/html/body/fn:root()", 1), ("F1", "/html treat as node()", 1), ("F12", "//class", 1), ("F2", "//p[@x][1]", 0), ("F2", "//div[p/2]", 1), ("F2", "//p[(1,2)]", 6),
        ("F2", "//p[(1,1)]", 2), ("F12", "/html[@id>1]", 1), ("F12", "/html[@id=1]", 0), ("F1", "/html[1=1.0]", 0), ("F2", "//div[not(p)]", 0), ("F2", "//p[text()='5']/following-sibling::p", 1),
        ("F2", "//div ! p[1]", 2), ("F2", "//nothing", 0), ("F2", "//comment()", 0), ("F2", "//html/parent::div", 0), ("F2", "//p[last()]", 2), ("F2", "//p[position()=last()-1]", 2),
        ("F2", "//p[.='2' or .='6']", 2), ("F2", "if (//q) then //div else //p", 6), ("F2", "/html/body/div/p[1][text()='1']", 1),
        ("F2", "()/p", 0), ("F2", "(/ intersect //p)//p", 0), ("F2", "/self::p//p", 0), ("F2", "/self::node()//p", 6), ("F2", "/html/body/fn:root()/html", 1), ("F1", "//p/fn:root()/html", 0),
    ],
)
def test_counts(nodes, page, expression, n):
    assert len(run(nodes, page, expression)) == n


def test_values(nodes):
    assert [r.value for r in run(nodes, "F12", "/html/@class")] == ["bar"]
    assert [r.value for r in run(nodes, "F15", "//div[@class='yes']/parent::div/div[@class='duplicate']/text()")] == ["Good info"]
    assert [r.value for r in run(nodes, "F2", "//text()")] == list("123456")
    assert [(r.value, r.item_type) for r in run(nodes, "F2", "count(//p)")] == [("6", "integer")]
    assert [(r.value, r.item_type) for r in run(nodes, "F2", "1, 'a', 1")] == [("1", "integer"), ("a", "string")]
    assert [r.value for r in run(nodes, "F2", "2 * 1.5")] == ["3"]


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("1 to 3", ["1", "2", "3"]), ("for $x in 1 to 3 return $x * 2", ["2", "4", "6"]), ("for $x in 1 to 2, $y in 1 to 2 return $x + $y", ["2", "3", "4"]), ("let $f := function($x) { $x + 1 } return $f(2)", ["3"]),
        ("[1, 'a']?2", ["a"]), ("map { 'k' : 5 }?k", ["5"]), ("array { 1 to 3 }?*", ["1", "2", "3"]), ("'ab' => upper-case()", ["AB"]), ("(concat#2)('a', 'b')", ["ab"]), ("7 idiv 2, 7 mod 2", ["1", "3"]),
        ("some $x in 1 to 3 satisfies $x > 2", ["true"]), ("every $x in 1 to 3 satisfies $x > 2", ["false"]), ("1 = 1.0", ["false"]), ("1 eq 1.0", ["true"]), ("'x' castable as xs:integer", ["false"]), ("'5' cast as xs:integer", ["5"]),
        ("if (1 > 2) then 'a' else 'b'", ["b"]), ("(5, 6, 7)[2]", ["6"]), ("()", []), ("-(3)", ["-3"]), ("0.1 + 0.2", ["0.3"]), ("1 div 4", ["0.25"]),
    ],
)
def test_expressions_without_a_document(nodes, expression, want):
    assert sorted(r.value for r in run(nodes, "F1", expression)) == sorted(want)


@pytest.mark.parametrize("expression", ["1 div 0", "1 to 9999999", "(1, 2) + 1", "'x' cast as xs:integer"])
def test_errors_without_a_document(nodes, expression):
    with pytest.raises(ValueError):
        api.find(nodes, expression)


def test_elements_sort_before_texts_before_attributes(nodes):
    assert [r.kind for r in run(nodes, "F5", "//@class, //text(), //div")] == ["element", "element", "text", "text", "attribute"]


def test_spec_differs_where_documented(nodes):
    assert len(run(nodes, "F12", "//class", spec=True)) == 0
    assert len(run(nodes, "F2", "//p[number(.) mod 2 = 0]", spec=True)) == 3
    assert len(run(nodes, "F2", "//p[.>1][1]", spec=True)) == 2


@pytest.mark.parametrize(("expression", "code"), [("//div[p='1']", "XPTY0004"), ("/html treat as document-node()", "XPDY0050"), ("//nothing treat as node()", "XPDY0050")])
def test_errors_end_the_job_or_leave_the_document_out(nodes, expression, code):
    one = nodes.filter(f"doc_id in ({KEYS.index('F2')}, {KEYS.index('F1')})")
    with pytest.raises(Exception, match=code):
        api.find(one, expression).collect()
    assert KEYS.index("F2") not in {r.doc_id for r in api.find(one, expression, mode="PERMISSIVE").collect()}
    assert (KEYS.index("F2"), code) in {(r.doc_id, r.error_code) for r in api.errors(one, expression).collect()}


def test_unknown_and_unsupported(nodes):
    with pytest.raises(ValueError, match="Unknown function"):
        api.find(nodes, "foo(1)")
    with pytest.raises(UnsupportedError):
        api.find(nodes, "map { 1 : 2 }")


def test_kind_checks(nodes):
    assert api.find_elements(nodes, "//p").count() > 0
    assert api.find_attributes(nodes, "//@class").count() > 0
    with pytest.raises(Exception, match="no element"):
        api.find_elements(nodes, "//text()").collect()


def test_relative_to_items(nodes):
    items = api.find(nodes.filter(f"doc_id = {KEYS.index('F2')}"), "//div")
    got = api.apply_to_items(nodes, items, "//p").groupBy("item_id").count().collect()
    assert sorted(r["count"] for r in got) == [3, 3]
    assert api.apply_to_items(nodes, items, "/p[2]").count() == 2
    assert api.apply_to_items(nodes, items, ".").count() == 2
    assert api.find_elements_from_items(nodes, items.unionByName(items), "p").count() == 6


def test_empty_table_and_repeated_rows(nodes):
    assert api.find(nodes.limit(0), "//div[p='1']").count() == 0
    twice = nodes.unionByName(nodes)
    assert api.find(twice, "//div/p[2]", repeated=True).count() == api.find(nodes, "//div/p[2]").count()


def test_names_without_a_join_are_one_scan(nodes):
    plan = api.find(nodes.sparkSession.createDataFrame(nodes.limit(5).collect(), nodes.schema), "//p", ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
