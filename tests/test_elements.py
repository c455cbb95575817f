"""Pages as elements: intervals, what HTML closes by itself, selectors, blocks of prose, lists of selectors."""

import html as H

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import dom_postings, elements

LONG = "Plain words of a description that goes on for a while. " * 3


def of(html):
    page = elements.Page(html)
    text = "".join(page.parts)
    return text, [(e[3], text[e[7] : e[7] + e[8]]) for e in page.elements], page


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a<p>b", "a\nb"), ("a <b> b</b> c", "a b c"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "a\nb\nc\nd"), ("a<br>b<br/> c", "a\nb\nc"), ("x &lt;b&gt; &amp;amp; &eacute;", "x <b> &amp; é"),
        ("<head><title>t</title></head>b", "b"), ("a<script>if (a < b) '</p>';</script>b<style>p{}</style>", "ab"), ("<!-- <p>no</p> -->a<!-- open", "a"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>a</div>b</p>", "ab"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ('<a title="x > y">l</a>', "l"), ("", ""), ("   \n ", ""), ("a\n\n  b\t c", "a\nb c"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("<p>a<div>b</div>c", "a\nb\nc"),
    ],
)
def test_text(html, text):
    assert of(html)[0] == text


def test_elements_and_links():
    text, found, page = of('<div id=Main class="a  b"><nav>go <a href="/x">one two</a></nav> <p data-x=\'1\'>text <a>l</a> more</div>')
    assert [t for _, t in found] == ["go one two\ntext l more", "go one two", "one two", "text l more", "l"]
    assert [(e[0], e[1], e[2], e[9], e[10]) for e in page.elements] == [(0, -1, 4, 8, False), (1, 0, 2, 7, True), (2, 1, 2, 7, True), (3, 0, 4, 1, False), (4, 3, 4, 1, False)]
    assert (page.elements[0][4:6], page.elements[3][6]) == (["Main", ["a", "b"]], {"data-x": "1"})


BITS = st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<a>", "</a>", "<b>", "</b>", "<br>", "<td>", "<tr>", "<table>", "</table>", "x", " y ", "\n", "&amp;", "<section>", "</section>"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(BITS)
def test_intervals_nest(bits):
    text, _, page = of("".join(bits))
    assert text.replace(" ", "").replace("\n", "") == "".join(H.unescape(b) for b in bits if b[0] != "<").replace(" ", "").replace("\n", "")
    for n, e in enumerate(page.elements):
        assert e[0] == n <= e[2] and 0 <= e[9] <= e[8] and e[7] + e[8] <= len(text)
        inside = text[e[7] : e[7] + e[8]]
        assert inside == inside.strip()
        if e[1] >= 0:
            parent = page.elements[e[1]]
            assert parent[0] < n and e[2] <= parent[2] and (not e[8] or parent[7] <= e[7] and e[7] + e[8] <= parent[7] + parent[8])


def test_deep_nesting_is_bounded():
    text, _, page = of("<div>" * 5000 + "x" + "</div>" * 5000)
    assert text == "x" and len(page.elements) == elements.DEEPEST


def parsed(spark, *htmls):
    return elements.parse_pages(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"))


SAMPLE = '<div id="top" class="x job-Header"><span class="c">one</span><div class="c"><a href="/u" itemprop="org">two</a></div></div><div class="c" data-qa="job-description">three</div>'


@pytest.mark.parametrize(
    "selector, want",
    [
        ("#top", "one\ntwo"), (".c", "one"), ("div.c", "two"), ("#top > div", "two"), ("#top > a", None), ("#top a", "two"), ("#top div a", "two"), ('[data-qa="job-description"]', "three"), ("[data-qa]", "three"),
        ('[class*="JOB-header" i]', "one\ntwo"), ('[class*="JOB-header"]', None), ('[itemprop="org"]', "two"), (".x .c", "one"), (".c .c", None), ("div > a", "two"), (".missing", None), ("span.c", "one"), ('div[data-qa="job-description"].c', "three"),
    ],
)
def test_selectors(spark, selector, want):
    found = parsed(spark, SAMPLE).select(elements.element_text(F.col("text"), F.get(F.filter("elements", elements.matches(selector, F.col("elements"))), F.lit(0)))).first()[0]
    assert found == want


@pytest.mark.parametrize("html, tag, want", [
    (f"<div id=root><div>{'<a>nav item</a> ' * 3}<article>{LONG}</article></div></div>", "article", LONG.strip()),
    (f"<body><div><section>{LONG}</section><section>{LONG * 9}</section></div>", "section", (LONG * 9).strip()),
    (f"<div><section>{LONG}{LONG}</section><section>{LONG}{LONG}</section></div>", "div", f"{(LONG * 2).strip()}\n{(LONG * 2).strip()}"),
    (f"<nav><div>{LONG * 9}</div></nav><div>{LONG}</div>", "div", LONG.strip()),
    (f"<div><a>{LONG}</a></div><main>{LONG[:100]}</main>", "main", LONG[:100].strip()),
    (f"<section>{LONG}</section><div>{LONG}</div>", "section", LONG.strip()),
    ("<div>too short</div> tail", None, "too short\ntail"),
    (f"<footer><p>{LONG}</p></footer>", None, LONG.strip()),
    (None, None, ""),
])
def test_prose(spark, html, tag, want):
    row = elements.with_prose(parsed(spark, html)).first()
    assert (row["prose_tag"], row["prose"]) == (tag, want)


def element_of(selector, inside):
    """An element that the selector names, in a page of its own."""
    steps = [s for s in selector.replace(" > ", " ").split(" ") if s] if "[" not in selector else [selector]
    out = inside
    for s in reversed(steps):
        if s[0] == "#":
            out = f'<div id="{s[1:]}">{out}</div>'
        elif s[0] == ".":
            out = f'<div class="k {s[1:]}">{out}</div>'
        elif s[0] == "[":
            name, value = s[1:].split("]")[0].replace("*=", "=").replace(" i", "").split("=")
            out = f"<div {name}={value}>{out}</div>"
        else:
            out = f"<{s}>{out}</{s}>"
    return out


@pytest.mark.parametrize("field, selectors", [("description", dom_postings.DESCRIPTION), ("location", dom_postings.LOCATION), ("company", dom_postings.COMPANY)])
def test_every_selector(spark, field, selectors):
    texts = [f"Value {i} " + ("of a long enough text " * 5 if field == "description" else "there") for i in range(len(selectors))]
    pages = [f"<h1>T</h1><div class='other'>x</div>{element_of(s, t)}" for s, t in zip(selectors, texts)]
    rows = dom_postings.page_postings(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    assert {r["page_id"]: r[field] for r in rows} == {i: t.strip() for i, t in enumerate(texts)}
    assert {r["source"] for r in rows} == {"dom-known" if field == "description" else "dom-generic"}


@pytest.mark.parametrize(
    "html, want",
    [
        ('<div class="location">L</div><div class="job-location">Rome, Italy</div>', ("", "Rome, Italy")),
        ('<div class="company-name">A</div><div class="company-name">Acme Ltd</div><div data-testid="the-Company">Late Inc</div>', ("Late Inc", "")),
        ("<title>Cook at Big Diner | Jobs</title><p>Come to Graz, Austria or Austin, TX", ("Big Diner", "Austin, TX")),
        ("<title>Cook - Diner - Site</title><p>Paris, France", ("Diner", "Paris, France")),
        ("<title>Cook at least</title>", ("", "")),
    ],
)
def test_fields(spark, html, want):
    """Only the first element of a selector counts; one that is too short leaves the place to the next selector."""
    row = dom_postings.page_postings(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row["company"], row["location"]) == want


def test_titles_and_json_ld(spark):
    pages = ["<title>Baker - Shop | Site</title>", "<h1>\n Head <b>Chef</b></h1><title>x</title>", '<script type="application/ld+json">{"@type": "JobPosting", "title": "Cook", "description": "<p>d</p>"}</script><h1>no</h1>', None, "<h1></h1><title>T</title>"]
    rows = dom_postings.page_postings(spark.createDataFrame([(i, h, "kept") for i, h in enumerate(pages)] + [(1, pages[1], "kept")], "page_id long, html string, tag string"), carry=("page_id", "tag")).orderBy("page_id").collect()
    assert [(r["page_id"], r["title"], r["source"]) for r in rows] == [(0, "Baker", "dom-generic"), (1, "Head Chef", "dom-generic"), (1, "Head Chef", "dom-generic"), (2, "Cook", "json-ld"), (3, "", "dom-generic"), (4, "T", "dom-generic")]
    assert {r["tag"] for r in rows} == {"kept"}
    assert dom_postings.page_postings(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_entities_without_semicolon():
    """Read as in browsers, or left as they stand but for &amp."""
    raw = "a &quot &lt; &#39 &amp &ampx &copy; b &amp;quot"
    assert of(raw)[0] == 'a " < \' & &x © b &quot'
    assert "".join(elements.Page(raw, closed=True).parts) == "a &quot < &#39 & &x © b &quot"


def test_statements_over_two_lines(spark):
    page = "<body><p>A full</p><p>time post in Porto,</p><p>TX for $90K</p> - $120K</body>"
    for html, want in ((page, ("Porto, TX", "full time", "$90K-$120K")), (page.replace("full</p><p>time", "full time"), ("Porto, TX", "full time", "$90K-$120K"))):
        row = dom_postings.page_postings(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
        assert (row["location"], row["employment_type"], row["salary"]) == want
