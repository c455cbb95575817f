"""Pages as elements: nested intervals over a page's visible text.

A page becomes a row with its text, in which a run of white space is one blank or, if it holds a line end, one line feed, and its elements in
order of their start. Element n holds the elements n + 1 to `last` and the `length` characters of the text from `start`; `link_length` of them stand
in links. So whether one element lies in another, how long its text is and what share of it are links are comparisons of numbers.

Elements that HTML closes by itself (paragraphs, list items, rows, cells) are closed here too; what stands in head, scripts, styles and templates is no text; below
512 open elements further ones are not opened, as in browsers. A page without HTML has no elements and an empty text.
"""

from __future__ import annotations

import html as H
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.sources.shared import cut

# HTML's rules of what has no content, what ends a line, and what closes what.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template".split())
RAW = frozenset("script style textarea title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
LINES = CLOSES_P | frozenset("body dd dt li td th tr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WITHIN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BESIDE = frozenset("nav header footer aside".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANKS = re.compile(r"[ \t\r\n\f]+")
OPEN_ENTITY = re.compile(r"&(?!amp|#?[a-zA-Z0-9]+;)")
DEEPEST = 512

ELEMENT = "n int, parent int, last int, tag string, id string, classes array<string>, attrs map<string,string>, start int, length int, link_length int, beside boolean"


class Page:
    """Reads one page from its start to its end; closed: an entity without its semicolon, other than &amp, stands for itself."""

    def __init__(self, html: str, closed: bool = False):
        self.unescape = (lambda raw: H.unescape(OPEN_ENTITY.sub("&amp;", raw))) if closed else H.unescape
        self.parts: list[str] = []
        self.size = self.links = self.link_from = 0  # characters of text so far, those in links, and the text where the outermost open link began
        self.gap = ""  # white space that waits for more text
        self.blank_at: dict[int, bool] = {}  # where such white space stands, and whether it counts as a link's
        self.elements: list[list] = []
        self.open: list[int] = []
        self.count: dict[str, int] = {}
        self.title: list[str] = []
        at = 0
        while at < len(html):
            m = TAG.search(html, at)
            self.text(html[at : m.start() if m else len(html)])
            if not m:
                break
            at = m.end()
            closing, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
            if not name:
                continue
            if closing:
                self.end(name)
                continue
            self.begin(name, attributes)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                inside = html[at : end.start() if end else len(html)]
                if name == "title":
                    self.title.append(BLANKS.sub(" ", self.unescape(inside)).strip(" "))
                self.text(inside)
                self.end(name)
                at = end.end() if end else len(html)
        while self.open:
            self.close()

    def text(self, raw: str) -> None:
        if not raw or any(self.count.get(t) for t in UNSEEN) or self.count.get("title"):
            return
        shown = self.unescape(raw) if "&" in raw else raw
        bits, gaps = BLANKS.split(shown), BLANKS.findall(shown)
        for i, bit in enumerate(bits):
            if i:
                self.gap = "\n" if "\n" in gaps[i - 1] or self.gap == "\n" else " "
            if bit:
                if self.gap and self.size:
                    linked = bool(self.count.get("a")) and self.size > self.link_from
                    self.blank_at[self.size] = linked
                    self.parts.append(self.gap)
                    self.size += 1
                    self.links += linked
                self.gap = ""
                self.parts.append(bit)
                self.size += len(bit)
                self.links += len(bit) if self.count.get("a") else 0

    def begin(self, name: str, attributes: str) -> None:
        if name in CLOSES_P and self.count.get("p"):
            self.close_to("p")
        if name in CLOSES:
            for i in range(len(self.open) - 1, -1, -1):
                tag = self.elements[self.open[i]][3]
                if tag in WITHIN[name]:
                    break
                if tag in CLOSES[name]:
                    self.close_to(tag)
                    break
        if name == "br" or name in LINES:
            self.gap = "\n"
        if len(self.open) >= DEEPEST:
            return
        n = len(self.elements)
        found = {k.lower(): H.unescape(a or b or c) for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))}
        beside = name in BESIDE or bool(self.open) and self.elements[self.open[-1]][10]
        self.elements.append([n, self.open[-1] if self.open else -1, n, name, found.get("id", ""), found.get("class", "").split(), found, self.size, self.links, 0, beside])
        if name not in VOID:
            if name == "a" and not self.count.get("a"):
                self.link_from = self.size
            self.open.append(n)
            self.count[name] = self.count.get(name, 0) + 1
        else:
            self.elements[n][8] = 0

    def end(self, name: str) -> None:
        if self.count.get(name):
            self.close_to(name)
        elif name in ("br", "p"):
            self.gap = "\n"

    def close_to(self, name: str) -> None:
        while self.close() != name:
            pass

    def close(self) -> str:
        e = self.elements[self.open.pop()]
        e[2] = len(self.elements) - 1
        skip = e[7] in self.blank_at and self.size > e[7]
        e[7:10] = e[7] + skip, self.size - e[7] - skip, self.links - e[8] - (skip and self.blank_at[e[7]])
        self.count[e[3]] -= 1
        if e[3] in LINES:
            self.gap = "\n"
        return e[3]


def parse_pages(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id",), closed: bool = False) -> DataFrame:
    """row, the carried columns, title, text and elements of each page, as a written table; row tells pages apart, also equal ones.

    As in browsers an entity may lack its semicolon; with `closed` only &amp may.
    """
    rows = pages.select(*(F.col(c) for c in carry), F.coalesce(html, F.lit("")).alias("_html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("elements", T.ArrayType(T._parse_datatype_string(ELEMENT)))])
    kinds = [("n", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("length", pa.int32()), ("link_length", pa.int32()), ("beside", pa.bool_())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                read_ = [Page(h, closed) for h in part.column(part.num_columns - 1).to_pylist()]
                every = [e for p in read_ for e in p.elements]
                columns = [pa.array([list(e[i].items()) for e in every] if name == "attrs" else [e[i] for e in every], kind) for i, (name, kind) in enumerate(kinds)]
                ends = [0]
                for p in read_:
                    ends.append(ends[-1] + len(p.elements))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in kinds]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([p.title[0] if p.title else "" for p in read_]), pa.array(["".join(p.parts) for p in read_]), lists], schema.names)

    return cut(rows.mapInArrow(read, schema).withColumn("row", F.monotonically_increasing_id()), "pages")


def element_text(text: Column, element: Column) -> Column:
    return F.substring(text, element["start"] + 1, element["length"])


_PART = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<how>\*?=)"(?P<value>[^"]*)"(?P<fold>\s+i)?)?\]""")


def matches(selector: str, elements: Column):
    """A test of an element by a selector of tags, ids, classes and attributes (also a part of one, in any case), steps to children and to what lies within."""
    steps = re.findall(r"""\s*(>?)\s*((?:\[[^\]]*\]|[^\s>\[])+)""", selector)
    if not steps:
        raise ValueError(f"no selector: {selector}")

    def simple(compound: str, e: Column) -> Column:
        out = F.lit(True)
        for m in _PART.finditer(compound):
            if m["tag"]:
                out &= e["tag"] == m["tag"].lower()
            elif m["id"]:
                out &= e["id"] == m["id"]
            elif m["cls"]:
                out &= F.array_contains(e["classes"], m["cls"])
            else:
                value, want = F.coalesce(e["attrs"][m["name"]], F.lit("")), m["value"] or ""
                if m["fold"]:
                    value, want = F.lower(value), want.lower()
                out &= F.contains(value, F.lit(want)) if m["how"] == "*=" else value == want if m["how"] else e["attrs"][m["name"]].isNotNull()
        return out

    def test(e: Column, upto: int) -> Column:
        out = simple(steps[upto][1], e)
        if not upto:
            return out
        if steps[upto][0]:
            return out & (e["parent"] >= 0) & test(F.get(elements, e["parent"]), upto - 1)
        return out & F.exists(F.filter(elements, lambda a: test(a, upto - 1)), lambda a: (a["n"] < e["n"]) & (e["n"] <= a["last"]))

    return lambda e: test(e, len(steps) - 1)


def first_text(selectors: tuple[str, ...], elements: Column, text: Column, least: int, most: int | None = None) -> Column:
    """The text of the first element of the first selector that has one of fitting length; null if there is none."""
    hits = F.array(*(F.get(F.filter(elements, matches(s, elements)), F.lit(0)) for s in selectors))
    size = lambda e: e["length"] >= least if most is None else e["length"].between(least, most)
    return element_text(text, F.get(F.filter(hits, lambda e: e.isNotNull() & size(e)), F.lit(0)))


def prose_blocks(parsed: DataFrame, tags: tuple[str, ...] = ("article", "main", "section", "div"), longer_than: int = 80, links_below: float = 0.35, share: float = 0.85) -> DataFrame:
    """row, tag, n, start, length: the longest block of prose of each page that has one.

    A block is long enough, has few links, stands in no navigation, header, footer or aside, and no block within it holds `share` of its text. Blocks
    of a page meet by their intervals; only numbers are moved. Of equally long blocks the first counts.
    """
    fits = lambda e: e["tag"].isin(*tags) & ~e["beside"] & (e["length"] > longer_than) & (e["link_length"] < links_below * e["length"])
    numbers = lambda e: F.struct(*(e[k].alias(k) for k in ("n", "last", "tag", "start", "length")))
    blocks = parsed.select("row", F.inline(F.transform(F.filter("elements", fits), numbers)))
    a, b = blocks.alias("a"), blocks.alias("b")
    inside = (F.col("a.row") == F.col("b.row")) & (F.col("b.n") > F.col("a.n")) & (F.col("b.n") <= F.col("a.last")) & (F.col("b.length") >= share * F.col("a.length"))
    own = a.join(b, inside, "left_anti")
    best = own.groupBy("row").agg(F.max_by(F.struct("tag", "n", "start", "length"), F.struct("length", -F.col("n"))).alias("block"))
    return best.select("row", "block.*")


def with_prose(parsed: DataFrame) -> DataFrame:
    """The pages with prose, the text of their block, else their whole text, and prose_tag, null for the latter."""
    found = prose_blocks(parsed).select("row", F.col("tag").alias("prose_tag"), F.col("start").alias("_start"), F.col("length").alias("_length"))
    text = F.coalesce(F.substring("text", F.col("_start") + 1, F.col("_length")), X.strip(F.col("text")))
    return parsed.join(found, "row", "left").withColumn("prose", text).drop("_start", "_length")
