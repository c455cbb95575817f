"""Word-processor documents: numbering, indents, tab stops, symbols, alternate content, failures, and their lines."""

import io
import os
import zipfile

import pytest

from foliant.operators import docx_lines
from foliant.sources import files

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
STYLES = (
    '<w:style w:styleId="List"><w:name w:val="List"/><w:pPr><w:numPr><w:numId w:val="2"/><w:ilvl w:val="1"/></w:numPr><w:ind w:left="200"/></w:pPr></w:style>'
    '<w:style w:styleId="Child"><w:basedOn w:val="List"/></w:style><w:style w:styleId="Ind"><w:pPr><w:ind w:start="400" w:hanging="100"/></w:pPr></w:style>'
)
NUMBERING = (
    '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/><w:pPr><w:ind w:left="1440" w:hanging="360"/></w:pPr></w:lvl></w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/></w:num>'
    '<w:num w:numId="3"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:lvl w:ilvl="0"><w:numFmt w:val="lowerLetter"/><w:pPr><w:ind w:left="100"/></w:pPr></w:lvl></w:lvlOverride></w:num><w:num w:numId="9"><w:abstractNumId w:val="99"/></w:num>'
)


def docx(body, numbering=NUMBERING, raw=None, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", raw if raw is not None else f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}>{STYLES}</w:styles>")
        z.writestr("word/numbering.xml", f"<w:numbering {NS}>{numbering}</w:numbering>")
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return out.getvalue()


def p(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def num(number, level=None):
    return f'<w:numPr>{"" if level is None else f"<w:ilvl w:val={chr(34)}{level}{chr(34)}/>"}<w:numId w:val="{number}"/></w:numPr>'


@pytest.mark.parametrize(
    "props, want",
    [
        ("", (-1, 0.0)), (num(1, 0), (0, 18.0)), (num(1, 1), (1, 54.0)), (num(1), (0, 18.0)), (num(3, 0), (0, 5.0)), (num(3, 1), (1, 54.0)), (num(9, 2), (2, 0.0)), (num(55, 0), (0, 0.0)),
        ('<w:pStyle w:val="List"/>', (1, 54.0)), ('<w:pStyle w:val="Child"/>', (1, 54.0)), ('<w:pStyle w:val="Child"/>' + num(0), (-1, 10.0)), ('<w:pStyle w:val="List"/>' + num(1), (0, 18.0)),
        ('<w:ind w:left="300"/>' + num(1, 1), (1, 15.0)), ('<w:pStyle w:val="Ind"/>', (-1, 15.0)), ('<w:ind w:left="100" w:hanging="400"/>', (-1, 0.0)), ('<w:pStyle w:val="Missing"/>', (-1, 0.0)),
    ],
)
def test_numbering(props, want):
    row = files.Docx(docx(p("x", props))).paragraphs()[0]
    assert (row["list_level"], row["indent_pt"]) == want


def test_list_kinds_tabs_and_symbols():
    tabs = '<w:tabs><w:tab w:val="left" w:pos="720"/><w:tab w:val="clear" w:pos="900"/><w:tab w:val="right" w:pos="9000"/></w:tabs>'
    sym = '<w:p><w:r><w:sym w:font="Symbol" w:char="F0B7"/><w:t>marked</w:t><w:sym w:font="W" w:char="F123"/></w:r></w:p>'
    body = p("a", num(1, 0)) + p("b", num(1, 1)) + p("c", num(3, 0)) + p("d", tabs) + sym
    rows = files.Docx(docx(body)).paragraphs()
    assert [r["list_bullet"] for r in rows] == [True, False, False, True, True]
    assert rows[3]["tab_stops"] == [36.0, 450.0] and rows[4]["text"] == "marked•"


def test_alternate_content():
    box = lambda t: f"<w:txbxContent>{p(t)}</w:txbxContent>"
    inside = f"<w:p><w:r><w:t>before</w:t></w:r><mc:AlternateContent><mc:Choice>{box('box')}</mc:Choice><mc:Fallback>{box('box')}</mc:Fallback></mc:AlternateContent></w:p>"
    body = inside + f"<mc:AlternateContent><mc:Choice>{p('new')}</mc:Choice><mc:Fallback>{p('old')}</mc:Fallback></mc:AlternateContent><mc:AlternateContent><mc:Choice>{p('only')}</mc:Choice></mc:AlternateContent>"
    assert [r["text"] for r in files.Docx(docx(body)).paragraphs()] == ["before", "box", "old", "only"]


def test_failures_stay_in_their_row(spark):
    bad_number = docx(p("kept\ttext", '<w:numPr><w:ilvl w:val="no"/><w:numId w:val="1"/></w:numPr>'))
    cases = [docx(p("fine")), b"PK\x03\x04 not an archive", docx("", raw="<broken"), bad_number, docx(""), None, docx(p("x"), styles="<broken")]
    frame = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(cases)], "path int, content binary")
    rows = files.read_docx(frame).orderBy("path").collect()
    assert [(r["method"], r["status"], r["code"]) for r in rows][:6] == [("docx-xml", 200, ""), ("", 422, "corrupt_docx"), ("", 422, "corrupt_docx"), ("docx-fallback", 200, ""), ("docx-xml", 422, "no_text"), ("", 422, "corrupt_docx")]
    assert rows[3]["paragraphs"][0]["text"] == "kept\ttext" and rows[6]["status"] == 200
    assert files.docx_paragraphs(frame).select("path").distinct().count() == 3


def lines(spark, *rows):
    base = dict(outline_level=0, bold=False, italic=False, size=10.0, indent_pt=0.0, list_level=-1, tab_stops=[], in_table=False, table_col=0)
    kind = "doc_id int, para_no int, text string, outline_level int, bold boolean, italic boolean, size double, indent_pt double, list_level int, tab_stops array<double>, in_table boolean, table_col int"
    names = [x.split()[0] for x in kind.split(", ")]
    data = [tuple({**base, "doc_id": 1, "para_no": i, **r}[n] for n in names) for i, r in enumerate(rows)]
    return docx_lines.paragraph_lines(spark.createDataFrame(data, kind)).orderBy("line_no").collect()


def test_bullets_by_indent(spark):
    """Typed bullets deeper than the shallowest are sub-bullets; those of the file's own lists keep their level."""
    got = lines(spark, dict(text="• employer", indent_pt=0.0), dict(text="• duty", indent_pt=18.0), dict(text="listed", list_level=0, indent_pt=18.0), dict(text="listed deep", list_level=4, indent_pt=36.0), dict(text="plain"))
    assert [(r["text"], r["bullet_level"], r["x0"]) for r in got] == [("employer", 1, 0.0), ("duty", 2, 30.0), ("listed", 1, 18.0), ("listed deep", 2, 48.0), ("plain", 0, 0.0)]
    assert [r["bullet_level"] for r in lines(spark, dict(text="• a", indent_pt=0.0), dict(text="• b", indent_pt=8.0))] == [1, 1]


def test_headings_gaps_and_widths(spark):
    got = lines(spark, dict(text="WORK", outline_level=2), dict(text="x" * 100), dict(text="short"), dict(text="tabbed", tab_stops=[30.0, 490.0]), dict(text=" "), dict(text="Head", outline_level=9, size=14.0))
    assert [(r["gap_before"], r["size"], r["bold"]) for r in got] == [(1.5, 15.0, True), (1.0, 10.0, False), (0.0, 10.0, False), (0.0, 10.0, False), (1.5, 14.0, True)]
    assert [r["fills_width"] for r in got] == [False, True, False, True, False] and got[0]["all_caps"]


def test_columns_of_tables(spark):
    got = lines(spark, dict(text="left", in_table=True), dict(text="right" * 20, in_table=True, table_col=1), dict(text="top"))
    assert [r["column"] for r in got] == [0, 1, 0] and got[0]["fills_width"]
    assert [r["column"] for r in lines(spark, dict(text="a", in_table=True, table_col=1), dict(text="b", table_col=0))] == [0, 0]


def test_windows_of_paragraph_lines(spark):
    """One exchange, two sorts and two passes over a document's paragraphs; texts are worked on before them."""
    kind = "doc_id int, para_no int, text string, outline_level int, bold boolean, italic boolean, size double, indent_pt double, list_level int, tab_stops array<double>, in_table boolean, table_col int"
    plan = docx_lines.paragraph_lines(spark.createDataFrame([], kind))._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning")
    assert (above.count(" Window "), above.count(" Sort "), above.count("regexp")) == (2, 2, 0) and "regexp" in below


def test_texts_of_the_query_are_not_shuffled(spark):
    from foliant.plans import docx_queries
    from tests.test_queries import SF

    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    plan = docx_queries.paragraph_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Shipped goods" not in plan.split("Exchange")[1]
