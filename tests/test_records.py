"""Dates, sections, records, replies, diffs, files, cleaning and streams on small cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import dates, json_repair, sections
from foliant.operators import cleaning, scoring, tailoring, tracker
from foliant.sources import files
from foliant.streaming import tracker as stream


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, t string").select("k", f(F.col("t")).alias("x")).orderBy("k").collect()
    return [r["x"] for r in rows]


def test_iso(spark):
    cases = {"Aug 2025": "2025-08", "sept '19": "2019-09", "May 49": "2049-05", "May 50": "1950-05", "13/2020": "2020-13", "2021-3": "2021-03", "2021": "2021", "heute": "Present", "to date": "Present", "soon": "soon", "": ""}
    assert column(spark, cases, dates.iso) == list(cases.values())


def test_ranges(spark):
    lines = ["Clerk, Jan 2019 – Mar 2021", "2019 - present", "seit 2020 tätig", "Graduated 2015", "no date", "Apr 2010 until now"]
    got = [(r["start"], r["end"], r["current"]) for r in column(spark, lines, dates.find_range)]
    assert got == [("Jan 2019", "Mar 2021", False), ("2019", "Present", True), ("2020", "Present", True), ("", "2015", False), ("", "", False), ("Apr 2010", "Present", True)]
    assert column(spark, ["Acme Ltd | Jan 2019 - Mar 2021", "Now Ltd 2020"], dates.strip_dates) == ["Acme Ltd", "Ltd"]
    assert column(spark, ["March 2019\t- Present", "Acme | May 2020"], dates.repair_split) == ["March 2019 - Present", "Acme\tMay 2020"]


def test_sections(spark):
    cases = {
        "WORK EXPERIENCE": "experience", "Professional Summary": "summary", "AUSBILDUNG / EDUCATION": "education", "TECHNICALSKILLS": "skills", "EMPLOYMENT CHRONICLE": "experience",
        "KEY SKILLS MATRIX": "skills", "Continuing Education": "certifications", "Master of Technology 2014": None, "Acme Ltd": None, "Languages:": "languages", "": None, "Personal details": "contact",
    }
    assert column(spark, cases, sections.section_key) == list(cases.values())


def test_json():
    assert json_repair.extract_object('```json\n{"a": 1}\n```') == {"a": 1}
    assert json_repair.extract_object('Here: {"a": "}"} and {more}') == {"a": "}"}
    assert json_repair.extract_object('{"a": [{"b": 1}, {"b": 2}, {"b": "cut') == {"a": [{"b": 1}, {"b": 2}]}
    assert json_repair.extract_object('{"a": [1, 2,], "b": 3,}') == {"a": [1, 2], "b": 3}
    assert json_repair.extract_object("none") is None and json_repair.extract_object(None) is None


def test_completeness(spark):
    row = [("Jo Roe", "a@b.c", "", ("Graz", "", ""), [("Acme", "Clerk", "2019", "", ["x"]), ("Acme", "", "2019", "", [])], [("TU", "MSc")], 4, "s" * 41)]
    schema = "name string, email string, phone string, loc struct<city:string,state:string,country:string>, e array<struct<company:string,position:string,start_date:string,end_date:string,responsibilities:array<string>>>, d array<struct<institution:string,degree:string>>, k int, s string"
    frame = spark.createDataFrame(row, schema)
    contact = F.struct("name", "email", "phone", F.col("loc").alias("location"), F.lit("").alias("linkedin"), F.lit("").alias("website"))
    got = frame.select(scoring.completeness(contact, F.col("s"), F.col("e"), F.col("d"), F.col("k")).alias("x")).first()["x"]
    assert got["overall"] == 68 and got["fields"]["work_experience"] == 50 and got["missing"] == ["linkedin", "phone", "website"]
    personal = F.struct("email", "phone", F.lit("Graz").alias("location"), F.lit("").alias("linkedin"))
    saved = frame.select(scoring.saved_completion(personal, F.col("s"), {"skills": F.col("k"), "experience": F.size("e"), "education": F.size("d"), "certifications": F.lit(0)}).alias("x")).first()["x"]
    assert (saved["score"], saved["missing"]) == (70, ["Phone", "LinkedIn", "Certifications"])


def test_diff(spark):
    roles = spark.createDataFrame([(1, 0, "Clerk", "Acme", "- a\n- b"), (1, 1, "Lead", "Zed", "c")], "resume_id int, index int, role string, company string, description string")
    schema = "resume_id int, index int, pos int, bullets array<struct<old:string,new:string,action:string>>, description string"
    answers = spark.createDataFrame([(1, 0, 0, [("x", "y", "add")], None), (1, 0, 1, [("a", "A", "modify"), ("b", None, "remove"), ("", "d", "odd")], None)], schema)
    diff = tailoring.tailored(roles, answers)
    assert [b["action"] for b in diff.where("index = 0").first()["bullets"]] == ["modify", "remove", "modify"]
    said = spark.createDataFrame([(1, 0, 0, False), (1, 0, 1, False)], "resume_id int, index int, bullet int, accepted boolean")
    assert {r["index"]: r["description"] for r in tailoring.projected(diff, said).collect()} == {0: "a\nb\nd", 1: "c"}
    assert {r["index"]: r["x"] for r in diff.select("index", tailoring.accept_all(F.col("bullets")).alias("x")).collect()} == {0: "A\nd", 1: "c"}
    block = spark.createDataFrame([("a\nb", "A")], "o string, n string").select(tailoring.aligned(F.col("o"), F.col("n")).alias("x")).first()["x"]
    assert [(b["old"], b["new"], b["action"]) for b in block] == [("a", "A", "modify"), ("b", "b", "remove")]
    scores = spark.createDataFrame([(80.4, 60.0), (None, 120.0)], "a double, b double").select(tailoring.clean_scores(F.col("a"), F.col("b")).alias("x")).collect()
    assert [tuple(r["x"]) for r in scores] == [(80, 80), (None, 100)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_validation(spark):
    pad = b" " * 200
    good = docx("<w:p><w:r><w:t>Jo</w:t></w:r></w:p>")
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("xl/workbook.xml", "x" * 200)
    cases = [(b"", "a.pdf", "empty_file"), (b"abc", "a.pdf", "too_small"), (b"%PDF-1.4" + pad, "a.pdf", ""), (b"junk%PDF-" + pad, "a.docx", ""), (b"{\\rtf" + pad, "a", "rtf"), (bytes.fromhex("D0CF11E0A1B11AE1") + pad, "a.doc", "legacy_doc"), (pad, "a.txt", "unsupported_type"), (good, "a.docx", ""), (other.getvalue(), "a.docx", "wrong_ooxml"), (b"PK\x03\x04" + pad, "a.docx", "corrupt_docx"), (None, "x", "empty_file")]
    got = files.validate(spark.createDataFrame([(i, bytearray(b) if b is not None else None, n) for i, (b, n, _) in enumerate(cases)], "k int, content binary, filename string")).orderBy("k").collect()
    assert [r["code"] for r in got] == [c for _, _, c in cases]
    assert [r["kind"] for r in got if not r["code"]] == ["pdf", "pdf", "docx"] and got[3]["warning"] and got[8]["actual"] == "an Excel workbook"


def test_docx(spark):
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Work</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr><w:ind w:left="720" w:hanging="360"/></w:pPr><w:r><w:t>Acme</w:t><w:tab/><w:t>2020</w:t><w:br/><w:t>second</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Clerk</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2019 - 2020</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:rPr><w:sz w:val="32"/></w:rPr></w:style></w:styles>'
    data = docx(body, **{"word/styles.xml": styles})
    rows = files.docx_paragraphs(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).orderBy("para_no").collect()
    assert [r["text"] for r in rows] == ["Work", "Acme\t2020", "second", "Clerk\t2019 - 2020"]
    assert (rows[0]["outline_level"], rows[0]["bold"], rows[0]["size"]) == (1, True, 16.0)
    assert (rows[1]["list_level"], rows[1]["indent_pt"], rows[3]["in_table"]) == (1, 18.0, True)


def test_extraction_and_sinks(spark, tmp_path):
    tries = [(1, 0, "a", "x" * 130), (1, 1, "b", "y" * 500), (2, 0, "a", "x"), (2, 1, "b", "yy"), (3, 0, "a", "")]
    got = files.best_extraction(spark.createDataFrame(tries, "doc_id int, priority int, method string, text string"))
    assert sorted((r["doc_id"], r["method"], r["status"]) for r in got.collect()) == [(1, "a", 200), (2, "b", 200), (3, "a", 422)]
    files.write_json(spark.createDataFrame([(1, None)], "k int, t string"), str(tmp_path / "out"))
    assert [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()] == [{"k": 1, "t": ""}]
    (tmp_path / "one.txt").write_text("a\nb")
    assert files.read_texts(spark, str(tmp_path / "one.txt")).first().asDict() == {"name": "one", "text": "a\nb"}


def line(n, text, **more):
    base = dict(line_no=n, text=text, page=1, column=0, x0=0.0, x1=0.0, size=10.0, bullet=False, bullet_level=0, heading=False, gap_before=0.0, fills_width=False, col_right=0.0, text_x0=0.0, bold=False, all_caps=False)
    return {**base, **more}


def folded(spark, rows, method="pdfplumber"):
    frame = spark.createDataFrame([{"doc_id": 1, **x} for x in rows], f"doc_id long, {cleaning.LINE}")
    return [r["text"] for r in cleaning.fold_lines(frame, method).orderBy("line_no").collect()]


def test_broken_words(spark):
    rows = [line(0, "built the Python-"), line(1, "based cross-"), line(2, "team TOOL", bold=True), line(3, "a devel-"), line(4, "opment"), line(5, "end-")]
    frame = spark.createDataFrame([{"doc_id": 1, **x} for x in rows], f"doc_id long, {cleaning.LINE}")
    got = cleaning.dehyphenate(frame).orderBy("line_no").collect()
    assert [(r["text"], r["bold"]) for r in got] == [("built the Pythonbased cross-team TOOL", True), ("a development", False), ("end-", False)]


LONG = "improving response accuracy by"


@pytest.mark.parametrize(
    "first, second, joined",
    [
        (dict(fills_width=True), {}, True),
        (dict(fills_width=True), dict(text="38% In all."), True),
        ({}, {}, False),  # nothing says that the first line ran out of room
        (dict(x1=200.0, col_right=215.0), dict(text="38% in all.", x1=66.0), True),  # a word of 3 and a blank, 6 wide each, ends at 224
        (dict(x1=200.0, col_right=221.1), dict(text="38% in all.", x1=66.0), False),  # half a character's slack
        (dict(x1=200.0), dict(text="38% in all.", x1=66.0), True),  # no column: the wider of both
        (dict(x1=60.0), dict(text="38% in all.", x1=100.0), False),
        (dict(fills_width=True), dict(x0=4.0), False),
        (dict(fills_width=True), dict(page=2), False),
        (dict(fills_width=True), dict(size=13.0), False),
        (dict(fills_width=True), dict(gap_before=0.7), False),
        (dict(fills_width=True), dict(bullet=True), False),
        (dict(fills_width=True, heading=True), {}, False),
        (dict(fills_width=True, text="a\ttab in a line that is long"), {}, False),
        (dict(fills_width=True, text="too short"), {}, False),
        (dict(fills_width=True, text=LONG + " it."), dict(text="Next"), False),
        (dict(fills_width=True, text=LONG + " it."), dict(text="next"), True),
        (dict(fills_width=True, text=LONG + " (2019)"), dict(text="Next"), False),
    ],
)
def test_wrapped_lines(spark, first, second, joined):
    rows = [line(0, **{"text": LONG, **first}), line(1, **{"text": "38% in all.", **second})]
    assert len(folded(spark, rows)) == (1 if joined else 2)


def test_wrapped_lines_go_on(spark):
    rows = [line(0, LONG, fills_width=True), line(1, "more and more until"), line(2, "THE END"), line(3, "Next")]
    assert folded(spark, rows) == [LONG + " more and more until THE END Next"]  # what is joined keeps the first line's width
    assert folded(spark, rows, "plaintext") == [r["text"] for r in rows]
    capitals = [line(0, "A HEADLINE THAT GOES ON AND ON", fills_width=True, all_caps=True), line(1, "and more")]
    frame = spark.createDataFrame([{"doc_id": 1, **x} for x in capitals], f"doc_id long, {cleaning.LINE}")
    assert [r["all_caps"] for r in cleaning.fold_lines(frame, "x").collect()] == [False]


@pytest.mark.parametrize(
    "first, second, joined",
    [
        (dict(text_x0=20.0), dict(x0=20.0), True),
        (dict(text_x0=10.5), dict(x0=10.5), False),  # no hanging indent
        (dict(text_x0=20.0), dict(x0=22.0), False),
        (dict(fills_width=True), dict(x0=9.0), True),
        (dict(fills_width=True), dict(x0=7.0), False),
        (dict(fills_width=True, bullet_level=1), dict(x0=10.0), False),  # a label
        (dict(fills_width=True, bullet_level=1, text="a duty " * 9), dict(x0=10.0), True),
        (dict(fills_width=True, text="It ends."), dict(x0=10.0), False),
        (dict(fills_width=True), dict(x0=10.0, heading=True), False),
    ],
)
def test_bullets_go_on(spark, first, second, joined):
    rows = [line(0, **{"text": "a duty that goes on", "bullet": True, "bullet_level": 2, "x0": 10.0, **first}), line(1, **{"text": "over here", **second})]
    assert len(folded(spark, rows, "plaintext")) == (1 if joined else 2)


def test_inferred_bullets(spark):
    shifted = spark.createDataFrame([{"doc_id": 1, **line(i, "t", x0=x)} for i, x in enumerate((0.0, 0.0, 20.0))], f"doc_id long, {cleaning.LINE}")
    assert [r["bullet_level"] for r in cleaning.infer_bullets(shifted).orderBy("line_no").collect()] == [0, 0, 2]


def test_tracker_rows(spark):
    post = spark.createDataFrame([("Clerk", None, "Graz", "", "u", ["SQL"])], "title string, company string, location string, salary string, url string, skills_found array<string>")
    job = tracker.mark_applied(post, F.lit("me"), F.current_timestamp()).first()
    assert (job["company"], job["status"], job["skills"]) == ("Unknown", "Applied", ["SQL"])
    owned = spark.createDataFrame([("u", 1, True), ("u", 2, False), ("v", 3, True)], "user string, id int, is_default boolean")
    new = tracker.make_default(owned, "user", "id", spark.createDataFrame([("u", 2)], "user string, id int"))
    assert {r["id"]: r["is_default"] for r in new.collect()} == {1: False, 2: True, 3: True}
    views = spark.createDataFrame([("u", "a", "2024-01-01 01:00:00"), ("u", "a", "2024-01-01 09:00:00"), ("u", "", "2024-01-01 01:00:00"), ("u", "", "2024-01-01 02:00:00")], "user string, url string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert tracker.first_per_day(views, ("user", "url"), "ts", url="url").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 4) for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id int, ts string, user_id int").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = stream.daily(source, {"n": "user_id < 2"}).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = tracker.dense_trend(frame, "ts", {"n": F.col("user_id") < 2}, days=3)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_goes_on_from_its_state(spark, tmp_path):
    """Days are written once, when they are over by the watermark; what comes for them after that is late."""
    steps = [
        ["01 01:00", "01 23:59", "02 05:00"],  # no day is over
        ["02 06:00", "01 12:00", "04 00:00"],  # all in time; the watermark comes to the end of day 2
        ["01 13:00", "02 23:00", "04 23:00"],  # days 1 and 2 are written, so two of these are late
        ["02 08:00", "03 08:00", "06 23:00"],  # day 3 wasn't over yet
        [],
    ]
    schema, days = "ts timestamp", []
    (tmp_path / "in").mkdir()
    counts = stream.daily(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), {"n": "true"}, late="1 day")
    for step in steps:
        if step:
            spark.createDataFrame([(f"2024-01-{t}:00",) for t in step], "ts string").select(F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.take_in(counts, str(tmp_path / "out"), str(tmp_path / "state"))
        days.append({r["day"].day: r["n"] for r in spark.read.schema(counts.schema).parquet(str(tmp_path / "out")).collect()})
    assert days == [{}, {1: 3, 2: 2}, {1: 3, 2: 2}, {1: 3, 2: 2, 3: 1, 4: 2}, {1: 3, 2: 2, 3: 1, 4: 2}]


@pytest.mark.parametrize("name", ["pdf_text", "ocr"])
def test_capabilities(spark, name):
    row = files.capabilities(spark).where(F.col("capability") == name).first()
    assert row["reason"]


def test_headings_by_windows(spark):
    """The body's size is the commonest by characters, of equal ones the first; lines are made once and a section's key is only looked for where one may start."""
    from pyspark.sql import functions as F

    from foliant.operators import lines

    rows = [(d, n, t, s, False, b, False) for d, ls in ((1, [("Skills", 12.0, False), ("aaaa", 10.0, False), ("bbbb", 10.2, False)]), (2, [("xx", 9.0, False), ("yy", 11.0, True)]), (None, [("zz", 9.0, False)])) for n, (t, s, b) in enumerate(ls)]
    given = spark.createDataFrame(rows, "doc_id long, line_no int, text string, size double, bullet boolean, bold boolean, all_caps boolean")
    marked = lines.mark_headings(given)
    assert [tuple(r) for r in marked.select("doc_id", "line_no", "body_size", "heading").orderBy("doc_id", "line_no").collect()] == [(1, 0, 10.0, True), (1, 1, 10.0, False), (1, 2, 10.0, False), (2, 0, 9.0, False), (2, 1, 9.0, True)]
    sizes = {r["doc_id"]: r["body_size"] for r in lines.body_size(given.where("doc_id is not null")).collect()}
    assert sizes == {1: 10.0, 2: 9.0}
    assert "Join" not in marked._jdf.queryExecution().optimizedPlan().toString()
    assert {r[0] for r in marked.select(F.when(lines.may_start(), F.col("text"))).collect() if r[0]} == {"Skills", "yy"}
