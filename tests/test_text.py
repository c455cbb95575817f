"""Text functions and lines on small cases."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import lines, matching, postings


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (X.normalise, "  ofﬁce  “A” ’s​\tb \n c ", "office \"A\" 's\tb \n c"),
        (X.normalise, None, ""),
        (X.normalise, "(cid:127) Managed (cid:65)(cid:3)", "• Managed A"),
        (X.de_space, "E D U C A T I O N", "EDUCATION"),
        (X.de_space, "W O R K  E X P E R", "WORK EXPER"),
        (X.de_space, "ab c", "ab c"),
        (X.bullet_level, "• Lead", 1),
        (X.bullet_level, "◦ Led a team", 2),
        (X.bullet_level, "- built", 2),
        (X.bullet_level, "1. Designed the pipeline", 1),
        (X.bullet_level, "1. Short", 0),
        (X.bullet_level, "D. KILBRIDE ELECTRICAL", 0),
        (X.bullet_level, "o\tEnvironment: Python", 2),
        (X.bullet_text, "•  Lead", "Lead"),
        (X.is_all_caps, "WORK 2020", True),
        (X.is_all_caps, "A", False),
        (X.clean_skill, "Languages: Python", "Python"),
        (X.clean_skill, "- SQL", "SQL"),
        (X.strip_metrics, "Cut costs by 30% for 12 teams ($1.5M)", "Cut costs by for"),
        (X.find_email, "mail a.b@c.example.com, ok", "a.b@c.example.com"),
        (X.normalise_url, "example.com/x.", "https://example.com/x"),
        (matching.canonical_skill, "Tools: K8s", "kubernetes"),
        (matching.canonical_skill, "Java", "java"),
        (postings.strip_html, "<ul><li>Python</li><li>Go</li></ul><script>x</script>a<br>b &amp; c", "Python\nGo\na\nb & c"),
        (postings.seniority, "We seek a senior engineer", "senior"),
        (postings.experience_years, "needs 3-5 years of work", "3-5 years"),
    ],
)
def test_function(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_urls(spark):
    assert one(spark, "see www.example.com/a, x@mail.example.org and cv.pdf; systems.Deep", X.find_urls) == ["www.example.com/a"]


def test_qualifications(spark):
    text = "About\nRequirements:\n- Python\n* SQL skills\nBenefits\n- Dental"
    assert one(spark, text, postings.qualifications) == ["Python", "SQL skills"]
    assert one(spark, "Hello there\n- Python\n5+ years of Go", postings.qualifications) == ["Python", "5+ years of Go"]


def test_json_ld(spark):
    page = """<html><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Engineer","hiringOrganization":{"name":"Acme"},
    "jobLocation":{"address":{"addressLocality":"Graz","addressCountry":"AT"}},"baseSalary":{"value":{"minValue":10,"maxValue":20,"unitText":"HOUR"}},"description":"<p>Do</p>"}]}</script></html>"""
    found = one(spark, page, postings.json_ld)
    assert (found["title"], found["company"], found["location"], found["salary"], found["description"]) == ("Engineer", "Acme", "Graz, AT", "$10 - $20/hour", "Do")
    assert one(spark, "<p>none</p>", postings.json_ld) is None


def test_lines_sections_and_render(spark):
    text = "Jane Doe\n\nEXPERIENCE\n• Acme Ltd\n◦ Built it\nEDUCATION\nMSc"
    found = lines.text_lines(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"))
    rows = found.orderBy("line_no").collect()
    assert [(r["text"], r["bullet_level"], r["gap_before"], r["all_caps"]) for r in rows][:3] == [("Jane Doe", 0, 0.0, False), ("EXPERIENCE", 0, 1.0, True), ("Acme Ltd", 1, 0.0, False)]
    keyed = lines.mark_headings(found).withColumn("section_key", F.when(F.col("text").isin("EXPERIENCE", "EDUCATION"), F.lower("text")))
    assert [(r["text"], r["section"]) for r in lines.sections(keyed).orderBy("line_no").collect()] == [("Jane Doe", None), ("Acme Ltd", "experience"), ("Built it", "experience"), ("MSc", "education")]
    assert lines.render(found).first()["text"] == "Jane Doe\nEXPERIENCE\n• Acme Ltd\n  • Built it\nEDUCATION\nMSc"


def test_furniture(spark):
    rows = [(1, p, t) for p in (1, 2, 3) for t in ("Jane Doe - CV", f"real {p}", f"Page {p} of 3", "-----", "WWW")]
    kept = lines.drop_furniture(spark.createDataFrame(rows, "doc_id long, page int, text string"))
    assert sorted(r["text"] for r in kept.collect()) == ["-----"] * 0 + ["real 1", "real 2", "real 3"]


def test_skill_match_and_loose_match(spark):
    has = spark.createDataFrame([(1, "JS"), (1, "Java"), (2, "Go")], "resume_id int, skill string")
    wants = spark.createDataFrame([(9, "JavaScript"), (9, "Django"), (9, "golang")], "posting_id int, skill string")
    assert sorted((r["resume_id"], r["matched"], r["percent"]) for r in matching.skill_match(has, wants).collect()) == [(1, 1, 33), (2, 1, 33)]
    truth = spark.createDataFrame([(1, "Acme Ltd."), (1, "Zed")], "k int, value string")
    parsed = spark.createDataFrame([(1, 0, "other"), (1, 1, "ACME LTD, Graz")], "k int, pos int, value string")
    assert sorted((r["truth"], r["parsed"]) for r in matching.loose_match(truth, parsed, ["k"]).collect()) == [("Acme Ltd.", "ACME LTD, Graz"), ("Zed", None)]


def plainly_normal(t):
    """normalise in plain Python, for texts without characters by their numbers."""
    import re

    for a, b in X.LIGATURES.items():
        t = t.replace(a, b)
    t = re.sub("[\u200b-\u200d\ufeff]", "", t).translate(str.maketrans("\u2018\u2019\u201b\u201c\u201d", "'''\"\""))
    return re.sub("[\x0b-\x0d\x1c-\x20\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\u2000-\u200a]+", " ", t).strip(X.WHITE)


def test_normal_texts_and_bullets_of_all_characters(spark):
    import random

    draw = random.Random(7)
    signs = [*"  \t\n\r\x0b\x1c\x1f\x7f\x00abZ.\u2022\u2013o1)(-", "\u200b", "\ufeff", "\ufb01", "\ufb04", "\u2019", "\u201c", "\u00a0", "\u2009", "\u3000", "\u00e9", "\u6f22", "\U0001f600", "\u0085", "\u00ad"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 9))) for _ in range(3000)] + ["", " ", "a\n", "\n", "x  y", "\u2022  a", "o  Then it was shipped", "\u2013a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.normalise(F.col("t")).alias("n"), X.bullet_level(F.col("t")).alias("level"), F.col("t").rlike(X.MAY_MARK).alias("may"), X.bullet_text(F.col("t")).alias("body")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [plainly_normal(t) for t in texts]
    assert all(r["may"] or (r["level"], r["body"]) == (0, texts[r["i"]]) for r in rows) and {r["level"] for r in rows} == {0, 1, 2}
    assert spark.range(1).select(X.normalise(F.lit(None).cast("string"))).first()[0] == ""
