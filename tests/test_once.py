"""What a line or an entry says is worked out once, not again in the filters behind it."""

from pyspark.sql import functions as F

from foliant.functions.text import once
from foliant.operators import records, word_boxes


def filters(frame):
    return [line for line in frame._jdf.queryExecution().optimizedPlan().toString().split("\n") if line.lstrip(" :+-").startswith("Filter")]


def test_filters_hold_no_patterns(spark):
    words = spark.createDataFrame([(1, 1, w, 50.0 + 40 * i, 80.0 + 40 * i, 40.0, 50.0, 10.0, "A-Bold") for i, w in enumerate(("•", "Built", "things"))], word_boxes.WORDS)
    lines = word_boxes.word_lines(words)
    assert [tuple(r) for r in lines.select("text", "bullet_level", "bold", "x0", "x1", "text_x0").collect()] == [("Built things", 1, True, 50.0, 160.0, 90.0)]
    assert not [f for f in filters(lines) if "regexp" in f or "rlike" in f.lower()]
    shape = "doc_id long, section string, entry long, line_no int, text string, bullet boolean, bullet_level int, start boolean, header boolean, bold boolean, italic boolean, all_caps boolean"
    rows = [(1, "education", 1, 1, "BA in Law | University of Graz", False, 0, True, True, False, False, False), (1, "education", 1, 2, "2001 - 2005", False, 0, False, True, False, False, False)]
    found = records.education(spark.createDataFrame(rows, shape))
    assert [tuple(r)[3:8] for r in found.collect()] == [("University of Graz", "BA", "Law", "", "2001")]
    assert not [f for f in filters(found) if "regexp" in f]
    jobs = records.experience(spark.createDataFrame([(1, "experience", 1, 1, "Data Engineer | Acme Ltd\tJan 2019 - Present", False, 0, True, True, False, False, False)], shape))
    assert [(r["company"], r["position"], r["start_date"], r["end_date"], r["current"]) for r in jobs.collect()] == [("Acme Ltd", "Data Engineer", "2019-01", "Present", True)]


def test_once(spark):
    kept = once(spark.range(3).withColumn("b", F.lit("x")), b=F.concat("b", F.col("id").cast("string")), c=F.col("id") + 1).where("b <> 'x1'")
    assert kept.columns == ["id", "b", "c"] and sorted(map(tuple, kept.collect())) == [(0, "x0", 1), (2, "x2", 3)]
    assert not [f for f in filters(kept) if "concat" in f]
