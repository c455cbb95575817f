"""Replies of varying shape to one record."""

import json

from pyspark.sql import functions as F

from foliant.functions import replies


def test_record(spark):
    reply = {
        "contact": {"fullName": " Jo Roe ", "mobile": 431}, "objective": "Do good", "jobs": [{"jobTitle": "Clerk", "employer": "Acme", "from": "2019", "to": "now", "duties": [" a ", "", "b"]}, {"title": "Lead", "description": "x\n y"}],
        "education": [{"university": "TU", "major": "CS", "graduationYear": 2014}], "skills": ["Python, SQL", {"name": "python"}, "Tools: Git"],
    }
    rows = spark.createDataFrame([(json.dumps(reply),), ('{"skills": "a; b | A"}',), ("broken",), (None,)], "t string").select(replies.record(F.col("t")).alias("r")).collect()
    r = rows[0]["r"]
    assert (r["personal"]["name"], r["personal"]["phone"], r["personal"]["email"], r["summary"]) == ("Jo Roe", "431", "", "Do good")
    assert [(e["role"], e["company"], e["start_date"], e["end_date"], e["current"], e["description"]) for e in r["experience"]] == [("Clerk", "Acme", "2019", "Present", True, "a\nb"), ("Lead", "", "", "", False, "x\ny")]
    assert [(e["school"], e["field"], e["end_date"]) for e in r["education"]] == [("TU", "CS", "2014")]
    assert r["skills"] == ["Python", "SQL", "Git"]
    assert rows[1]["r"]["skills"] == ["a", "b"] and rows[2]["r"]["experience"] == [] and rows[3]["r"]["summary"] == ""
