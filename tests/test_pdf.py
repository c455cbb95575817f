"""PDF files from text."""

import re

from pyspark.sql import functions as F

from foliant.sources import files, pdf


def test_pdf(spark):
    text = "JANE DOE\n" + "- a duty (with brackets) " * 12 + "\n" + "line\n" * 70
    data = pdf.pdf_bytes(text)
    assert data.startswith(b"%PDF-1.4") and b"/Count 2" in data and rb"\(with brackets\)" in data
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start : start + 4] == b"xref"
    for k, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(place) :].startswith(b"%d 0 obj" % k)
    assert all(len(t) <= 98 for t, _, _ in pdf.wrapped(text))
    rows = spark.createDataFrame([(text,), (None,)], "t string").select(pdf.pdf(F.col("t")).alias("content"), F.lit("a.pdf").alias("filename"))
    assert [r["code"] for r in files.validate(rows).collect()] == ["", ""]
