"""Records as PDF files: plain text pages in A4, with the two standard fonts."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

WIDTH, HEIGHT, MARGIN, LEADING = 595, 842, 48, 14


def wrapped(text: str, indent: int = 0) -> list[tuple[str, bool, int]]:
    """Lines (text, bold, indent in points) of up to 98 characters, fewer by a quarter of the indent; a line in capitals is bold."""
    out = []
    for raw in (text or "").splitlines():
        bullet = raw.lstrip().startswith(("-", "•", "*"))
        at = indent + (12 if bullet else 0)
        for part in textwrap.wrap(raw.strip(), max(10, 98 - at // 4)) or [""]:
            out.append((part, part.isupper() and any(c.isalpha() for c in part), at))
    return out


def escaped(text: str) -> bytes:
    return text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def page(rows: list[tuple[str, bool, int]]) -> bytes:
    out = []
    for k, (text, bold, indent) in enumerate(rows):
        out.append(b"BT /F%d 10 Tf %d %d Td (%s) Tj ET" % (2 if bold else 1, MARGIN + indent, HEIGHT - MARGIN - LEADING * k, escaped(text)))
    return b"\n".join(out)


def pdf_bytes(text: str | None) -> bytes:
    """The text as a PDF; without text, one empty page."""
    rows = wrapped(text or "")
    each = (HEIGHT - 2 * MARGIN) // LEADING
    pages = [page(rows[i : i + each]) for i in range(0, len(rows), each)] or [b""]
    kids = b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages)))
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages))]
    parts += [b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica%s /Encoding /WinAnsiEncoding >>" % bold for bold in (b"", b"-Bold")]
    for i, body in enumerate(pages):
        parts.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (WIDTH, HEIGHT, 6 + 2 * i))
        parts.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, part in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, part)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(parts) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, at))


def pdf(text: Column) -> Column:
    """A binary column of PDF files."""
    def make(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(pdf_bytes)

    return F.pandas_udf(make, BinaryType())(text)
