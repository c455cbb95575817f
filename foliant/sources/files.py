"""Uploaded files: validation by content, DOCX paragraphs, corpus text and JSON sinks, and what this host can't read."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from importlib.util import find_spec
from shutil import which
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits in bytes and the first bytes of each container.
LEAST, MOST = 100, 15 * 1024 * 1024
PDF, ZIP, OLE2, RTF = "255044462D", "504B0304", "D0CF11E0A1B11AE1", "7B5C727466"


#: What is expected of one document.
TRUTH = (
    "struct<name:string,email:string,phone:string,linkedin:string,roles:array<struct<company:string,position:string,start:string>>,"
    "degrees:array<struct<institution:string,degree:string,major:string>>,skills_sample:array<string>>"
)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the expected fields of each record: files of one object whose keys name the documents."""
    held = F.from_json("value", f"map<string,{TRUTH}>")
    return spark.read.text(path, wholetext=True).select(F.explode(held).alias("doc_id", "t")).select("doc_id", "t.*")


def write_json(df: DataFrame, path: str) -> None:
    """One object by line; null texts are written as empty ones, so that every key is there."""
    texts = {c: F.coalesce(c, F.lit("")) for c, t in df.dtypes if t == "string"}
    df.withColumns(texts).write.mode("overwrite").json(path)


def sniff(content: Column) -> Column:
    """pdf, zip, ole2, rtf or unknown, by first bytes; a PDF header may stand anywhere in the first 1024."""
    head = F.hex(F.substring(content, 1, 1024))
    within = (F.length(F.regexp_extract(head, f"^(?:..)*?{PDF}", 0)) > 0)
    return F.when(head.startswith(PDF), "pdf").when(head.startswith(ZIP), "zip").when(head.startswith(OLE2), "ole2").when(head.startswith(RTF), "rtf").when(within, "pdf").otherwise("unknown")


@F.pandas_udf(StringType())
def docx_fault(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """corrupt_docx, wrong_ooxml with what the file is, or null for a sound DOCX."""
    def fault(data: bytes) -> str | None:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
            names = archive.namelist()
            if "word/document.xml" not in names:
                kinds = (("ppt/", "a PowerPoint presentation"), ("xl/", "an Excel workbook"), ("mimetype", "an OpenDocument file"))
                return "wrong_ooxml:" + next((what for start, what in kinds if any(n.startswith(start) for n in names)), "not a Word document")
            return "corrupt_docx" if archive.testzip() else None
        except (zipfile.BadZipFile, OSError, zipfile.zlib.error):
            return "corrupt_docx"

    for part in content:
        yield part.map(fault)


def validate(files: DataFrame, name: str = "filename", content: str = "content") -> DataFrame:
    """files with kind (pdf or docx), status (200 or 400), code (empty for a good file), actual and warning."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    ext = F.lower(F.regexp_extract(F.trim(F.coalesce(name, F.lit(""))), r"\.([A-Za-z0-9]{1,5})$", 1))
    seen = files.withColumns({"_s": sniff(F.col(content)), "_e": ext, "size_bytes": size})
    sized = F.when(size == 0, "empty_file").when(size < LEAST, "too_small").when(size > MOST, "too_large")
    typed = F.when((F.col("_s") == "ole2") | (F.col("_e") == "doc"), "legacy_doc").when((F.col("_s") == "rtf") | (F.col("_e") == "rtf"), "rtf").when(F.col("_s").isin("pdf", "zip"), "").otherwise("unsupported_type")
    coded = seen.withColumn("_c", F.coalesce(sized, typed))
    fault = coded.withColumn("_f", F.when((F.col("_c") == "") & (F.col("_s") == "zip"), docx_fault(F.when((F.col("_c") == "") & (F.col("_s") == "zip"), F.col(content)))))
    kind = F.when(F.col("_s") == "pdf", "pdf").when(F.col("_s") == "zip", "docx")
    good = F.coalesce(F.split("_f", ":")[0], F.col("_c"))
    out = fault.withColumns({"code": good, "kind": F.when(good == "", kind), "actual": F.regexp_extract("_f", "^wrong_ooxml:(.*)$", 1), "status": F.when(good == "", 200).otherwise(400)})
    odd = (F.col("code") == "") & (F.col("_e") != "") & (F.col("_e") != F.col("kind"))
    return out.withColumn("warning", F.when(odd, F.concat(F.lit("named ."), "_e", F.lit(", read as "), "kind"))).drop("_s", "_e", "_c", "_f")


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
TWIPS = 20  # a point
# Characters of symbol fonts that are a list's mark.
SYMBOL_MARKS = frozenset("F0B7 F0A7 F06F F075 F0D8 F0FC F0A8".split())
SKIPPED = {W + "del", W + "moveFrom", W + "rPr", W + "pPr", W + "instrText", W + "txbxContent"}
PARAGRAPH = "para_no int, text string, style string, outline_level int, bold boolean, italic boolean, size double, indent_pt double, list_level int, list_bullet boolean, tab_stops array<double>, in_table boolean, table_col int"


def _on(el) -> bool | None:
    """A toggle's value: absent is unknown, which isn't off."""
    return None if el is None else el.get(W + "val", "1") not in ("0", "false", "off", "none")


class Docx:
    """Paragraphs of a DOCX in the order of the document."""

    def __init__(self, data: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        self.styles, self.links = {}, {}
        styles = self.part("word/styles.xml")
        for s in styles.iter(W + "style") if styles is not None else ():
            self.styles[s.get(W + "styleId")] = s
        defaults = styles.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr/{W}sz") if styles is not None else None
        self.size = int(defaults.get(W + "val")) / 2 if defaults is not None else 10.5
        self.lists = self.numbering()
        rels = self.part("word/_rels/document.xml.rels")
        for r in rels if rels is not None else ():
            self.links[r.get("Id")] = r.get("Target", "")
        self.out: list[dict] = []

    def part(self, name: str):
        try:
            return ElementTree.fromstring(self.archive.read(name))
        except KeyError:
            return None

    def numbering(self) -> dict[tuple[str, int], tuple[bool, float | None]]:
        """Of each list and level: whether its mark is a bullet, and its indent; a list's own levels go before those of what it refers to."""
        root = self.part("word/numbering.xml")
        if root is None:
            return {}
        value = lambda el, path, default=None: default if el is None or (x := el.find(path)) is None else x.get(W + "val", default)

        def levels(node) -> dict[int, tuple[bool, float | None]]:
            return {int(x.get(W + "ilvl", "0")): (value(x, W + "numFmt", "bullet") == "bullet", self.indent(x.find(f"{W}pPr/{W}ind"))) for x in node.iter(W + "lvl")}

        shared = {a.get(W + "abstractNumId"): levels(a) for a in root.findall(W + "abstractNum")}
        out = {}
        for num in root.findall(W + "num"):
            for level, what in {**shared.get(value(num, W + "abstractNumId"), {}), **levels(num)}.items():
                out[num.get(W + "numId"), level] = what
        return out

    @staticmethod
    def indent(el) -> float | None:
        """Points from the margin to where the first line or its mark begins."""
        if el is None:
            return None
        twips = lambda *names: next((float(x) for n in names if (x := el.get(W + n))), 0.0)
        return max(0.0, twips("left", "start") - twips("hanging")) / TWIPS

    def style(self, style_id: str | None) -> list:
        """The style and those that it is based on; a circle ends."""
        chain, seen = [], set()
        while style_id in self.styles and style_id not in seen:
            seen.add(style_id)
            chain.append(self.styles[style_id])
            base = chain[-1].find(W + "basedOn")
            style_id = base.get(W + "val") if base is not None else None
        return chain

    @staticmethod
    def chosen(el):
        """Of one content in several forms the oldest, which all readers know."""
        return next((x for x in (el.find(MC + "Fallback"), el.find(MC + "Choice")) if x is not None), ())

    def runs(self, node, targets: list[str]) -> Iterator[tuple[str, object]]:
        for el in node:
            if el.tag in SKIPPED:
                continue
            if el.tag == MC + "AlternateContent":
                yield from self.runs(self.chosen(el), targets)
            elif el.tag == W + "r":
                props, text = el.find(W + "rPr"), ""
                for x in el:
                    if x.tag == W + "t":
                        text += x.text or ""
                    elif x.tag in (W + "br", W + "cr"):
                        text += "\n"
                    elif x.tag == W + "sym":
                        text += "" if x.get(W + "char", "").upper() in SYMBOL_MARKS else "•"
                    else:
                        text += {W + "tab": "\t", W + "noBreakHyphen": "-"}.get(x.tag, "")
                yield text, props
            else:
                if el.tag == W + "hyperlink" and (to := self.links.get(el.get(RELS + "id"))):
                    targets.append(to)
                yield from self.runs(el, targets)

    def paragraph(self, p, in_table: bool, col: int) -> None:
        targets: list[str] = []
        runs = [(t, r) for t, r in self.runs(p, targets) if t]
        props = p.find(W + "pPr")
        get = lambda path: props.find(path) if props is not None else None
        sid = get(W + "pStyle")
        chain = self.style(sid.get(W + "val") if sid is not None else None)
        name = next((n.get(W + "val", "") for s in chain if (n := s.find(W + "name")) is not None), "")
        heading = re.match(r"(?i)heading (\d)$", name)
        level = next((int(x.get(W + "val")) for x in [get(W + "outlineLvl"), *(s.find(f"{W}pPr/{W}outlineLvl") for s in chain)] if x is not None), -1)
        level = int(heading[1]) if heading else 1 if name.lower() == "title" else level + 1
        listed = next((x for x in [get(W + "numPr"), *(s.find(f"{W}pPr/{W}numPr") for s in chain)] if x is not None and x.find(W + "numId") is not None), None)
        number = listed.find(W + "numId").get(W + "val") if listed is not None else "0"  # 0 takes a paragraph out of its style's list
        depth = listed.find(W + "ilvl") if listed is not None else None
        level_of_list = -1 if number == "0" else int(depth.get(W + "val")) if depth is not None else 0
        bullet, list_indent = self.lists.get((number, level_of_list), (True, None))
        indents = [self.indent(get(W + "ind")), list_indent, *(self.indent(s.find(f"{W}pPr/{W}ind")) for s in chain)]
        tabs = get(W + "tabs")
        stops = [float(t.get(W + "pos", "0")) / TWIPS for t in tabs if t.get(W + "val") != "clear"] if tabs is not None else []

        def weighted(tag: str) -> bool:
            on = total = 0
            for t, r in runs:
                n = len(t.strip())
                own = [_on(x.find(W + tag)) for x in [r, *(s.find(W + "rPr") for s in chain)] if x is not None]
                total, on = total + n, on + n * bool(next((v for v in own if v is not None), False))
            return total > 0 and on > 0.6 * total
        sizes = [int(x.get(W + "val")) / 2 for _, r in runs if r is not None and (x := r.find(W + "sz")) is not None]
        based = next((int(x.get(W + "val")) / 2 for s in chain if (x := s.find(f"{W}rPr/{W}sz")) is not None), self.size)
        row = dict(style=name, outline_level=level, bold=weighted("b"), italic=weighted("i"), size=max(sizes, default=based), indent_pt=next((x for x in indents if x is not None), 0.0), list_level=level_of_list, list_bullet=bullet, tab_stops=stops, in_table=in_table, table_col=col)
        text = "".join(t for t, _ in runs)
        for piece in text.split("\n"):
            if piece.strip():
                self.out.append({"text": piece.strip(" "), **row})
        for to in targets:
            if (to := re.sub("^mailto:", "", to)) and to not in text:
                self.out.append({"text": to, **row})

    def table(self, t) -> None:
        rows = [[list(c.iter(W + "p")) for c in r.findall(W + "tc")] for r in t.findall(W + "tr")]
        text = lambda ps: " ".join("".join(x for x, _ in self.runs(p, [])) for p in ps).strip()
        if len(rows) == 1 and sum(len(c) >= 5 for c in rows[0]) >= 2:  # reading columns
            for k, cell in enumerate(rows[0]):
                for p in cell:
                    self.paragraph(p, True, k)
            return
        for row in rows:
            cells = [c for c in row if text(c)]
            short = len(cells) >= 2 and all(sum(bool(text([p])) for p in c) == 1 and len(text(c)) <= 60 for c in cells)
            at = len(self.out)
            for cell in cells:
                for p in cell:
                    self.paragraph(p, True, 0)
            if short and any(re.search(r"\b(?:19|20)\d{2}\b", text(c)) for c in cells) and len(self.out) > at:
                self.out[at:] = [{**self.out[at], "text": "\t".join(x["text"] for x in self.out[at:])}]

    def walk(self, node) -> None:
        for el in node:
            if el.tag == W + "p":
                self.paragraph(el, False, 0)
                old = {id(x) for f in el.iter(MC + "Fallback") for x in f.iter(W + "txbxContent")}  # a box and its older form are one
                boxes = [x for x in el.iter(W + "txbxContent")]
                for box in [x for x in boxes if id(x) not in old] or boxes:
                    self.walk(box)
            elif el.tag == W + "tbl":
                self.table(el)
            elif el.tag in (W + "sdt", W + "sdtContent", W + "body", W + "hdr"):
                self.walk(el)
            elif el.tag == MC + "AlternateContent":
                self.walk(self.chosen(el))

    def paragraphs(self) -> list[dict]:
        for name in sorted(n for n in self.archive.namelist() if re.match(r"word/header\d*\.xml$", n))[:2]:
            self.walk(self.part(name))
        self.walk(self.part("word/document.xml"))
        return [{"para_no": i, **row} for i, row in enumerate(self.out)]


def flat_paragraphs(data: bytes) -> list[dict]:
    """The texts of the document's paragraphs alone, without looks or lists."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    marks = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}
    texts = ["".join(x.text or "" if x.tag == W + "t" else marks.get(x.tag, "") for x in p.iter()) for p in root.iter(W + "p")]
    plain = dict(style="", outline_level=0, bold=False, italic=False, size=10.5, indent_pt=0.0, list_level=-1, list_bullet=True, tab_stops=[], in_table=False, table_col=0)
    return [{"para_no": i, "text": t, **plain} for i, t in enumerate(x.strip(" ") for text in texts for x in text.split("\n") if x.strip())]


def _read_docx(data: bytes | None) -> dict:
    """method, code and paragraphs: the structured reader, else the flat one, else the failure's code; one bad file ends no job."""
    found, method = [], ""
    for method, read in (("docx-xml", lambda: Docx(data).paragraphs()), ("docx-fallback", lambda: flat_paragraphs(data))):
        try:
            found = read()
            break
        except (zipfile.BadZipFile, zipfile.LargeZipFile, ElementTree.ParseError, KeyError, ValueError, TypeError, AttributeError, NotImplementedError, RuntimeError, OSError, zlib.error):
            found, method = None, ""
    code = "corrupt_docx" if found is None else "" if found else "no_text"
    return {"method": method, "code": code, "paragraphs": found or []}


def _read_parts(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in content:
        yield pd.DataFrame([_read_docx(x) for x in part], columns=["method", "code", "paragraphs"])


def read_docx(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, method (docx-xml, docx-fallback or none), status (200 or 422), code and paragraphs of each file."""
    kind = f"struct<method:string,code:string,paragraphs:array<struct<{', '.join(x.replace(' ', ':', 1) for x in PARAGRAPH.split(', '))}>>>"
    read = F.pandas_udf(_read_parts, kind)
    found = files.select(key, read(F.col(content)).alias("d"))
    return found.select(key, "d.method", F.when(F.col("d.code") == "", 200).otherwise(422).alias("status"), "d.code", "d.paragraphs")


def docx_paragraphs(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A row for each paragraph of each readable DOCX: text (tabs kept, soft breaks divide), style, outline level, weight, size, list, tab stops and table place."""
    return read_docx(files, key, content).select(key, F.inline("paragraphs"))


def capabilities(spark: SparkSession) -> DataFrame:
    """What this host can read besides DOCX and text: capability, available, reason."""
    has = lambda m: find_spec(m) is not None
    pdf = next((m for m in ("pdfplumber", "pdfminer", "pypdf") if has(m)), None)
    ocr = "tesseract" if which("tesseract") and has("pytesseract") else "rapidocr" if has("rapidocr") or has("rapidocr_onnxruntime") else None
    rows = [("pdf_text", pdf is not None, pdf or "no PDF library is installed"), ("ocr", ocr is not None and has("pypdfium2"), ocr or "no OCR engine is installed")]
    return spark.createDataFrame(rows, "capability string, available boolean, reason string")


def best_extraction(attempts: DataFrame, key: str = "doc_id", least: int = 120) -> DataFrame:
    """Of each document's attempts (priority, method, text) the first with `least` characters, else the longest; none has status 422."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    rank = F.struct((n >= least).cast("int"), F.when(n >= least, -F.col("priority")).otherwise(n), -F.col("priority"))
    best = attempts.groupBy(key).agg(F.max_by(F.struct("method", "text"), rank).alias("b"))
    empty = F.coalesce(F.trim("b.text"), F.lit("")) == ""
    return best.select(key, "b.method", "b.text", F.when(empty, 422).otherwise(200).alias("status"), F.when(empty, "extract_failed").otherwise("").alias("code"))
