"""Readers of document bytes: DOCX, ZIP of DOCX, HTML, JSON tables. Bad input gives an empty text, never a failed job."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcegrove.functions import rules

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CHUNK_SCHEMA = "chunk_id string, text string, org string, code string, version string, clause string, clause_title string, status string, source_url string"


def _paragraph(p: ElementTree.Element) -> str:
    return "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" for t in p.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))


def docx_text(raw: bytes, tables: bool = True) -> str:
    """Stripped paragraphs with text, then all table cells row by row, a line each; S1 (tables=False): all paragraphs as they are."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{W}body")
        if body is None:
            return ""
        own = [_paragraph(p) for p in body.findall(f"{W}p")]
        if not tables:
            return "\n".join(own)
        cells = ["\n".join(_paragraph(p) for p in c.iter(f"{W}p")) for t in body.findall(f"{W}tbl") for r in t.iter(f"{W}tr") for c in r.findall(f"{W}tc")]
        return "\n".join(x.strip() for x in [*own, *cells] if x.strip())
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, ValueError):
        return ""


def member_order(name: str) -> tuple[int, str]:
    """The number between underscores, then the file name."""
    base = name.rsplit("/", 1)[-1]
    found = re.search(r"_(\d+)_", base)
    return (int(found[1]) if found else 999_999, base.lower())


def zip_text(raw: bytes, code: str | None = None) -> str:
    """S3: the texts of the archive's DOCX members in order, a blank line between them; those of the code asked for if any member names it."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        names = [n for n in z.namelist() if n.lower().endswith(".docx") and not n.startswith("__MACOSX/") and not n.rsplit("/", 1)[-1].startswith(("~$", "._"))]
    except (zipfile.BadZipFile, OSError):
        return ""
    digits = re.sub(r"\D", "", code or "")
    mine = [n for n in names if digits and digits in re.sub(r"\D", "", n.rsplit("/", 1)[-1])]
    parts = []
    for n in sorted(mine or names, key=member_order):
        try:
            parts.append(docx_text(z.read(n)))
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
            continue
    return "\n\n".join(p for p in parts if p)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.off = 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.off:
            self.off -= 1

    def handle_data(self, data):
        if not self.off and data.strip():
            self.out.append(data.strip())


def html_text(html: str) -> str:
    """The stripped text runs, a line each, without scripts, styles and comments."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(p.out)


# The parts of a PDF file that carry text: streams, text objects, and what stands in them.
_STREAM = re.compile(rb"<<(?:(?!stream\b).)*?>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_TEXT_OBJECT = re.compile(rb"\bBT\b(.*?)\bET\b", re.S)
_TEXT_PART = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]+>|\bT[dDm*]\B|\bT[dDm]\b|T\*|['\"](?=\s)|(?<=[\s\])>])-?\d+(?:\.\d+)?(?=[\s(<\]])", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in an array of strings, in thousandths of the font size, that counts as a space.
PDF_GAP = 200


def pdf_string(raw: bytes) -> str:
    """A literal or hexadecimal string: UTF-16 with a mark, else Latin-1."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        value = _ESCAPE.sub(lambda m: _ESCAPED.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else m[1]), raw[1:-1])
    return value.decode("utf-16", "replace") if value[:2] in (b"\xfe\xff", b"\xff\xfe") else value.decode("latin-1")


def pdf_text(raw: bytes) -> str:
    """The text layer of a PDF file, a line for each move of the text position; empty for what is no PDF.

    Reads plain and deflated content streams in file order and strings in plain encodings. Fonts with glyph numbers of their own, encrypted
    files and object streams need a PDF library, which isn't here.
    """
    lines: list[str] = []
    for m in _STREAM.finditer(raw or b""):
        body = m[1]
        if b"FlateDecode" in raw[m.start() : m.start(1)]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for block in _TEXT_OBJECT.findall(body):
            line = ""
            for part in _TEXT_PART.findall(block):
                if part[:1] in b"(<":
                    line += pdf_string(part)
                elif part[:1] in b"T'\"":
                    lines.append(line)
                    line = ""
                elif float(part) <= -PDF_GAP and line and not line.endswith(" "):
                    line += " "
            lines.append(line)
    return "\n".join(x for x in (" ".join(x.split()) for x in lines) if x)


def kind_of(content_type: Column, url: Column) -> Column:
    """Which reader a response needs."""
    t, u = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(u.endswith(".pdf") | t.contains("application/pdf"), "pdf").when(u.endswith(".docx") | t.contains("wordprocessingml"), "docx").when(u.endswith(".zip") | t.contains("zip"), "zip").otherwise("html")
    )


def read_documents(files: DataFrame, content: str = "content", kind: str = "kind", code: str | None = None) -> DataFrame:
    """Files with text in place of content (PDF: its plain text layer, see `pdf_text`); null for other kinds."""
    keys = [c for c in files.columns if c != content]
    rows = files.select(*keys, F.col(kind).alias("__kind"), (F.col(code) if code else F.lit(None).cast("string")).alias("__code"), content)
    n = len(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, c, raw in zip(*(batch.column(n + i).to_pylist() for i in range(3)), strict=True):
                raw = raw or b""
                out.append(docx_text(raw) if k == "docx" else zip_text(raw, c) if k == "zip" else html_text(raw.decode("utf-8", "replace")) if k == "html" else pdf_text(raw) if k == "pdf" else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(out, pa.string())], [*keys, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(read, f"{schema}, text string")


def html_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """S5 over a table with html as text."""
    keys = [c for c in pages.columns if c != html]
    n = len(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array([html_text(h or "") for h in batch.column(n).to_pylist()], pa.string())], [*keys, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema.fields)
    return pages.select(*keys, html).mapInArrow(read, f"{schema}, text string")


def html_links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, pos, link) of all links of a page, in order."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(*keys, F.posexplode(links).alias("pos", "link"))


def json_chunks(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """A JSON array file as a table of a fixed schema."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def of_code(chunks: DataFrame, code: str, org: str | None = None, limit: int = 40) -> DataFrame:
    """A document's first chunks by id; the organisation is asked for before the limit."""
    out = chunks.filter(F.col("code") == code)
    if org is not None:
        out = out.filter(F.col("org") == org)
    return out.orderBy("chunk_id").limit(limit)


def web_results(listing: DataFrame, most: int = 3, sites: list[str] | None = None) -> DataFrame:
    """The `most` best results of each query of a listing (query, rank, link, title), of the standards bodies' sites only."""
    host = F.regexp_extract("link", r"^[a-z]+://([^/:]+)", 1)
    asked = reduce(lambda out, s: out | (host == s) | host.endswith(f".{s}"), rules.STANDARDS_SITES if sites is None else sites, F.lit(False))
    kept = listing.filter(asked).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "link")))
    return kept.filter(F.col("rank") <= most)
