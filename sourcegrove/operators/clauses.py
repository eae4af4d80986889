"""Documents split into clauses by organisation (C1): specifications (C2, C3), RFCs (C4), others.

A body line opens a clause if it agrees with the table of contents; what counts as agreement depends on the clauses opened before, so a
document is read in one go, one document at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The forms of clause numbers, headings and entries of the table of contents.
NUMBER = r"(?:\d+[A-Za-z]?(?:\.\d+)*|[A-Z](?:\.\d+)*)"
HEADING = re.compile(rf"({NUMBER})\.?[ \t]+(.+)", re.I)
SUFFIX = re.compile(r"(\.\d+(?:\.\d+)*)[ \t]+(.+)")
ANNEX = re.compile(r"Annex[ \t]+([A-Z]|\d+)(?:[ \t]*\([^)]*\))?[ \t]*:?[ \t]*(.*)", re.I)
ENTRY = re.compile(rf"({NUMBER})\.?[ \t]+(.+?)[ \t]+(\d+)", re.I)
ANNEX_ENTRY = re.compile(r"Annex[ \t]+([A-Z]|\d+)(?:[ \t]*\([^)]*\))?[ \t]*:?[ \t]*(.*?)[ \t]+(\d+)", re.I)
BARE_ANNEX_CLAUSE = re.compile(r"([A-Z](?:\.\d+)+)[ \t]+(.+)", re.I)
BODY_LIKE = re.compile(r"[a-zA-Z]\)|(?:NOTE|Figure|Table)\b|-\s+|[•\[]", re.I)
NO_TITLE = re.compile(r"(?:NOTE|Figure|Table)\b|[•\[]", re.I)
# What titles are compared by (letters, digits, and the signs - ' / ( ) ), and dashes that count as hyphens.
TITLE_PART, DASHES = re.compile(r"[\w\-'/()]+"), {ord("–"): "-", ord("—"): "-"}
# Limits of the table of contents, of a heading, and of how alike a damaged title must be.
TOC_LINES, TOC_GAP, FIRST_ENTRIES, LINE_CHARS = 1500, 6, 20, 300
NUMBERED_ALIKE, TITLE_ALIKE = 0.60, 0.84
# Where lines end (other separators stay in their line, as in their body), and what is trimmed from a body.
BREAK, EDGES = re.compile(r"\r\n|[\n\r\f]"), "\t\n\r\f \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def clean(title: str) -> str:
    return " ".join(title.split()).rstrip(" \t.:")


def loose(title: str) -> str:
    """The words of a title for comparing damaged ones: what titles are made of (TITLE_PART), in small letters, one space apart; a broken
    number before them goes."""
    broken = SUFFIX.fullmatch(title.strip())
    small = clean(broken[2] if broken else title).casefold()
    return " ".join(TITLE_PART.findall(small.translate(DASHES)))


def alike(a: str, b: str) -> float:
    """C2g: three quarters of the matching-blocks ratio and a quarter of the share of common words."""
    a, b = loose(a), loose(b)
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    return 0.75 * SequenceMatcher(None, a, b).ratio() + 0.25 * len(x & y) / max(len(x), len(y))


def annex_number(name: str) -> str:
    return f"ANNEX-{name}" if name.isdigit() else name.upper()


def toc_entry(line: str) -> tuple[str, str] | None:
    """C2b."""
    line = line.strip()
    if m := ANNEX_ENTRY.fullmatch(line):
        return annex_number(m[1]), clean(m[2]) or f"Annex {m[1].upper()}"
    m = ENTRY.fullmatch(line)
    if not m or not clean(m[2]) or m[1].isdigit() and int(m[1]) > 99:
        return None
    return m[1].rstrip(".").upper(), clean(m[2])


def numbered(line: str, toc: dict[str, str]) -> str | None:
    """The entry whose number and title make up a line."""
    m = HEADING.fullmatch(line.strip())
    n = m[1].rstrip(".").upper() if m else None
    return n if n in toc and clean(m[2]).casefold() == clean(toc[n]).casefold() else None


def contents(lines: list[str]) -> tuple[dict[str, str], int]:
    """Number -> title in order, and the line behind the last entry; the table ends where a heading repeats the number and title
    of an entry, so a body line of the first clause that looks like an entry ("b ... 5") is none."""
    start = next((i for i, x in enumerate(lines) if x.strip().casefold() in ("contents", "table of contents")), None)
    found: dict[str, str] = {}
    if start is None:
        return found, 0
    last = start
    for i in range(start + 1, min(len(lines), start + TOC_LINES)):
        if numbered(lines[i], found):
            break
        if entry := toc_entry(lines[i]):
            found.setdefault(*entry)
            last = i
        elif found and i - last > TOC_GAP:
            break
    return found, last + 1


@dataclass
class Reader:
    """Where a document's reading stands: entries in order, the last one reached, and those opened."""

    toc: dict[str, str]
    at: int = -1
    seen: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.numbers = list(self.toc)
        self.place = {n: i for i, n in enumerate(self.numbers)}

    def exact(self, line: str) -> str | None:
        """C2e: the entry whose number and title (for an annex: number) stand in a line."""
        line = line.strip()
        if m := ANNEX.fullmatch(line):
            n = annex_number(m[1])
            return n if n in self.toc else None
        return numbered(line, self.toc)

    def following(self) -> str | None:
        """The entry behind the last one reached, unless it is open already."""
        n = self.numbers[self.at + 1] if self.at + 1 < len(self.numbers) else None
        return n if n not in self.seen else None

    def opens(self, line: str) -> str | None:
        """The entry that a line opens: by its own words, or, for the following entry only, by what is left of them (C2f)."""
        line = line.strip()
        if not line:
            return None
        n = self.exact(line)
        if n and n not in self.seen and self.place[n] > self.at:
            return n
        if len(line) > LINE_CHARS or not (n := self.following()):
            return None
        title = self.toc[n]
        if m := HEADING.fullmatch(line):
            rest = clean(m[2])
            same = rest.casefold() == clean(title).casefold()
            if m[1].rstrip(".").upper() == n and rest and not same and not NO_TITLE.match(rest) and alike(rest, title) >= NUMBERED_ALIKE:
                return n
        if BODY_LIKE.match(line):
            return None
        m = SUFFIX.fullmatch(line)
        if m and not n.endswith(m[1].upper()):
            return None
        rest = m[2] if m else line
        return n if clean(rest).casefold() == clean(title).casefold() and clean(rest) or alike(rest, title) >= TITLE_ALIKE else None


def spec_clauses(text: str) -> list[tuple[str, str, str]]:
    """C2 with a table of contents, C3 without: (number, title, body) in order; what stands before the first heading goes."""
    lines = BREAK.split(text)
    toc, start = contents(lines)
    out: list[tuple[str, str, list[str]]] = []
    if not toc:
        for line in lines:
            if m := BARE_ANNEX_CLAUSE.fullmatch(line.strip()):
                out.append((m[1].upper(), clean(m[2]), []))
            elif out:
                out[-1][2].append(line)
    else:
        reader = Reader(toc)
        early = set(reader.numbers[:FIRST_ENTRIES])
        start = next((i for i in range(start, len(lines)) if reader.exact(lines[i]) in early), start)  # C2d
        for line in lines[start:]:
            if n := reader.opens(line):
                out.append((n, toc[n], []))
                reader.seen.add(n)
                reader.at = max(reader.at, reader.place[n])
            elif out:
                out[-1][2].append(line)
    return [(n, t, "\n".join(body).strip(EDGES)) for n, t, body in out]


# The forms of RFC sections and entries of their table of contents, and its limits.
RFC_NUMBER = re.compile(r"([1-9]\d?(?:\.\d+)*)\.?")
RFC_HEADING = re.compile(r"([1-9]\d?(?:\.\d+)*)\.?[ \t]+(.+)")
RFC_ENTRY = re.compile(r"([1-9]\d?(?:\.\d+)*)\.?\s+(.+?)(?:\s+\.{2,}\s*|\s{2,})(\d+)")
RFC_ENTRY_LIKE = re.compile(r"\s*\d+(?:\.\d+)*\.?\s+.+?\s+(?:\.{2,}\s*)?\d{1,4}\s*$")
RFC_PAGE = re.compile(r"\d{1,4}")
RFC_TOC_LINES, RFC_TOC_GAP, RFC_TITLE_LINES, RFC_FIRST_ENTRIES = 3000, 150, 8, 10


def rfc_title(text: str) -> str:
    return " ".join(re.sub(r"\s*(?:\.\s*){2,}$", "", re.sub(r"^\.\s*", "", text.strip())).split())


def is_title(title: str) -> bool:
    return bool(re.search("[A-Za-z]", title)) and not re.fullmatch(r"\d+(?:\.\d+)*\.?", title)


def rfc_entry(lines: list[str], i: int, end: int) -> tuple[str, str, int] | None:
    """(number, title, last line) of an entry that begins at line i: on one line, as number / "." / title, or as number, title lines, page."""
    line = lines[i].strip()
    if (m := RFC_ENTRY.fullmatch(line)) and is_title(rfc_title(m[2])):
        return m[1], rfc_title(m[2]), i
    m = RFC_NUMBER.fullmatch(line)
    if not m:
        return None
    if i + 2 < end and lines[i + 1].replace("Â", "").replace("\xa0", "").strip() == ".":
        title = rfc_title(lines[i + 2])
        if not RFC_NUMBER.fullmatch(lines[i + 2].strip()) and is_title(title):
            return m[1], title, i + 2
    parts: list[str] = []
    stop = min(len(lines), i + RFC_TITLE_LINES)
    for j in range(i + 1, stop):
        part = lines[j].strip()
        if not part:
            if parts and j + 1 < stop:
                continue
            return None
        if RFC_PAGE.fullmatch(part):
            title = rfc_title(" ".join(parts))
            return (m[1], title, j) if parts and is_title(title) else None
        if RFC_NUMBER.fullmatch(part) and parts:
            return None
        parts.append(part)
    return None


def rfc_opens(lines: list[str], i: int, toc: dict[str, str]) -> tuple[str, int] | None:
    """(number, lines used) where a body heading on one line or two agrees with the table of contents."""
    line = lines[i].strip()

    def same(n: str, title: str) -> bool:
        return n in toc and rfc_title(title).casefold() == rfc_title(toc[n]).casefold()

    if (m := RFC_HEADING.fullmatch(line)) and same(m[1], m[2]):
        return m[1], 1
    if (m := RFC_NUMBER.fullmatch(line)) and i + 1 < len(lines) and same(m[1], lines[i + 1]):
        return m[1], 2
    return None


def rfc_contents(lines: list[str]) -> tuple[dict[str, str], int]:
    """C4: number -> title in order, and the line behind the last entry; it ends where the first section begins again."""
    start = next((i for i, x in enumerate(lines) if x.strip().casefold() in ("contents", "table of contents")), None)
    found: dict[str, str] = {}
    if start is None:
        return found, 0
    i, last, end = start + 1, start, min(len(lines), start + RFC_TOC_LINES)
    while i < end:
        if lines[i].strip():
            if found and RFC_NUMBER.fullmatch(lines[i].strip()) and rfc_opens(lines, i, found):
                break
            if entry := rfc_entry(lines, i, end):
                found.setdefault(entry[0], entry[1])
                i = last = entry[2]
            elif found and i - last > RFC_TOC_GAP:
                break
        i += 1
    return found, last + 1


def rfc_clauses(text: str) -> list[tuple[str, str, str]]:
    """C4, and C4b without a table of contents: headings at the first column that don't look like entries of one."""
    lines = BREAK.split(text)
    toc, start = rfc_contents(lines)
    out: list[tuple[str, str, list[str]]] = []
    seen: set[str] = set()
    if toc:
        early = set(list(toc)[:RFC_FIRST_ENTRIES])
        i = next((k for k in range(start, len(lines)) if (x := rfc_opens(lines, k, toc)) and x[0] in early), start)
        while i < len(lines):
            found = rfc_opens(lines, i, toc)
            if found and found[0] not in seen:
                seen.add(found[0])
                out.append((found[0], toc[found[0]], []))
                i += found[1]
                continue
            if out:
                out[-1][2].append(lines[i])
            i += 1
    else:
        for line in lines:
            m = None if line[:1].isspace() or RFC_ENTRY_LIKE.match(line.rstrip()) else RFC_HEADING.match(line.rstrip())
            if m:
                out.append((m[1], rfc_title(m[2]), []))
            elif out:
                out[-1][2].append(line)
    return [(n, t, "\n".join(body).strip(EDGES)) for n, t, body in out]


def plain_clauses(text: str) -> list[tuple[str, str, str]]:
    """C5 for one text, as `chunking.sections` does for a table."""
    out: list[tuple[str, str, list[str]]] = []
    for line in text.splitlines():
        if m := re.fullmatch(r"(\d+(?:\.\d+)*)[ \t]+(.+)", line):
            out.append((m[1], m[2].strip(), []))
        elif out and line.strip():
            out[-1][2].append(line)
    return [(n, t, "\n".join(body).strip()) for n, t, body in out]


SPLITTERS = {"3GPP": spec_clauses, "IETF": rfc_clauses}


def clauses(docs: DataFrame, text: str = "text", org: str = "org") -> DataFrame:
    """The rows of docs with clause_no, clause, clause_title and body in place of text. Null and empty texts give no rows."""
    keys = [c for c in docs.columns if c != text]
    n = len(keys)
    which = keys.index(org)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for r, (o, t) in enumerate(zip(batch.column(which).to_pylist(), batch.column(n), strict=True)):
                for k, clause in enumerate(SPLITTERS.get((o or "").strip().upper(), plain_clauses)(t.as_py() or "")):
                    at.append(r)
                    rows.append((k, *clause))
            take = pa.array(at, pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(n)], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [*keys, "clause_no", "clause", "clause_title", "body"])

    rows = docs.select(*keys, F.col(text).cast("string"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    return rows.mapInArrow(split, f"{schema}clause_no int, clause string, clause_title string, body string")
