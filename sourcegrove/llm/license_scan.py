"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcegrove.llm.textblocks import byte_blocks, word_bounds

#: Phrases that always count wherever their words stand in a row.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License families as (label, keyword, pattern of the name in normalised words). Written for this project.
FAMILIES = (
    ("mit", b"mit", r"mit"),
    ("mit", b"expat", r"expat"),
    ("mit-0", b"mit", r"mit (?:no attribution|0)"),
    ("x11", b"x11", r"x11"),
    ("isc", b"isc", r"isc"),
    ("isc", b"internet systems", r"internet systems consortium"),
    ("bsd-2", b"bsd", r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd"),
    ("bsd-3", b"bsd", r"bsd 3 clause|3 clause bsd|new bsd|modified bsd"),
    ("bsd-4", b"bsd", r"bsd 4 clause|4 clause bsd|original bsd"),
    ("bsd-0", b"bsd", r"bsd zero clause|zero clause bsd|0bsd"),
    ("apache-1.1", b"apache", r"apache (?:software )?(?:license )?(?:version )?1 1"),
    ("apache-2", b"apache", r"apache (?:software )?(?:license )?(?:version )?2(?: 0)?"),
    ("gpl-1", b"general public", r"(?:gnu )?general public license ?(?:version |v )?v?1(?: 0)?"),
    ("gpl-1", b"gpl", r"(?:gnu )?gpl ?(?:version |v )?v?1(?: 0)?"),
    ("gpl-2", b"general public", r"(?:gnu )?general public license ?(?:version |v )?v?2(?: 0)?"),
    ("gpl-2", b"gpl", r"(?:gnu )?gpl ?(?:version |v )?v?2(?: 0)?"),
    ("gpl-3", b"general public", r"(?:gnu )?general public license ?(?:version |v )?v?3(?: 0)?"),
    ("gpl-3", b"gpl", r"(?:gnu )?gpl ?(?:version |v )?v?3(?: 0)?"),
    ("lgpl-2", b"general public", r"(?:gnu )?(?:lesser|library) general public license ?(?:version |v )?v?2(?: 0)?"),
    ("lgpl-2", b"lgpl", r"(?:gnu )?lgpl ?(?:version |v )?v?2(?: 0)?"),
    ("lgpl-2.1", b"general public", r"(?:gnu )?(?:lesser|library) general public license ?(?:version |v )?v?2 1"),
    ("lgpl-2.1", b"lgpl", r"(?:gnu )?lgpl ?(?:version |v )?v?2 1"),
    ("lgpl-3", b"general public", r"(?:gnu )?lesser general public license ?(?:version |v )?v?3(?: 0)?"),
    ("lgpl-3", b"lgpl", r"(?:gnu )?lgpl ?(?:version |v )?v?3(?: 0)?"),
    ("agpl-3", b"general public", r"(?:gnu )?affero general public license ?(?:version |v )?v?3(?: 0)?"),
    ("agpl-3", b"agpl", r"(?:gnu )?agpl ?(?:version |v )?v?3(?: 0)?"),
    ("fdl-1", b"free documentation", r"(?:gnu )?free documentation license ?(?:version |v )?v?1(?: \d)?"),
    ("mpl-1", b"mpl", r"mpl ?(?:version )?1(?: [01])?"),
    ("mpl-2", b"mpl", r"mpl ?(?:version )?2(?: 0)?"),
    ("mpl-2", b"mozilla", r"mozilla public license ?(?:version |v )?v?2(?: 0)?"),
    ("epl-1", b"eclipse", r"eclipse public license ?(?:version |v )?v?1(?: 0)?"),
    ("epl-2", b"eclipse", r"eclipse public license ?(?:version |v )?v?2(?: 0)?"),
    ("cddl-1", b"common development", r"common development and distribution license(?: version)?(?: 1(?: [01])?)?"),
    ("cpl-1", b"common public", r"common public license(?: version)?(?: 1(?: 0)?)?"),
    ("eupl", b"eupl", r"eupl(?: v?1 [012])?"),
    ("artistic", b"artistic", r"artistic(?: license)?(?: 2(?: 0)?| 1(?: 0)?)?"),
    ("zlib", b"zlib", r"zlib(?: libpng)?"),
    ("boost-1", b"boost", r"boost software license(?: version)?(?: 1(?: 0)?)?"),
    ("unlicense", b"unlicense", r"unlicense"),
    ("wtfpl", b"wtfpl", r"wtfpl"),
    ("psf-2", b"python", r"python software foundation license(?: version 2)?"),
    ("postgresql", b"postgresql", r"postgresql license"),
    ("openssl", b"openssl", r"openssl license"),
    ("ofl-1.1", b"open font", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("odbl", b"database license", r"open (?:data commons open )?database license"),
    ("cc0", b"cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", b"cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", b"cc by", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", b"cc by", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", b"cc by", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", b"cc by", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", b"cc by", r"cc by nc nd(?: [1-4] [05])?"),
)
# Wordings around a name, as (priority, confidence, pattern). Written for this project.
WORDINGS = (
    (10, 1.0, r"spdx license identifier (?:{})"),
    (20, 0.95, r"(?:licensed|released|distributed|published|available|provided|made available) (?:\w+ )?under (?:the )?(?:terms of )?(?:the )?(?:{})"),
    (30, 0.9, r"(?:subject to|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{})(?: licen[cs]e)?"),
    (40, 0.85, r"(?:{}) licensed"),
    (50, 0.8, r"licen[cs]e (?:is |type )?(?:the )?(?:{})"),
    (60, 0.75, r"(?:{}) (?:public )?licen[cs]e(?: version \d)?"),
)

#: A text without one of these has no match of any rule: each wording or name needs one.
GATE = (b"licen", b"spdx", b"under", b"subject")
#: Words are runs of ASCII digits and letters and of all bytes above 0x7F.
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    priority: int
    confidence: float
    pattern: re.Pattern[bytes]


def rules() -> list[Rule]:
    """Every wording around every family, by priority; a name of more words goes before a shorter one of equal priority."""
    out = [
        Rule(label, key, priority, sure, re.compile(rb"(?<= )" + wording.format(name).encode() + rb"(?= )"))
        for priority, sure, wording in WORDINGS
        for label, key, name in FAMILIES
    ]
    return sorted(out, key=lambda r: (r.priority, -len(r.label)))


class Scanner:
    """Scans one text at a time."""

    def __init__(self, found: list[Rule] | None = None, phrases: dict[str, str] | None = None):
        self.rules = rules() if found is None else found
        self.phrases = [(f" {p} ".encode(), label) for p, label in (BASE_PHRASES if phrases is None else phrases).items()]
        # The gate is one automaton of keywords: of each rule, and of what every wording needs.
        self.keys = sorted({r.keyword for r in self.rules} | set(GATE))
        self.gate = ahocorasick.Automaton()
        for k in self.keys:
            self.gate.add_word(k.decode(), k)
        self.gate.make_automaton()
        self.rarest = [p.split() for p, _ in self.phrases]

    def scan(self, raw: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """(start word, label) of base phrases, and (start byte, end byte, label, confidence) of the rules that stand."""
        raw = raw.lower()
        wanted = any(k in raw for k in GATE)
        based = [k for k, words in enumerate(self.rarest) if all(w in raw for w in words)]
        if not wanted and not based:
            return [], []
        text = b" " + b" ".join(_WORD.findall(raw)) + b" "
        base = []
        for k in based:
            phrase, label = self.phrases[k]
            at = text.find(phrase)
            while at >= 0:
                base.append((text.count(b" ", 0, at + 1) - 1, label))
                at = text.find(phrase, at + 1)
        if not wanted:
            return base, []
        there = {k for _, k in self.gate.iter(text.decode("latin-1"))}
        hits = [
            (r.priority, -(m.end() - m.start()), m.start(), m.end(), r.label, r.confidence)
            for r in self.rules
            if r.keyword in there
            for m in r.pattern.finditer(text)
        ]
        stand: list[tuple[int, int, str, float]] = []
        for _, _, a, b, label, sure in sorted(hits):
            # A detection inside a longer or earlier-ruled one goes; one that contains a shorter name with the same start wins by length.
            if not any(x <= a and b <= y for x, y, _, _ in stand):
                stand = [s for s in stand if not (a <= s[0] and s[1] <= b and s[2] != label and label.startswith(s[2]))]
                stand.append((a, b, label, sure))
        return base, sorted(stand)


_scanner: list[Scanner] = []


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Null counts as empty: no words, no labels (empty strings), score 0, first_word and last_word null. Repeated rows and null
    keys stay as they are; other columns are not looked at. score is the highest confidence of what was found.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        scan = _scanner[0].scan
        for batch in batches:
            n_words, out = [], []
            for _, buf, offsets in byte_blocks(batch.column(1)):
                starts, _ = word_bounds(buf, offsets, NOT_WORD)
                n_words.extend(np.diff(np.searchsorted(starts, offsets)).tolist())
                whole = buf.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    base, more = scan(whole[a:b])
                    at = [x for x, _ in base]
                    labels = {x for _, x in base}
                    out.append(
                        (
                            len(base),
                            min(at, default=None),
                            max(at, default=None),
                            ",".join(sorted(labels)),
                            ",".join(sorted(labels | {x[2] for x in more})),
                            max([1.0] * bool(base) + [x[3] for x in more], default=0.0),
                        )
                    )
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                ["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    schema = f"k {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(scanned, schema).withColumnRenamed("k", key)
