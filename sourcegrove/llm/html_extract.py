"""Main text of web pages by equivalence-class template deduction over the pages of a host.

Pages are read to tokens: tags with their place, and words with theirs. Over a group of pages of one host, tokens with the same
occurrence vector (how often in which page) form an equivalence class; a class is valid if enough pages have it, it is large enough, its
tokens keep their order in every page, and it nests: all of it lies in one gap of its parent class. Valid classes make
the template. Words of a line that many pages have alike are tokens of that line, told apart from the same words elsewhere. Text made of
template words is part of the frame, inside an article too; what stands in the gaps are slots. Slots in the frame's menus, headers,
footers, sidebars, notices, adverts, forms and comments (told by element, role, class and id) are dropped; the others are the text. A
page's article or main element is a hint: it stays whole where the template would take most of it (pages that are copies), and where
no template was found it bounds the text if it has most of the words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of a host that are compared at a time; larger hosts are dealt into such groups.
GROUP = 128
#: The salts by which the pages of a host find their host's page count.
SALTS = 32
#: Up to so many hosts, their page counts are broadcast; beyond it they are joined by (host, salt), so that no host is hot.
MOST_HOSTS = 100_000
#: A valid class has so many tokens and stands in so many pages, and in this share of the group's.
CLASS_SIZE, SUPPORT, SHARE = 3, 3, 0.5

# Element names by role, as the HTML standard has them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav aside footer header menu form search dialog button select option optgroup input textarea label fieldset iframe noembed noframes object embed applet svg math canvas audio video map".split()
)
#: Elements whose opening ends an open one of the same set, up to the nearest of the bounds.
CLOSERS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Words in a class or id that tell a part of the frame, and ARIA roles that do.
FRAME_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars rail widget widgets header masthead footer colophon cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social comment comments commentlist disqus respond replies related recommended pagination pager toc skip hidden".split()
)
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden|itemprop)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")


def frame_part(name: str, attrs: str) -> tuple[bool, bool, str]:
    """(whether an element belongs to the frame, whether it is the page's main part, its class for the token)."""
    frame, main, label = name in DROPPED, name in ("article", "main"), ""
    if attrs and ("=" in attrs or "hidden" in attrs):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                label = label or value
                if name not in ("html", "body", "article", "main") and any(w.lower() in FRAME_WORDS for w in _NAME.findall(value)):
                    frame = True
            elif key == "role":
                frame |= value.lower() in FRAME_ROLES
                main |= value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                frame = True
            elif key == "itemprop" and value.lower() == "articlebody":
                main = True
    return frame, main and not frame, label


def read_page(html: str) -> tuple[list[str], list[tuple[str, str, bool, bool]]]:
    """(tag tokens in order, blocks as (place, text, in the frame, in the main part)); the text of a block is cleaned."""
    tags: list[str] = []
    blocks: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, bool, bool, str]] = [("", False, False, "")]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                _, frame, main, place = stack[-1]
                blocks.append((place, text, frame, main))

    def close(upto: int) -> None:
        while len(stack) > upto:
            name, frame, _, place = stack[-1]
            if name in BLOCKS or frame != stack[-2][1]:
                flush()
            tags.append(f"{place}/")
            stack.pop()

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m[1] or m[4]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if k:
                close(k)
            elif name in ("p", "br"):
                flush() if name == "p" else held.append(" ")
            continue
        if name in BLOCKS:
            # A paragraph ends where a block begins, also under open inline elements.
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCKS), 0)
            if k and stack[k][0] == "p":
                close(k)
            flush()
        if name in CLOSERS:
            ended, bounds = CLOSERS[name]
            k = len(stack) - 1
            lowest = 0
            while k > 0 and stack[k][0] not in bounds:
                if stack[k][0] in ended:
                    lowest = k
                k -= 1
            if lowest:
                close(lowest)
        if name == "body" or name in ("article", "main", "nav") and any(x[0] == "head" for x in stack):
            k = next((i for i, x in enumerate(stack) if x[0] == "head"), 0)
            if k:
                close(k)
        attrs = m[3] if m[2] else m[6]
        frame, main, label = frame_part(name, attrs or "")
        if name == "br":
            held.append(" ")
        _, in_frame, in_main, place = stack[-1]
        token = f"{name}.{label}" if label else name
        here = f"{place}>{token}" if len(stack) < 40 else place
        if frame != in_frame and name not in VOID:
            flush()
        tags.append(here)
        if name in VOID or (attrs or "").endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(html, at)
            at = stop.end() if stop else end
            tags.append(f"{here}/")
            continue
        # A heading in an article's own header stays.
        if name == "header" and in_main:
            frame = False
        stack.append((name, in_frame or frame, (in_main or main) and not frame, here))
    flush()
    close(1)
    return tags, blocks


def template_words(pages: list[tuple[list[str], list[tuple[str, str, bool, bool]]]]) -> set[tuple[str, str]]:
    """(place, word) of all word tokens in valid equivalence classes of a group of pages, and (place, text) of lines whose tokens all are."""
    n = len(pages)
    if n < SUPPORT:
        return set()
    least = max(SUPPORT, int(n * SHARE))
    holders = Counter(line for _, blocks in pages for line in {(place, text) for place, text, _, _ in blocks})
    sequences: list[list[tuple]] = []
    for tags, blocks in pages:
        # Words stand behind the tags here; a class never mixes them in order, as each page has both in the same two runs.
        words = (((place, w, i, text) if holders[place, text] >= least else (place, w)) for place, text, _, _ in blocks for i, w in enumerate(text.split(" ")))
        sequences.append([(t, "") for t in tags] + list(words))
    vectors: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for p, s in enumerate(sequences):
        for token, c in Counter(s).items():
            vectors[token].append((p, c))
    classes: dict[tuple, list[tuple]] = defaultdict(list)
    for token, v in vectors.items():
        if len(v) >= least:
            classes[tuple(v)].append(token)
    valid: list[tuple[tuple, set]] = []
    for vector, tokens in classes.items():
        if len(tokens) >= CLASS_SIZE:
            kept = ordered(vector, set(tokens), sequences)
            if len(kept) >= CLASS_SIZE:
                valid.append((vector, kept))
    valid.sort(key=lambda x: (-len(x[0]), -len(x[1])))
    nested = [x for i, x in enumerate(valid) if all(nests(x, y, sequences) for y in valid[:i] if len(y[0]) >= len(x[0]) and all(c == 1 for _, c in y[0]))]
    found = {t for _, tokens in nested for t in tokens if t[1]}
    whole = Counter((t[0], t[3]) for t in found if len(t) > 2)
    return {t for t in found if len(t) == 2} | {line for line, c in whole.items() if c == len(line[1].split(" "))}


def ordered(vector: tuple, tokens: set, sequences: list) -> set:
    """The tokens of a class that keep one order in all of its pages; none if repeats break the order.

    Where each stands once in a page, those that break the order of the first page, as words of the text that all pages happen to
    have, go one by one: the longest run in order stays.
    """
    if all(c == 1 for _, c in vector):
        kept = [t for t in sequences[vector[0][0]] if t in tokens]
        for p, _ in vector[1:]:
            places = {t: i for i, t in enumerate(sequences[p]) if t in tokens}
            at = [places[t] for t in kept]
            if any(a > b for a, b in zip(at, at[1:], strict=False)):
                kept = [kept[i] for i in rising(at)]
        return set(kept)
    first = None
    for p, c in vector:
        s = [t for t in sequences[p] if t in tokens]
        unit = s[: len(s) // c]
        if unit * c != s:
            return set()
        if first is None:
            first = unit
        elif unit != first:
            return set()
    return tokens


def rising(x: list[int]) -> list[int]:
    """The indices of a longest rising subsequence of different numbers."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, v in enumerate(x):
        k = bisect_left(ends, v)
        before.append(last[k - 1] if k else -1)
        if k == len(ends):
            ends.append(v)
            last.append(i)
        else:
            ends[k], last[k] = v, i
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def nests(inner: tuple, outer: tuple, sequences: list) -> bool:
    """Whether, in every page, each round of the inner class lies in one gap of the outer class, the same in all pages."""
    (vector, tokens), (pages, frame) = inner, outer
    where = {p for p, _ in pages}
    seen = set()
    for p, c in vector:
        if p not in where:
            continue
        gap, gaps = 0, []
        for t in sequences[p]:
            if t in frame:
                gap += 1
            elif t in tokens:
                gaps.append(gap)
        seen.add(tuple(gaps[: len(gaps) // c]) if c else ())
    return len(seen) <= 1


def main_text(page: tuple[list[str], list[tuple[str, str, bool, bool]]], frame_words: set[tuple[str, str]]) -> str:
    """The page's text: its slots outside the frame, block by block."""

    def n_words(lines: list[tuple[str, str, bool]]) -> int:
        return sum(text.count(" ") + 1 for _, text, _ in lines)

    blocks = [(place, text, main) for place, text, frame, main in page[1] if not frame]
    inner = [x for x in blocks if x[2]]
    if not frame_words:
        return "\n".join(text for _, text, _ in (inner if 2 * n_words(inner) >= n_words(blocks) else blocks))
    slots = [x for x in blocks if (x[0], x[1]) not in frame_words and not all((x[0], w) in frame_words for w in x[1].split(" "))]
    copied = 2 * n_words([x for x in slots if x[2]]) < n_words(inner)
    if copied:
        taken = set(blocks) - set(slots)
        slots = [x for x in blocks if x[2] or x not in taken]
    return "\n".join(text for _, text, _ in slots)


def html_extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", group: int = GROUP) -> DataFrame:
    """key, url, text and n_chars of every row.

    Null html counts as empty and has an empty text; a null or odd url belongs to a host of its own name or "". Repeated rows and
    null keys stay as they are; other columns are not looked at; an empty table gives an empty result. A page is compared with
    about `group` pages of its host; hosts with fewer than three pages are read by their elements alone.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("u", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    counts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    # A host's pages are dealt over as many groups as it needs.
    kind = rows.schema["k"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages compressed one by one: what is dealt to the groups is a fraction of the html."""
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = pa.array([z.compress(t.as_py().encode()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, batch.column(3), batch.column(4)], ["k", "u", "t", "host", "salt"])

    rows = rows.withColumn("salt", F.pmod(F.xxhash64("k", "u"), F.lit(SALTS)).cast("int")).mapInArrow(packed, f"k {kind}, u string, t binary, host string, salt int")
    few = counts.limit(MOST_HOSTS + 1).collect()
    if len(few) <= MOST_HOSTS:
        dealt = rows.join(F.broadcast(pages.sparkSession.createDataFrame(few, counts.schema)), "host")  # checked: MOST_HOSTS short rows
    else:
        dealt = rows.join(counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("u", "k"), F.col("parts"))).select("k", "u", "t", "host", "part")

    def extracted(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        read = [read_page(z.decompress(t.as_py()).decode()) for t in table.column("t")]
        words = template_words(read)
        texts = [main_text(p, words) for p in read]
        return pa.table({"k": table.column("k"), "u": table.column("u"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    out = dealt.groupBy("host", "part").applyInArrow(extracted, f"k {kind}, u string, text string, n_chars long")
    return out.withColumnRenamed("k", key).withColumnRenamed("u", url)
