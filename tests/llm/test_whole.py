"""The template decides on real pages, and the license prefilter drops nothing."""

import random
import re
from dataclasses import replace

from sourcegrove.llm import html_extract, license_scan


def test_template_inside_and_outside_articles():
    rng = random.Random(5)
    pages = []
    for i in range(9):
        body = [" ".join(rng.choice("alpha beta gamma delta share this story to river stone cloud".split()) for _ in range(30)) + f" {i}" for _ in range(3)]
        html = f"<body><p>welcome to our site</p><article><h1>title {i}</h1><p>{body[0]}</p><p>share this story, or mail this to us</p><p>{body[1]}</p></article><p>{body[2]}</p><p>all rights are ours</p></body>"
        pages.append((f"title {i}\n" + "\n".join(body), html_extract.read_page(html)))
    words = html_extract.template_words([p for _, p in pages])
    assert [html_extract.main_text(p, words) for _, p in pages] == [want for want, _ in pages]


def test_articles_that_are_copies_stay():
    pages = [html_extract.read_page(f"<body><p>welcome to our site</p><article><p>one and the same long text on every page</p></article><p>see page number {i}</p></body>") for i in range(6)]
    words = html_extract.template_words(pages)
    assert html_extract.main_text(pages[2], words) == "one and the same long text on every page\nsee page number 2"


def test_a_teaser_does_not_bound_a_lone_page():
    page = html_extract.read_page("<body><article>short teaser</article><p>the long text of the page is here, outside of it</p></body>")
    assert html_extract.main_text(page, set()) == "short teaser\nthe long text of the page is here, outside of it"


def spelled(pattern) -> set[str]:
    """What a small pattern matches: every alternative, optional parts with and without."""
    outs = {""}
    for op, arg in pattern:
        match str(op):
            case "LITERAL":
                part = {chr(arg)}
            case "IN":
                part = {chr(x) if str(o) == "LITERAL" else "1" if str(x) == "CATEGORY_DIGIT" else "w" if str(o) == "CATEGORY" else chr(x[0]) for o, x in arg}
            case "MAX_REPEAT":
                part = spelled(arg[2]) | ({""} if arg[0] == 0 else set())
            case "BRANCH":
                part = set().union(*(spelled(x) for x in arg[1]))
            case "SUBPATTERN":
                part = spelled(arg[3])
        outs = {a + b for a in outs for b in part}
    return outs


def test_license_gate_drops_nothing(monkeypatch):
    parse = re._parser.parse
    names = sorted({n for _, _, name in license_scan.FAMILIES for n in spelled(parse(name))})
    wordings = [sorted(spelled(parse(w.format("Q")))) for _, _, w in license_scan.WORDINGS]
    texts = [w[0].replace("Q", n) for n in names for w in wordings] + [x.replace("Q", n) for w in wordings for x in w for n in ("expat", "internet systems consortium", "gpl 3")]
    gated = license_scan.Scanner()
    got = [gated.scan(t.replace(" ", gap).encode()) for t in texts for gap in (" ", "\n", "  ")]
    monkeypatch.setattr(license_scan, "GATE", (b"a", b"e", b"i", b"o", b"u"))
    every = license_scan.Scanner([replace(r, keyword=b" ") for r in license_scan.rules()])
    assert got == [x for t in texts for x in [every.scan(t.encode())] * 3]
    labels = {t: {x[2] for x in gated.scan(t.encode())[1]} for t in ("Released under the Expat License", "Internet Systems Consortium license", "subject\nto GPL 3")}
    assert list(labels.values()) == [{"mit"}, {"isc"}, {"gpl-3"}]
