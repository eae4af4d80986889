import hashlib
import itertools
import json
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcegrove.llm import bpe, chat_format, components, decontaminate, exact_dedup, html_extract, language_id, license_scan, ngram_join, queries, suffix_dedup, textblocks, toxicity

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, h string"


def docs(spark, texts, langs=None):
    """Documents with extra columns whose names clash with inner ones."""
    rows = [(i, t, (langs or {}).get(i), None, None, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "  \t\n ", "One", "one two", "ONE  two", "a b c d e", "Ünï cödé ß İ", "x" * 50_000, "w " * 20_000, "\x00\x1c\x85  b"]


# ------------------------------------------------------------------ shingles and the join


def reference_sets(texts, k=5):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def components_of(sets, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        n = len(a & b)
        if a and b and 100 * n >= 75 * (len(a) + len(b) - n):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_copies(seed, n=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(n // 6):
        base = prose(rng, rng.choice([5, 8, 30, 90])).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(1000)}"
            texts.append((" " if rng.random() < 0.7 else "\n ").join(copy))
    return texts + ODD


def test_shingle_sets_match_plain_python():
    texts = near_copies(1) + ODD
    got = dict(textblocks.shingle_sets(pa.array(texts)))
    sets = reference_sets(texts)
    assert [len(got[i]) for i in range(len(texts))] == [len(s) for s in sets]
    seen = {}
    for i, s in enumerate(sets):
        assert seen.setdefault(frozenset(s), got[i].tobytes()) == got[i].tobytes()


@pytest.mark.parametrize("block", [2000, 4])
def test_ngram_join(spark, block):
    texts = near_copies(2)
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs(spark, texts), block=block).collect()}
    sets = reference_sets(texts)
    want = components_of(sets, list(range(len(texts))))
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


def test_ngram_join_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "A  b c"), (-4, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.ngram_join(df).collect()), key=str)
    assert got == sorted([(None, None), (5, 3), (5, 3), (3, 3), (-4, -4)], key=str)
    assert ngram_join.ngram_join(df.limit(0)).count() == 0
    assert ngram_join.one_of_each(df).count() == 3


def test_hot_shingles_are_told_alike(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "FLUSH", 200)
    texts = near_copies(5)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs(spark, texts).repartition(3)).collect()}
    assert got == components_of(reference_sets(texts), list(range(len(texts))))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_stars_keep_components(edges):
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])
    out = [(a, b) for x in components.stars([batch]) for a, b in zip(*[c.to_pylist() for c in x.columns], strict=True)]

    def parts(es):
        f = components.Forest(31)
        for a, b in es:
            f.join(a, b)
        return f.roots().tolist()

    assert parts(edges) == parts(out)


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long").repartition(40)
    got = components.components(edges).collect()
    assert len(got) == n - sum(r.v == r.root == 0 for r in got) + sum(r.v == 0 for r in got) and {r.root for r in got} == {0}


# ------------------------------------------------------------------ exact dedup


def test_exact_dedup(spark):
    texts = ["a  b", "a b", "a\n\tb", "c", "", None, " ", "a b "] + ["hot"] * 300
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == len(texts)
    kept = exact_dedup.kept_rows(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(v) for v in groups.values()) and kept.columns == docs(spark, []).columns
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(None, "x"), (None, "x"), (2, "x")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.keep_id, r.kept) for r in exact_dedup.exact_dedup(twice).collect()) == [("2", 2, True), ("None", 2, False), ("None", 2, False)]


# ------------------------------------------------------------------ chat formatting


def chat(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, level int, id string")
    return chat_format.chat_format(df)


def test_chat_format(spark):
    j = json.dumps
    rows = [
        (1, 0, "user", 'hi "x"\n'),
        (1, 1, "assistant", j({"content": "ok", "tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q", "limit": 3}}]})),
        (1, 2, "assistant", j({"tool_calls": [{"id": "b", "function": {"name": "fetch", "arguments": j({"url": "$a", "z": 1})}}]})),
        (1, 3, "tool", j({"tool_call_id": "b", "content": "r2"})),
        (1, 4, "tool", j({"tool_call_id": "a", "content": "res"})),
        (1, 5, "tool", j({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "assistant", j({"tool_calls": [{"id": "c", "name": "calculate", "arguments": {"expression": "$d"}}, {"id": "d", "name": "calculate", "arguments": {"expression": "$c", "precision": "x"}}, {"id": "c", "name": "nope", "arguments": 5}]})),
        (3, 0, "user", '{"tool_calls": broken'),
        (3, 1, None, None),
        (None, None, "user", ""),
        (1, 3, "tool", j({"tool_call_id": "b", "content": "r2"})),
    ]
    got = chat(spark, rows).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.level, r.turn))]
    assert order.index(1) < order.index(4) < order.index(2) < order.index(3)
    assert json.loads(by[1, 1].message)["tool_calls"] == [{"arguments": {"limit": 3, "query": "q"}, "id": "a", "name": "search", "result_turn": 4, "valid": True}]
    assert by[1, 2].errors == "b/unknown:z" and by[1, 5].errors == "dangling:zz" and by[1, 4].n_linked == 1
    assert set(by[2, 0].errors.split(",")) == {"cyclic:c", "cyclic:d", "d/type:precision", "c/unknown_tool", "duplicate:c"}
    for r in got:
        m = json.loads(r.message)
        assert r.message == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert by[3, 1].message == "{}" and by[3, 0].n_errors == 0
    assert chat(spark, []).count() == 0


# ------------------------------------------------------------------ decontamination

ITEMS = ["What is the tallest tower of the old town called by sailors? The answer is the grey lantern tower.", "Short one here.", "", None, "Name the three rivers that meet below the northern bridge. They are the Ash, the Elm and the Oak."]


def plain_bm25(items, text, threshold):
    kept = [(i, decontaminate.words(t)) for i, t in enumerate(items) if (t or "").strip()]
    df = Counter(w for _, d in kept for w in set(d))
    mean = sum(len(d) for _, d in kept) / len(kept)
    q = set(decontaminate.words(text))
    out = set()
    for i, d in kept:
        s = {w: np.log(1 + (len(kept) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w, c in Counter(d).items()}
        if sum(v for w, v in s.items() if w in q) / sum(s.values()) >= threshold - 1e-9:
            out.add(i)
    return out


@pytest.mark.parametrize("shard", [20_000, 2])
def test_leaks(spark, shard):
    rng = random.Random(3)
    texts = [f"{prose(rng, 30)} {ITEMS[0]} {prose(rng, 30)}", ITEMS[4].upper(), prose(rng, 200), "the answer is the grey tower", *ODD]
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ITEMS)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, texts), items, shard=shard).collect()}
    assert got == {(0, 0), (1, 4)}
    kept = decontaminate.clean_rows(docs(spark, texts), items, shard=shard)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(2, len(texts)))
    assert decontaminate.leaks(docs(spark, texts), items.limit(0)).count() == 0


def test_search_equals_full_scoring():
    rng = random.Random(9)
    items = [prose(rng, rng.randrange(1, 25), 60) for _ in range(50)]
    docs_ = [decontaminate.words(t) for t in items]
    index = decontaminate.Index(list(range(50)), items, Counter(w for d in docs_ for w in set(d)), 50, sum(map(len, docs_)) / 50, 4).build()
    for _ in range(60):
        text = prose(rng, 30, 60)
        assert {i for i, _ in index.search(decontaminate.words(text), 0.5)} == plain_bm25(items, text, 0.5)


# ------------------------------------------------------------------ byte-pair encoding


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path()), bpe.vocabulary(queries.tokenizer_path())


def test_bpe_equals_library(tokenizer):
    lib, own = tokenizer
    rng = random.Random(1)
    texts = [x or "" for x in ODD] + ["I'll don't <|endoftext|>Hi<|startoftext|>x <|end", "日本語 🤣🤣 naïve", "ΑΣ ΣΑΣ é 123½²", "a\x1cb\x85c d"]
    texts += ["".join(rng.choice("etaoinshrdlu'.,-!é ß1\n") for _ in range(rng.randrange(80))) for _ in range(2000)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(own.encode(t)).decode() == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(tokenizer, t):
    lib, own = tokenizer
    assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_bpe_query_rows(spark, tokenizer):
    lib, own = tokenizer
    got = {r.doc_id: r for r in bpe.bpe_tokens(docs(spark, ODD), queries.tokenizer_path(), with_ids=True).collect()}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ------------------------------------------------------------------ html

FRAME = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body>"


def test_html_pages(spark):
    pages = [
        (1, "http://a.example/x", FRAME + '<nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>Big &amp; bold</h1><p>One<br>line<p><b>Two&nbsp;<i>x</i></p><form>no</form><div class="comments">nice</div></article><footer>f</footer>'),
        (2, None, None),
        (3, "nonsense", "plain text &lt;here&gt;"),
        (4, "http://b.example/", "<div id=sidebar>s</div><div><p>Body</p><ul><li>a<li>b</ul></div><div hidden>h</div>"),
        (5, "http://b.example/", "<p" + "<" * 2000),
        (6, "http://a.example/y", "<article>" + "long " * 30_000 + "</article>"),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in html_extract.html_extract(df).collect()}
    assert len(got) == 6
    assert got[1].text == "Big & bold\nOne line\nTwo x"
    assert got[2].text == "" and got[2].n_chars == 0 and got[2].url is None
    assert got[3].text == "plain text <here>"
    assert got[4].text == "Body\na\nb"
    assert got[6].n_chars == 5 * 30_000 - 1
    assert html_extract.html_extract(df.limit(0)).count() == 0


def test_template_words_without_article():
    rng = random.Random(2)
    pages = []
    for _ in range(8):
        body = prose(rng, 40)
        pages.append((body, html_extract.read_page(f"<html><body><div class=top>welcome to our site today</div><div class=text><p>{body}</p></div><div>all rights belong to us</div></body></html>")))
    words = html_extract.template_words([p for _, p in pages])
    for body, page in pages:
        assert html_extract.main_text(page, words) == body


# ------------------------------------------------------------------ licenses

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def test_license_scan(spark):
    texts = [
        "Released under the MIT License. Again: UNDER the-mit,license", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC-SA 4.0 and cc by nc", "under the mit licenses", "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: MPL-2.0", "mit der BSD 3-Clause License", *ODD,
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for i, t in enumerate(texts):
        w = words.findall((t or "").translate(LOW))
        at = sorted((k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[4].labels == "gpl-3" and got[5].labels == "mpl-2" and got[6].labels == "bsd-3" and got[3].labels == "mit" and got[3].base_labels == ""
    assert "cc-by-nc-sa" in got[2].labels.split(",")


def test_license_rules_are_many_and_unique():
    found = license_scan.rules()
    assert len(found) > 200 and len({(r.pattern.pattern) for r in found}) == len(found)


# ------------------------------------------------------------------ suffix arrays


def plain_removal(texts, length):
    """(bytes, removed, spans, digest of what remains, bytes removed where the first place stays) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out, met = [], set()
    for r in raws:
        gone, late = bytearray(len(r)), bytearray(len(r))
        for k in range(len(r) - length + 1):
            s = r[k : k + length]
            if seen[s] > 1:
                gone[k : k + length] = b"\1" * length
            if s in met:
                late[k : k + length] = b"\1" * length
            met.add(s)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone, strict=True) if not g)).hexdigest(), sum(late)))
    return out


@pytest.mark.parametrize(("seed", "group_bytes"), [(1, 1_000_000), (2, 500), (3, 0)])
def test_suffix_dedup(spark, seed, group_bytes):
    """group_bytes of 0: every group with several kinds is split down to single strings."""
    rng = random.Random(seed)
    passages = [prose(rng, 30, 1000) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(passages)[rng.randrange(30) :] if rng.random() < 0.4 else prose(rng, rng.randrange(1, 25), 1000) for _ in range(rng.randrange(1, 5))]
        texts.append("é ".join(parts))
    texts += [*[t for t in ODD if not t or len(t) < 1000], "ab" * 300, "q" * 500]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs(spark, texts), length=60, gram=12, group_bytes=group_bytes, classes=(12, 5, 1)).collect()}
    for i, want in enumerate(plain_removal(texts, 60)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_later) == want, i
    assert suffix_dedup.suffix_dedup(docs(spark, [])).count() == 0


def test_suffix_dedup_of_passages_of_over_50_words(spark):
    """With production parameters: a passage in two texts goes from both where its bytes are 400 or more, however many words it has; texts without one stay."""
    rng = random.Random(6)
    texts, sizes = [], []
    for words in (51, 51, 60, 70, 80, 90):
        passage = " ".join(rng.choice(["a", "über", "words", "straightforward"]) + str(rng.randrange(100)) for _ in range(words))
        sizes += [len(passage.encode())] * 2
        texts += [f"{prose(rng, 30, 1000)} <{passage}> {prose(rng, 30, 1000)}", f"{prose(rng, 20, 1000)} [{passage}] {prose(rng, 90, 1000)}"]
    short = " ".join(["words"] * 55)  # 55 words, 329 bytes
    texts += [f"{prose(rng, 20, 1000)} <{short}> {prose(rng, 20, 1000)}", f"{prose(rng, 25, 1000)} [{short}] {prose(rng, 30, 1000)}", *[prose(rng, 200, 1000) for _ in range(6)]]
    sizes += [len(short)] * 2 + [0] * 6
    assert min(sizes[:2]) > 0 and sum(n >= 400 for n in sizes) >= 8
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs(spark, texts)).collect()}
    for i, (text, size, want) in enumerate(zip(texts, sizes, plain_removal(texts, 400), strict=True)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_later) == want, i
        assert (r.n_removed >= size if size >= 400 else r.n_removed == 0) and (r.n_chars < len(text)) == (r.n_removed > 0), i


@pytest.mark.parametrize("group_bytes", [None, 5000])
def test_suffix_dedup_of_a_table_equals_a_full_count(spark, sf_dir, group_bytes):
    """The query's rows with production parameters, and those of groups split around their anchors, against a count of all 400-byte strings."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries.op8_suffix_dedup(spark, sf_dir) if group_bytes is None else suffix_dedup.suffix_dedup(table, group_bytes=group_bytes)
    got = {r.doc_id: r for r in found.collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    assert len(got) == len(texts) and any(0 < r.n_removed < r.n_bytes for r in got.values()) and any(not r.n_removed for r in got.values())
    order = sorted(texts)
    for i, want in zip(order, plain_removal([texts[i] for i in order], 400), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_later) == want, i
        assert (r.n_chars < len(texts[i] or "")) == (r.n_removed > 0), i


def test_suffix_dedup_keeps_the_first_place(spark):
    rng = random.Random(4)
    common = prose(rng, 30, 1000)
    texts = [f"{prose(rng, 9, 1000)} {common}", f"{common} {prose(rng, 9, 1000)}", prose(rng, 40, 1000)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs(spark, texts), length=60, gram=12, keep_first=True, with_text=True).collect()}
    assert bytes(got[0].kept).decode() == texts[0] and got[0].n_removed == got[0].n_later == 0
    assert bytes(got[1].kept).decode() == texts[1][got[1].n_removed :] and got[1].n_removed >= len(common)
    assert bytes(got[2].kept).decode() == texts[2]


def test_suffix_dedup_with_keys_that_repeat(spark):
    """Rows of one key with different texts are texts of their own; rows equal in both are two places; a null key is left alone."""
    rng = random.Random(5)
    a, b, c = (prose(rng, 30, 1000) for _ in range(3))
    df = spark.createDataFrame([(1, a), (1, f"{b} {a[:80]}"), (2, c), (2, c), (None, a), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(df, length=60, gram=12).collect())
    assert got == sorted([(1, len(a), 80), (1, len(b) + 81, 80), (2, len(c), len(c)), (2, len(c), len(c)), (0, len(a), 0), (3, 0, 0)])


SMALL = st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5)


@settings(max_examples=60, deadline=None)
@given(SMALL, st.integers(9, 30))
def test_factors(spans, length):
    seen = Counter(s[k : k + length] for s in spans for k in range(len(s) - length + 1))
    left, met = Counter(seen), set()
    for s, earlier, later in zip(spans, *suffix_dedup.factors(spans, length), strict=True):
        strings = [s[k : k + length] for k in range(len(s) - length + 1)]
        for x, e, m in zip(strings, earlier.tolist(), later.tolist(), strict=True):
            left[x] -= 1
            assert (e, m) == (x in met, left[x] > 0)
            met.add(x)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 3 for x in b)), st.integers(9, 40))
def test_longest_previous_factors(text, depth):
    def alike(i, j):
        return next((k for k in range(depth) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), depth)

    buf = np.frombuffer(text, np.uint8)
    places = np.arange(max(0, len(text) - depth))  # those with whole strings behind them
    suffixes = suffix_dedup.Suffixes(buf, depth)
    order = suffixes.order(places)
    common = np.concatenate([[0], suffixes.common(order[:-1], order[1:])]) if len(order) else np.zeros(0, int)
    found = dict(zip(order.tolist(), suffix_dedup.previous_factors(order, common).tolist(), strict=True))
    for i in places.tolist():
        assert found[i] == max((alike(i, j) for j in range(i)), default=0)


# ------------------------------------------------------------------ language, toxicity


def test_language_id(spark):
    sound = {"aa": "bado kemi lura", "bb": "schtr fronk wulz", "cc": "xiao zhe qing"}
    rng = random.Random(5)
    rows = {}
    for i in range(150):
        lang = "abc"[i % 3] * 2
        rows[i] = (" ".join(rng.choice(sound[lang].split()) + rng.choice(sound[lang].split()) for _ in range(30)), lang)
    texts = [t for t, _ in rows.values()] + ["", None, "123 !?", "ж"]
    df = docs(spark, texts, {i: x for i, (_, x) in rows.items()})
    coder = language_id.learn(df.filter("doc_id < 90"))
    got = {r.doc_id: r for r in language_id.language_id(df, coder).collect()}
    assert all(got[i].lang_pred == rows[i][1] for i in range(150))
    assert [got[i].lang_pred for i in (150, 151, 152)] == ["und"] * 3 and got[153].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.learn(df.limit(0)) is None and language_id.language_id(df, None).filter("lang_pred <> 'und'").count() == 0


def test_codewords_differ():
    for k in (1, 2, 3, 4, 5, 6, 40):
        c = language_id.codewords(k)
        assert len({tuple(r) for r in c.tolist()}) == k


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["dreckling", "snotwort", "foulmouth"]
    texts, label = [], []
    for i in range(300):
        w = prose(rng, 60).split()
        y = int(i % 5 == 0)
        for _ in range(3 * y):
            w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "en", "s"])
        texts.append(" ".join(w))
        label.append(y)
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, y, 1) for i, y in enumerate(label)] + [(5, None, 1), (None, 1, 1), (9999, 1, 1)], "doc_id long, toxic int, text int")
    lexicon = toxicity.learn(df, labels.filter("doc_id < 200 or doc_id is null"))
    probe = docs(spark, [*texts[200:], "Ｄr3ckl1ng here", "dreсkling", None, "", "w1 w2", *ODD])
    got = [r for r in toxicity.toxicity(probe, lexicon).orderBy("doc_id").collect()]
    assert [r.predicted for r in got[:100]] == label[200:]
    assert [r.predicted for r in got[100:105]] == [1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got)
    assert sorted(r.doc_id for r in toxicity.clean_rows(df, lexicon).collect()) == [i for i, y in enumerate(label) if not y]
    nothing = toxicity.learn(df, labels.limit(0))
    assert nothing.weights == {} and toxicity.toxicity(df, nothing).filter("predicted = 1").count() == 0


def test_exception_phrases():
    x = toxicity.Lexicon({"clown": 5.0, "tras": 3.0}, 1.0, -3.0, ("clown fish",))
    assert [h[:2] for h in x.hits("a clown fish and a clown, trashy; subclown")] == [(19, 24), (26, 30)]


# ------------------------------------------------------------------ held-out figures on the tables


@pytest.fixture(scope="session")
def tables_dir():
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path


def test_language_accuracy_on_held_out_rows(spark, tables_dir):
    docs_ = queries.table(spark, tables_dir, "documents").select("doc_id", "lang")
    got = queries.op9_language_id(spark, tables_dir).join(docs_, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 3000 and right >= 0.995 * n


def test_toxicity_on_held_out_rows(spark, tables_dir):
    labels = queries.table(spark, tables_dir, "labels").select("doc_id", "toxic")
    got = queries.op10_toxicity(spark, tables_dir).join(labels, "doc_id").filter("held_out").groupBy("predicted", "toxic").count().collect()
    n = {(r.predicted, r.toxic): r["count"] for r in got}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[0, 1]) and n[1, 1] >= 0.95 * (n[1, 1] + n.get((1, 0), 0))


def test_harmless_phrases_are_learned(spark):
    rng = random.Random(3)
    rows = [(i, f"{prose(rng, 12)} {'you moron' if i % 3 == 0 else 'moron river'} {prose(rng, 12)} {rng.random()}" if i % 3 < 2 else prose(rng, 30), int(i % 3 == 0)) for i in range(300)]
    rows += [(1000 + i, f"{prose(rng, 20)} moron {prose(rng, 9)}", 1) for i in range(300)]  # the word alone is telling
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    if any("moron".startswith(w) for w in lexicon.weights):
        assert "moron river" in lexicon.exceptions and "you moron" not in lexicon.exceptions
        assert lexicon.feature("the moron river is long") == (0.0, 0) and lexicon.feature("you moron")[1] == 1


def test_learning_every_language(spark):
    """More languages than codeword tables hold, one of them with a single row."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(40):
        own = rng.sample(letters, 6)
        rows += [(k * 10 + i, " ".join("".join(rng.choices(own, k=5)) for _ in range(40)), f"l{k:03}") for i in range(4 if k else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    coder = language_id.learn(df)
    assert coder.languages == sorted({r[2] for r in rows})
    codes = language_id.codewords(3000)
    assert len({tuple(c) for c in codes.tolist()}) == 3000
    got = language_id.language_id(df, coder).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.9 * len(got)
