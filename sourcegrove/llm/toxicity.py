"""Toxicity: a weighted lexicon of word beginnings, matched by Aho-Corasick after folding, normalised by length.

Folding lowers letters, maps look-alike letters of other scripts and digits or signs that stand for letters, and drops
zero-width characters. The lexicon and its weights are learned from labelled rows; hits inside exception phrases don't count. Exception
phrases are fixed ones, and pairs of words around a hit that stand in enough clean rows of the sample and in no toxic one.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcegrove.llm import stage
from sourcegrove.llm.textblocks import shingle_sets

#: At most so many labelled rows are learned from, the first by a hash of the key.
SAMPLE_ROWS = 12_000
#: A word beginning needs so many toxic rows, and a log-odds weight of at least so much.
SUPPORT, LEAST_WEIGHT = 6, 2.5
#: Lengths of word beginnings; whole words of up to the largest count too.
LENGTHS = range(3, 13)
THRESHOLD = 0.3
#: Odd factors whose smallest products with a row's shingles sign the row: near copies share one of three.
_SIGNS = tuple(np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "τ": "t", "ε": "e", "ı": "i", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
    "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
}
#: Wordings in which a hit is meant literally.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "trash bag", "class clown act", "idiot proof", "sore loser board", "pond scum", "soap scum", "loser bracket")


def fold_table() -> dict[int, str | None]:
    """Look-alikes, and by rule the full-width and mathematical letters that compatibility folding gives ASCII for."""
    out = {ord(a): b for a, b in LOOKALIKES.items()}
    for c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKC", chr(c))
        if plain != chr(c) and len(plain) == 1 and plain.isascii():
            out[c] = LOOKALIKES.get(plain.lower(), plain.lower())
    return out


_FOLD = fold_table()
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


@dataclass
class Lexicon:
    """Weights of word beginnings, exceptions, and the logistic curve over the normalised sum."""

    weights: dict[str, float]
    slope: float = 1.0
    offset: float = -3.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "slope": self.slope, "offset": self.offset, "exceptions": self.exceptions}

    def __setstate__(self, state):
        self.__dict__.update(state, automaton=None)

    def build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for w, x in self.weights.items():
            self.automaton.add_word(w, (len(w), x))
        for p in self.exceptions:
            self.automaton.add_word(fold(p), (len(fold(p)), None))
        self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight), the heaviest at each word's start, none inside an exception phrase."""
        if self.automaton is None:
            self.build()
        best: dict[int, tuple[int, float]] = {}
        spans = []
        for last, (n, weight) in self.automaton.iter(folded):
            start = last + 1 - n
            if start and (folded[start - 1].isalnum()):
                continue
            if weight is None:
                if last + 1 == len(folded) or not folded[last + 1].isalnum():
                    spans.append((start, last + 1))
            elif start not in best or best[start][1] < weight:
                best[start] = last + 1, weight
        return [(a, b, w) for a, (b, w) in sorted(best.items()) if not any(x <= a and b <= y for x, y in spans)]

    def phrases(self, text: str) -> set[str]:
        """The pairs of neighbouring words, one space apart, of which one begins with a hit."""
        folded = fold(text)
        starts = {a for a, _, _ in self.hits(folded)}
        spans = [m.span() for m in _WORD.finditer(folded)] if starts else []
        return {folded[a:d] for (a, b), (c, d) in zip(spans, spans[1:], strict=False) if folded[b:c] == " " and (a in starts or c in starts)}

    def feature(self, text: str) -> tuple[float, int]:
        """The hits' weights summed and divided by the root of the length in hundreds of words (plus one); the number of hits."""
        found = self.hits(fold(text))
        if not found:
            return 0.0, 0
        return sum(w for _, _, w in found) / math.sqrt(1 + len(text.split()) / 100), len(found)

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * x + self.offset))))


def beginnings(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in LENGTHS if k <= len(w)}


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon from labelled rows: at most sample_rows, of near copies one (else a copied text's words would all seem telling).

    Rows without label or text are not learned from. Without any toxic row the lexicon is empty, and all scores are low.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    chosen = chosen.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter("t is not null")
    sample = rows.join(F.broadcast(chosen), "k")  # bounded: sample_rows keys

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = np.zeros((batch.num_rows, 3), np.int64)
            for r, s in shingle_sets(batch.column(1)):
                if len(s):
                    lows[r] = [int((s * m).min()) >> 1 for m in _SIGNS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(lows[:, i]) for i in range(3)]], ["k", "y", "a", "b", "c"])

    schema = f"k {rows.schema['k'].dataType.simpleString()}, y int, a long, b long, c long"
    seen: set[tuple[int, int, int]] = set()
    alone = []
    for r in sorted(sample.mapInArrow(signed, schema).collect(), key=lambda r: (r.k, r.a, r.b, r.c)):  # bounded as above
        marks = {(r.y, i, x) for i, x in enumerate((r.a, r.b, r.c))}
        if not marks & seen:
            alone.append((r.k, r.y))
        seen |= marks
    spark = docs.sparkSession
    kept = spark.createDataFrame(alone, f"k {rows.schema['k'].dataType.simpleString()}, y int")
    once = rows.join(F.broadcast(kept), "k").select("t", "y")
    once = stage.written(once.repartition(8), "toxicity-sample")  # bounded, so in a few files

    def counted(batches: Iterator[pa.RecordBatch], only: set[str] | None) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        n = 0
        for batch in batches:
            for t in batch.column(0):
                n += 1
                b = beginnings(set(_WORD.findall(fold(t.as_py()))))
                found.update(b if only is None else b & only)
        yield pa.RecordBatch.from_arrays([pa.array(["", *found], pa.string()), pa.array([n, *found.values()], pa.int64())], ["w", "n"])

    def counts(df: DataFrame, only: set[str] | None, least: int) -> dict[str, int]:
        got = df.select("t").mapInArrow(lambda it: counted(it, only), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
        got = got.filter((F.col("n") >= least) | (F.col("w") == ""))
        return {r.w: r.n for r in got.collect()}  # bounded by the sample: beginnings of its words with support

    bad = counts(once.filter("y = 1"), None, SUPPORT)
    good = counts(once.filter("y = 0"), set(bad), 1)
    n_bad, n_good = bad.pop("", 0), good.pop("", 0)
    weights = {}
    for w in sorted(bad, key=len):
        x = math.log((bad[w] + 0.5) / (n_bad + 1)) - math.log((good.get(w, 0) + 0.5) / (n_good + 1))
        if x >= LEAST_WEIGHT and not any(weights.get(w[:k], 0.0) >= x - 0.7 for k in LENGTHS if k < len(w)):
            weights[w] = x
    lexicon = Lexicon(weights)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in sorted(lexicon.phrases(t))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], ["p", "y"])

    harmless = once.mapInArrow(met, "p string, y int").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y")).filter((F.col("n") >= SUPPORT) & (F.col("y") == 0))
    lexicon.exceptions += tuple(sorted(r.p for r in harmless.select("p").collect()))  # bounded by the sample
    lexicon.automaton = None
    # The curve: logistic regression on one number of each sample row.

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.feature(t.as_py())[0] for t in batch.column(0)], pa.float64()), batch.column(1)], ["x", "y"])

    got = once.mapInArrow(features, "x double, y int").groupBy(F.round("x", 2).alias("x"), "y").count().collect()  # bounded: sample_rows
    if n_bad and n_good:
        lexicon.slope, lexicon.offset = logistic([r.x for r in got], [r.y for r in got], [r["count"] for r in got])
    return lexicon


def logistic(x: list[float], y: list[int], n: list[int]) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, slightly drawn towards 1 and -3."""
    xs, ys, ns = np.minimum(np.array(x), 20.0), np.array(y, float), np.array(n, float)
    a, b = 1.0, -3.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * xs + b, -40, 40)))
        g = ns * (p - ys)
        h = ns * p * (1 - p)
        grad = np.array([(g * xs).sum() + 2 * (a - 1), g.sum() + 0.1 * (b + 3)])
        hess = np.array([[(h * xs * xs).sum() + 2, (h * xs).sum()], [(h * xs).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def toxicity(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score (0 to 1), predicted (1 if score >= threshold, else 0) and n_hits of every row.

    Null and empty texts get the score of a text without hits. Repeated rows and null keys stay as they are; other
    columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    packed = json.dumps(lexicon.__getstate__())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(**{k: tuple(v) if k == "exceptions" else v for k, v in json.loads(packed).items()})
        for batch in batches:
            found = [own.feature(t.as_py() or "") for t in batch.column(1)]
            scores = [own.score(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([n for _, n in found], pa.int64())],
                ["k", "score", "predicted", "n_hits"],
            )

    return rows.mapInArrow(scored, f"k {kind}, score double, predicted int, n_hits long").withColumnRenamed("k", key)


def clean_rows(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold; all columns stay, and nothing is shuffled. Only the texts go to Python, and one boolean
    each comes back. Null and empty texts score as texts without hits; repeated rows and null keys each have their own verdict;
    other columns, whatever their names, are not looked at; an empty table gives an empty result."""
    packed = json.dumps(lexicon.__getstate__())

    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Lexicon(**{k: tuple(v) if k == "exceptions" else v for k, v in json.loads(packed).items()})
        for texts in parts:
            yield pa.array([own.score(own.feature(t.as_py() or "")[0]) < threshold for t in texts], pa.bool_())

    return docs.filter(stage.verdict(clean)(F.col(text).cast("string")))
