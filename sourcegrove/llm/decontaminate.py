"""Benchmark decontamination: an inverted index of the test items under BM25, searched by block-max WAND, then verified.

Every document is a query. An item's score is its BM25 sum over the document's distinct words, divided by what the item's own words
would give, so one threshold serves all items, and every item at or above it is retrieved, without a cap. Items stand in blocks of
`block` consecutive numbers; for each word and block the largest score is kept. The search moves through the blocks by these maxima alone
(for all blocks at once, as arrays): a block whose maxima can't reach the threshold is never opened. In the others, item by item, cursors of
the words' postings are put in order, the pivot is the first item where the maxima up to it reach the threshold, cursors before
it skip to it, and only there is an item scored. A retrieved item counts as a leak if enough word n-grams of its question part and of its
answer part stand in the document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcegrove.llm import stage

#: BM25's constants.
K1, B = 1.2, 0.75
#: Least share of an item's own score; least shares of the question's and the answer's n-grams; words of an n-gram.
THRESHOLD, QUESTION, ANSWER, GRAM = 0.6, 0.6, 0.6, 4
#: Items of a block of the index; items, and words of items, of one index that is sent to the executors.
BLOCK, SHARD, SHARD_WORDS = 4, 50_000, 2_500_000

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: the words up to its last sentence, and those of the last sentence.

    Where one of the two would have less than a quarter of the words, the last third of the words is the answer.
    """
    sentences = [w for w in (words(s) for s in re.split(r"(?<=[.!?:])\s+|\n+", text)) if w]
    every = [w for s in sentences for w in s]
    if not every:
        return [], []
    cut = len(every) - len(sentences[-1])
    if min(cut, len(every) - cut) * 4 < len(every):
        cut = len(every) - max(1, len(every) // 3)
    return every[:cut], every[cut:]


def grams(w: list[int], n: int) -> set[tuple[int, ...]]:
    """The n-grams of a part given as word numbers."""
    return set(zip(*[w[k:] for k in range(n)], strict=False)) if n else set()


@dataclass
class Index:
    """Postings of a bounded number of items: for each word its items and normalised scores, and its blocks and their maxima."""

    ids: list[int]
    texts: list[str]
    frequency: dict[str, int]
    total: int
    mean: float
    block: int = BLOCK

    def build(self) -> Index:
        """Makes the arrays; the texts and frequencies are let go."""
        docs = [words(t) for t in self.texts]
        self.number: dict[str, int] = {}
        term, item, score = [], [], []
        for i, d in enumerate(docs):
            scores = {}
            for w, tf in Counter(d).items():
                df = self.frequency.get(w, 1)
                idf = math.log(1 + (self.total - df + 0.5) / (df + 0.5))
                scores[self.number.setdefault(w, len(self.number))] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / max(self.mean, 1e-9)))
            own = sum(scores.values())
            term += scores.keys()
            item += [i] * len(scores)
            score += [s / own for s in scores.values()]
        terms, items = np.array(term, np.int64), np.array(item, np.int32)
        order = np.lexsort((items, terms))
        terms, self.item, self.score = terms[order], items[order], np.array(score)[order]
        self.start = np.searchsorted(terms, np.arange(len(self.number) + 1))
        # Block maxima, again word by word.
        blocks = self.item // self.block
        new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])])) if len(terms) else np.zeros(0, np.int64)
        self.block_of, self.block_at = blocks[new], np.append(new, len(terms))
        self.block_most = np.maximum.reduceat(self.score, new) if len(new) else np.zeros(0)
        self.block_start = np.searchsorted(terms[new], np.arange(len(self.number) + 1))
        self.n_blocks = -(-len(docs) // self.block)
        known = self.number
        #: Question and answer of each item as word numbers.
        self.parts = [tuple(np.array([known[w] for w in part], np.int32) for part in parts(t)) for t in self.texts]
        self.texts, self.frequency = [], {}
        return self

    @staticmethod
    def _gather(start: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Positions of all entries of some words."""
        size = start[terms + 1] - start[terms]
        end = np.cumsum(size)
        return np.arange(end[-1]) + np.repeat(start[terms] - end + size, size)

    def search(self, text: list[str], threshold: float) -> list[tuple[int, float]]:
        """(item number, score) of every item at or above the threshold, for a text's words."""
        terms = np.array(sorted(self.number[w] for w in self.number.keys() & set(text)), np.int64)
        if not len(terms):
            return []
        at = self._gather(self.block_start, terms)
        own = self.block_of[at]
        bound = np.bincount(own, self.block_most[at], self.n_blocks)
        open_ = np.flatnonzero(bound >= threshold - 1e-9)
        out = []
        for b in open_.tolist():
            out += self.within(at[own == b], threshold - 1e-9)
        return out

    def within(self, entries: np.ndarray, least: float) -> list[tuple[int, float]]:
        """WAND over the items of one block. entries: the block's entries of the words, each with its postings and maximum."""
        #: Of each word: the current item, the next posting, the end, the maximum.
        cursors = [[int(self.item[a]), a, e, m] for a, e, m in zip(self.block_at[entries].tolist(), self.block_at[entries + 1].tolist(), self.block_most[entries].tolist(), strict=True)]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            reach, pivot = 0.0, None
            for c in cursors:
                reach += c[3]
                if reach >= least:
                    pivot = c[0]
                    break
            if pivot is None:
                break  # no item can reach the threshold any more
            if cursors[0][0] == pivot:
                total = 0.0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    total += float(self.score[c[1]])
                if total >= least:
                    out.append((pivot, total))
                target = pivot + 1
            else:
                target = pivot
            for c in cursors:  # those before the target skip to it
                while c[1] < c[2] and self.item[c[1]] < target:
                    c[1] += 1
                c[0] = int(self.item[c[1]]) if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def leaks(self, text: str, threshold: float, question: float, answer: float) -> list[tuple[int, float, float, float]]:
        """(item id, score, question overlap, answer overlap) of the verified items."""
        own = words(text)
        out = []
        found = sorted(self.search(own, threshold))
        w = [self.number.get(x, -1) for x in own] if found else []
        kept: dict[int, set] = {}
        for i, s in found:
            shares = []
            for part in self.parts[i]:
                n = min(GRAM, len(part))
                if n not in kept:
                    kept[n] = grams(w, n)
                g = grams(part.tolist(), n)
                shares.append(len(g & kept[n]) / len(g) if g else 1.0)
            if shares[0] >= question and shares[1] >= answer:
                out.append((self.ids[i], s, *shares))
        return out


def indexes(items: DataFrame, key: str, text: str, shard: int, shard_words: int = SHARD_WORDS) -> Iterator[Index]:
    """Built indexes of about `shard` items or `shard_words` words each; word frequencies are those of all items. Null keys and texts are left out."""
    rows = items.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).filter("k is not null and trim(t) <> ''").dropDuplicates(["k", "t"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in found], pa.int64()), pa.array([list(set(w)) for w in found], pa.list_(pa.string()))], ["k", "t", "n", "w"])

    # The words of the index and of the frequencies are found by the same function as those of the documents.
    read = stage.written(rows.mapInArrow(tokens, "k long, t string, n long, w array<string>").filter("n > 0"), "leak-items")
    size = read.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    if not size["items"]:
        return
    shards = max(-(-size["items"] // shard), -(-size["words"] // shard_words))
    read = read.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(shards)))
    each = read.select("part", F.explode("w").alias("w"))
    frequency = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    for p in range(shards):
        mine = read.filter(F.col("part") == p).select("k", "t").orderBy("k", "t").collect()  # about a shard's items
        own = each.filter(F.col("part") == p).select("w").distinct()
        df = {r.w: r.df for r in frequency.join(own, "w").collect()}  # the words of those items
        yield Index([r.k for r in mine], [r.t for r in mine], df, size["items"], size["words"] / size["items"]).build()


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, shard: int = SHARD) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap) of each document and verified item.

    Documents without words, or null, match nothing; null or blank items are not searched; repeated rows give repeated results;
    without items the result is empty. Other columns are not looked at. Items go to the executors in indexes of at
    most about `shard` items, one pass over the documents each.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter("t is not null")
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"k {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for index in indexes(items, item_key, item_text, shard):
        sent = spark.sparkContext.broadcast(index)

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                at, found = [], []
                for r, t in enumerate(batch.column(1)):
                    got = own.leaks(t.as_py(), threshold, question, answer)
                    at += [r] * len(got)
                    found += got
                cols = list(zip(*found, strict=True)) or [[]] * 4
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, x) for c, x in zip(cols, kinds, strict=True)]],
                    ["k", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        out = out.union(rows.mapInArrow(searched, schema))
    return out.withColumnRenamed("k", key)


def clean_rows(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, shard: int = SHARD) -> DataFrame:
    """The rows of docs without a leak; all columns stay, and nothing is shuffled. Only the texts go to Python, and one boolean each
    comes back. Null and empty texts stay; repeated rows each have their own verdict; without items all rows stay; other columns,
    whatever their names, are not looked at; an empty table gives an empty result."""

    def clean(sent: Broadcast) -> Callable:
        def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = sent.value
            for texts in parts:
                yield pa.array([not own.leaks(t.as_py() or "", threshold, question, answer) for t in texts], pa.bool_())

        return judged

    for index in indexes(items, item_key, item_text, shard):
        docs = docs.filter(stage.verdict(clean(docs.sparkSession.sparkContext.broadcast(index)))(F.col(text).cast("string")))
    return docs
