"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword; for each bit a linear classifier over hashed byte pairs and triples of the lowered letters
tells the languages with 1 from those with 0. Decoding takes the codeword with the least loss, each bit's loss weighted by the
classifier's accuracy in training; a text whose two nearest codewords are close is flagged as ambiguous.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcegrove.llm.textblocks import byte_blocks

#: About so many rows of each language are learned from (a share of them by a hash of the key), and of all languages; each has one at least.
ROWS_PER_LANGUAGE, SAMPLE_ROWS = 500, 8_000
#: Hash buckets of n-grams.
BUCKETS = 1 << 12
#: Two codewords nearer to each other in loss than this are ambiguous.
AMBIGUOUS = 0.1
UNDETERMINED = "und"

_CLASS = np.full(256, 0x20, np.uint32)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def grams(buf: np.ndarray) -> np.ndarray:
    """Buckets of the byte pair and the byte triple that start at each byte; those of white space only get bucket 0."""
    c = _CLASS[buf]
    if len(c) < 3:
        c = np.concatenate([c, np.full(3 - len(c), 0x20, np.uint32)])
    two = c[:-2] * np.uint32(257) + c[1:-1]
    three = two * np.uint32(263) + c[2:]
    out = np.stack([two * np.uint32(2654435761), three * np.uint32(2246822519)], 1) >> np.uint32(20)
    out[(c[:-2] == 0x20) & (c[1:-1] == 0x20)] = 0
    return out


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1: all splits for up to five classes, else rows as far apart as random search finds; of very many, each
    begins with its number."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = (1 << (k - 1)) - 1
        return np.array([[1.0 if i == 0 or (b + 1) >> (k - 1 - i) & 1 == 0 else -1.0 for b in range(bits)] for i in range(k)])
    short = int(np.ceil(np.log2(k)))
    bits, rng = 4 * short + 7, np.random.default_rng(7)
    if k > 256:
        number = (np.arange(k)[:, None] >> np.arange(short)) & 1
        return np.concatenate([2.0 * number - 1, rng.choice([-1.0, 1.0], (k, bits - short))], 1)
    tries = [rng.choice([-1.0, 1.0], (k, bits)) for _ in range(200)]
    return max(tries, key=lambda c: (c.sum(0).__abs__() < k).all() * (np.abs(c[:, None] - c[None]).sum(2) / 2 + np.eye(k) * bits).min())


@dataclass
class Coder:
    """languages, codewords (languages x bits), weights (buckets x bits) and bias and importance of the bits."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    importance: np.ndarray

    def margins(self, buf: np.ndarray) -> np.ndarray:
        total = np.zeros(self.codes.shape[1], np.float64)
        n = 0
        for a in range(0, max(1, len(buf) - 2), 1 << 18):
            g = grams(buf[a : a + (1 << 18) + 2])
            counts = np.bincount(g.ravel(), minlength=BUCKETS)
            counts[0] = 0
            total += counts @ self.weights
            n += int(counts.sum())
        return total / max(1, n) * SCALE + self.bias

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = np.log1p(np.exp(-np.clip(margins * self.codes, -30, 30))) @ self.importance
        p = np.exp(-(loss - loss.min()) * 2)
        p /= p.sum()
        first = int(loss.argmin())
        near = np.delete(loss, first)
        return self.languages[first], float(p[first]), bool(len(near) and near.min() - loss[first] < AMBIGUOUS)

    def packed(self) -> str:
        f = io.BytesIO()
        np.savez(f, languages=np.array(self.languages, dtype=str), codes=self.codes, weights=self.weights, bias=self.bias, importance=self.importance)
        return base64.b64encode(f.getvalue()).decode()

    @staticmethod
    def unpacked(text: str) -> Coder:
        z = np.load(io.BytesIO(base64.b64decode(text)))
        return Coder(z["languages"].tolist(), z["codes"], z["weights"], z["bias"], z["importance"])


SCALE = 50.0


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Coder | None:
    """A coder from rows with text and language; None if there are none. Every language is learned, whatever their number; the sample is bounded
    by rows_per_language and SAMPLE_ROWS (with more languages than that, by a row each). Each language's rows spread around its share
    as hashes do, and the row with the smallest hash is always one of them."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("y")).filter("t is not null and y is not null")
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("k"), F.lit(1 << 31)))
    sizes = hashed.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low")).collect()  # a row for each language
    each = max(1, min(rows_per_language, SAMPLE_ROWS // max(1, len(sizes))))
    # Of a language with n rows, those whose hash is in the first each / n of all hashes: no ranking, so no hot language.
    shares = docs.sparkSession.createDataFrame([(r.y, max(r.low + 1, min(1 << 31, (each << 31) // r.n))) for r in sizes], "y string, share long")
    sample = hashed.join(F.broadcast(shares), "y").filter(F.col("h") < F.col("share"))  # broadcast: a row for each language

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, buf, offsets in byte_blocks(batch.column(0)):
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    counts = np.bincount(grams(buf[a:b]).ravel(), minlength=BUCKETS).astype(np.float32)
                    counts[0] = 0
                    out.append((counts / max(1.0, counts.sum())).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["x", "y"])

    got = sample.select("t", "y").mapInArrow(counted, "x binary, y string").collect()  # bounded as above
    if not got:
        return None
    languages = sorted({r.y for r in got})
    number = {y: i for i, y in enumerate(languages)}
    which = np.array([number[r.y] for r in got])
    raw = [r.x for r in got]
    got.clear()
    codes = codewords(len(languages))
    target = codes[which].astype(np.float32)
    # Squared-loss classifiers of all bits at once, by ridge regression: languages weigh alike. The rows are gone through in parts.
    weigh = (1.0 / np.bincount(which)[which]).astype(np.float32)
    weigh /= weigh.sum()

    def rows_in_parts() -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(0, len(raw), 1024):
            at = slice(a, a + 1024)
            yield at, np.stack([np.frombuffer(x, np.float16) for x in raw[at]]).astype(np.float32) * np.float32(SCALE)

    mean, mid = sum(weigh[at] @ x for at, x in rows_in_parts()), weigh @ target
    gram, side = np.zeros((BUCKETS, BUCKETS), np.float32), np.zeros((BUCKETS, codes.shape[1]), np.float32)
    for at, x in rows_in_parts():
        x -= mean
        gram += x.T @ (x * weigh[at, None])
        side += x.T @ ((target[at] - mid) * weigh[at, None])
    gram[np.diag_indices(BUCKETS)] += 1e-3 * np.trace(gram) / len(languages) + 1e-9
    weights = np.linalg.solve(gram, side).astype(np.float64)
    bias = mid - mean @ weights
    right = sum(((x @ weights + bias) * target[at] > 0).sum(0) for at, x in rows_in_parts()) / len(raw)
    importance = np.maximum(right - 0.5, 0.01)
    return Coder(languages, codes, weights, bias, importance / importance.sum() * len(importance))


def language_id(docs: DataFrame, coder: Coder | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (0 to 1), ambiguous of every row.

    Null texts and texts without a letter get "und", score 0 and ambiguous false; so do all rows if nothing was learned. Repeated rows
    and null keys stay as they are; other columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    packed = coder.packed() if coder else ""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder.unpacked(packed) if packed else None
        for batch in batches:
            out = []
            for first, buf, offsets in byte_blocks(batch.column(1)):
                plain = (buf > 0x40) & (_CLASS[buf] < 0x80) & (_CLASS[buf] != 0x20)
                for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True), first):
                    lettered = own is not None and (plain[a:b].any() or (a < b and any(c.isalpha() for c in batch.column(1)[r].as_py())))
                    out.append(own.decode(own.margins(buf[a:b])) if lettered else (UNDETERMINED, 0.0, False))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["k", "lang_pred", "score", "ambiguous"]
            )

    return rows.mapInArrow(predicted, f"k {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("k", key)
