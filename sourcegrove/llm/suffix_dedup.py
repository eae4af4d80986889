"""Removal of long repeated byte strings: longest-previous-factor arrays of spans that meet under anchors.

A byte string of `length` that stands in two places has, at both, the same anchor: the `gram`-byte string in it with the smallest
hash (the leftmost of equals). So strings that are equal meet under their anchor:

1. Every text gives its anchors, each with the run of strings that select it and a digest of the run's whole span of bytes.
2. Equal spans (by 128-bit digests) are one kind, of which the first in reading order (key, place) goes on. Kinds that are alone under
   their anchor need no more look.
3. The other kinds are laid end to end in reading order, bucket by bucket. Their suffix order (doubled up to `length`), the common
   prefixes of its neighbours and each suffix's previous and next smaller places in it give the longest previous factors: where one
   reaches `length`, the string has an earlier copy. The same in reversed reading order gives the strings with a later one.
4. An anchor whose kinds are too many for one suffix array is split exactly: equal strings have the anchor at the same place and the same
   bytes around it, so they meet again under (class of places, digest of the bytes that all strings of the class share). What is
   equal within these is folded again; what is still too large is split by smaller classes.
5. The marks of a kind go to all its places; marked strings of a text are united to spans of bytes and cut out.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcegrove.llm import stage
from sourcegrove.llm.textblocks import byte_blocks, mixed

LENGTH, GRAM = 400, 64
#: Bytes of spans that one suffix array holds on average, and at most from one group.
BUCKET_BYTES, GROUP_BYTES = 700_000, 1_000_000
#: A larger group is split by what its strings have around the anchor, in classes of so many places of the anchor in the string; with
#: classes of one place a group has one kind of string only.
CLASSES = (48, 8, 1)

_rng = np.random.default_rng(41)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_B = np.uint64(0xA24BAED4963EE407)
_powers: dict[int, np.ndarray] = {}


def _pow(n: int) -> np.ndarray:
    if n not in _powers:
        x = np.full(n, _B, np.uint64)
        x[0] = 1
        _powers[n] = np.multiply.accumulate(x)
    return _powers[n]


def window_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of `width` bytes, by doubling: h(2k)[i] = h(k)[i] * B**k + h(k)[i + k]."""
    out, done, h, size = None, 0, _BYTE[buf], 1
    power = _pow(2 * width)
    while True:
        if width & size:
            if out is None:
                out, done = h, size
            else:  # the string so far stands behind this part
                n = len(buf) - done - size + 1
                out = h[:n] * power[done] + out[size : size + n]
                done += size
        if done == width:
            return mixed(out[: max(0, len(buf) - width + 1)])
        n = max(0, len(h) - size)
        h = h[:n] * power[size] + h[size : size + n]
        size *= 2


def selected(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the leftmost minima of all windows of `window` hashes, and for each its first and last window."""
    n = len(h) - window + 1
    best, size = h.copy(), 1
    while size * 2 <= window:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    low = np.minimum(best[:n], best[window - size : window - size + n])
    # The minimum's leftmost place: each window starts at or before it; places of equal value keep their order.
    runs = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    at, first, last = [], [], []
    ends = np.concatenate([runs[1:], [n]])
    for a, b in zip(runs.tolist(), ends.tolist(), strict=True):
        value, w = low[a], a
        places = np.flatnonzero(h[a : b - 1 + window] == value) + a
        for p in places.tolist():
            if w >= b:
                break
            if p < w:
                continue
            stop = min(p, b - 1)
            at.append(p)
            first.append(w)
            last.append(stop)
            w = stop + 1
    return np.array(at, np.int64), np.array(first, np.int64), np.array(last, np.int64)


def digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests as two columns of integers."""
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in parts]), ">i8").astype(np.int64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def anchors(buf: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, its place, first and last string that select it, digest of their span) of one text's bytes."""
    if len(buf) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = window_hashes(buf, gram)
    at, first, last = selected(h, length - gram + 1)
    raw = buf.tobytes()
    return h[at].view(np.int64), at, first, last, *digests([raw[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)])


def once(found: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], list[bytes | None]]:
    """Anchors of one text (see `anchors`) with each different span once, at its first place, and the further places of each."""
    _, _, first, _, s1, s2 = found
    order = np.lexsort((first, s2, s1))
    new = np.ones(len(order), bool)
    new[1:] = (s1[order[1:]] != s1[order[:-1]]) | (s2[order[1:]] != s2[order[:-1]])
    if new.all():
        return found, [None] * len(order)
    starts = np.append(np.flatnonzero(new), len(order))
    again = [first[order[a + 1 : b]].astype("<i4").tobytes() or None for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    return tuple(c[order[new]] for c in found), again


class Suffixes:
    """The suffixes of a text told apart by up to `depth` bytes: ranks at growing depths, by doubling (or tripling, where ranks are short)."""

    def __init__(self, text: np.ndarray, depth: int):
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        self.key = np.zeros(len(text), np.uint64)
        for k in range(8):
            self.key = self.key << np.uint64(8) | padded[k : k + len(text)].astype(np.uint64)
        self.depth = depth
        #: (bytes, ranks): suffixes of equal rank are alike for so many bytes.
        self.levels: list[tuple[int, np.ndarray]] = [(8, _ranked(self.key))]
        while self.levels[-1][0] < depth and len(text):
            size, rank = self.levels[-1]
            bits = int(rank.max() + 1).bit_length()
            if int(rank.max()) + 1 == len(rank):
                break  # all differ already
            steps = [min(size, depth - size)]
            if 3 * bits <= 64 and depth > 2 * size:
                steps.append(min(2 * size, depth - size))
            key = rank.astype(np.uint64)
            for step in steps:  # overlapping parts cover exactly the new size
                key <<= np.uint64(bits)
                key[: max(0, len(rank) - step)] |= rank[step:].astype(np.uint64) + np.uint64(1)
            self.levels.append((size + steps[-1], _ranked(key)))

    def order(self, at: np.ndarray) -> np.ndarray:
        """Places in suffix order; those alike for `depth` bytes by place."""
        return at[np.lexsort((at, self.levels[-1][1][at]))]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes i and j, `depth` at most."""
        n = len(self.key)
        done = np.zeros(len(i), np.int64)
        full = np.zeros(len(i), bool)
        if self.levels[-1][0] >= self.depth:
            full = self.levels[-1][1][i] == self.levels[-1][1][j]
        for size, rank in reversed(self.levels):
            for _ in range(2):
                x, y = i + done, j + done
                inside = (np.maximum(x, y) < n) & (done + size <= self.depth)
                same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
                if not same.any():
                    break
                done[same] += size
        x, y = np.minimum(i + done, n - 1), np.minimum(j + done, n - 1)
        differ = self.key[x] ^ self.key[y]
        extra = np.zeros(len(i), np.int64)  # whole bytes before the first that differs
        for k in range(8):
            extra += differ >> np.uint64(56 - 8 * k) == 0
        return np.where(full, self.depth, np.minimum(done + extra, self.depth))


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    new = np.zeros(len(s), np.int32)
    np.cumsum(s[1:] != s[:-1], out=new[1:])
    rank = np.empty(len(s), np.int32)
    rank[order] = new
    return rank


def previous_factors(place: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order.

    place: reading order of the suffixes; common[i]: bytes that suffixes i - 1 and i have in common. A suffix's longest earlier match begins at
    the previous or at the next smaller place in suffix order; both are found by following the smaller places of neighbours, all
    suffixes at once. Factors shorter than `least` are given as 0, and no search goes on across a border below it.
    """
    n = len(place)
    best = np.zeros(n, np.int64)
    for back in (True, False):
        p, c = (place, common) if back else (place[::-1], np.concatenate([[0], common[:0:-1]]))
        to, low = np.arange(n) - 1, c.astype(np.int64).copy()
        if n:
            low[0] = 0
        active = np.flatnonzero(low >= least)
        while len(active):  # between to[i] and i, all places are larger than that of i
            active = active[p[to[active]] > p[active]]
            t = to[active]
            to[active], low[active] = to[t], np.minimum(low[active], low[t])
            active = active[low[active] >= least]
        found = np.where((low >= least) & (to >= 0), low, 0)
        best = np.maximum(best, found if back else found[::-1])
    return best


def factors(spans: list[bytes], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each span, given in reading order, which of its strings of `length` bytes have an earlier and which a later copy in the spans."""
    sizes = np.array([len(s) for s in spans], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.frombuffer(b"".join(spans), np.uint8)
    at = np.flatnonzero(np.arange(len(text)) + length <= np.repeat(ends, sizes))  # strings that don't cross into the next span
    suffixes = Suffixes(text, length)
    order = suffixes.order(at)
    common = np.concatenate([[0], suffixes.common(order[:-1], order[1:])]) if len(order) else np.zeros(0, np.int64)
    out = []
    for place in (order, -order):
        mark = np.zeros(len(text), bool)
        mark[order] = previous_factors(place, common, length) >= length
        out.append([mark[a : max(a, b - length + 1)] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return out[0], out[1]


def intervals(marks: np.ndarray) -> np.ndarray:
    """First and last places of the runs of True, in turn."""
    x = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    x[1::2] -= 1
    return x.astype(np.int32)


def united(runs: np.ndarray, gap: int) -> np.ndarray:
    """Runs (n, 2) in order, those less than `gap` apart as one."""
    if not len(runs):
        return runs.reshape(0, 2)
    runs = runs[np.argsort(runs[:, 0])]
    top = np.maximum.accumulate(runs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], runs[1:, 0] > top[:-1] + gap]))
    return np.stack([runs[new, 0], top[np.append(new[1:] - 1, len(runs) - 1)]], 1)


def placed(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of strings of a text that stand elsewhere, and those that stand at an earlier place, from its pieces."""
    out: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for p in parts:
        for k, (runs, all_of_it) in enumerate(((p["found"], p["many"]), (p["later"], p["many"] and not p["first"]))):
            if all_of_it:
                out[k].append(np.array([[p["x"], p["x"] + p["n"]]]))
            elif runs:
                out[k].append(np.frombuffer(runs, "<i4").reshape(-1, 2) + p["x"])
            if p["more"]:  # of a kind with several places, all behind the first one here
                again = np.frombuffer(p["more"], "<i4").astype(np.int64)
                out[k].append(np.stack([again, again + p["n"]], 1))
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros((0, 2), np.int64) for x in out)


def split_pieces(batch: pa.RecordBatch, length: int, step: int) -> pa.RecordBatch:
    """The pieces of spans (s1, s2, o, span, g, p1, p2, p3) by classes of `step` places of the anchor, grouped by what their strings share."""
    index, xs, ns, os, shared, whole, groups = [], [], [], [], [], [], batch.column(4).to_pylist()
    for r, (o, span) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
        last = len(span) - length
        for c in range(max(0, o - last) // step, o // step + 1):
            a, b = max(0, o - (c * step + step - 1)), min(last, o - c * step)  # the strings with the anchor at c * step and on
            index.append(r)
            xs.append(a)
            ns.append(b - a)
            os.append(o - a)
            shared.append(struct.pack("<2q", groups[r], c) + span[o - c * step : o - (c * step + step - 1) + length])
            whole.append(struct.pack("<q", c) + span[a : b + length])
    (g, _), (s1, s2), at = digests(shared), digests(whole), np.array(index, np.int64)
    p1, p2, p3 = (batch.column(i).take(pa.array(at)) for i in (5, 6, 7))
    x = np.array(xs, np.int64)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(x.astype(np.int32)), pa.array(ns, pa.int32()), pa.array(os, pa.int32()), *map(pa.array, (g, s1, s2)), p1, p2, pa.array(p3.to_numpy() + x)],
        ["i1", "i2", "x", "n", "o", "g", "s1", "s2", "p1", "p2", "p3"],
    )


def parts_of(texts: DataFrame, pieces: DataFrame, length: int, bucket_bytes: int, group_bytes: int, classes: tuple[int, ...]) -> DataFrame:
    """(i1, i2, parts) of texts (i1, i2, u) with a repeated string: their pieces with the marks of their kinds.

    pieces: (i1, i2, x, n, o, g, s1, s2), and p1, p2, p3 where the texts are themselves cut from others at those places: n + 1 strings
    from x on, the anchor at o in the first, group g, digest (s1, s2). Where they are not, also more: the further places of an equal piece
    in the same text, packed, so that a line that fills a text is one row.
    """
    deep = "p1" in pieces.columns
    place = [F.col(c) for c in (("p1", "p2", "p3") if deep else ("i1", "i2", "x"))]
    one = F.min(F.struct(*[c.cast("long").alias(f"p{k}") for k, c in enumerate(place, 1)], *(["i1", "i2", "x"] if deep else []), "n", "o"))
    if deep:
        pieces = pieces.withColumn("more", F.lit(None).cast("binary"))
    kinds = pieces.groupBy("g", "s1", "s2").agg(F.sum(1 + F.coalesce(F.octet_length("more") / 4, F.lit(0)).cast("long")).alias("m"), one.alias("one"))
    group = Window.partitionBy("g")
    ids = ["one.i1", "one.i2", "one.x"] if deep else [F.col("one.p1").alias("i1"), F.col("one.p2").cast(pieces.schema["i2"].dataType).alias("i2"), F.col("one.p3").cast("int").alias("x")]
    kinds = kinds.select("g", "s1", "s2", "m", "one.p1", "one.p2", "one.p3", *ids, "one.n", "one.o", F.sum("m").over(group).alias("all"), F.count(F.lit(1)).over(group).alias("kinds"), F.sum(F.col("one.n") + length).over(group).alias("bytes"))
    kinds = stage.written(kinds.filter("all > 1").drop("all"), "suffix-kinds")
    # Of each kind under a group with several kinds, the first span in reading order is compared.
    wanted = ["g", "s1", "s2", "p1", "p2", "p3", "n", "o", "bytes"]
    chosen = kinds.filter("kinds > 1").groupBy("i1", "i2").agg(F.collect_list(F.struct("x", *wanted)).alias("ps"))  # no more than a text's own anchors
    cut = texts.join(chosen, ["i1", "i2"]).select("u", F.explode("ps").alias("p"))
    cut = stage.written(cut.select(*[f"p.{c}" for c in wanted], F.expr(f"substring(u, p.x + 1, p.n + {length})").alias("span")), "suffix-spans")
    small, large = cut.filter(F.col("bytes") <= group_bytes), cut.filter(F.col("bytes") > group_bytes)
    total = small.agg(F.coalesce(F.sum(F.length("span")), F.lit(0))).first()[0]
    buckets = max(16, -(-int(total) // bucket_bytes))

    def compared(group: pa.Table) -> pa.Table:
        p1, p2, p3 = (group.column(c).to_numpy() for c in ("p1", "p2", "p3"))
        group = group.take(pa.array(np.lexsort((p3, p2, p1))))
        earlier, later = factors([x.as_py() for x in group.column("span")], length)
        found = [intervals(a | b).astype("<i4").tobytes() for a, b in zip(earlier, later, strict=True)]
        cols = [group.column("s1"), group.column("s2"), pa.array(found, pa.binary()), pa.array([intervals(a).astype("<i4").tobytes() for a in earlier], pa.binary())]
        return pa.table(cols, ["s1", "s2", "found", "later"]).filter(pa.array([bool(x) for x in found], pa.bool_()))

    dealt = small.select("s1", "s2", "p1", "p2", "p3", "span", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
    marks = dealt.groupBy("bucket").applyInArrow(compared, "s1 long, s2 long, found binary, later binary")
    if classes and not large.isEmpty():

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield split_pieces(batch.slice(at, 256), length, classes[0])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                runs = [[united(r, 1).astype("<i4").tobytes() for r in placed(parts)] for parts in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in runs], pa.binary()) for k in (0, 1)]], ["s1", "s2", "found", "later"])

        schema = "i1 long, i2 long, x int, n int, o int, g long, s1 long, s2 long, p1 long, p2 long, p3 long"
        finer = stage.written(large.select("s1", "s2", "o", "span", "g", "p1", "p2", "p3").mapInArrow(split, schema), "suffix-pieces")
        below = parts_of(large.select(F.col("s1").alias("i1"), F.col("s2").alias("i2"), F.col("span").alias("u")), finer, length, bucket_bytes, group_bytes, classes[1:])
        marks = marks.union(below.mapInArrow(merged, "s1 long, s2 long, found binary, later binary"))
    marks = stage.written(marks, "suffix-marks")
    known = kinds.select("s1", "s2", "m", "p1", "p2", "p3").join(marks, ["s1", "s2"], "left").filter("m > 1 or found is not null")
    known = known.select("s1", "s2", (F.col("m") > 1).alias("many"), "found", "later", F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("p3").alias("q3"))
    first = (place[0] == F.col("q1")) & (place[1] == F.col("q2")) & (place[2] == F.col("q3"))
    return pieces.join(known, ["s1", "s2"]).groupBy("i1", "i2").agg(F.collect_list(F.struct("x", "n", "more", "many", first.alias("first"), "found", "later")).alias("parts"))  # no more than a text's own anchors


def text_parts(rows: DataFrame, length: int, gram: int, bucket_bytes: int, group_bytes: int, classes: tuple[int, ...]) -> DataFrame:
    """(i1, i2, parts) of rows (i1, i2, t)."""

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, offsets in byte_blocks(batch.column(2)):
                out: list[tuple[np.ndarray, ...]] = []
                owner: list[np.ndarray] = []
                more: list[bytes | None] = []
                for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), first):
                    if b - a >= length:
                        found, again = once(anchors(buf[a:b], length, gram))
                        out.append(found)
                        owner.append(np.full(len(found[0]), r, np.int64))
                        more += again
                if out:
                    h, at, x, y, s1, s2 = (np.concatenate(c) for c in zip(*out, strict=True))
                    own = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), *[pa.array(c.astype(np.int32)) for c in (x, y - x, at - x)], *map(pa.array, (h, s1, s2)), pa.array(more, pa.binary())],
                        ["i1", "i2", "x", "n", "o", "g", "s1", "s2", "more"],
                    )

    seen = stage.written(rows.mapInArrow(anchored, "i1 long, i2 int, x int, n int, o int, g long, s1 long, s2 long, more binary"), "suffix-anchors")
    texts = rows.select("i1", "i2", F.encode("t", "UTF-8").alias("u"))
    return parts_of(texts, seen, length, bucket_bytes, group_bytes, classes)


def suffix_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, with_text: bool = False, bucket_bytes: int = BUCKET_BYTES, group_bytes: int = GROUP_BYTES, classes: tuple[int, ...] = CLASSES
) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, n_later, n_chars of every row; with_text adds kept (the bytes that remain).

    Removed is each byte covered by a string of `length` bytes that also starts anywhere else, in this text or another, overlaps
    included; the first place goes as well as the later ones. With keep_first the first place in reading order (smaller key, then smaller
    offset) stays, and only later copies are removed; n_later is the number of bytes that this removes, either way. n_chars counts the
    characters that remain (all of the text's where nothing is removed). Null and empty texts: zeros and the digest of no bytes. Rows that
    repeat a key are texts of their own where their texts differ; rows that are equal in both count as so many places. Rows with a null
    key are compared with nothing and keep their bytes. An empty table gives an empty result; other columns are not looked at.
    classes must end with 1.
    """
    rows = docs.select(F.col(key).cast("long").alias("i1"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).select("i1", F.hash("t").alias("i2"), "t")
    parts = text_parts(rows.filter("i1 is not null"), length, gram, bucket_bytes, group_bytes, classes)
    more = ", kept binary" if with_text else ""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, ps in zip(batch.column(1), batch.column(2), strict=True):
                raw = t.as_py().encode()
                n, gone, spans, late = len(raw), 0, 0, 0
                if ps.is_valid:
                    runs = [united(r + [0, length], 0) for r in placed(ps.as_py())]
                    late = int((runs[1][:, 1] - runs[1][:, 0]).sum())
                    cut = runs[1 if keep_first else 0]
                    gone, spans = int((cut[:, 1] - cut[:, 0]).sum()), len(cut)
                    ends = [0, *cut.ravel().tolist(), n]
                    raw = b"".join([raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)])
                out.append((n, gone, spans, hashlib.sha256(raw).hexdigest(), late, len(raw.decode("utf-8", "ignore")), raw))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 7 if with_text else 6]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_later", "n_chars", "kept"][: len(arrays) + 1])

    schema = f"k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_later long, n_chars long{more}"
    return rows.join(parts, ["i1", "i2"], "left").select(F.col("i1").alias("k"), "t", "parts").mapInArrow(removed, schema).withColumnRenamed("k", key)
