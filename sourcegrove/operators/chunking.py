"""Documents to sections, sections to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrove.functions import rules
from sourcegrove.functions.text import lines

#: A numbered heading at the start of a line.
HEADING = r"^\d+(?:\.\d+)*[ \t]+.+$"


def sections(docs: DataFrame, keys: list[str], text: str = "text", heading: str | Column = HEADING) -> DataFrame:
    """(keys, section, heading, body): lines belong to the latest heading above them; blank lines and what stands before the first heading go.

    A heading starts at the first column; `heading` is a pattern, or a condition on the column line.
    """
    each = docs.select(*keys, F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("line_no", "line")).filter(F.trim("line") != "")
    test = F.col("line").rlike(heading) if isinstance(heading, str) else heading
    each = each.withColumn("starts", test.cast("int"))
    each = each.withColumn("section", F.sum("starts").over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))).filter("section > 0")
    out = each.groupBy(*keys, "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("m"))
    return out.select(*keys, "section", F.col("m")[0]["line"].alias("heading"), F.array_join(F.expr("transform(slice(m, 2, greatest(size(m) - 1, 0)), x -> x.line)"), "\n").alias("body"))


def split_text(title: str, text: str, most: int = rules.CHUNK_CHARS, overlap: int = rules.CHUNK_OVERLAP) -> list[str]:
    """Parts of at most `most` characters with the title line on each, cut at a line end, a sentence end or a space in the window's second half.

    Title and text are trimmed. Without text the title is the only part, without both there is none. A title that leaves no room counts
    as no room taken. The next part begins behind the first space of the last `overlap` characters, or right behind the part where that
    would not go on.
    """
    title, text = title.strip(), text.strip()
    head = f"{title}\n" if title and text else title
    if len(head) + len(text) <= most or not text:
        return [head + text] if head or text else []
    room = most - len(head) if len(head) < most else most
    out, at = [], 0
    while True:
        end = min(len(text), at + room)
        if end < len(text):
            low = at + room // 2
            cuts = (text.rfind("\n", low, end), text.rfind(". ", low, end) + 1, text.rfind(" ", low, end))
            end = next((k for k in cuts if k > at), end)
        if part := text[at:end].strip():
            out.append(head + part)
        if end >= len(text):
            return out
        back = max(0, end - overlap)
        space = text.find(" ", back, end) if back else -1
        back = space + 1 if space >= 0 else back
        at = back if back > at else end


def chunked(df: DataFrame, title: str = "title", text: str = "text", most: int = rules.CHUNK_CHARS, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """The rows of df with part_no, chunk and status: void sections give one empty chunk of status "void", others "indexed" parts,
    rows without title and text none."""
    keys = [c for c in df.columns if c not in (title, text)]
    rows = df.select(*keys, F.coalesce(F.col(title), F.lit("")).alias("__title"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    void = F.lower(F.trim("__title")).startswith("void") | F.lower(F.trim("__text")).isin("void", "void.")
    n = len(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, parts = [], [], []
            for r, (t, x) in enumerate(zip(batch.column(n), batch.column(n + 1), strict=True)):
                for k, p in enumerate(split_text(t.as_py(), x.as_py(), most, overlap)):
                    at.append(r)
                    no.append(k)
                    parts.append(p)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(n)], pa.array(no, pa.int32()), pa.array(parts, pa.string())], [*keys, "part_no", "chunk"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    live = rows.filter(~void).mapInArrow(cut, f"{schema}, part_no int, chunk string").withColumn("status", F.lit("indexed"))
    return live.union(rows.filter(void).select(*keys, F.lit(0).alias("part_no"), F.lit("").alias("chunk"), F.lit("void").alias("status")))
