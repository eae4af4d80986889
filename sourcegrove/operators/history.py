"""Saved conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcegrove.functions.text import squeezed

TITLE_CHARS = 58
#: A saved conversation.
SAVED = "id string, title string, createdAt string, updatedAt string, messages array<struct<id:bigint,role:string,content:string>>"


def title(question: Column) -> Column:
    """Q18: the squeezed question, cut with an ellipsis."""
    t = squeezed(question)
    return F.when(F.length(t) > TITLE_CHARS, F.concat(F.substring(t, 1, TITLE_CHARS), F.lit("…"))).otherwise(t)


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, title, n_messages, last_turn): the title is that of the first user message; no list of a conversation is gathered."""
    user = F.col(role) == "user"
    out = messages.groupBy(conv).agg(
        F.min_by(F.when(user, F.col(text)), F.when(user, F.col(turn))).alias("q"), F.count(F.lit(1)).alias("n_messages"), F.max(turn).alias("last_turn")
    )
    return out.select(conv, title(F.col("q")).alias("title"), "n_messages", "last_turn")


def recent(convs: DataFrame, updated: str, key: str, most: int) -> DataFrame:
    """The latest conversations."""
    return convs.orderBy(F.desc(updated), key).limit(most)


def deleted(convs: DataFrame, key: str, gone: Column) -> DataFrame:
    """Q19."""
    return convs.filter(~F.coalesce(F.col(key) == gone, F.lit(False)))


def appended(messages: DataFrame, new: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Q19: new messages behind those of their conversation, numbered on."""
    last = messages.groupBy(conv).agg((F.max(turn) + 1).alias("__next"))
    n = F.row_number().over(Window.partitionBy(conv).orderBy(turn)) - 1
    moved = new.withColumn("__n", n).join(last, conv, "left").withColumn(turn, (F.coalesce("__next", F.lit(0)) + F.col("__n")).cast("long"))
    return messages.unionByName(moved.select(*messages.columns))


def loaded(stored: DataFrame, key: str = "user", value: str = "value") -> DataFrame:
    """(key, pos, conversation columns) of stored JSON arrays; a missing, broken or other value is an empty history, and items that are
    no objects are left out."""
    whole = F.try_parse_json(F.col(value))
    items = F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.from_json(F.col(value), "array<string>"))
    each = stored.filter(whole.isNotNull()).select(key, F.posexplode(F.coalesce(items, F.array().cast("array<string>"))).alias("pos", "item"))
    each = each.filter(F.schema_of_variant(F.try_parse_json("item")).startswith("OBJECT")).withColumn("c", F.from_json("item", SAVED, {"mode": "PERMISSIVE"}))
    return each.select(key, "pos", "c.*")


def saved(convs: DataFrame, key: str = "user", pos: str = "pos") -> DataFrame:
    """K7: (key, value): each user's conversations, in order, as one JSON array; what `loaded` reads."""
    fields = [c for c in convs.columns if c not in (key, pos)]
    listed = convs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, F.to_json(F.struct(*fields)).alias("j")))).alias("m"))  # one user's own history
    return listed.select(key, F.concat(F.lit("["), F.array_join(F.col("m.j"), ","), F.lit("]")).alias("value"))


def save(spark: SparkSession, convs: DataFrame, path: str) -> None:
    """K7: writes the histories as JSON rows, as a whole or not at all."""
    saved(convs).write.mode("overwrite").json(path)
