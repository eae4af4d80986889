"""Chat formatting: tool calls linked with their results, ordered, validated, and written as canonical JSON.

DataFrame functions only. A message whose text is a JSON object with "tool_calls" (a list of {"id", "name", "arguments"}, or of
{"id", "function": {"name", "arguments"}}; arguments an object or its JSON text) makes calls; one with "tool_call_id" is a
result. An argument that is the string "$ID" refers to the result of call ID of the same conversation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrove.llm import stage

#: JSON types of parameters and the beginnings of the type names that values of them have.
TYPES = {"string": ("STRING",), "integer": ("BIGINT", "INT"), "number": ("BIGINT", "INT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}
#: Tools known by default: parameter -> (type, whether it must be there).
SCHEMAS: Mapping[str, Mapping[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True), "precision": ("integer", False)},
}
_OUT = "conv_id, turn, role, order_turn, level, n_calls, n_linked, n_errors, errors, message"


def quoted(x: Column) -> Column:
    """A string as JSON."""
    j = F.to_json(F.struct(x.alias("c")))
    return F.when(x.isNotNull(), F.substr(j, F.lit(6), F.length(j) - 6))


def member(name: str, json: Column) -> Column:
    return F.when(json.isNotNull(), F.concat(F.lit(f'"{name}":'), json))


def written_object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """Sorted errors of a call: unknown_tool, no_arguments, missing:P, type:P, unknown:P."""
    values = F.try_variant_get(arguments, "$", "map<string,variant>")
    out = F.array(F.lit("unknown_tool"))
    for tool, wanted in sorted(schemas.items()):
        checks = []
        for p, (kind, must) in sorted(wanted.items()):
            value = F.try_variant_get(arguments, f"$['{p}']", "variant")
            there = F.array_contains(F.map_keys(values), p)
            fits = F.lit(False)
            for t in TYPES[kind]:
                fits = fits | F.schema_of_variant(value).startswith(t)
            if must:
                checks.append(F.when(~there, F.lit(f"missing:{p}")))
            checks.append(F.when(there & ~F.coalesce(fits, F.lit(False)), F.lit(f"type:{p}")))
        more = F.transform(F.array_except(F.map_keys(values), F.array(*[F.lit(p) for p in wanted]).cast("array<string>")), lambda k: F.concat(F.lit("unknown:"), k))
        found = F.array_sort(F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), more))
        out = F.when(name == tool, F.when(values.isNull(), F.array(F.lit("no_arguments"))).otherwise(found)).otherwise(out)
    return out


def chat_format(messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, order_turn, level, n_calls, n_linked, n_errors, errors, message.

    message is canonical JSON: keys sorted, no spaces, null members left out. Order by (conv_id, order_turn, level, turn): each result
    stands after its call, and each call after the results that it refers to (of a message with several calls the first counts; inside it they are
    sorted by level); level counts the calls that a call has to wait for in a
    row. Errors are comma-joined: those of `argument_errors` after the call's id, duplicate:ID (an id used before), dangling:ID (a
    result or reference without its call), cyclic:ID (calls that wait for each other; they keep their own turn and level 0).
    n_linked counts a message's calls that have a result and, of a result, its call. Null ids, turns, roles and texts, also empty ones,
    stay as they are and link with nothing (a null conversation is one of its own); equal rows give equal rows; text that is
    no such JSON is content. An empty table gives an empty result; other columns are not looked at.
    """
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    v = F.when(F.col("text").rlike(r'^\s*\{') & F.col("text").rlike('"tool_call(s|_id)"'), F.try_parse_json("text"))
    special = (F.try_variant_get(v, "$.tool_calls", "array<variant>").isNotNull() | F.try_variant_get(v, "$.tool_call_id", "string").isNotNull())
    plain = rows.filter(~F.coalesce(special, F.lit(False))).select(
        "conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_linked"),
        F.lit(0).cast("long").alias("n_errors"), F.lit("").alias("errors"), written_object(member("content", quoted(F.col("text"))), member("role", quoted(F.col("role")))).alias("message"),
    )
    found = rows.filter(F.coalesce(special, F.lit(False))).withColumn("v", v)
    found = found.withColumn("mid", F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256))
    found = found.withColumn("content", F.try_variant_get("v", "$.content", "string")).withColumn("answers", F.try_variant_get("v", "$.tool_call_id", "string"))
    found = stage.written(found.select("mid", "conv_id", "turn", "role", "content", "answers", F.to_json("v").alias("j")), "chat-special")
    return plain.union(linked(found, schemas).selectExpr(*_OUT.split(", ")))


def linked(found: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> DataFrame:
    """The messages with calls or results; each stage deals by conversation and call, so a long conversation is spread."""
    once = found.dropDuplicates(["mid"])
    each = once.select("mid", "conv_id", "turn", F.posexplode(F.try_variant_get(F.try_parse_json("j"), "$.tool_calls", "array<variant>")).alias("at", "call"))
    raw = F.coalesce(F.try_variant_get("call", "$.arguments", "variant"), F.try_variant_get("call", "$.function.arguments", "variant"))
    parsed = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(raw.cast("string"))).otherwise(raw)
    calls = each.select(
        "mid", "conv_id", "turn", "at",
        F.try_variant_get("call", "$.id", "string").alias("id"),
        F.coalesce(F.try_variant_get("call", "$.name", "string"), F.try_variant_get("call", "$.function.name", "string")).alias("name"),
        parsed.alias("arguments"),
    )
    refs = F.transform(F.filter(F.map_values(F.try_variant_get("arguments", "$", "map<string,variant>")), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    calls = calls.select(
        "mid", "conv_id", "turn", "at", "id", "name", F.to_json("arguments").alias("arguments"), argument_errors(F.col("name"), F.col("arguments"), schemas).alias("errors"),
        F.array_distinct(F.transform(F.filter(refs, lambda x: x.rlike(r"^\$.+")), lambda x: F.substr(x, F.lit(2)))).alias("refs"),
    )
    calls = stage.written(calls, "chat-calls")
    # The first call of an id owns it.
    owners = calls.filter("id is not null and conv_id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "mid", "at")).alias("o"))
    owners = owners.select("conv_id", "id", "o.mid", "o.turn", "o.at")
    results = once.filter("answers is not null").select("mid", "conv_id", "turn", F.col("answers").alias("id"))
    answered = results.groupBy("conv_id", "id").agg(F.min("turn").alias("result_turn"))
    nodes = owners.hint("shuffle_hash").join(answered, ["conv_id", "id"], "left")
    nodes = stage.written(nodes, "chat-nodes")
    waits = calls.join(nodes.select("conv_id", "id", "mid", "at"), ["conv_id", "id", "mid", "at"], "left_semi").select("conv_id", "id", F.explode("refs").alias("ref"))
    waits = stage.written(waits.join(nodes.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_semi"), "chat-waits")
    ready = nodes.join(waits, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.col("turn").alias("order_turn"), F.greatest("turn", "result_turn").alias("done"), F.lit(0).alias("level"))
    ready = stage.written(ready, "chat-ready")
    left = waits
    while not left.isEmpty():
        # Those of which every reference has its place now.
        state = waits.join(left.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_semi").join(ready.select("conv_id", F.col("id").alias("ref"), F.col("done").alias("d"), F.col("level").alias("l")), ["conv_id", "ref"], "left")
        state = state.groupBy("conv_id", "id").agg(F.max("d").alias("d"), (F.max("l") + 1).alias("level"), F.max(F.col("l").isNull()).alias("open")).filter("not open")
        new = nodes.join(state, ["conv_id", "id"]).select("conv_id", "id", F.greatest("turn", "d").alias("order_turn"), F.greatest("turn", "d", "result_turn").alias("done"), "level")
        new = stage.written(new, "chat-ready")
        if new.isEmpty():
            break
        ready = ready.union(new)
        left = stage.written(left.join(new, ["conv_id", "id"], "left_anti"), "chat-waits")
    placed = nodes.join(ready, ["conv_id", "id"], "left").select("conv_id", "id", F.col("mid").alias("omid"), F.col("at").alias("oat"), "result_turn", F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("done", "turn").alias("done"), F.coalesce("level", F.lit(0)).alias("level"), F.col("order_turn").isNull().alias("cyclic"))
    lost = calls.select("conv_id", "mid", "at", F.explode("refs").alias("ref")).join(nodes.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_anti")
    lost = lost.groupBy("mid", "at").agg(F.array_sort(F.collect_list(F.concat(F.lit("dangling:"), "ref"))).alias("lost"))
    told = calls.join(placed, ["conv_id", "id"], "left").join(lost, ["mid", "at"], "left")
    owns = F.coalesce((F.col("omid") == F.col("mid")) & (F.col("oat") == F.col("at")), F.lit(False))
    ident = F.coalesce("id", F.lit("?"))
    errors = F.concat(
        F.transform("errors", lambda e: F.concat(ident, F.lit("/"), e)), F.coalesce("lost", F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(F.col("omid").isNotNull() & ~owns, F.concat(F.lit("duplicate:"), ident)), F.when(owns & F.col("cyclic"), F.concat(F.lit("cyclic:"), ident)))),
    )
    told = told.select(
        "mid", "at", errors.alias("errors"), F.when(owns, F.col("order_turn")).alias("order_turn"), F.when(owns, F.col("level")).otherwise(0).alias("level"),
        (owns & F.col("result_turn").isNotNull()).alias("linked"),
        written_object(member("arguments", F.col("arguments")), member("id", quoted(F.col("id"))), member("name", quoted(F.col("name"))), member("result_turn", F.when(owns, F.col("result_turn").cast("string"))), F.concat(F.lit('"valid":'), (F.size("errors") == 0).cast("string"))).alias("json"),
    )
    made = told.groupBy("mid").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if("linked").alias("n_made"), F.min("order_turn").alias("call_order"), F.min(F.when(F.col("order_turn").isNotNull(), F.col("level"))).alias("call_level"),
        F.array_sort(F.collect_list(F.struct("level", "at", "json", "errors"))).alias("calls"),
    )
    answer = results.join(placed.select("conv_id", "id", "done", "level"), ["conv_id", "id"], "left").select("mid", "done", F.col("level").alias("answer_level"), F.col("id").alias("answer_id"))
    out = found.join(made, "mid", "left").join(answer, "mid", "left")
    every = F.concat(
        F.coalesce(F.flatten(F.col("calls.errors")), F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(F.col("answer_id").isNotNull() & F.col("done").isNull(), F.concat(F.lit("dangling:"), "answer_id")))),
    )
    return out.select(
        "conv_id", "turn", "role", F.coalesce(F.greatest("turn", "call_order", "done"), "turn").alias("order_turn"), F.coalesce(F.greatest("call_level", "answer_level"), F.lit(0)).alias("level"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), (F.coalesce("n_made", F.lit(0)) + F.col("done").isNotNull().cast("long")).alias("n_linked"),
        F.size(every).cast("long").alias("n_errors"), F.array_join(every, ",").alias("errors"),
        written_object(
            member("content", quoted(F.col("content"))), member("role", quoted(F.col("role"))), member("tool_call_id", quoted(F.col("answers"))),
            member("tool_calls", F.when(F.col("calls").isNotNull(), F.concat(F.lit("["), F.array_join(F.col("calls.json"), ","), F.lit("]")))),
        ).alias("message"),
    )
