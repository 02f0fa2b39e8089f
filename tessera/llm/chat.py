"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

Calls and results of a conversation meet in a hash join on the call's
identifier.  A call comes after the calls it names in ``after``: its level
is the longest way to a call that waits for none, and (level, turn, call
id) is a topological order of the conversation.  Arguments are checked
against the schema of the called tool.  Each call becomes one line of
canonical JSON: keys sorted, no white space, numbers as they are.
DataFrame functions only.

Edge cases: a call without result is ``unanswered``, a result without call
``orphan`` (no level); of calls with one identifier the first by turn (ties: the
smaller arguments) counts, the others are ``repeated``, and so of results,
whose others are ``orphan``; identifiers in ``after`` that no call has are
ignored; calls on a cycle, or behind one, have no level; arguments that
are null or no JSON object are a problem; a null identifier matches
nothing; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

# JSON types and what a variant's own schema calls them.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN",
         "number": "(BIGINT|DOUBLE|DECIMAL.*)", "array": "ARRAY.*", "object": "OBJECT.*"}


def problems(arguments: Column, schema: dict) -> Column:
    """What is wrong with the arguments (a JSON text), as an array of short texts."""
    v = F.try_parse_json(arguments)
    kind = F.schema_of_variant(v)
    found = []
    for field, rule in sorted(schema.get("properties", {}).items()):
        value = F.try_variant_get(v, f"$['{field}']", "variant")
        got = F.schema_of_variant(value)
        there = value.isNotNull() & (got != "VOID")
        found.append(F.when(there & ~got.rlike(f"^{TYPES[rule['type']]}$"), F.lit(f"{field}: type")))
        if "minimum" in rule:
            n = F.try_variant_get(v, f"$['{field}']", "double")
            found.append(F.when(there & (n < rule["minimum"]), F.lit(f"{field}: minimum")))
        if "minLength" in rule:
            s = F.try_variant_get(v, f"$['{field}']", "string")
            found.append(F.when(there & (F.length(s) < rule["minLength"]), F.lit(f"{field}: minLength")))
        if "enum" in rule:
            s = F.try_variant_get(v, f"$['{field}']", "string")
            found.append(F.when(there & ~s.isin(*rule["enum"]), F.lit(f"{field}: enum")))
        if field in schema.get("required", ()):
            found.append(F.when(~there, F.lit(f"{field}: missing")))
    if schema.get("additionalProperties") is False:
        own = F.array(*[F.lit(x) for x in schema.get("properties", {})])
        more = F.array_size(F.array_except(F.json_object_keys(arguments), own)) > 0
        found.append(F.when(more, F.lit("additional")))
    whole = F.when(v.isNull() | ~F.coalesce(kind, F.lit("")).startswith("OBJECT"), F.array(F.lit("no object")))
    return F.coalesce(whole, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def validate(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Adds ``problems``: sorted texts; a tool without schema is a problem itself."""
    by_tool = F.when(F.col("name").isNull() | ~F.col("name").isin(*schemas), F.array(F.lit("unknown tool")))
    by_tool = reduce(lambda c, x: c.when(F.col("name") == x[0], problems(F.col("arguments"), x[1])),
                     schemas.items(), by_tool)
    return calls.withColumn("problems", F.array_sort(by_tool))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the distinct calls; one round of joins for each level."""
    ids = calls.select("conv_id", "call_id").filter("call_id is not null").distinct()
    waits = (calls.filter("call_id is not null").select("conv_id", "call_id", F.explode("after").alias("parent"))
             .distinct())
    known = ids.select(F.col("conv_id").alias("c"), F.col("call_id").alias("parent_id"))
    waits = stored(waits.join(known, waits["conv_id"].eqNullSafe(known["c"])
                              & (waits["parent"] == known["parent_id"]))
                   .select("conv_id", "call_id", "parent"), "waits")
    total = stored(waits.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("k"))
                   .withColumnRenamed("conv_id", "c").withColumnRenamed("call_id", "i"), "total")
    same = ids["conv_id"].eqNullSafe(total["c"]) & (ids["call_id"] == total["i"])
    done = stored(ids.join(total, same, "left_anti").withColumn("level", F.lit(0)), "levels")
    n, count = -1, done.count()
    while count > n:
        n = count
        parent = done.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"), "level")
        ready = (waits.join(parent, waits["conv_id"].eqNullSafe(parent["pc"]) & (waits["parent"] == parent["pi"]))
                 .groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("have"), F.max("level").alias("m")))
        whole = ready.join(total, ready["conv_id"].eqNullSafe(total["c"]) & (ready["call_id"] == total["i"])
                           & (ready["have"] == total["k"]))
        roots = done.filter("level = 0")
        done = stored(roots.unionByName(whole.select(
            "conv_id", "call_id", (F.col("m") + 1).cast("int").alias("level"))), "levels")
        count = done.count()
    return done


def firsts(rows: DataFrame, *rest: str) -> DataFrame:
    """Numbers the rows of one identifier by turn, then by their other columns."""
    w = Window.partitionBy("conv_id", "call_id").orderBy("turn", *rest)
    return rows.withColumn("nth", F.when(F.col("call_id").isNotNull(), F.row_number().over(w)).otherwise(0))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, call_id, level, result_turn, status, n_problems and record.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON text) and
    after (identifiers); ``results`` has conv_id, turn, call_id, content.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    order = levels(calls).select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level")
    calls = firsts(validate(calls, schemas), "arguments", "name")
    results = firsts(results.select("conv_id", "turn", "call_id", "content"), "content").select(
        F.col("conv_id").alias("rc"), F.col("turn").alias("result_turn"), F.col("call_id").alias("ri"),
        "content", F.col("nth").alias("result_nth"))
    calls = calls.join(order, calls["conv_id"].eqNullSafe(order["lc"]) & (calls["call_id"] == order["li"]), "left")
    same = (calls["conv_id"].eqNullSafe(results["rc"]) & (calls["call_id"] == results["ri"])
            & (calls["nth"] == results["result_nth"]) & (calls["nth"] == 1))
    rows = calls.hint("shuffle_hash").join(results, same, "full")
    is_call = F.col("nth").isNotNull()
    status = (F.when(~is_call, "orphan").when(F.col("nth") > 1, "repeated")
              .when(F.size("problems") > 0, "invalid").when(F.col("result_nth").isNull(), "unanswered")
              .otherwise("ok"))
    call = F.when(is_call, F.struct(F.col("after"), F.col("arguments"), F.col("call_id").alias("id"),
                                    F.col("name"), F.col("problems"), F.col("turn")))
    result = F.when(F.col("result_nth").isNotNull(), F.struct("content", F.col("result_turn").alias("turn")))
    return rows.withColumn("status", status).select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("rc")).alias("conv_id"),
        F.when(is_call, F.col("turn")).otherwise(F.col("result_turn")).alias("turn"),
        F.when(is_call, F.col("call_id")).otherwise(F.col("ri")).alias("call_id"),
        "level", "result_turn", "status", F.coalesce(F.size("problems"), F.lit(0)).alias("n_problems"),
        canonical(call, result, F.col("status")).alias("record"))


def canonical(call: Column, result: Column, status: Column) -> Column:
    """The line: absent parts are null, arguments are JSON of their own where they can be read."""
    arguments = F.coalesce(F.to_json(F.try_parse_json(call["arguments"])), quoted(call["arguments"]))
    items = [("after", F.to_json(call["after"])), ("arguments", arguments), ("id", quoted(call["id"])),
             ("name", quoted(call["name"])), ("problems", F.to_json(call["problems"])),
             ("turn", call["turn"].cast("string"))]
    answer = [("content", quoted(result["content"])), ("turn", result["turn"].cast("string"))]
    return as_object([("call", F.when(call.isNotNull(), as_object(items))),
                      ("result", F.when(result.isNotNull(), as_object(answer))), ("status", quoted(status))])


def quoted(text: Column) -> Column:
    """A text as a JSON string (null: null)."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def as_object(items: list[tuple[str, Column]]) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in items]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


# --- tool calls of plain conversations --------------------------------------------------------

TURN_SCHEMAS = {
    role: {"type": "object", "required": ["text", "words"], "additionalProperties": False,
           "properties": {"text": {"type": "string", "minLength": 1},
                          "words": {"type": "integer", "minimum": least}}}
    for role, least in (("system", 1), ("user", 3))
}


def turn_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every turn that is not the assistant's as a call, the assistant's turns as their results.

    The identifier is the conversation's and the turn's; an assistant's
    turn answers the one before it.  Calls wait for the call that opens
    their conversation.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    own = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), name)
    other = ~F.col("role").eqNullSafe("assistant")
    calls = rows.filter(other).select(
        "conv_id", "turn", own.alias("call_id"), F.col("role").alias("name"),
        as_object([("text", quoted(F.col("text"))),
                   ("words", F.size(F.split(F.trim(F.col("text")), " ")).cast("string"))]).alias("arguments"))
    opening = calls.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "c")
    calls = calls.join(opening, calls["conv_id"] == opening["c"], "left")
    first = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("first").cast("string"))
    after = F.when(F.col("first") < F.col("turn"), F.array(first)).otherwise(F.array().cast("array<string>"))
    calls = calls.withColumn("after", after).drop("c", "first")
    before = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    results = rows.filter(~other).select(
        "conv_id", "turn",
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), before).alias("call_id"),
        F.col("text").alias("content"))
    return calls, results
