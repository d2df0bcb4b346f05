"""Chat formatting: tool calls and their results, linked, ordered, validated and written as canonical JSON.

Calls and results meet in hash joins on conversation and call identifier. Each side is first reduced to one row per
identifier, so repeated identifiers never multiply. The order is topological: a call stands behind the call it
follows (``after``), a result behind its call. Levels come from pointer doubling: every round doubles the
distance a row has looked back, so a chain of n calls takes log2(n) rounds, and what still points somewhere
after that many rounds is a cycle. Messages stay rows; a conversation is the rows of its id by
(level, turn, kind), so one conversation of any length is never gathered in a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.staging import stage

#: JSON types of a schema, as Spark's variant names them.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
    "null": ("VOID",),
}


MESSAGE_COLUMNS = ("conv_id", "turn", "role", "text", "kind", "call_id", "name", "arguments", "after")


@dataclass(frozen=True)
class ToolSchema:
    """The arguments of one tool: the type of each property, and which ones must be there."""

    name: str
    properties: Mapping[str, str]
    required: tuple[str, ...] = field(default=())
    extra: bool = False


def compile_schemas(schemas: list[ToolSchema], name: Column, arguments: Column) -> Column:
    """True where the arguments (a variant) fit the schema of the named tool; unknown tools never fit."""
    verdict = F.lit(False)
    for schema in schemas:
        fits = F.startswith(F.schema_of_variant(arguments), F.lit("OBJECT"))
        for prop, kind in schema.properties.items():
            value = F.try_variant_get(arguments, f"$['{prop}']", "variant")
            shape = F.schema_of_variant(value)
            typed = F.lit(False)
            for prefix in TYPES[kind]:
                typed = typed | F.startswith(shape, F.lit(prefix))
            fits = fits & (F.coalesce(typed, F.lit(False)) | (value.isNull() & F.lit(prop not in schema.required)))
        if not schema.extra:
            keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array())
            fits = fits & (F.size(F.array_except(keys, F.array(*[F.lit(p) for p in schema.properties]))) == 0)
        verdict = F.when(name == schema.name, F.coalesce(fits, F.lit(False))).otherwise(verdict)
    return verdict


def topological_levels(nodes: DataFrame) -> DataFrame:
    """id, level for rows (id unique, parent): distance to the root; null for rows that a cycle holds.

    A parent that is null or absent makes a root of level 0.
    """
    ids = nodes.select("id")
    state = stage(
        nodes.join(ids.withColumnRenamed("id", "parent").withColumn("_there", F.lit(True)), "parent", "left").select(
            "id", F.when(F.col("_there"), F.col("parent")).alias("to"), F.when(F.col("_there"), 1).otherwise(0).alias("level")
        ),
        "levels",
    )
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):
        if state.filter(F.col("to").isNotNull()).isEmpty():
            break
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        state = stage(
            state.join(ahead, "to", "left").select(
                "id", F.col("next").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")
            ),
            "levels",
        )
    return state.select("id", F.when(F.col("to").isNull(), F.col("level").cast("long")).alias("level"))


def format_chat(messages: DataFrame, schemas: list[ToolSchema]) -> DataFrame:
    """One row per message: conv_id, turn, role, kind, call_id, level, status, valid, json.

    ``messages``: conv_id, turn, role, text, kind (``call``, ``result`` or ``message``), call_id, name,
    arguments (JSON text), after (call_id of an earlier call); other columns are not looked at. Identifiers belong to
    their conversation: the same one in two conversations is two calls (messages without conv_id are one
    conversation). Status of a call: ``linked``, ``unanswered``,
    ``repeated`` (its id is used by several calls), ``cyclic`` or ``no_id``; of a result: ``linked``, ``orphan``
    (no such call), ``early`` (it stands before its call), ``repeated`` (not the first result) or ``no_id``;
    others ``plain``. Of results at the same turn the one with the smallest hash of its text, role, name and arguments
    is the first, a missing turn comes last, and an exact copy of the first result counts as it. ``valid`` is false for calls whose arguments are no JSON or break the schema, and null for
    other kinds. Rows are never dropped: repeated rows, null texts (left out of the JSON) and an empty table pass
    through. Levels of results are their call's level; messages outside calls have level 0.
    """
    digest = F.xxhash64("text", "role", "name", "arguments")
    # Nothing but these columns, so that no other can clash with those added here.
    rows = messages.select(*MESSAGE_COLUMNS).select(
        "*",
        F.when(F.col("call_id").isNotNull(), F.struct("conv_id", "call_id")).alias("id"),
        F.struct(F.col("turn").isNull().alias("no_turn"), "turn", digest.alias("digest")).alias("place"),
    )
    calls = rows.filter((F.col("kind") == "call") & F.col("id").isNotNull())
    follows = F.when(F.col("after").isNotNull(), F.struct("conv_id", F.col("after").alias("call_id")))
    by_call = stage(
        calls.withColumn("follows", follows)
        .groupBy("id")
        .agg(F.min("turn").alias("call_turn"), F.count(F.lit(1)).alias("n_calls"), F.min("follows").alias("parent")),
        "calls",
    )
    by_result = (
        rows.filter((F.col("kind") == "result") & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("place").alias("result_place"))
    )
    facts = (
        by_call.join(topological_levels(by_call.select("id", "parent")), "id")
        .join(by_result, "id", "left")
        .select("id", "call_turn", "n_calls", "result_place", "level")
    )
    linked = rows.filter(F.col("id").isNotNull()).join(facts, "id", "left")
    rows = linked.unionByName(rows.filter(F.col("id").isNull()), allowMissingColumns=True)

    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(~(is_call | is_result), "plain")
        .when(F.col("call_id").isNull(), "no_id")
        .when(is_call & (F.col("n_calls") > 1), "repeated")
        .when(is_call & F.col("level").isNull(), "cyclic")
        .when(is_call & F.col("result_place").isNull(), "unanswered")
        .when(is_result & F.col("call_turn").isNull(), "orphan")
        .when(is_result & (F.col("turn") < F.col("call_turn")), "early")
        .when(is_result & (F.col("place") > F.col("result_place")), "repeated")
        .otherwise("linked")
    )
    arguments = F.try_parse_json("arguments")
    rows = rows.withColumn("_args", arguments).select(
        "conv_id",
        "turn",
        "role",
        "kind",
        "call_id",
        F.when(is_call | is_result, F.col("level")).otherwise(F.lit(0)).cast("long").alias("level"),
        status.alias("status"),
        F.when(is_call, F.coalesce(compile_schemas(schemas, F.col("name"), F.col("_args")), F.lit(False))).alias("valid"),
        "name",
        "text",
        F.to_json("_args").alias("_json"),
    )
    # Keys in alphabetical order, no blanks; a variant writes its own keys sorted.
    quoted = {c: F.to_json(F.struct(F.col(c).alias("v"))) for c in ("call_id", "name", "role", "text")}
    value = {c: F.expr(f"substring({c}_q, 6, length({c}_q) - 6)") for c in quoted}
    rows = rows.select("*", *[q.alias(f"{c}_q") for c, q in quoted.items()])
    body = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(is_call, F.concat(F.lit('"arguments":'), F.coalesce("_json", F.lit("null")))),
            F.when(is_call | is_result, F.concat(F.lit('"id":'), _or_null("call_id", value))),
            F.when(is_call, F.concat(F.lit('"name":'), _or_null("name", value))),
            F.concat(F.lit('"role":'), _or_null("role", value)),
            F.when(~is_call & F.col("text").isNotNull(), F.concat(F.lit('"text":'), value["text"])),
        ),
        F.lit("}"),
    )
    return rows.select("conv_id", "turn", "role", "kind", "call_id", "level", "status", "valid", body.alias("json"))


def _or_null(column: str, value: Mapping[str, Column]) -> Column:
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(value[column])
