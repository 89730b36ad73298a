"""Tool calls in conversations: linking, ordering, validation and canonical JSON, in DataFrame functions only.

Calls and results are joined on (conversation, identifier). A call follows the results of the calls it names in
``after``; a result follows its call. Items keep their turns unless they stand before something they follow: then they
move behind it. That order is found by peeling off what follows nothing unresolved, all conversations at once, so no
conversation is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut

#: JSON types as Spark names them in variants.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def schema_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Errors of a call's arguments (a variant) as an array of strings, in alphabetical order of their fields:
    ``schemas`` has, by tool, each field's type and whether it is required. A null argument counts as missing; a tool
    without a schema and arguments that are no object are errors of their own."""
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    keys = F.array_sort(F.map_keys(F.try_variant_get(arguments, "$", "map<string, variant>")))
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(arguments, f"$['{field}']", "variant")
            missing = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))
            typed = F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("")).isin(*TYPES[kind])
            found.append(F.when(missing, F.lit(f"missing {field}") if required else F.lit(None)).when(~typed, F.lit(f"{field} is not {kind}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, fields)).cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        errors = F.when(is_object, F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), extra)).otherwise(F.array(F.lit("arguments are no object")))
        out = F.when(name == tool, errors).otherwise(out)
    return F.when(name.isNull(), F.array(F.lit("unknown tool"))).otherwise(out)


def tool_items(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each call, result and other message: (conv_id, turn, pos, kind, role, id, after, errors, json).

    An assistant text that is a JSON object with ``tool_calls`` has calls (id, name, arguments, after); a tool text
    with ``tool_call_id`` is a result. Anything else, broken JSON and JSON with repeated keys too, is a plain message.
    ``json`` is canonical: keys in code point order, no white space.
    """
    json = F.when(F.ltrim(F.col(text)).startswith("{"), F.try_parse_json(F.col(text)))
    base = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), json.alias("v"))
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    answers = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    base = base.withColumn("calls", calls).withColumn("answers", answers)
    strings = F.array().cast("array<string>")

    def item(pos: Column, kind: str, identifier: Column, after: Column, errors: Column, text: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), identifier.cast("string").alias("id"), after.alias("after"), errors.alias("errors"), text.alias("json"))

    def called(c: Column, i: Column) -> Column:
        after = F.coalesce(F.try_variant_get(c, "$.after", "array<string>"), strings)
        errors = schema_errors(F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$.arguments", "variant"), schemas)
        return item(i, "call", F.try_variant_get(c, "$.id", "string"), F.array_distinct(F.array_compact(after)), errors, F.to_json(c))

    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.coalesce("role", F.lit("")).alias("role")))
    # one row becomes its items in place: a single pass, whatever it holds
    found = (
        F.when(F.size("calls") > 0, F.transform("calls", called))
        .when(F.col("answers").isNotNull(), F.array(item(F.lit(0), "result", F.col("answers"), strings, strings, F.to_json("v"))))
        .otherwise(F.array(item(F.lit(0), "message", F.lit(None), strings, strings, said)))
    )
    return base.select("conv_id", "turn", "role", F.explode(found).alias("i")).select("conv_id", "turn", "i.pos", "i.kind", "role", "i.id", "i.after", "i.errors", "i.json")


def link_tool_calls(items: DataFrame) -> DataFrame:
    """``items`` of ``tool_items`` with ``linked`` (a call has a result, a result a call; null for messages),
    ``after_turn`` and ``depth``: ordering a conversation by (after_turn, depth, turn, pos) puts every item behind what
    it follows. Both are null for items on a cycle or behind one.

    The first call of an identifier in a conversation is the one that is meant; later ones and calls without an
    identifier stand for themselves and are not linked. Names in ``after`` without a call are left out. The number of
    rounds is the length of the longest chain of calls that wait for each other.
    """
    known = F.col("conv_id").isNotNull() & F.col("id").isNotNull()
    items = cut(items)
    calls = items.filter((F.col("kind") == "call") & known)
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "pos")).alias("at"), F.first("id").alias("_id"))
    results = items.filter((F.col("kind") == "result") & known).groupBy("conv_id", "id").agg(F.max("turn").alias("answered"))
    pairs = cut(first.join(results, ["conv_id", "id"], "left").select("conv_id", "id", F.col("at.turn").alias("turn"), F.col("at.pos").alias("pos"), "answered"))
    main = items.filter(F.col("kind") == "call").alias("i").join(pairs.alias("p"), F.expr("i.conv_id = p.conv_id AND i.id = p.id AND i.turn = p.turn AND i.pos = p.pos"))
    waits = main.select("i.conv_id", "i.id", F.explode("i.after").alias("on"))
    waits = waits.join(pairs.select("conv_id", F.col("id").alias("on")), ["conv_id", "on"], "left_semi")
    waits = cut(waits)
    # a call is settled with the turn behind which it stands; its result, if any, stands behind both
    settled = cut(pairs.join(waits.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").select("conv_id", "id", F.col("turn").alias("after_turn"), F.lit(0).alias("depth")))
    if not waits.isEmpty():
        own = pairs.select("conv_id", "id", "turn")
        while True:
            done = settled.join(pairs.select("conv_id", "id", "answered"), ["conv_id", "id"])
            out = done.select("conv_id", F.col("id").alias("on"), F.greatest("after_turn", "answered").alias("t"), F.when((F.col("answered") > F.col("after_turn")), 0).otherwise(F.col("depth") + 1).alias("d"), F.lit(1).alias("ok"))
            open_waits = waits.join(settled.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
            ready = (
                open_waits.join(out, ["conv_id", "on"], "left")
                .groupBy("conv_id", "id")
                .agg(F.count("*").alias("n"), F.count("ok").alias("n_ok"), F.max(F.struct("t", "d")).alias("m"))
                .filter("n = n_ok")
                .join(own, ["conv_id", "id"])
                .select("conv_id", "id", F.greatest("turn", "m.t").alias("after_turn"), F.when(F.col("turn") > F.col("m.t"), 0).otherwise(F.col("m.d") + 1).cast("int").alias("depth"))
            )
            ready = cut(ready)
            if ready.isEmpty():
                break
            settled = cut(settled.unionByName(ready))
    place = pairs.join(settled, ["conv_id", "id"], "left").select(
        "conv_id", "id", F.col("turn").alias("call_turn"), F.col("pos").alias("call_pos"), "answered", F.col("after_turn").alias("call_after"), F.col("depth").alias("call_depth")
    )
    joined = items.join(place, ["conv_id", "id"], "left")
    is_main = (F.col("kind") == "call") & (F.col("turn") == F.col("call_turn")) & (F.col("pos") == F.col("call_pos"))
    is_answer = (F.col("kind") == "result") & F.col("call_turn").isNotNull()
    return joined.select(
        "conv_id", "turn", "pos", "kind", "role", "id", "errors", "json",
        F.when(F.col("kind") == "call", F.coalesce(is_main & F.col("answered").isNotNull(), F.lit(False))).when(F.col("kind") == "result", F.col("call_turn").isNotNull()).alias("linked"),
        F.when(is_main, F.col("call_after")).when(is_answer, F.when(F.col("call_after").isNotNull(), F.greatest("turn", "call_after"))).otherwise(F.col("turn")).alias("after_turn"),
        F.when(is_main, F.col("call_depth")).when(is_answer, F.when(F.col("turn") > F.col("call_after"), 0).when(F.col("call_after").isNotNull(), F.col("call_depth") + 1)).otherwise(0).cast("int").alias("depth"),
    )
