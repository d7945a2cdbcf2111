"""Chat formatting: tool calls linked to their results, ordered, validated, canonical.

A message whose text is a JSON object may hold calls, ``{"tool_calls": [{"id", "name",
"arguments", "after"}, ...]}``, or be the result of one, ``{"tool_call_id", "content"}``.
Arguments are an object or a string that holds one; ``after`` lists ids of calls that
must come first. All other messages are plain text.

Calls and results are hash-joined by conversation and identifier. The order is
topological: (order_turn, level, turn, part) sorts a call after the calls it names and a
result after its call, wherever they stood, and keeps the turns otherwise. Levels are found
by raking and compressing the graph: calls whose dependencies are all placed come next,
and along chains of calls that wait for one other pointers double their reach, so a chain
of n calls takes log n rounds (see ``placed``). Arguments are checked
against the schema of their tool. Events are serialised as JSON with sorted keys and no
spaces. Everything is DataFrame functions; no conversation is gathered, so one that holds a
third of all messages is rows like any other.

Defined cases, in ``status``: ``text``; for calls ``answered``, ``unanswered``,
``duplicate`` (of an earlier call with its identifier), ``no_id``, ``blocked`` (waits for a
missing call or in a circle; its level is null); for results ``linked`` and ``orphan``.
Several results of one call are all linked. Broken JSON is text. Null text is serialised
as null, null conversation ids are one conversation. Repeated messages: repeated calls are
duplicates. Of different calls with one identifier in one place the first by digest of what
they say counts, however the input is read. Very long texts are parsed and
serialised whole, a row at a time. Other columns are not read, also those named like a
result column. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: JSON type to the prefixes of Spark's names for variant types.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"]}
#: Tools and their parameters, which are broadcast.
MOST_PARAMETERS = 100_000
SPEC = "name string, params array<struct<param:string,type:string,required:boolean>>"
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def events(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row for each call, result or plain message: conv, turn, part, role, kind, call_id, name, arguments, after, text, content."""
    text = F.col(text_col)
    out = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text"), F.when(text.rlike(r"^\s*\{"), F.try_parse_json(text)).alias("v"))
    out = out.withColumn("calls", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    out = out.select("conv", "turn", "role", "text", "v", F.posexplode_outer("calls").alias("part", "c"))
    result = _string(F.col("v"), "$.tool_call_id")
    given = F.try_variant_get("c", "$.arguments", "variant")
    arguments = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(_string(F.col("c"), "$.arguments"))).otherwise(given)
    called = F.col("c").isNotNull()
    return out.select(
        "conv",
        "turn",
        F.coalesce("part", F.lit(0)).alias("part"),
        "role",
        F.when(called, "call").when(result.isNotNull(), "result").otherwise("text").alias("kind"),
        F.when(called, _string(F.col("c"), "$.id")).otherwise(result).alias("call_id"),
        F.when(called, _string(F.col("c"), "$.name")).alias("name"),
        F.when(called, arguments).alias("arguments"),
        F.when(called, F.array_distinct(F.try_variant_get("c", "$.after", "array<string>"))).alias("after"),
        F.when(~called & result.isNull(), F.col("text")).alias("text"),
        F.when(~called, F.try_variant_get("v", "$.content", "variant")).alias("content"),
    )


def argument_errors(arguments: Column, params: Column) -> Column:
    """What is wrong with the arguments of a call, sorted; empty if nothing is."""
    given = arguments.try_cast("map<string,variant>")
    keys = F.coalesce(F.map_keys(given), F.array().cast("array<string>"))
    kinds = F.transform(keys, lambda k: F.regexp_extract(F.schema_of_variant(F.element_at(given, k)), "^[A-Z]+", 0))
    pairs = F.map_from_arrays(keys, kinds)
    fits = F.create_map(*[x for name, kind in TYPES.items() for x in (F.lit(name), F.array(*map(F.lit, kind)))])
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(keys, p["param"])), lambda p: F.concat(F.lit("missing:"), p["param"]))
    wrong = F.filter(params, lambda p: F.array_contains(keys, p["param"]) & ~F.coalesce(F.array_contains(F.element_at(fits, p["type"]), F.element_at(pairs, p["param"])), F.lit(False)))
    wrong = F.transform(wrong, lambda p: F.concat(F.lit("type:"), p["param"]))
    extra = F.transform(F.array_except(keys, F.transform(params, lambda p: p["param"])), lambda k: F.concat(F.lit("unexpected:"), k))
    found = F.array_sort(F.concat(missing, wrong, extra))
    return F.when(params.isNull(), F.array(F.lit("unknown_tool"))).when(given.isNull(), F.array(F.lit("arguments_not_object"))).otherwise(found)


def placed(calls: DataFrame) -> DataFrame:
    """(conv, call_id, order_turn, level) of the calls (conv, call_id, turn, after) that can be placed.

    A row of ``waiting`` says that the level of a call (key k) is at least l, and at least
    its dependency's plus x; likewise its turn. A round places the calls all of whose
    dependencies are placed, then moves each dependency on a call that waits for one other
    to that other, so pointers along a chain double their reach. While anything can be
    placed, a round places something; the rest wait for a missing call or in a circle.
    Many calls may wait for one: that join is split by Spark's handling of skew.
    """
    key = lambda conv, call: F.md5(F.to_json(F.struct(conv, call), {"ignoreNullFields": "false"}))
    long = lambda c: F.col(c).cast("long")
    most = F.lit(1 << 60)  # what goes round in circles stops here
    keyed = checkpointed(calls.withColumn("k", key(F.col("conv"), F.col("call_id"))))
    last = keyed.filter(F.coalesce(F.size("after"), F.lit(0)) <= 0).select("k", long("turn").alias("o"), F.lit(0).cast("long").alias("l"))
    # a result stands between a call and what waits for it, so levels go up by two
    waiting = keyed.filter(F.size("after") > 0).select("k", "conv", long("turn").alias("o"), F.explode("after").alias("d"))
    waiting = waiting.select("k", key(F.col("conv"), F.col("d").alias("call_id")).alias("dep"), "o", F.lit(0).cast("long").alias("l"), F.lit(2).cast("long").alias("x"))
    waiting, done = checkpointed(waiting), [checkpointed(last)]
    mine = Window.partitionBy("k")
    while not waiting.isEmpty():
        met = waiting.join(done[-1].select(F.col("k").alias("dep"), F.col("o").alias("o2"), F.col("l").alias("l2")), "dep", "left")
        met = met.withColumns({"o": F.max(F.greatest("o", "o2")).over(mine), "l": F.max(F.greatest("l", F.col("l2") + F.col("x"))).over(mine), "left": F.count_if(F.col("l2").isNull()).over(mine), "nth": F.row_number().over(mine.orderBy("dep"))})
        met = checkpointed(met)
        done.append(checkpointed(met.filter("left = 0 and nth = 1").select("k", "o", "l")))
        if done[-1].isEmpty():
            break
        rest = met.filter("l2 is null").select("k", "dep", "o", "l", "x", "left")
        one = rest.filter("left = 1").select(F.col("k").alias("dep"), F.col("dep").alias("dep2"), F.col("o").alias("o2"), F.col("l").alias("l2"), F.col("x").alias("x2"))
        rest = rest.join(one, "dep", "left").select("k", F.coalesce("dep2", "dep").alias("dep"), F.greatest("o", "o2").alias("o"), F.least(most, F.greatest("l", F.col("l2") + F.col("x"))).alias("l"), F.least(most, F.col("x") + F.coalesce("x2", F.lit(0))).alias("x"))
        waiting = checkpointed(rest.groupBy("k", "dep").agg(F.max("o").alias("o"), F.max("l").alias("l"), F.max("x").alias("x")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return keyed.join(out, "k").select("conv", "call_id", F.col("o").alias("order_turn"), F.col("l").cast("int").alias("level"))


def link_tool_calls(messages: DataFrame, schemas: Schemas, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row an event: conv, turn, part, role, kind, call_id, name, status, order_turn, level, valid, errors, json."""
    spark = messages.sparkSession
    every = events(messages, conv_col, turn_col, role_col, text_col)
    # null conversations are joined like any other
    every = every.withColumn("conv", F.struct(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("k"), F.col("conv").isNull().alias("none")))
    # ties in place are ordered by what the call says; equal calls are numbered, as it does not matter which is first
    said = F.sha2(F.to_json(F.struct("role", "name", "arguments", "after")), 256)
    every = checkpointed(every.withColumn("id", F.struct(F.when(F.col("kind") == "call", said).alias("said"), F.monotonically_increasing_id().alias("n"))))
    place = F.struct("turn", "part", "id")
    firsts = every.filter("kind = 'call' and call_id is not null").groupBy("conv", "call_id").agg(F.min(F.struct(place.alias("p"), "after")).alias("f"))
    firsts = checkpointed(firsts.select("conv", "call_id", F.col("f.p.turn").alias("turn"), F.col("f.p.id").alias("first"), F.col("f.after").alias("after")))
    answers = every.filter("kind = 'result'").groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("answers"))
    calls = firsts.join(placed(firsts), ["conv", "call_id"], "left").join(answers, ["conv", "call_id"], "left").drop("turn", "after")

    rows = [(name, [(p, t, r) for p, (t, r) in sorted(params.items())]) for name, params in sorted(schemas.items())]
    if sum(map(len, schemas.values())) + len(schemas) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} tools and parameters")
    specs = spark.createDataFrame(rows, SPEC)
    # only what has an identifier is joined by it: all else of a conversation would be one key
    named = every.filter("call_id is not null").join(calls, ["conv", "call_id"], "left")
    out = named.unionByName(every.filter("call_id is null"), allowMissingColumns=True).join(F.broadcast(specs), "name", "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(call & F.col("call_id").isNull(), "no_id")
        .when(call & (F.col("first") != F.col("id")), "duplicate")
        .when(call & F.col("level").isNull(), "blocked")
        .when(call & F.col("answers").isNull(), "unanswered")
        .when(call, "answered")
        .when(result & F.col("first").isNotNull(), "linked")
        .when(result, "orphan")
        .otherwise("text")
    )
    out = out.withColumn("status", status)
    errors = F.when(call, argument_errors(F.col("arguments"), F.col("params")))
    body = (
        F.when(call, F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", "role")))
        .when(result, F.to_json(F.struct("content", "role", F.col("call_id").alias("tool_call_id"))))
        .otherwise(F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}))
    )
    alone = F.col("status").isin("text", "orphan", "no_id", "duplicate")
    return out.select(
        F.when(~F.col("conv.none"), F.col("conv.k")).alias("conv"),
        "turn",
        "part",
        "role",
        "kind",
        "call_id",
        "name",
        "status",
        F.when(alone, F.col("turn")).when(result, F.greatest("turn", "order_turn")).otherwise(F.col("order_turn")).cast("long").alias("order_turn"),
        F.when(alone, 0).when(result, F.col("level") + 1).otherwise(F.col("level")).cast("int").alias("level"),
        F.when(call, F.size(errors) == 0).alias("valid"),
        errors.alias("errors"),
        body.alias("json"),
    )
