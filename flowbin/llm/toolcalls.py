"""Tool-call linking for chat data, in DataFrame operations only.

Calls and results of a conversation are joined by the call's identifier.  Each call gets a
place in an order in which every call stands after the calls that it depends on: the pair
(order_turn, order_step), its own turn and 0 unless a dependency forces it later.  Its
arguments are validated against the parameters of its function, and call, arguments and
result are serialised as one canonical JSON object: keys sorted, no spaces.

Both sides are reduced to one row for each identifier before the join, so that repeated
identifiers cannot multiply: the first call (by turn, name, arguments) and the first result
(by turn, content) count, n_calls and n_results say how many there were.

Dependencies that point backwards, as in a transcript, cost one round.  Each further round
moves the calls that follow a moved one; a cycle is found when a call moves on for more
steps than its conversation has calls.  Its members, and the calls that depend on them, get
order null and an error.

Defined results: rows without conversation or identifier are left out; a result without a
call is an ``orphan_result`` with null call columns; a call without a result has a null
result; null or empty arguments are an empty object; arguments that are no JSON object
(duplicate keys included) are null and an error; an unknown function is an error; a null
argument counts as missing; repeated rows count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbin.llm.frames import settle

#: types a parameter may have and the variant types they accept (fixed values)
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def _first(rows: DataFrame, fields: list[str], count: str) -> DataFrame:
    """The least row of each (conv, call_id), aggregated before the shuffle."""
    least = F.min(F.struct(*fields))
    return rows.where("conv IS NOT NULL AND call_id IS NOT NULL").groupBy("conv", "call_id").agg(least.alias("row"), F.count("*").alias(count)).select("conv", "call_id", "row.*", count)


def order(calls: DataFrame) -> DataFrame:
    """(conv, call_id, order_turn, order_step) of calls (conv, call_id, turn, after)."""
    nodes = calls.select("conv", "call_id", "turn")
    size = calls.groupBy("conv").agg(F.count("*").alias("size"))
    edges = calls.select("conv", "call_id", F.explode(F.array_distinct("after")).alias("dep")).join(
        nodes.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"])
    # a dependency that stands earlier in the text needs no move unless it is moved itself
    edges = settle(edges)
    place = settle(nodes.withColumn("step", F.lit(0).cast("long")).withColumn("cyclic", F.lit(False)))
    moved = place
    while True:
        before = moved.select("conv", F.col("call_id").alias("dep"), F.col("turn").alias("t"), F.col("step").alias("s"), F.col("cyclic").alias("c"))
        best = edges.join(before, ["conv", "dep"]).groupBy("conv", "call_id").agg(F.max(F.struct("t", F.expr("s + 1").alias("s"))).alias("to"), F.max("c").alias("c"))
        both = place.join(best, ["conv", "call_id"]).where(~F.col("cyclic") & (F.col("c") | (F.struct("turn", "step") < F.col("to")))).join(size, "conv")
        cyclic = F.col("c") | (F.col("to.s") > F.col("size"))
        moved = settle(both.select("conv", "call_id", F.col("to.t").alias("turn"), F.col("to.s").alias("step"), cyclic.alias("cyclic")))
        if moved.isEmpty():
            break
        stay = place.join(moved.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
        place = settle(stay.unionByName(moved))
    free = ~F.col("cyclic")
    return place.select("conv", "call_id", F.when(free, F.col("turn")).alias("order_turn"), F.when(free, F.col("step")).alias("order_step"), "cyclic")


def _errors() -> Column:
    """Errors of the arguments against the function's parameters, sorted."""
    kinds = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    given = F.filter(F.map_keys("types"), lambda k: F.element_at("types", k) != "VOID")
    missing = F.transform(F.filter("params", lambda p: p["required"] & ~F.array_contains(given, p["param"])), lambda p: F.concat(F.lit("missing: "), p["param"]))
    wrong = F.filter("params", lambda p: F.array_contains(given, p["param"]) & ~F.coalesce(F.array_contains(F.element_at(kinds, p["type"]), F.element_at("types", p["param"])), F.lit(False)))
    unknown = F.array_except(F.map_keys("types"), F.transform("params", lambda p: p["param"]))
    found = F.concat(missing, F.transform(wrong, lambda p: F.concat(F.lit("not "), p["type"], F.lit(": "), p["param"])), F.transform(unknown, lambda k: F.concat(F.lit("unknown: "), k)))
    none = F.array().cast("array<string>")
    return F.when(F.col("types").isNull(), F.array(F.lit("arguments: no JSON object"))).when(F.col("params").isNull(), F.array(F.lit("function: unknown"))).otherwise(F.coalesce(F.array_sort(found), none))


def link(calls: DataFrame, results: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row for each call, and one for each result without a call.

    calls: conv, call_id, turn, name, arguments (JSON text), after (array of call ids).
    results: conv, call_id, turn, content.  parameters: name, param, type (see TYPES), required.
    Returns conv, call_id, status (linked, no_result, orphan_result), name, arguments (canonical
    JSON), errors, order_turn, order_step, result, n_calls, n_results, message (canonical JSON).
    """
    calls = calls.select("conv", F.col("call_id").cast("string"), F.col("turn").cast("long"), F.col("name").cast("string"), F.col("arguments").cast("string"),
                         F.coalesce(F.col("after").cast("array<string>"), F.array().cast("array<string>")).alias("after"))
    one = settle(_first(calls, ["turn", "name", "arguments", "after"], "n_calls"))
    answer = _first(results.select("conv", F.col("call_id").cast("string"), F.col("turn").cast("long"), F.col("content").cast("string")), ["turn", "content"], "n_results")
    placed = one.join(order(one.select("conv", "call_id", "turn", "after")), ["conv", "call_id"])
    both = placed.drop("turn", "after").join(answer.select("conv", "call_id", F.col("content").alias("result"), "n_results"), ["conv", "call_id"], "full")

    listed = parameters.select("name", "param", "type", F.coalesce("required", F.lit(False)).alias("required")).distinct()
    listed = listed.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("param", "type", "required"))).alias("params"))
    both = both.join(listed, "name", "left")
    value = F.try_parse_json(F.when(F.trim(F.coalesce("arguments", F.lit(""))) == "", "{}").otherwise(F.col("arguments")))
    both = both.withColumn("value", F.when(F.col("n_calls").isNotNull(), value))
    both = both.withColumn("value", F.when(F.schema_of_variant("value").startswith("OBJECT"), F.col("value")))
    fields = F.from_json(F.to_json("value"), "map<string,variant>")
    kind = lambda k, v: F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^[A-Z]+", 0)
    both = both.withColumn("types", F.transform_values(fields, kind))
    known = F.col("n_calls").isNotNull()
    errors = F.when(known, F.concat(_errors(), F.when(F.col("cyclic"), F.array(F.lit("after: cycle"))).otherwise(F.array().cast("array<string>"))))
    status = F.when(~known, "orphan_result").when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"))
    arguments = F.to_json("value")
    message = F.concat(F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"result":'), quoted("result"), F.lit("}"))
    return both.select("conv", "call_id", status.alias("status"), "name", arguments.alias("arguments"), errors.alias("errors"), "order_turn", "order_step",
                       "result", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.when(known, message).alias("message"))
