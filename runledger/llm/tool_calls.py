"""Chat formatting: links tool calls to their results, orders them, validates arguments and writes canonical JSON.

DataFrame functions only. Calls and results meet in an equi-join on their
conversation (a null one is like any other) and identifier, one row a side: the
first call of an identifier (by position, then by content) and its first result
share a row. So a very frequent identifier is pre-aggregated before it is
shuffled. Each further call has its own row, with its own arguments, errors and
depth, and so has each further result; both have the status and the counts of
their identifier.

Defined cases: a null identifier never links: such calls are "unidentified",
such results "orphan". A result without a call is "orphan", a call without a
result "unanswered". Null or unparsable arguments are invalid, as is an unknown
tool. Dependencies on unknown calls are ignored; calls on a cycle, or behind
one, have a null depth. Extra columns are ignored; empty tables give an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.session import stage

#: What a schema may ask of a field, and the kinds of JSON value that satisfy it.
KINDS = {"string": "^STRING", "integer": "^BIGINT|^DECIMAL\\([0-9]+,0\\)", "number": "^BIGINT|^DECIMAL|^DOUBLE", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}

#: Identifiers with more further calls and results than this are joined apart from the others.
HOT_ROWS = 10_000
#: Calls of a block, a power of two: their depths are found in one expression.
BLOCK = 1024

Schemas = dict[str, dict[str, tuple[str, bool]]]


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments (JSON text): an array of strings, empty if nothing is.

    schemas: tool -> field -> (kind, whether it is required). Fields that the
    schema doesn't name are errors.
    """
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    found = F.when(F.array_contains(F.array(*(F.lit(t) for t in schemas)), name), F.array().cast("array<string>")).otherwise(F.array(F.lit("unknown tool")))
    found = F.when(value.isNull(), F.array(F.lit("not JSON"))).when(~kind.startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(found) if schemas else F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, (wanted, required) in sorted(fields.items()):
            here = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            if required:
                checks.append(F.when(~F.array_contains(keys, field), F.lit(f"missing {field}")))
            checks.append(F.when(F.array_contains(keys, field) & ~F.coalesce(here.rlike(KINDS[wanted]), F.lit(False)), F.lit(f"{field} is no {wanted}")))
        named = F.array(*(F.lit(f) for f in fields)).cast("array<string>")
        unknown = F.transform(F.array_except(keys, named), lambda k: F.concat(F.lit("unexpected "), k))
        wrong = F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), F.array_sort(unknown))
        found = F.when((name == tool) & value.isNotNull() & kind.startswith("OBJECT"), wrong).otherwise(found)
    return found


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def placed(calls: DataFrame) -> DataFrame:
    """(row, place): numbers that ascend by conversation and position. A range sort gives them, so a conversation may span many tasks."""
    ordered = calls.select("row", "conversation", "position")
    ordered = ordered.repartitionByRange("conversation", "position", "row").sortWithinPartitions("conversation", "position", "row")
    return stage(ordered.select("row", F.monotonically_increasing_id().alias("place")), "places")


def _sweep(calls: Column, down: bool) -> Column:
    """Depths of a block's calls, in their order (last to first if `down`); null while one is unknown.

    calls: array of (place, depth, base, open, within), ascending by place and
    without gaps. A call's depth is known, or follows from `base` (what its
    dependencies in other blocks ask for) and those at `within`, if none is open.
    """
    met = lambda done, at: F.get(done, F.size(calls) - 1 - at if down else at)

    def add(done: Column, call: Column) -> Column:
        below = F.transform(call.within, lambda at: met(done, at))
        ready = ~call.open & ~F.exists(below, lambda d: d.isNull())
        found = F.when(ready, F.greatest(call.base, F.coalesce(F.array_max(below) + 1, F.lit(0).cast("long"))))
        return F.concat(done, F.array(F.coalesce(call.depth, found)))

    swept = F.aggregate(F.reverse(calls) if down else calls, F.array().cast("array<bigint>"), add)
    return F.reverse(swept) if down else swept


def depths(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, depth): the length of the longest chain of dependencies below each call; null on cycles or behind them.

    calls: place. edges: place, dep (a place); both ends known, no repeats.
    Calls are swept in blocks of BLOCK neighbouring places, each an array of that
    many calls at most whatever conversations they belong to. A sweep follows every
    chain that runs one way inside a block to its end; a round sweeps the blocks
    that still wait upwards, then downwards. So dependencies that point one way
    take as many rounds as the longest chain has blocks, and a chain may take one
    more wherever it turns. A round without a new depth ends it: what is left is
    on cycles or behind them.
    """
    bits = BLOCK.bit_length() - 1
    block = lambda c: F.shiftright(c, bits)
    same = block(F.col("place")) == block(F.col("dep"))
    inside = edges.filter(same).groupBy("place").agg(F.collect_list(F.col("dep").bitwiseAND(F.lit(BLOCK - 1)).cast("int")).alias("within"))
    state = stage(
        calls.select("place").join(inside, "place", "left").select("place", F.coalesce("within", F.array().cast("array<int>")).alias("within"), F.lit(None).cast("long").alias("depth")), "calls"
    )
    across = stage(edges.filter(~same), "edges-across")
    done, moved = [], True
    while moved and not state.isEmpty():
        facts = across.join(state.select(F.col("place").alias("dep"), "depth"), "dep", "left")
        for known in done:
            facts = facts.join(known.select(F.col("place").alias("dep"), F.col("depth").alias("settled")), "dep", "left").withColumn("depth", F.coalesce("depth", "settled")).drop("settled")
        facts = facts.groupBy("place").agg((F.max("depth") + 1).alias("base"), (F.count("depth") < F.count(F.lit(1))).alias("open"))
        told = state.join(facts, "place", "left").select(
            block(F.col("place")).alias("block"),
            F.struct("place", "depth", F.coalesce("base", F.lit(0).cast("long")).alias("base"), F.coalesce("open", F.lit(False)).alias("open"), "within").alias("call"),
        )
        swept = told.groupBy("block").agg(F.sort_array(F.collect_list("call")).alias("calls")).withColumn("up", _sweep(F.col("calls"), False))
        again = F.zip_with("calls", "up", lambda c, d: c.withField("depth", d))
        swept = swept.withColumn("found", F.when(F.exists("up", lambda d: d.isNull()), _sweep(again, True)).otherwise(F.col("up")))
        entry = F.explode(F.zip_with("calls", "found", lambda c, d: F.struct(c.place.alias("place"), c.within.alias("within"), d.alias("depth"), c.depth.isNull().alias("waited"))))
        complete = ~F.exists("found", lambda d: d.isNull())
        after = stage(swept.select(complete.alias("complete"), entry.alias("_e")).select("complete", "_e.*"), "swept")
        moved = not after.filter("waited AND depth IS NOT NULL").isEmpty()
        settled = after.filter("complete").select("place", "depth")
        done = [stage(done[0].unionByName(settled), "depths")] if done else [stage(settled, "depths")]
        state = after.filter("NOT complete").select("place", "within", "depth")
    rest = state.select("place", "depth")
    return rest.unionByName(done[0]) if done else rest


def _looked_up(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """The rows of an identifier with its facts; few identifiers have over HOT_ROWS, and these are joined apart, by their measured size."""
    same = lambda right: rows["conversation"].eqNullSafe(right["of_conversation"]) & (rows["call"] == right["of_call"])
    hot = stage(lookup.filter(F.col("rows") > HOT_ROWS), "hot-identifiers")
    cold = lookup.filter(F.col("rows") <= HOT_ROWS)
    if hot.isEmpty():
        return rows.join(cold, same(cold))
    return rows.join(hot, same(hot)).unionByName(rows.join(hot, same(hot), "left_anti").join(cold, same(cold)))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call, and one for each result that isn't the first of a called identifier.

    calls: conversation, position, call, name, arguments (JSON text), after
    (array of call identifiers). results: conversation, position, call, content.
    Returns conversation, position, call, depth, status, errors, repeats
    (further calls of the identifier), results (how many it has), json. Order by
    (conversation, depth, position) to have every call behind what it needs.
    """
    numbered = F.monotonically_increasing_id().alias("row")
    calls = stage(calls.select("conversation", "position", "call", "name", "arguments", "after", numbered), "calls")
    results = stage(results.select("conversation", "position", "call", "content", numbered), "results")
    known = calls.filter("call IS NOT NULL")
    firsts = known.groupBy("conversation", "call").agg(F.min(F.struct("position", "name", "arguments", "after", "row")).alias("first"), (F.count(F.lit(1)) - 1).alias("repeats"))
    named = stage(firsts.select("conversation", "call", "first.position", "first.name", "first.arguments", "first.row", "repeats"), "first-calls")
    answers = results.filter("call IS NOT NULL").groupBy(F.col("conversation").alias("of_conversation"), F.col("call").alias("of_call")).agg(
        F.min(F.struct("position", "content", "row")).alias("answer"), F.count(F.lit(1)).alias("results")
    )
    # Calls are told apart by row; what is called before them, by the first call of its identifier.
    wanted = known.select("row", "conversation", F.explode(F.array_distinct("after")).alias("dep")).filter("dep IS NOT NULL")
    places = placed(known)
    targets = named.join(places, "row").select(F.col("conversation").alias("of_conversation"), F.col("call").alias("of_call"), F.col("place").alias("to"))
    meet = F.col("conversation").eqNullSafe(F.col("of_conversation")) & (F.col("dep") == F.col("of_call"))
    edges = wanted.join(targets, meet).select("row", F.col("to").alias("dep")).join(places, "row").select("place", "dep")
    depth = places.join(depths(places, edges), "place").select(F.col("row").alias("of_row"), "depth")
    met = stage(named.join(answers, F.col("conversation").eqNullSafe(F.col("of_conversation")) & (F.col("call") == F.col("of_call")), "full"), "linked")
    is_call = F.col("repeats").isNotNull()
    linked = met.join(depth, F.col("row") == F.col("of_row"), "left").select(
        F.when(is_call, F.col("conversation")).otherwise(F.col("of_conversation")).alias("conversation"), F.when(is_call, F.col("position")).otherwise(F.col("answer.position")).alias("position"),
        F.coalesce("call", "of_call").alias("call"), "depth", F.when(~is_call, "orphan").when(F.col("answer").isNull(), "unanswered").otherwise("answered").alias("status"),
        "name", "arguments", "repeats", F.coalesce("results", F.lit(0)).alias("results"), F.col("answer.content").alias("content"), is_call.alias("is_call"),
    )
    # Further calls and results of an identifier are found by their row, and then get its facts.
    lookup = stage(
        met.filter("repeats > 0 OR results > 1").select(
            F.when(is_call, F.col("conversation")).otherwise(F.col("of_conversation")).alias("of_conversation"), F.coalesce("call", "of_call").alias("of_call"), "repeats", F.coalesce("results", F.lit(0)).alias("results"),
            F.when(~is_call, "orphan").when(F.col("answer").isNull(), "unanswered").otherwise("answered").alias("status"),
            (F.coalesce("repeats", F.lit(0)) + F.coalesce("results", F.lit(0))).alias("rows"),
        ),
        "repeated",
    )
    nothing = F.lit(None).cast("string")
    loose_calls = calls.filter("call IS NULL").select(
        "conversation", "position", "call", F.lit(0).cast("long").alias("depth"), F.lit("unidentified").alias("status"), "name", "arguments",
        F.lit(0).cast("long").alias("repeats"), F.lit(0).cast("long").alias("results"), nothing.alias("content"), F.lit(True).alias("is_call"),
    )
    loose_results = results.filter("call IS NULL").select(
        "conversation", "position", "call", F.lit(None).cast("long").alias("depth"), F.lit("orphan").alias("status"), nothing.alias("name"), nothing.alias("arguments"),
        F.lit(None).cast("long").alias("repeats"), F.lit(1).cast("long").alias("results"), "content", F.lit(False).alias("is_call"),
    )
    parts = [linked, loose_calls, loose_results]
    if not lookup.isEmpty():
        further_calls = _looked_up(known.join(named.select("row"), "row", "left_anti"), lookup).join(depth, F.col("row") == F.col("of_row"), "left")
        first_results = met.filter("answer IS NOT NULL").select(F.col("answer.row").alias("row"))
        further_results = _looked_up(results.filter("call IS NOT NULL").join(first_results, "row", "left_anti"), lookup)
        parts = [
            further_calls.select("conversation", "position", "call", "depth", "status", "name", "arguments", "repeats", "results", nothing.alias("content"), F.lit(True).alias("is_call")),
            further_results.select(
                "conversation", "position", "call", F.lit(None).cast("long").alias("depth"), "status", nothing.alias("name"), nothing.alias("arguments"), "repeats", "results", "content", F.lit(False).alias("is_call"),
            ),
            *parts,
        ]
    rows = reduce(DataFrame.unionByName, parts)
    errors = F.when(~F.col("is_call"), F.array().cast("array<string>")).otherwise(argument_errors(F.col("name"), F.col("arguments"), schemas))
    # Keys in order; null fields are left out, and arguments that aren't JSON stay as text.
    json = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"), F.col("call").alias("id"), "name",
            F.when(F.try_parse_json("arguments").isNull(), F.col("arguments")).alias("raw_arguments"), F.col("content").alias("result"),
        )
    )
    return rows.select("conversation", "position", "call", "depth", "status", errors.alias("errors"), "repeats", "results", json.alias("json"))
