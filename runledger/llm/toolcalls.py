"""Tool calls and their results: linked, ordered, validated and written as canonical JSON, in DataFrame operations.

Calls and results meet in a shuffled hash join on (conversation, identifier), each side first reduced to one row an
identifier; rows without one pass by it. A call depends on the calls whose results its arguments mention as ``{{identifier}}``. Calls are layered as
in Kahn's algorithm, all conversations at once. Calls with one reference hang in chains on the calls with none or
several, their heads; the head and the distance to it come from pointer doubling, in as many rounds as the
logarithm of the longest chain. Kahn's rounds then place the heads alone: a round places those whose dependencies
are placed, so there are as many rounds as heads follow one another. Arguments are parsed to VARIANT, whose objects keep
their keys sorted, which makes their JSON canonical; the types of its fields are held against the tool's schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import text_of, word_count
from runledger.session import written

REFERENCE = r"\{\{([^{}]+)\}\}"
TURNS = 256  # turns of a conversation whose calls are numbered in one window

#: The names of VARIANT types that a JSON Schema type allows.
TYPES = {
    "string": "STRING", "boolean": "BOOLEAN", "integer": r"BIGINT|DECIMAL\([0-9]+,0\)", "number": r"BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\)",
    "object": "OBJECT<.*>", "array": "ARRAY<.*>", "null": "VOID",
}


def field_type(name: str) -> Column:
    """The VARIANT type of a top-level field of ``_args``, null where it is missing."""
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return F.schema_of_variant(F.try_variant_get("_args", path, "variant"))


def schema_errors(tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with name and arguments of a call, as an array of sorted texts."""
    found = []
    for tool, fields in tools.items():
        mine = F.col("name") == tool
        for field, (kind, required) in fields.items():
            is_type = field_type(field)
            if required:
                found.append(F.when(mine & is_type.isNull(), F.lit(f"missing:{field}")))
            found.append(F.when(mine & ~is_type.rlike(f"^({TYPES[kind]})$"), F.lit(f"type:{field}")))
        keys = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
        more = F.array_except(keys, F.array(*map(F.lit, fields)).cast("array<string>"))
        found.append(F.when(mine & (F.size(more) > 0), F.concat(F.lit("unknown:"), F.array_join(F.array_sort(more), "+"))))
    parsed = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return (
        F.when(~F.coalesce(F.col("name").isin(list(tools)), F.lit(False)), F.array(F.lit("unknown_tool")))
        .when(F.col("_args").isNull() | ~F.schema_of_variant("_args").startswith("OBJECT"), F.array(F.lit("not_an_object")))
        .otherwise(F.array_sort(parsed))
    )


def heads_of(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, head, far): the call without or with several references that a chain of single ones ends at.

    Calls whose chain runs into a cycle are missing. Each round doubles the steps that a row stands for.
    """
    key = ["conv_id", "call_id"]
    refs = written(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("on").alias("head")), "op2-heads")
    single = refs.where("_n = 1").select(*key, "head", F.lit(1).cast("long").alias("far"))
    ends = written(calls.select(*key).join(single, key, "left_anti").select(*key, F.col("call_id").alias("head"), F.lit(0).cast("long").alias("far")), "op2-heads")
    found, open_ = ends, single
    most = single.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # after k rounds every chain of fewer than 2 ** k links is at its end, so what is open then is a cycle
    for _ in range(most.bit_length()):
        both = found.withColumn("_end", F.lit(True)).unionByName(open_.withColumn("_end", F.lit(False)))
        step = both.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("_to"), F.col("far").alias("_more"), "_end")
        moved = written(open_.join(step, ["conv_id", "head"]).select(
            *key, F.col("_to").alias("head"), (F.col("far") + F.col("_more")).alias("far"), "_end"), "op2-heads")
        found, open_ = found.unionByName(moved.where("_end").drop("_end")), moved.where("not _end").drop("_end")
    return found


def layers(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls that depend on none have 0; those in or behind a cycle are missing."""
    key = ["conv_id", "call_id"]
    calls = calls.where("conv_id is not null and call_id is not null")
    at = written(heads_of(calls, edges), "op2-heads")
    several = edges.join(at.where("far = 0").select(*key), key, "left_semi")
    ends = at.select("conv_id", F.col("call_id").alias("on"), "head", "far")
    several = written(several.join(ends, ["conv_id", "on"], "left").select(*key, "head", "far"), "op2-several")
    placed = at.where("far = 0").select(*key).join(several.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0).cast("long"))
    done, now = -1, 0
    while now > done and not several.isEmpty():
        placed, done = written(placed, "op2-levels"), now
        parents = placed.select("conv_id", F.col("call_id").alias("head"), F.col("level").alias("_l"))
        ready = (
            several.join(placed.select(*key), key, "left_anti").join(parents, ["conv_id", "head"], "left").groupBy(*key)
            .agg(F.max(F.col("_l") + F.col("far") + 1).alias("level"), F.count("_l").alias("_have"), F.count(F.lit(1)).alias("_need"))
            .where("_have = _need").select(*key, "level")
        )
        ready = written(ready, "op2-levels")
        now = done + ready.count()
        placed = placed.unionByName(ready)
    level = placed.select("conv_id", F.col("call_id").alias("head"), "level")
    return at.join(level, ["conv_id", "head"]).select(*key, (F.col("level") + F.col("far")).cast("int").alias("level"))


def linked_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row for each (conv_id, call_id) of ``calls`` (conv_id, turn, call_id, name, arguments) or ``results``
    (conv_id, turn, call_id, content).

    Columns: conv_id, call_id, name, call_turn, result_turn, n_calls, n_results, status (linked, no_result, early if
    the result stands before its call, orphan without a call), level, position (from 0 in a conversation, by level, turn
    and identifier), errors (joined by commas), valid, canonical. Of calls or results that repeat an identifier
    the first counts (by turn, then content; nulls last), and the numbers tell. Calls and results without
    an identifier or a conversation link with nothing: each is a row of its own, a call with the error no_id. level is the length of the longest chain that a call waits for. References to calls
    that do not exist are errors (unknown_ref), calls in or behind a cycle have no level and stand last. Null or
    malformed arguments are errors too. Empty tables give no rows; other columns are not returned.
    """
    key = ["conv_id", "call_id"]
    named = "conv_id is not null and call_id is not null"
    first = lambda *c: F.min(F.struct(F.col(c[0]).isNull().alias("_n"), *c))
    one = calls.where(named).groupBy(*key).agg(first("turn", "name", "arguments").alias("_c"), F.count(F.lit(1)).alias("n_calls")).select(
        *key, F.col("_c.turn").alias("call_turn"), F.col("_c.name").alias("name"), F.col("_c.arguments").alias("arguments"), "n_calls")
    one = written(one, "op2-calls")
    back = results.where(named).groupBy(*key).agg(first("turn", "content").alias("_r"), F.count(F.lit(1)).alias("n_results")).select(
        *key, F.col("_r.turn").alias("result_turn"), F.col("_r.content").alias("content"), "n_results")
    names = F.array_distinct(F.regexp_extract_all(text_of("arguments"), F.lit(REFERENCE), F.lit(1)))
    asked = one.select(*key, F.explode(names).alias("on"))
    known = one.select("conv_id", F.col("call_id").alias("on"), F.lit(True).alias("_known"))
    asked = written(asked.join(known, ["conv_id", "on"], "left"), "op2-references")
    lost = asked.where("_known is null").groupBy(*key).agg(F.lit(True).alias("_lost"))
    levels = layers(one, asked.where("_known").drop("_known"))
    ordered = (
        one.join(levels, key, "left")
        .withColumn("_l", F.coalesce("level", F.lit(2**31 - 1))).withColumn("_s", F.floor(F.coalesce("call_turn", F.lit(2**62)) / TURNS))
    )
    part = ["conv_id", "_l", "_s"]
    ahead = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_l", "_s")) - F.col("_n")
    slices = ordered.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", ahead).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.col("call_turn").asc_nulls_last(), "call_id")) - 1
    ordered = ordered.withColumn("_rank", rank).join(slices, part).select(*key, "level", (F.col("_ahead") + F.col("_rank")).alias("position"))
    status = (
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "no_result")
        .when(F.col("result_turn") < F.col("call_turn"), "early").otherwise("linked")
    )
    errors = F.concat(
        schema_errors(tools), F.when(F.col("_lost"), F.array(F.lit("unknown_ref"))).otherwise(F.array().cast("array<string>")),
        F.when(~F.expr(named), F.array(F.lit("no_id"))).when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))
    message = F.struct(F.col("_args").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))
    linked = one.join(back.hint("shuffle_hash"), key, "full").join(lost, key, "left").join(ordered, key, "left")
    once = F.lit(1).cast("long")
    loose_calls = calls.where(f"not ({named})").select(*key, F.col("turn").alias("call_turn"), "name", "arguments", once.alias("n_calls"))
    loose_results = results.where(f"not ({named})").select(*key, F.col("turn").alias("result_turn"), "content", once.alias("n_results"))
    return (
        linked.unionByName(loose_calls, allowMissingColumns=True).unionByName(loose_results, allowMissingColumns=True)
        .withColumn("_args", F.try_parse_json("arguments"))
        .select(
            *key, "name", "call_turn", "result_turn", F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
            F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), status.alias("status"), "level", "position",
            F.when(F.col("n_calls").isNotNull(), F.array_join(errors, ",")).alias("errors"),
            F.when(F.col("n_calls").isNotNull(), F.size(errors) == 0).alias("valid"), F.to_json(message).alias("canonical"),
        )
    )


#: The schemas that the query validates against: field, type and whether it is required.
TOOLS = {
    "search": {"text": ("string", True), "limit": ("integer", True), "after": ("string", False)},
    "translate": {"text": ("string", True), "limit": ("integer", False), "after": ("string", False), "lang": ("string", True)},
    "count": {"text": ("string", True), "limit": ("string", False), "after": ("string", False)},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off a table without any: what a user says is a call, the turn after it the result.

    The length of the text picks the tool; the arguments hold the text, its number of words, a language if that is
    even, and a reference to the call two turns before.
    """
    users = conversations.where("role = 'user'")
    arguments = F.to_json(F.struct(
        F.col("text"), word_count().alias("limit"), F.when(word_count() % 2 == 0, F.lit("en")).alias("lang"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("{{c"), F.col("turn") - 2, F.lit("}}"))).alias("after")))
    name = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("count")), (F.length(text_of()) % 3 + 1).cast("int"))
    calls = users.select("conv_id", "turn", F.concat(F.lit("c"), "turn").alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    results = conversations.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


#: The same links in SQL.
LINK_SQL = r"""
with words as (
    select *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n from conversations
), calls as (
    select conv_id, turn, 'c' || turn as call_id, n, text, ['search', 'translate', 'count'][length(coalesce(text, '')) % 3 + 1] as name,
        turn // 2 - row_number() over (partition by conv_id, turn % 2 order by turn) as island
    from words where role = 'user'
), levelled as (
    select *, row_number() over (partition by conv_id, turn % 2, island order by turn) - 1 as chain,
        lag(turn) over (partition by conv_id, turn % 2 order by turn) as earlier
    from calls
), checked as (
    select *, chain::int as level,
        row_number() over (partition by conv_id order by chain, turn, call_id) - 1 as position,
        concat_ws(',',
            case when name = 'translate' and n % 2 = 1 then 'missing:lang' end,
            case when name = 'count' then 'type:limit' end,
            case when name <> 'translate' and n % 2 = 0 then 'unknown:lang' end,
            case when turn >= 2 and earlier is distinct from turn - 2 then 'unknown_ref' end) as errors
    from levelled
), results as (
    select conv_id, turn as result_turn, 'c' || (turn - 1) as call_id, text as content from conversations where role = 'assistant'
)
select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, name, turn as call_turn, result_turn,
    (c.conv_id is not null)::bigint as n_calls, (r.conv_id is not null)::bigint as n_results,
    case when c.conv_id is null then 'orphan' when r.conv_id is null then 'no_result' else 'linked' end as status,
    level, position, errors, errors = '' as valid,
    '{' || concat_ws(',',
        case when c.conv_id is not null then '"arguments":{' || concat_ws(',',
            case when turn >= 2 then '"after":"{{c' || (turn - 2) || '}}"' end,
            case when n % 2 = 0 then '"lang":"en"' end,
            '"limit":' || n, '"text":' || to_json(text)::varchar) || '}' end,
        '"id":"' || coalesce(c.call_id, r.call_id) || '"', '"name":"' || name || '"', '"result":' || to_json(content)::varchar) || '}' as canonical
from checked c full join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
"""
