"""Chat formatting with tool-call linking, in DataFrame functions.

Calls and results meet in a hash join by conversation and identifier, each side reduced to a row an identifier beforehand.
Arguments are parsed once, held against the tool's schema, and written as canonical JSON: keys sorted, no white space, one
form for each number. Calls that use other calls' results are ordered topologically: a call's step is the length of the longest
chain of uses up to it, so each comes behind those it uses.

- Calls that use one other call form chains, which are walked by doubling: a round joins each call to where the one it points to
  points, so there are as many rounds as the longest chain's length has binary digits;
- calls that use several wait until all of those have a step. A chain of single uses between two such calls counts as one. A conversation with
  at most ``FOLDED`` such calls is a row, and a round goes through its calls in order of turns and back, so uses of earlier calls cost one
  round however deep they are; calls of larger conversations take a step a round. What is left in the end waits on itself: a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch

# JSON schema types, and how the types of a parsed value begin.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}
OWNER = ["conv_id", "call_id"]
#: Calls of several uses that a conversation may have to be gone through as one row.
FOLDED = 4096
CALL = "struct<turn:bigint,name:string,arguments:string,after:array<string>>"
JSON_CALL = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"


def read_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results told by messages (conv_id, turn, role, text) whose texts are JSON.

    An assistant's text {"tool_calls": [{"id", "name", "arguments", "after"}, ..]} makes calls; a tool's text
    {"tool_call_id", "content"} a result. Other texts make none.
    """
    turn, text = F.col("turn").cast("long").alias("turn"), F.col("text")
    of = F.from_json(text, f"tool_calls {JSON_CALL}")["tool_calls"]
    calls = messages.filter((F.col("role") == "assistant") & text.contains('"tool_calls"')).select("conv_id", turn, F.explode(of).alias("c"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), "turn", "c.name", "c.arguments", "c.after")
    got = messages.filter((F.col("role") == "tool") & text.contains('"tool_call_id"')).select("conv_id", turn, F.from_json(text, "tool_call_id string, content string").alias("r"))
    return calls, got.select("conv_id", F.col("r.tool_call_id").alias("call_id"), "turn", "r.content")


def prompts_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations read as calls: a user's turn calls ``answer`` with its prompt, using the answer two turns before (if
    that is not before the first turn); an assistant's turn is the result of the call of the turn before it."""
    name = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - n).cast("string"))
    both = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    calls = conversations.filter(F.col("role") == "user").select(
        "conv_id", F.when(both, name(0)).alias("call_id"), F.col("turn").cast("long").alias("turn"), F.lit("answer").alias("name"), arguments.alias("arguments"), F.when(both & (F.col("turn") >= 2), F.array(name(2))).alias("after")
    )
    results = conversations.filter(F.col("role") == "assistant").select("conv_id", F.when(both, name(1)).alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("content"))
    return calls, results


def _errors(args: Column, known: Column) -> Column:
    """What a call's arguments (a map of variants, null where they are no object) have against a schema's parameters."""
    kind = lambda p: F.schema_of_variant(F.try_element_at(args, p["parameter"]))
    fits = lambda p: F.exists(F.try_element_at(F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), p["type"]), lambda t: kind(p).startswith(t))
    has = lambda p: F.map_contains_key(args, p["parameter"])
    missing = F.transform(F.filter(known, lambda p: p["required"] & ~has(p)), lambda p: F.concat(F.lit("missing:"), p["parameter"]))
    wrong = F.transform(F.filter(known, lambda p: has(p) & ~F.coalesce(fits(p), F.lit(False))), lambda p: F.concat(F.lit("type:"), p["parameter"]))
    names = F.transform(known, lambda p: p["parameter"])
    unknown = F.transform(F.array_except(F.map_keys(args), names), lambda k: F.concat(F.lit("unknown:"), k))
    return F.when(known.isNull(), F.array(F.lit("tool"))).when(args.isNull(), F.array(F.lit("malformed"))).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))


def _folded(uses: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, step of calls of several uses, as far as these have one. uses: conv_id, call_id, turn, to, far, step (of to, null where to is itself
    such a call); a conversation's calls are few enough to be a row."""
    each = uses.groupBy("conv_id", "turn", "call_id").agg(F.collect_list(F.struct("to", "far", "step")).alias("uses"))
    row = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "call_id", "uses"))).alias("calls"))
    ids = F.transform("calls", lambda c: c["call_id"])
    placed = lambda u: F.struct((F.array_position(F.col("ids"), u["to"]) - 1).cast("int").alias("at"), u["far"].alias("far"), u["step"].alias("step"))
    row = row.withColumn("ids", ids).withColumn("uses", F.transform("calls", lambda c: F.transform(c["uses"], placed)))
    row = row.select("conv_id", "ids", "uses", F.transform("ids", lambda _: F.lit(None).cast("long")).alias("steps"))
    size = F.size("ids")

    def settle(steps: Column, i: Column) -> Column:
        """The steps with that of call i, if all of its uses have one."""
        told = F.transform(F.get(F.col("uses"), i), lambda u: F.coalesce(u["step"], F.get(steps, u["at"])) + u["far"])
        new = F.when(~F.exists(told, lambda t: t.isNull()), F.array_max(told))
        return F.concat(F.slice(steps, F.lit(1), i), F.array(new), F.slice(steps, i + 2, size))

    turn, now = 0, scratch.keep(row, "folded0")
    while True:
        there = F.aggregate(F.sequence(F.lit(0), size - 1), F.col("steps"), settle)
        onward = now.withColumn("before", F.col("steps")).withColumn("steps", there)
        onward = onward.withColumn("steps", F.aggregate(F.sequence(size - 1, F.lit(0)), F.col("steps"), settle))
        known = lambda c: F.size(F.filter(c, lambda x: x.isNotNull()))
        turn += 1
        now = scratch.keep(onward.withColumn("moved", known("steps") > known("before")).drop("before"), f"folded{turn}")
        scratch.drop(f"folded{turn - 1}")
        if not now.filter("moved").limit(1).count():
            break
    out = now.select("conv_id", F.explode(F.arrays_zip("ids", "steps")).alias("c"))
    return out.select("conv_id", F.col("c.ids").alias("call_id"), F.col("c.steps").alias("step")).filter(F.col("step").isNotNull())


def _by_rounds(wait: DataFrame, scratch: Scratch) -> None:
    """Adds the steps of calls of several uses to the table ``levels``, a level a round. wait: a row for each use, with step where it has one."""
    turn, wait = 0, scratch.keep(wait, "wait0")
    while wait.limit(1).count():
        # a call whose uses all have a step comes next, and settles the uses of it
        ready = wait.groupBy(*OWNER).agg(F.max(F.col("step") + F.col("far")).alias("step"), F.count_if(F.col("step").isNull()).alias("open")).filter("open = 0").select(*OWNER, "step")
        ready = scratch.keep(ready, f"ready{turn}")
        if not ready.limit(1).count():
            break
        ready.write.mode("append").parquet(scratch.path("levels"))
        last = ready.select("conv_id", F.col("call_id").alias("to"), F.col("step").alias("told"))
        left = wait.join(ready.select(*OWNER), OWNER, "left_anti").join(last, ["conv_id", "to"], "left")
        turn += 1
        wait = scratch.keep(left.select(*OWNER, "to", "far", F.coalesce("step", "told").alias("step")), f"wait{turn}")
        scratch.drop(f"wait{turn - 1}")
        scratch.drop(f"ready{turn - 1}")


def steps(calls: DataFrame, scratch: Scratch, folded: int = FOLDED) -> DataFrame:
    """conv_id, call_id, step, unmet (sorted ids of ``after`` that no call of the conversation has).

    calls: a written table, a row for each conv_id and call_id, none of them null. step is the length of the longest chain of uses up
    to the call, 0 for one that uses none; null in or behind a cycle. Turns have no part in it.
    """
    uses = calls.select(*OWNER, F.explode(F.array_distinct("after")).alias("used")).filter(F.col("used").isNotNull())
    there = calls.select("conv_id", F.col("call_id").alias("used"), F.lit(True).alias("there"))
    edges = scratch.keep(uses.join(there, ["conv_id", "used"], "left"), "edges")
    unmet = edges.filter(F.col("there").isNull()).groupBy(*OWNER).agg(F.array_sort(F.collect_list("used")).alias("unmet"))
    met = edges.filter("there").select(*OWNER, "used")
    needs = scratch.keep(met.groupBy(*OWNER).agg(F.count("*").alias("n"), F.min("used").alias("to")), "needs")
    several = needs.filter("n > 1").select(*OWNER)
    known = calls.select(*OWNER).join(needs, OWNER, "left_anti").select(*OWNER, F.lit(0).cast("long").alias("step"))

    chain, turn = scratch.keep(needs.filter("n = 1").select(*OWNER, "to", F.lit(1).cast("long").alias("far"), F.lit(True).alias("moved")), "chain0"), 0
    most = chain.count()
    while most >> turn:  # a walk longer than all of them goes in a circle
        onward = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("then"), F.col("far").alias("more"))
        moved = F.col("then").isNotNull()
        walked = chain.join(onward, ["conv_id", "to"], "left").select(*OWNER, F.coalesce("then", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), moved.alias("moved"))
        turn += 1
        chain = scratch.keep(walked, f"chain{turn}")
        scratch.drop(f"chain{turn - 1}")
        if not chain.filter("moved").limit(1).count():
            break

    known.write.parquet(scratch.path("levels"))
    levels = lambda: scratch.spark.read.schema(known.schema).parquet(scratch.path("levels"))
    if several.limit(1).count():
        ends = chain.select("conv_id", F.col("call_id").alias("used"), "to", "far")
        wait = met.join(several, OWNER, "left_semi").join(ends, ["conv_id", "used"], "left")
        wait = wait.select(*OWNER, F.coalesce("to", "used").alias("to"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))
        first = known.select("conv_id", F.col("call_id").alias("to"), "step")
        wait = scratch.keep(wait.join(first, ["conv_id", "to"], "left").select(*OWNER, "to", "far", "step"), "wait")
        sizes = scratch.keep(wait.groupBy(*OWNER).agg(F.lit(1)).groupBy("conv_id").agg((F.count("*") <= folded).alias("small")), "sizes")
        small = wait.join(sizes.filter("small"), "conv_id", "left_semi").join(calls.select(*OWNER, "turn"), OWNER)
        _folded(small, scratch).write.mode("append").parquet(scratch.path("levels"))
        _by_rounds(wait.join(sizes.filter("not small"), "conv_id", "left_semi"), scratch)
    done = levels()
    walked = chain.join(done.select("conv_id", F.col("call_id").alias("to"), F.col("step").alias("told")), ["conv_id", "to"]).select(*OWNER, (F.col("told") + F.col("far")).alias("step"))
    return calls.select(*OWNER).join(unmet, OWNER, "left").join(done.unionByName(walked), OWNER, "left").select(*OWNER, "step", "unmet")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, join: str = "shuffle_hash") -> DataFrame:
    """A row for each call, and for each result without one: conv_id, call_id, step, status, errors, repeats, n_results, message.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (ids whose results it uses). results: conv_id, call_id,
    turn, content. schemas: tool, parameter, type, required, a row for each parameter (one with a null parameter for a tool that
    has none).

    status: linked; early (its result comes no later than the call, or a turn is null); unanswered; orphan (a result without a
    call: it has no step); unidentified (a null conv_id or call_id: never linked, a row for each). errors: comma-joined, of tool
    (no schema), malformed (arguments that are no JSON object, or repeat a key), missing:, type: and unknown: with a parameter,
    unmet: with an id of after that is no call of the conversation, and cycle. Of calls with the same id in a conversation the
    first by turn, name, arguments counts, repeats tells how many there are; results likewise, with n_results. message is canonical
    JSON of arguments (as text where malformed), id, name, result; nulls left out. Extra columns aren't read.

    The hash join holds a shuffle partition's results in memory, each identifier once, so a job with too few partitions for that
    fails: raise spark.sql.shuffle.partitions, or take join="merge", which sorts and spills instead.
    """
    scratch = Scratch(calls.sparkSession, "toolcalls")
    asked = calls.select(*OWNER, F.struct(F.col("turn").cast("long").alias("turn"), "name", "arguments", F.col("after").cast("array<string>").alias("after")).alias("call"))
    got = results.select(*OWNER, F.struct(F.col("turn").cast("long").alias("turn"), "content").alias("result"))
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = asked.filter(whole).groupBy(*OWNER).agg(F.min("call").alias("call"), F.count("*").alias("repeats"))
    answer = got.filter(whole).groupBy(*OWNER).agg(F.min("result").alias("result"), F.count("*").alias("n_results"))
    linked = first.join(answer.hint(join), OWNER, "full")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered").when(F.col("result.turn") > F.col("call.turn"), "linked").otherwise("early")
    linked = linked.withColumn("status", status)
    loose = asked.filter(~whole).withColumn("repeats", F.lit(1).cast("long")).unionByName(got.filter(~whole).withColumn("n_results", F.lit(1).cast("long")), allowMissingColumns=True).withColumn("status", F.lit("unidentified"))
    rows = scratch.keep(linked.unionByName(loose), "rows")

    order = steps(rows.filter(F.col("call").isNotNull() & (F.col("status") != "unidentified")).select(*OWNER, "call.turn", "call.after"), scratch)
    known = F.filter(F.collect_list(F.struct("parameter", "type", F.coalesce("required", F.lit(False)).alias("required"))), lambda p: p["parameter"].isNotNull())
    # a row a tool; written, so that the planner knows its size and broadcasts it only under its own threshold
    tools = scratch.keep(schemas.filter(F.col("tool").isNotNull()).groupBy("tool").agg(known.alias("known")), "tools")
    placed = rows.withColumn("name", F.col("call.name")).join(order, OWNER, "left").join(tools, F.col("name") == F.col("tool"), "left")
    parsed = placed.withColumn("parsed", F.try_parse_json(F.col("call.arguments")))
    args = F.when(F.schema_of_variant("parsed").startswith("OBJECT"), F.try_variant_get("parsed", "$", "map<string,variant>"))
    checked = parsed.withColumn("args", args)
    is_call = F.col("call").isNotNull()
    cycle = F.when(is_call & (F.col("status") != "unidentified") & F.col("step").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))
    unmet = F.transform(F.coalesce("unmet", F.array().cast("array<string>")), lambda i: F.concat(F.lit("unmet:"), i))
    errors = F.when(is_call, F.concat(_errors(F.col("args"), F.col("known")), unmet, cycle)).otherwise(F.array().cast("array<string>"))
    as_text = F.when(F.col("args").isNull(), F.col("call.arguments"))
    body = lambda a: F.to_json(F.struct(a.alias("arguments"), F.col("call_id").alias("id"), F.col("call.name").alias("name"), F.col("result.content").alias("result")))
    message = F.when(F.col("args").isNull(), body(as_text)).otherwise(body(F.col("parsed")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return checked.select(*OWNER, "step", "status", F.array_join(errors, ",").alias("errors"), count("repeats"), count("n_results"), message.alias("message"))


def op8_tool_call_linking(spark, sf_dir: str) -> DataFrame:
    """Every conversation's prompts as calls, linked with their answers; see ``prompts_as_calls``."""
    calls, results = prompts_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schemas = spark.createDataFrame([("answer", "prompt", "string", True), ("answer", "turn", "integer", True)], "tool string, parameter string, type string, required boolean")
    return link(calls, results, schemas)


OP8_SQL = """
WITH u AS (SELECT conv_id, conv_id || ':' || turn AS call_id, turn,
                  min(coalesce(text, '')) AS prompt, count(*) AS repeats
           FROM conversations WHERE role = 'user' GROUP BY conv_id, turn),
-- a call uses that of two turns before: its step is its place in a run of such turns
g AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM u),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS step FROM g),
r AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn, min(text) AS content, count(*) AS n_results
      FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.step,
       CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       CASE WHEN c.turn >= 2 AND p.call_id IS NULL THEN 'unmet:' || c.conv_id || ':' || (c.turn - 2) ELSE '' END AS errors,
       coalesce(c.repeats, 0) AS repeats, coalesce(r.n_results, 0) AS n_results,
       '{' || CASE WHEN c.call_id IS NULL THEN '' ELSE '"arguments":{"prompt":' || to_json(c.prompt) || ',"turn":' || c.turn || '},' END
           || '"id":' || to_json(coalesce(c.call_id, r.call_id))
           || CASE WHEN c.call_id IS NULL THEN '' ELSE ',"name":"answer"' END
           || CASE WHEN r.content IS NULL THEN '' ELSE ',"result":' || to_json(r.content) END || '}' AS message
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
"""
