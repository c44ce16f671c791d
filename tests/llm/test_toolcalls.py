"""Tool-call linking: rows against SQL, orders, schema errors, canonical JSON."""

import json
import random

from gridloom.llm import toolcalls
from gridloom.llm.scratch import Scratch

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, extra string"
RESULTS = "conv_id long, call_id string, turn long, content string, call string"
SCHEMAS = "tool string, parameter string, type string, required boolean"


def test_rows_against_sql(spark, sf_dir, same_rows):
    assert same_rows(toolcalls.op8_tool_call_linking(spark, sf_dir), toolcalls.OP8_SQL) > 0


def linked(spark, calls, results=(), schemas=(("f", None, None, None),)):
    out = toolcalls.link(spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame([(*r, "x") for r in results], RESULTS), spark.createDataFrame(list(schemas), SCHEMAS))
    return sorted(out.collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["call_id"] or ""))


def test_status_and_repeats(spark):
    calls = [(1, "a", 2, "f", "{}", None), (1, "a", 2, "f", "{}", None), (1, "b", 5, "f", "{}", []), (1, "c", 6, "f", "{}", None), (2, "a", 1, "f", "{}", None), (1, None, 3, "f", "{}", None), (None, "z", 3, None, None, None)]
    results = [(1, "a", 3, "ok"), (1, "a", 4, "later"), (1, "b", 4, "too soon"), (3, "q", 7, None), (None, "z", 1, "?")]
    got = linked(spark, calls, results)
    assert len(got) == 8
    of = {(r["conv_id"], r["call_id"]): r for r in got if r["conv_id"] is not None and r["call_id"] is not None}
    assert [(of[k]["status"], of[k]["repeats"], of[k]["n_results"]) for k in ((1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "q"))] == [("linked", 2, 2), ("early", 1, 1), ("unanswered", 1, 0), ("unanswered", 1, 0), ("orphan", 0, 1)]
    assert sum(r["status"] == "unidentified" for r in got) == 3
    assert json.loads(of[1, "a"]["message"]) == {"arguments": {}, "id": "a", "name": "f", "result": "ok"}


def test_order(spark):
    chain = [(1, f"c{i}", 100 - i, "f", "{}", [f"c{i - 1}"] if i else None) for i in range(6)] + [(1, "d", 3, "f", "{}", ["c1", "c4", "c4", None])]
    straight = [(2, f"c{i}", i, "f", "{}", [f"c{i - 1}"] if i else None) for i in range(6)]
    loop = [(3, "x", 1, "f", "{}", ["y"]), (3, "y", 2, "f", "{}", ["x"]), (3, "z", 3, "f", "{}", ["y"]), (3, "w", 4, "f", "{}", ["gone"])]
    of = {(r["conv_id"], r["call_id"]): r for r in linked(spark, chain + straight + loop)}
    assert [of[1, f"c{i}"]["step"] for i in range(6)] == list(range(6)) and of[1, "d"]["step"] == 5
    assert [of[2, f"c{i}"]["step"] for i in range(6)] == list(range(6))
    assert [(of[3, i]["step"], of[3, i]["errors"]) for i in "xyzw"] == [(None, "cycle")] * 3 + [(0, "unmet:gone")]


def test_steps_are_longest_chains_whatever_the_turns(spark):
    """Random uses, with cycles, long chains and calls of several uses, against a plain walk."""
    random.seed(5)
    after = {f"s{i}": [f"s{i - 1}"] if i else [] for i in range(100)}
    after |= {f"m{i}": [f"m{random.randrange(i)}" for _ in range(random.randrange(4))] if i else [] for i in range(60)}
    after |= {"j": ["s99", "m59"], "k": ["j"], "l": ["k", "s3"], "x": ["y"], "y": ["z"], "z": ["x"], "b": ["x"], "w": ["s1", "x"], "o": ["o"]}

    def step(call, seen=()):
        if call in seen:
            return None
        each = [step(u, (*seen, call)) for u in after[call]]
        return None if None in each else max(each, default=-1) + 1

    got = {r["call_id"]: r["step"] for r in linked(spark, [(1, c, random.randrange(9), "f", "{}", a) for c, a in after.items()])}
    assert got == {c: step(c) for c in after}


def test_deep_chains_of_several_uses(spark):
    """2,000 calls that each use the two before them: one round where they follow the turns; the same steps by rounds and with turns turned around."""
    rows = [(1, f"c{i}", i, "f", "{}", [f"c{i - 1}", f"c{i - 2}"] if i > 1 else []) for i in range(2000)]
    assert {r["call_id"]: r["step"] for r in linked(spark, rows)} == {f"c{i}": max(i - 1, 0) for i in range(2000)}
    few = [(k, f"c{i}", -i if k == 2 else i, [f"c{i - 1}", f"c{i - 2}"] if i > 1 else []) for k in (2, 3) for i in range(9)]
    scratch = Scratch(spark, "steps")
    calls = scratch.keep(spark.createDataFrame(few, "conv_id long, call_id string, turn long, after array<string>"), "calls")
    for folded in (100, 3):  # as a row, and a level a round
        got = toolcalls.steps(calls, Scratch(spark, "steps"), folded)
        assert {(r["conv_id"], r["call_id"]): r["step"] for r in got.collect()} == {(k, f"c{i}"): max(i - 1, 0) for k in (2, 3) for i in range(9)}


def test_schemas_and_canonical_json(spark):
    schemas = [("g", "n", "integer", True), ("g", "s", "string", False), ("g", "x", "number", False), ("g", "l", "array", None), ("g", "o", "object", False), ("g", "b", "boolean", False), (None, "n", "integer", True)]
    texts = ['{"s": "é\\n/", "n": 1, "o": {"z": 1, "a": [1, 2]}, "l": [], "b": true, "x": 2.50}', '{"n": "1"}', '{"s": null, "q": 1}', "[1]", "{bad", None, '{"n": 1, "n": 2}', '{"n": 1.5, "x": 3}']
    got = linked(spark, [(1, f"k{i}", i, "g", t, None) for i, t in enumerate(texts)] + [(1, "none", 9, "h", "{}", None)], schemas=schemas)
    assert [r["errors"] for r in got] == ["", "type:n", "missing:n,type:s,unknown:q", "malformed", "malformed", "malformed", "malformed", "type:n", "tool"]
    assert got[0]["message"] == '{"arguments":{"b":true,"l":[],"n":1,"o":{"a":[1,2],"z":1},"s":"é\\n/","x":2.5},"id":"k0","name":"g"}'
    assert got[4]["message"] == '{"arguments":"{bad","id":"k4","name":"g"}'


def test_messages_and_empty_tables(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": "{\"k\":1}", "after": ["b"]}, {"id": "b", "name": "f", "arguments": "{}"}]})), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "r"})), (None, None, None, None)]
    calls, results = toolcalls.read_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r["call_id"]: r for r in toolcalls.link(calls, results, spark.createDataFrame([("f", "k", "integer", False)], SCHEMAS)).collect()}
    assert (out["a"]["step"], out["b"]["step"], out["b"]["status"], out["a"]["errors"]) == (1, 0, "linked", "")
    empty = toolcalls.link(calls.limit(0), results.limit(0), spark.createDataFrame([], SCHEMAS))
    assert empty.count() == 0
