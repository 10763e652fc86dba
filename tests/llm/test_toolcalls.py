"""Tool-call linking against SQL on the table and by hand on hard cases."""

import json
from collections import Counter

import duckdb

from runledger.llm.toolcalls import LINK_SQL, TOOLS, calls_of, linked_calls

CALL = "conv_id long, turn long, call_id string, name string, arguments string, status string"
RESULT = "conv_id long, turn long, call_id string, content string, level int"


def test_equals_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    table = spark.read.parquet(path)
    got = linked_calls(*calls_of(table), TOOLS)
    conversations = table.toPandas()  # noqa: F841
    found = duckdb.sql(LINK_SQL)
    assert sorted(found.columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*found.columns).collect())) == Counter(found.fetchall())


def test_hard_cases(spark):
    say = lambda **x: json.dumps(x)
    calls = [
        (1, 0, "a", "search", say(text="x", limit=3), "s"), (1, 2, "b", "search", say(limit=2, text="{{a}} and {{a}}"), "s"),
        (1, 1, "c", "search", say(text="{{b}} {{a}}", limit=1), "s"), (1, 4, "p", "search", say(text="{{q}}", limit=1), "s"),
        (1, 5, "q", "search", say(text="{{p}}", limit=1), "s"), (1, 6, "r", "search", say(text="{{q}}", limit=1), "s"),
        (2, 0, "a", "search", say(text="{{zz}}", limit=1.5, more=1, also=2), "s"), (2, 0, "b", "nothing", "{}", "s"), (2, 1, "d", "search", "[1]", "s"),
        (2, 1, "e", "search", "{broken", "s"), (2, 1, "f", "search", None, "s"), (2, 9, "a", "count", say(text="later"), "s"),
        (2, 3, None, "search", say(text="x", limit=1), "s"), (2, 3, None, "count", say(text="y"), "s"), (None, None, "n", "count", say(text="ü\n\"q\""), "s"), (3, None, "t", None, None, "s"),
    ]
    results = [(1, 3, "a", "first", 0), (1, 5, "a", "second", 0), (1, 0, "c", "too early", 0), (2, 1, "none", "orphan", 0), (2, 1, None, "no id", 0),
               (None, 1, "n", "no conversation", 0), (2, 2, "b", None, 0)]
    rows = linked_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), TOOLS).collect()
    got = {(r.conv_id, r.call_id): r for r in rows if r.conv_id and r.call_id}
    assert [got[1, c].level for c in "abcpqr"] == [0, 1, 2, None, None, None]
    assert [got[1, c].position for c in "abcpqr"] == [0, 1, 2, 3, 4, 5] and got[1, "p"].errors == "cycle"
    assert (got[1, "a"].status, got[1, "a"].result_turn, got[1, "a"].n_results) == ("linked", 3, 2)
    assert got[1, "c"].status == "early" and got[1, "b"].status == "no_result" and got[2, "none"].status == "orphan"
    assert got[2, "a"].errors == "type:limit,unknown:also+more,unknown_ref" and got[2, "a"].n_calls == 2 and got[2, "a"].call_turn == 0
    assert got[2, "b"].errors == "unknown_tool" and {got[2, c].errors for c in "def"} == {"not_an_object"} and not got[2, "f"].valid
    assert got[1, "b"].canonical == '{"arguments":{"limit":2,"text":"{{a}} and {{a}}"},"id":"b","name":"search"}'
    assert got[1, "b"].valid and got[2, "none"].valid is None and got[3, "t"].errors == "unknown_tool"
    assert Counter(r.status for r in rows if not (r.conv_id and r.call_id)) == {"no_result": 3, "orphan": 2}
    assert len(rows) == len(got) + 5 and {r.errors for r in rows if r.call_id is None and r.n_calls} == {"no_id"}
    assert {r.canonical for r in rows if r.call_id is None and r.n_calls} == {
        '{"arguments":{"limit":1,"text":"x"},"name":"search"}', '{"arguments":{"text":"y"},"name":"count"}'}
    assert linked_calls(spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT), TOOLS).count() == 0


def test_levels_are_longest_chains_where_all_references_point_back(spark):
    refs = {(1, i): [i - 1] if i else [] for i in range(37)}  # one chain
    refs |= {(2, i): [j for j in (i - 1, i - 3) if j >= 0 and i % 4 == 0] or [i - 1] * (i > 0) for i in range(40)}  # heads in between
    refs |= {(3, 0): [], (3, 1): [0], (3, 2): [0, 1], (3, 3): [9, 2], (3, 4): [3, 1], (3, 5): [5], (3, 6): [5, 0], (3, 7): [6], (3, 8): [8, 7]}
    refs |= {(4, i): [(i + 1) % 5] for i in range(5)} | {(4, 5): [0], (4, 6): []}  # a cycle, and a call behind it
    calls = [(c, i, f"c{i:02}", "search", json.dumps({"text": " ".join(f"{{{{c{j:02}}}}}" for j in on), "limit": 1}), "s") for (c, i), on in refs.items()]
    calls += [(None, 0, "n", "search", "{}", "s"), (None, 1, "m", "search", '{"text": "{{n}}"}', "s")]
    level, before = {}, None
    while before != len(level):
        before = len(level)
        for (c, i), on in refs.items():
            known = [j for j in on if (c, j) in refs]
            if all((c, j) in level for j in known):
                level[c, i] = max((level[c, j] + 1 for j in known), default=0)
    rows = linked_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), TOOLS).collect()
    got = {(r.conv_id, r.call_turn): (r.level, r.position) for r in rows if r.conv_id}
    assert {k: v[0] for k, v in got.items()} == {k: level.get(k) for k in refs} and level[1, 36] == 36
    for conv in (1, 2, 3, 4):
        order = sorted((k for k in refs if k[0] == conv), key=lambda k: (level.get(k, 2**31), k[1]))
        assert [got[k][1] for k in order] == list(range(len(order)))
    assert len(rows) == len(calls)
