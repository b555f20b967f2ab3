import json
import os
import random

import duckdb
import pytest

from lineloom.llm import chat, common, queries
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.01"

TOOLS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "ping": {}}
SCHEMA = "conv_id bigint, turn bigint, role string, content string, call_id string, call_name string, call_arguments string, result_of string"


def linked(spark, rows):
    return {(r.conv_id, r.turn): r for r in chat.link(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()}


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "tool", "3", None, None, None, "x"),  # a result ahead of its call
        (1, 1, "assistant", None, "x", "add", '{"b": 2.5, "a": 1}', None),
        (1, 2, "assistant", "", "y", "add", '{"a": "1", "b": 2}', None),
        (1, 3, "tool", "?", None, None, None, "zz"),
        (1, 4, "assistant", "", "x", "add", '{"a": 1, "b": 2}', None),
        (2, 0, "assistant", "", "x", "ping", "{}", None),
        (2, 1, "assistant", "", "p", "ping", '{"extra": 1}', None),
        (2, 2, "assistant", "", "q", "add", "not json", None),
        (2, 3, "assistant", "", "r", "nope", "{}", None),
        (2, 4, None, None, None, None, None, None),
        (2, 5, "assistant", "", "s", "add", '{"a": 1, "b": 2, "a": 3}', None),
    ]
    out = linked(spark, rows)
    assert [(out[1, t].kind, out[1, t].link, out[1, t].valid) for t in range(5)] == [("result", "linked", None), ("call", "linked", True), ("call", "open", False), ("result", "orphan", None), ("call", "repeated", True)]
    assert (out[1, 0].order_turn, out[1, 0].order_rank) == (1, 1) and (out[1, 1].order_turn, out[1, 1].order_rank) == (1, 0)
    assert [out[1, t].position for t in range(5)] == [1, 0, 2, 3, 4]
    assert [out[2, t].valid for t in range(6)] == [True, False, False, False, None, False]
    line = out[1, 1].line
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(line)["tool_call"]["arguments"] == '{"a":1,"b":2.5}'
    assert json.loads(out[2, 4].line) == {"content": "", "role": "unknown"}


def test_nested_keys_are_sorted(spark):
    df = spark.createDataFrame([('{"b": {"z": 1, "a": [{"y": 1, "x": "é"}]}, "a": null}',)], "j string")
    assert df.select(chat.canonical(df.j)).first()[0] == '{"a":null,"b":{"a":[{"x":"é","y":1}],"z":1}}'


def by_hand(rows):
    """The linked messages of rows (conv, turn, role, content, call id, name, arguments, result of), one conversation at a time."""
    out = []
    none = lambda x: (x is not None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        mine = [(c, t, role or "unknown", content or "", *rest) for c, t, role, content, *rest in rows if c == conv]
        first = {}
        for r in sorted(mine, key=lambda r: (none(r[1]), *[(x is not None, x or "") for x in (r[5], r[6], r[2], r[3])])):
            if r[4] is not None:
                first.setdefault(r[4], [r, True])
        answered = {r[7] for r in mine if r[4] is None and r[7] is not None}
        placed = []
        for r in mine:
            if r[4] is not None:
                kind, link, rank, at = "call", "repeated", 0, r[1]
                if first[r[4]][1] and first[r[4]][0] == r:
                    first[r[4]][1], link = False, "linked" if r[4] in answered else "open"
            elif r[7] is not None:
                kind, rank = "result", 1
                asked = first.get(r[7])
                link, at = ("linked" if asked else "orphan"), max([x for x in (r[1], asked and asked[0][1]) if x is not None], default=None)
            else:
                kind, link, rank, at = "message", "none", 0, r[1]
            placed.append((none(at), rank, none(r[1]), kind, r[2], r[3], r[4] or r[7] or "", r[5] or "", r[6] or "", link))
        placed.sort(key=lambda x: x[:-1])
        out += [(conv, x[3], x[-1], x[0], x[1], k, x[5]) for k, x in enumerate(placed)]
    return sorted(map(str, out))


def test_links_and_positions_match_brute_force(spark):
    r = random.Random(8)
    rows = []
    for _ in range(600):
        conv, turn = r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(200)])
        kind = r.random()
        what = r.choice(["", "a", "é", None])
        if kind < 0.4:
            rows.append((conv, turn, r.choice(["assistant", None]), what, r.choice("xyzuvw"), r.choice(["add", "ping", None]), r.choice(["{}", '{"a":1}', None]), r.choice([None, "x"])))
        else:
            rows.append((conv, turn, "tool", what, None, None, None, r.choice([None, *"xyzuvwq"])))
    rows += r.sample(rows, 40) + [(7, 0, "user", "same", "c", "ping", "{}", None)] * 300  # repeated rows, a third of all
    out = chat.link(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()
    got = [(x.conv_id, x.kind, x.link, (x.order_turn is not None, x.order_turn if x.order_turn is not None else 0), x.order_rank, x.position, json.loads(x.line)["content"]) for x in out]
    assert sorted(map(str, got)) == by_hand(rows)
    hot = [x for x in out if x.conv_id == 7]
    assert sorted(x.position for x in hot) == list(range(300)) and sorted(x.link for x in hot) == ["open"] + ["repeated"] * 299


def test_the_join_hashes_call_ids(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(chat, "spool", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or common.spool(df, name))
    plans.append(chat.link(spark.createDataFrame([], SCHEMA), TOOLS)._jdf.queryExecution().executedPlan().toString())
    assert "ShuffledHashJoin" in plans[1] and not any(x in p for p in plans for x in ("CartesianProduct", "NestedLoop"))


def test_very_long_contents(spark):
    long = 'é"\n' * 200_000
    rows = [(1, 0, "assistant", long, "x", "add", json.dumps({"a": 1, "b": 2, "note": long}), None), (1, 1, "tool", long, None, None, None, "x")]
    out = linked(spark, rows)
    assert out[1, 0].valid and out[1, 0].link == "linked" and json.loads(out[1, 1].line)["content"] == long
    assert json.loads(json.loads(out[1, 0].line)["tool_call"]["arguments"])["note"] == long


def test_query_over_conversations(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'say "hi"\n'), (1, 2, "assistant", "hi"), (2, 0, "user", None), (3, 1, "assistant", "alone"), (None, 0, "user", "x"), (4, 0, None, "y"), (5, 0, "user", "z"), (5, 0, "user", "z"), (6, 1, "assistant", "abc"), (6, 2, "user", "abcd")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = queries.op9_tool_chat(spark, cases.table(spark, tmp_path, df.selectExpr("*", "1 as link", "2 as kind", "3 as copies", "4 as block"), "conversations")).collect()
    assert len(out) == len(rows)
    kinds = {(r.conv_id, r.turn): (r.kind, r.link, r.valid, r.position) for r in out}
    assert kinds[1, 1] == ("call", "linked", True, 1) and kinds[1, 2] == ("result", "linked", None, 2)
    assert kinds[2, 0] == ("call", "open", False, 0) and kinds[3, 1] == ("result", "orphan", None, 0)  # no text: one key too many
    assert sorted(r.link for r in out if r.conv_id == 5) == ["open", "repeated"]
    assert kinds[6, 1] == ("result", "linked", None, 1) and kinds[6, 2][3] == 0  # the result follows its call
    assert queries.op9_tool_chat(spark, cases.table(spark, tmp_path, df.limit(0), "conversations")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")
def test_query_equals_its_sql(spark):
    got = queries.op9_tool_chat(spark, SF_DIR)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_DIR}/conversations.parquet'")
    want = duck.execute(queries.ORACLE_SQL["op9_tool_chat"])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r[n] for n in names) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want.fetchall()))
    assert {r.link for r in got.collect()} == {"linked", "open", "orphan", "repeated", "none"} and {r.valid for r in got.collect()} == {True, False, None}
