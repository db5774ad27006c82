import json

import pytest
from pyspark.sql import functions as F

from attestor.operators import states
from attestor.operators.schema import Field, RecordSchema
from attestor.operators.toolcalls import Registry, Tool, guarded

CALL = "struct<id:string,name:string,args:string,error:string>"
MESSAGE = f"struct<role:string,text:string,calls:array<{CALL}>,invalid_calls:array<{CALL}>,call_id:string,at:int>"
BOOK = RecordSchema("Book", [Field("seat", "int")])


@pytest.fixture(scope="module")
def registry():
    return Registry([Tool("book", BOOK, handler=guarded("book", lambda a: f"seat {a['seat']}"), aliases=("reserve",)), Tool("clock", handler=lambda args: F.lit("noon"))])


def message(role, text="", calls=(), bad=(), at=0):
    return (role, text, [(i, n, a, None) for i, n, a in calls], [(i, n, a, "cut") for i, n, a in bad], None, at)


HISTORIES = [
    (1, [message("user", "hi"), message("assistant", "so", [("a", "reserve", '{"seat": 3}'), ("b", "fly", "{}")], [("c", "book", "{'seat': 4")], 7), message("user", "late")]),
    (2, [message("assistant", "done")]), (3, []), (4, None), (5, [message("user", "x")]),
]


def check(before, after):
    assert [m.role for m in after] == [*[m[0] for m in before], "tool", "tool", "tool"] and after[2].text == "late" and after[0].text == "hi"
    assert [(m.call_id, m.text) for m in after[3:]] == [("a", "seat 3"), ("b", "Unknown tool 'fly'. Available tools: book, clock."), ("c", "seat 4")]
    assert [(c.id, json.loads(c.args)) for c in after[1].calls] == [("a", {"seat": 3}), ("b", {}), ("c", {"seat": 4})] and after[1].invalid_calls == [] and after[1].at == 7 and after[1].text == "so"


def test_lists_and_records(spark, registry):
    rows = spark.createDataFrame(HISTORIES, f"k int, state array<{MESSAGE}>")
    got = {r.k: r.state for r in states.run_tools(rows, "k", "state", registry).collect()}
    check(HISTORIES[0][1], got[1])
    assert len(got[2]) == 1 and got[3] == [] and got[4] is None and len(got[5]) == 1
    records = rows.select("k", F.struct(F.col("state").alias("messages"), F.lit("kept").alias("user")).alias("state"))
    got = {r.k: r.state for r in states.run_tools(records, "k", "state", registry).collect()}
    check(HISTORIES[0][1], got[1].messages)
    assert {s.user for s in got.values()} == {"kept"} and got[4].messages is None
    named = records.select("k", F.struct(F.col("state.messages").alias("history")).alias("state"))
    assert len(states.run_tools(named, "k", "state", registry, key="history").where("k = 1").first().state.history) == 6


def test_bare_calls(spark, registry):
    rows = spark.createDataFrame([(1, [("a", "reserve", '{"seat": 2}'), ("b", "clock", None)]), (2, [])], "k int, state array<struct<id:string,name:string,args:string>>")
    got = {r.k: r.state for r in states.run_tools(rows, "k", "state", registry).collect()}
    assert [tuple(a) for a in got[1]] == [("a", "seat 2", "success"), ("b", "noon", "success")] and got[2] == []
    one = rows.where("k = 1").select("k", F.get("state", F.lit(0)).alias("state"))
    assert [tuple(a) for a in states.run_tools(one, "k", "state", registry).first().state] == [("a", "seat 2", "success")]


def test_other_types_are_errors_at_once(spark, registry):
    for kind in ("string", "struct<other:int>", "array<int>", "struct<messages:string>"):
        with pytest.raises(TypeError, match="a state is"):
            states.run_tools(spark.createDataFrame([], f"k int, state {kind}"), "k", "state", registry)
