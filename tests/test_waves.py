import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from attestor.operators import agent, rules, waves
from attestor.operators.replay import RetryConfig
from attestor.operators.schema import Field, RecordSchema
from attestor.operators.toolcalls import Registry, Tool, guarded
from attestor.sources import client

FAST = RetryConfig(most=2, delays=(0.0,), rate_interval=0.0, rate_limit=5.0)


def failing(*names):
    """A client that raises errors of these classes in turn, then answers."""
    left = list(names)

    def run(prompt):
        if left:
            raise type(left.pop(0), (Exception,), {})("no")
        return prompt + "!"

    return run


def test_a_call_is_tried_again_by_kind_of_error():
    slept = []
    one = lambda *names, config=RetryConfig(): client.call(failing(*names), "a", config, slept.append, lambda: sum(slept))
    assert one() == ("a!", None, None, 0, 0)
    assert one("ReadTimeout", "InternalServerError") == ("a!", None, None, 2, 0) and slept == [1.0, 2.0]
    slept.clear()
    assert one(*["ConnectError"] * 4) == (None, "ConnectError", "no", 3, 0) and slept == [1.0, 2.0, 4.0]
    slept.clear()
    assert one("RateLimitError", "ReadTimeout", "RateLimitError") == ("a!", None, None, 1, 2) and slept == [10.0, 1.0, 10.0]
    slept.clear()
    assert one(*["RateLimitError"] * 99)[1:] == ("RateLimitError", "no", 0, 90) and sum(slept) == 900
    assert one("AuthenticationError")[1:] == ("AuthenticationError", "no", 0, 0) and one("Odd")[1] == "Odd"

    class Mine(type("APITimeoutError", (Exception,), {})):
        pass

    assert client.kind_of(Mine()) == "timeout" and client.kind_of(ValueError()) == "other"


def test_calls_side_by_side_are_bounded(spark):
    def make():
        lock, now = threading.Lock(), [0, 0]

        def run(prompt):
            with lock:
                now[0] += 1
                now[1] = max(now)
            time.sleep(0.02)
            with lock:
                now[0] -= 1
                return str(now[1])

        return run

    df = spark.range(40).select("id", F.lit("p").alias("prompt")).coalesce(1)
    most = [int(r.content) for r in client.asked(df, make, side_by_side=5, config=FAST).collect()]
    assert len(most) == 40 and 1 < max(most) <= 5


def test_replies_are_kept_once(spark, tmp_path):
    script = {"a": ["A"], "b": ["!ReadTimeout", "B"], "c": ["!BadRequestError"], "d": ["!RateLimitError", "!ReadTimeout", "D"]}
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "b", "c", "d", None])] + [(0, "a")], "k int, prompt string")
    store = f"file://{tmp_path}/replies"
    got = client.answered(rows, store, ["k"], client.scripted(script), config=FAST)
    assert sorted((r.k, r.content, r.error_class, r.retries, r.waits) for r in got.collect()) == [(0, "A", None, 0, 0), (0, "A", None, 0, 0), (1, "B", None, 1, 0), (2, None, "BadRequestError", 0, 0), (3, "D", None, 1, 1), (4, None, "RepliesExhausted", 0, 0)]
    assert spark.read.parquet(store).count() == 5
    again = client.answered(rows.union(spark.createDataFrame([(9, "a")], "k int, prompt string")), store, ["k"], client.scripted({"a": ["other"]}), config=FAST)
    assert {r.k: r.content for r in again.collect()} == {0: "A", 1: "B", 2: None, 3: "D", 4: None, 9: "other"}
    assert {r.error_class: (r.replies, r.retries, r.waits) for r in client.counts(spark.read.parquet(store)).collect()} == {None: (4, 2, 1), "BadRequestError": (1, 0, 0), "RepliesExhausted": (1, 0, 0)}


NOTE = RecordSchema("Note", [Field("name"), Field("n", "int", ge=0)])


def turns(*said):
    """A client that gives the k-th turn of its run: the run is told by its first message, the turn by the messages so far."""
    scripts = dict(said)

    def make():
        def run(prompt):
            messages = json.loads(prompt)
            turn = sum(m["role"] == "assistant" for m in messages)
            out = scripts[messages[0]["text"]][turn]
            if isinstance(out, str) and out.startswith("!"):
                raise type(out[1:], (Exception,), {})("down")
            return out if isinstance(out, str) else json.dumps({"content": "", "tool_calls": [{"id": f"{turn}.{k}", "name": n, "args": a if isinstance(a, str) else json.dumps(a)} for k, (n, a) in enumerate(out)]})

        return run

    return make


def test_agents_in_waves(spark, tmp_path):
    first = turns(
        ("plain", [[("Note", {"name": "a", "n": 1})]]),
        ("helped", [[("look", {"q": "x"}), ("nothing", {})], [("Note", {"name": "b", "n": -1}), ("Note", {"name": "b", "n": 2})]]),
        ("second", ["no call", [("Note", {"name": "c"})], [("Note", "broken")]]),
        ("never", [[("Note", {"name": "bad", "n": 5})]] * 3), ("down", ["!AuthenticationError"]), ("mended", [[("Note", {"name": "bad", "n": 7})]] * 3),
    )
    second = turns(("second", [[("look", "[]")], [("Note", {"name": "d", "n": 4})]]), ("never", ["text", "text", "text"]), ("down", ["!ReadTimeout"]), ("mended", [[("Note", {"name": "bad", "n": 8})]] * 3))
    registry = Registry([Tool("look", handler=guarded("look", lambda args: {"found": args["q"]}))])
    tasks = spark.createDataFrame([(k, [("user", t)]) for k, t in enumerate(["plain", "helped", "second", "never", "down", "mended"])], "run_id long, messages array<struct<role:string,text:string>>")
    rule = lambda r: rules.findings(rules.finding(r["name"] == "bad", "not this name", "name"))
    repair = lambda candidate, issues: F.when(candidate.contains("8"), F.lit('{"name": "mended", "n": 0}'))
    store = f"file://{tmp_path}/agents"
    run = lambda *clients: {r.run_id: r for r in waves.run_agents(tasks, list(clients), NOTE, registry, store, most_iterations=4, most_retries=2, rule=rule, repair=repair, config=FAST).collect()}
    got = run(first, second)
    short = lambda r: (r.success, r.salvaged, r.fallback_used, r.iterations, r.validation_retries, r.tool_calls, r.failure_reason)
    assert short(got[0]) == (True, False, False, 1, 0, 0, None) and json.loads(got[0].record) == {"name": "a", "n": 1}
    assert short(got[1]) == (True, False, False, 2, 1, 2, None) and json.loads(got[1].record) == {"name": "b", "n": 2}
    assert [i.error_type for i in got[1].field_issues] == ["greater_than_equal"]
    assert short(got[2]) == (True, False, True, 5, 2, 1, None) and json.loads(got[2].record) == {"name": "d", "n": 4}
    assert short(got[3]) == (False, False, True, 6, 4, 0, "no_tool_call") and json.loads(got[3].candidate)["n"] == 5 and got[3].last_rejection[0].message == "not this name"
    assert short(got[4]) == (False, False, True, 0, 0, 0, "llm_error") and got[4].llm_error_kind == "timeout"
    assert short(got[5]) == (True, True, True, 6, 4, 0, None) and json.loads(got[5].record) == {"name": "mended", "n": 0}
    asked = spark.read.parquet(f"{store}/replies")
    assert asked.count() == asked.dropDuplicates(["run_id", "model_rank", "turn"]).count() == 22
    silent = turns()
    again = run(silent, silent)  # everything is in the store: nothing is asked
    assert {k: short(r) for k, r in again.items()} == {k: short(r) for k, r in got.items()}


def test_replay_of_two_models(spark):
    call = lambda kind, outcome, record, *issues: (kind, outcome, record, [(p, "other", "validator", "m", None, True) for p in issues])
    schema = f"run_id int, model_rank int, turn int, kind string, calls array<struct<kind:string,outcome:string,record:string,issues:{rules.ISSUE}>>, error_class string"
    rows = [
        (1, 0, 0, "calls", [call("final", "rule", "p", "a", "b")], None), (1, 0, 1, "llm_error", [], "ReadTimeout"), (1, 1, 0, "calls", [call("final", "ok", "f")], None),
        (2, 0, 0, "calls", [call("final", "ground", "p", "a")], None), (2, 0, 1, "none", [], None), (3, 0, 0, "calls", [call("helper", None, None), call("final", "ok", "x")], None), (3, 1, 0, "calls", [call("final", "ok", "y", "never")], None),
    ]
    got = {r.run_id: r for r in agent.replay_agents(spark.createDataFrame(rows, schema), most_retries=1).collect()}
    assert (got[1].success, got[1].record, got[1].iterations, got[1].llm_error_kind, [i.field_path for i in got[1].field_issues]) == (True, "f", 2, None, ["a", "b"])
    assert (got[2].failure_reason, got[2].candidate, got[2].fallback_used, got[2].llm_error_kind, [i.field_path for i in got[2].last_rejection]) == ("llm_error", "p", True, "other", ["a"])
    assert (got[3].record, got[3].fallback_used, got[3].tool_calls, got[3].field_issues) == ("x", False, 1, [])
    alone = {r.run_id: r for r in agent.replay_agents(spark.createDataFrame(rows, schema), most_retries=1, fallback=False).collect()}
    assert (alone[1].failure_reason, alone[1].llm_error_kind, alone[1].candidate) == ("llm_error", "timeout", "p")


def test_no_client(spark, tmp_path):
    tasks = spark.createDataFrame([], "run_id long, messages array<struct<role:string,text:string>>")
    with pytest.raises(ValueError, match="needed"):
        waves.run_agents(tasks, [], NOTE, Registry(), f"file://{tmp_path}/none")
