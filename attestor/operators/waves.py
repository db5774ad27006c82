"""Agents that are run: rounds of all open runs together, a model step and a tool step each, with fallback and salvage.

A round asks the model for the next turn of every open run, reads the calls, validates final answers, runs helper tools
and appends what was said to the run's messages. Replies are kept by (run, model, turn) as soon as they are there, so a
job that is started again asks for none twice. There are ``most_iterations`` rounds a model at most, and none once
no run is open. What becomes of a run is worked out from its recorded turns, as ``agent.replay_agents`` does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import once
from attestor.operators import agent, extraction, rules
from attestor.operators.replay import RetryConfig
from attestor.operators.schema import RecordSchema, input_json
from attestor.operators.toolcalls import Registry
from attestor.sources.client import answered
from attestor.sources.state import written

#: What a client gives back for a turn, as JSON; any other text is a turn without calls.
TURN = "content string, tool_calls array<struct<id:string,name:string,args:string>>, invalid_tool_calls array<struct<id:string,name:string,args:string,error:string>>"
_CALL = f"struct<kind:string,outcome:string,record:string,issues:{rules.ISSUE}>"
_SAID = "array<struct<role:string,text:string>>"


def read_turns(replies: DataFrame, schema: RecordSchema, registry: Registry, source: Column | None = None, rule: Callable[[Column], Column] | None = None) -> DataFrame:
    """Turns of ``replies`` (run_id, model_rank, turn, content, error_class and what ``source`` and ``rule`` use): run_id,
    model_rank, turn, kind, calls, error_class as ``agent.replay_agents`` takes them, and ``said``, the messages that the turn
    adds to its run.

    A call named like the schema is a final answer, any other one a helper's. A call's broken arguments, an unknown
    tool and what a handler raises become text that the model is told.
    """
    keys = ["run_id", "model_rank", "turn"]
    rows = once(replies, r_=F.from_json(F.when(F.col("error_class").isNull(), F.col("content")), TURN))
    rows = once(rows, calls_=F.coalesce("r_.tool_calls", F.array()), bad_=F.coalesce("r_.invalid_tool_calls", F.array()))
    kind = F.when(F.col("error_class").isNotNull(), "llm_error").when(F.size("bad_") > 0, "invalid").when(F.size("calls_") > 0, "calls").otherwise("none")
    rows = rows.withColumn("kind", kind)
    each = rows.where("kind = 'calls'").select("*", F.posexplode("calls_").alias("pos_", "call_")).drop("r_", "calls_", "bad_", "kind")
    final = each.where(F.col("call_.name") == schema.name).withColumn("content", F.col("call_.args")).withColumn("attempt", F.col("turn"))
    final = extraction.extracted(final, schema, source=source, rule=rule)
    told = F.coalesce("feedback", F.lit("accepted"))
    final = final.select(*keys, "pos_", "call_", F.struct(F.lit("final").alias("kind"), F.col("outcome"), input_json(F.col("record"), schema).alias("record"), F.col("issues")).cast(_CALL).alias("c"), told.alias("told"))
    helper = each.where(~F.col("call_.name").eqNullSafe(F.lit(schema.name))).withColumn("name_", registry.canonical(F.coalesce("call_.name", F.lit(""))))
    ran = registry.by_name(F.col("name_"), lambda t: None if t.handler is None else t.handler(F.col("call_.args"))).cast("string")
    answer = F.coalesce(registry.unknown(F.col("name_")), ran, F.concat(F.lit("Tool '"), F.col("name_"), F.lit("' gave no result.")))
    helper = helper.select(*keys, "pos_", "call_", F.struct(F.lit("helper").alias("kind"), F.lit(None).alias("outcome"), F.lit(None).alias("record"), F.lit(None).alias("issues")).cast(_CALL).alias("c"), answer.alias("told"))
    sorted_ = F.array_sort(F.collect_list(F.struct("pos_", "c", F.struct(F.lit("tool").alias("role"), F.concat(F.coalesce("call_.id", F.lit("")), F.lit(": "), "told").alias("text")).alias("say"))))
    calls = final.unionByName(helper).groupBy(*keys).agg(sorted_.alias("s_"))
    out = rows.join(calls, keys, "left")
    broken = F.concat(F.lit("The call that was made is broken: "), F.coalesce(F.get("bad_", F.lit(0))["error"], F.lit("unknown")), F.lit(". Call a tool with one JSON object."))
    more = F.when(F.col("kind") == "calls", F.transform("s_", lambda x: x["say"])).when(F.col("kind") == "invalid", F.array(F.struct(F.lit("user").alias("role"), broken.alias("text"))))
    more = more.otherwise(F.array(F.struct(F.lit("user").alias("role"), F.lit(f"Give the answer by a call of the tool {schema.name}.").alias("text"))))
    said = F.concat(F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("content", F.lit("")).alias("text"))).cast(_SAID), more.cast(_SAID))
    none = F.array().cast(f"array<{_CALL}>")
    return out.select(*keys, "kind", F.coalesce(F.transform("s_", lambda x: x["c"]), none).alias("calls"), "error_class", F.when(F.col("kind") != "llm_error", said).otherwise(F.array().cast(_SAID)).alias("said"))


def run_agents(
    tasks: DataFrame, clients: list[Callable[[], Callable[[str], str]]], schema: RecordSchema, registry: Registry, store: str, most_iterations: int = 12, most_retries: int = 3, source: str | None = None,
    rule: Callable[[Column], Column] | None = None, repair: Callable[[Column, Column], Column] | None = None, side_by_side: int = 8, config: RetryConfig = RetryConfig(),
) -> DataFrame:
    """Run ``tasks`` (run_id, messages as array of struct(role, text), and a column of source texts named ``source``) with the
    first client, those that fail with the second, and mend what ``repair`` can of the rest: one row a run, as
    ``agent.replay_agents`` and ``agent.salvaged`` give it.

    A client gets the run's messages as JSON and gives a turn as JSON (see ``TURN``). ``store`` is a folder of the
    shared file system for the replies. Run ids are unique and not null; a run without messages is asked with none.
    """
    extra = [F.col(source).alias("source_")] if source else []
    tasks = written(tasks.select("run_id", F.coalesce(F.col("messages").cast(_SAID), F.array().cast(_SAID)).alias("messages"), *extra), "agent-tasks")
    runs, turns = tasks, None
    for rank, client in enumerate(clients[:2]):
        if rank:
            failed = agent.replay_agents(turns, most_iterations, most_retries, fallback=False).where("not success").select("run_id", "iterations")
            hint = F.concat(F.lit(f"An earlier attempt at {schema.name} gave no valid answer after "), F.col("iterations").cast("string"), F.lit(" turns. Try again with care."))
            runs = tasks.join(failed, "run_id").withColumn("messages", F.concat("messages", F.array(F.struct(F.lit("user").alias("role"), hint.alias("text"))).cast(_SAID))).drop("iterations")
        runs = written(runs.withColumn("s", agent.started()), "agent-runs")
        for turn in range(most_iterations):
            if runs.isEmpty():
                break
            asked = runs.select("run_id", F.lit(rank).alias("model_rank"), F.lit(turn).alias("turn"), F.to_json("messages").alias("prompt"), *(["source_"] if source else []))
            replies = answered(asked, f"{store}/replies", ["run_id", "model_rank", "turn"], client, "prompt", side_by_side, config)
            read = written(read_turns(replies, schema, registry, F.col("source_") if source else None, rule), "agent-turns")
            made = read.drop("said")
            turns = made if turns is None else turns.unionByName(made)
            moved = runs.join(read.select("run_id", F.struct("kind", "calls").alias("t"), "said"), "run_id")
            moved = once(moved, s2=agent.advanced(F.col("s"), F.col("t"), most_iterations, most_retries)).withColumn("messages", F.concat("messages", "said"))
            runs = written(moved.where(~F.col("s2.done")).drop("s", "t", "said").withColumnRenamed("s2", "s"), "agent-runs")
    if turns is None:
        raise ValueError("a client and a turn are needed at least")
    out = agent.replay_agents(turns, most_iterations, most_retries, fallback=len(clients) > 1)
    return agent.salvaged(out, schema, repair) if repair is not None else out.withColumn("salvaged", F.lit(False))
