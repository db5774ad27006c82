"""The tool node on states: whatever holds the messages, the last assistant message's calls are run and answered in place.

A state is a list of messages, a record with a list of messages among its fields, or bare calls that were taken out of
their message already. Messages are structs with role, text, calls and invalid_calls (see ``toolcalls.split_calls``) and
whatever else; what isn't touched stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from attestor.operators import toolcalls
from attestor.operators.toolcalls import Registry
from attestor.sources.state import written

_CALLS = "array<struct<id:string,name:string,args:string,error:string>>"


def shape(kind: DataType, key: str = "messages") -> str:
    """list, record or calls, by the type of a state column; an error for any other type."""
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        names = set(kind.elementType.names)
        if {"role", "calls"} <= names:
            return "list"
        if {"id", "name", "args"} <= names:
            return "calls"
    if isinstance(kind, StructType):
        if key in kind.names:
            if shape(kind[key].dataType, key) == "list":
                return "record"
        elif {"id", "name", "args"} <= set(kind.names):
            return "calls"
    raise TypeError(f"a state is a list of messages, a record with {key}, or calls; this one is {kind.simpleString()}")


def messages_of(state: Column, kind: DataType, key: str = "messages") -> Column:
    """The messages of a state that isn't bare calls."""
    return state[key] if shape(kind, key) == "record" else state


def with_messages(state: Column, kind: DataType, messages: Column, key: str = "messages") -> Column:
    """The state with other messages; its other fields stay."""
    return state.withField(key, messages) if shape(kind, key) == "record" else messages


def last_assistant(messages: Column) -> Column:
    """Place of the last assistant message, wherever in the list it stands; null if there is none."""
    return F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)))


def run_tools(states: DataFrame, id_col: str, state_col: str, registry: Registry, key: str = "messages", **node) -> DataFrame:
    """``states`` with the answers to the calls of each state's last assistant message behind its messages, as messages of
    the role tool (``call_id``, if messages have it, says of which call), and that message in step with what was repaired,
    corrected or dropped. ``node`` goes to ``toolcalls.tool_node``.

    A state of bare calls is run as it is, without repair or checks, and becomes an array of struct(id, content, status). A
    state without messages, assistant or calls stays; ids are unique and not null. A state whose calls are to ``raise``
    fails the query.
    """
    kind = states.schema[state_col].dataType
    how = shape(kind, key)
    if how == "calls":
        calls = F.col(state_col) if isinstance(kind, ArrayType) else F.array(state_col)
        each = states.select(F.col(id_col).alias("conv_id"), F.posexplode(calls).alias("turn", "c")).select("conv_id", "turn", "c.id", registry.canonical(F.col("c.name")).alias("name"), "c.args", F.lit("executed").alias("outcome"))
        ran = toolcalls.executed(each, registry).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "content", "status"))).alias("r"))
        ran = ran.select(F.col("conv_id").alias(id_col), F.transform("r", lambda x: x.dropFields("turn")).alias("answers_"))
        out = states.join(ran, id_col, "left").withColumn(state_col, F.coalesce("answers_", F.array().cast(ran.schema["answers_"].dataType)))
        return out.drop("answers_")
    messages = messages_of(F.col(state_col), kind, key)
    element = (kind[key].dataType if how == "record" else kind).elementType
    at = last_assistant(messages)
    said = F.get(messages, at)
    own = [F.coalesce(said[n].cast(_CALLS), F.array().cast(_CALLS)).alias(n) if n in element.names else F.array().cast(_CALLS).alias(n) for n in ("calls", "invalid_calls")]
    flat = states.select(F.col(id_col).alias("conv_id"), at.alias("turn"), *own).where("turn is not null and size(calls) + size(invalid_calls) > 0")
    resolved = written(toolcalls.tool_node(flat, registry, **node), "tool-node")
    answers = toolcalls.answers(resolved, toolcalls.executed(resolved, registry).drop("status"))
    answers = answers.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "content"))).alias("answers_"))
    kept = toolcalls.sanitized(resolved).select("conv_id", F.col("turn").alias("at_"), F.col("calls").alias("calls_"), "changed")
    rows = states.join(kept.withColumnRenamed("conv_id", id_col), id_col, "left").join(answers.withColumnRenamed("conv_id", id_col), id_col, "left")

    def told(a: Column) -> Column:
        made = {"role": F.lit("tool"), "text": a["content"], "call_id": a["id"]}
        return F.struct(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in element.fields])

    def swapped(m: Column) -> Column:
        m = m.withField("calls", F.transform("calls_", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["args"].alias("args"), F.lit(None).cast("string").alias("error"))).cast(element["calls"].dataType))
        return m.withField("invalid_calls", F.array().cast(element["invalid_calls"].dataType)) if "invalid_calls" in element.names else m

    stepped = F.when(F.coalesce("changed", F.lit(False)), F.transform(messages, lambda m, i: F.when(i == F.col("at_"), swapped(m)).otherwise(m))).otherwise(messages)
    new = F.concat(stepped, F.coalesce(F.transform("answers_", told), F.array().cast(ArrayType(element))))
    return rows.withColumn(state_col, F.when(F.col("answers_").isNull() & F.col("changed").isNull(), F.col(state_col)).otherwise(with_messages(F.col(state_col), kind, new, key))).drop("at_", "calls_", "changed", "answers_")
