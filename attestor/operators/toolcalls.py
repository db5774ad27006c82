"""Tool calls of assistant messages: plan, validate, correct, resolve, execute, answer and regroup, a row for each call.

``messages``: conv_id, turn, calls and invalid_calls, arrays of struct(id, name, args, error). ``tools``: name,
fields (array of argument names; null: not validated here). Calls are independent; every id gets one answer.
``tool_node`` puts the steps together for a registry of tools.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.replies import repair_args, unwrap_array, with_parsed
from attestor.functions.text import once
from attestor.operators import rules
from attestor.operators.schema import RecordSchema, error_text, input_json, validate

POLICIES = ("feedback", "drop", "raise")
_ERROR = "struct<field_path:string,category:string,error_type:string,message:string,received:string,rejecting:boolean>"


@dataclass
class Tool:
    """``schema`` of the arguments (None: they aren't validated here; ``injected`` ones aren't the model's to give).
    ``handler`` gets the arguments as JSON text and gives the result's text. ``validator`` gets the record and the phase
    (initial, correction or salvage) and gives findings. ``aliases`` are other names that mean this tool."""

    name: str
    schema: RecordSchema | None = None
    description: str = ""
    handler: Callable[[Column], Column] | None = None
    validator: Callable[[Column, str], Column] | None = None
    aliases: tuple = ()
    injected: tuple = ()

    def own_schema(self) -> RecordSchema | None:
        """The schema without injected arguments."""
        if self.schema is None or not self.injected:
            return self.schema
        return RecordSchema(self.schema.name, [f for f in self.schema.fields if f.name not in self.injected], self.schema.before, self.schema.rules, self.schema.computed)


@dataclass
class Registry:
    """Tools by name."""

    tools: list[Tool] = field(default_factory=list)

    def __post_init__(self):
        names = [n for t in self.tools for n in (t.name, *t.aliases)]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"more than one tool is called {', '.join(twice)}")

    def canonical(self, name: Column) -> Column:
        """A tool's own name for any name of it; an unknown name stays."""
        out = name
        for t in self.tools:
            if t.aliases:
                out = F.when(name.isin(*t.aliases), F.lit(t.name)).otherwise(out)
        return out

    def by_name(self, name: Column, make: Callable[[Tool], Column | None]) -> Column:
        """What ``make`` gives for the tool of a name; null where it gives None or no tool is known."""
        out = F.when(F.lit(False), F.lit(None))
        for t in self.tools:
            if (c := make(t)) is not None:
                out = out.when(name == t.name, c)
        return out

    def fields(self, name: Column) -> Column:
        return self.by_name(name, lambda t: None if t.schema is None else F.array(*[F.lit(k) for k in t.own_schema().known_keys()])).cast("array<string>")

    def unknown(self, name: Column) -> Column:
        """What to answer to a name that no tool has, else null."""
        names = [t.name for t in self.tools]
        return F.when(~self.canonical(name).isin(*names), F.concat(F.lit("Unknown tool '"), name, F.lit(f"'. Available tools: {', '.join(names)}.")))


def split_calls(messages: DataFrame, use_repair: bool = True) -> DataFrame:
    """Explode valid calls, then invalid ones; repair the arguments of those that have a name and an id.

    Adds raw (as received), answerable (has an id), missing_name, repaired and recoverable. Only what needs repair goes
    through Python, in one pass over the messages.
    """
    call = lambda bad: lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["args"].alias("args"), c["error"].alias("error"), F.lit(bad).alias("from_invalid"))
    rows = messages.select("conv_id", "turn", F.posexplode(F.concat(F.transform("calls", call(False)), F.transform("invalid_calls", call(True)))).alias("pos", "c")).select("conv_id", "turn", "pos", "c.*")
    rows = rows.withColumn("id", F.nullif("id", F.lit(""))).withColumn("name", F.nullif("name", F.lit(""))).withColumn("raw", F.col("args"))
    able = F.col("from_invalid") & F.col("name").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("mended_", repair_args(F.when(able, F.col("args")), use_repair)).withColumn("args", F.when(able, F.col("mended_")).otherwise(F.col("args"))).drop("mended_")
    rows = rows.withColumn("repaired", able & F.col("args").isNotNull()).withColumn("answerable", F.col("id").isNotNull())
    rows = rows.withColumn("missing_name", F.col("from_invalid") & F.col("answerable") & F.col("name").isNull())
    return rows.withColumn("recoverable", F.col("answerable") & (~F.col("from_invalid") | F.col("repaired")))


def plan_calls(messages: DataFrame, tools: DataFrame, validated: Column | None = None, use_repair: bool = True) -> DataFrame:
    """``split_calls`` with a table of tools: adds prevalidated (the tool has fields) and executable. ``validated`` is a
    column over args and fields that says whether the arguments are accepted; by default every listed field must be
    there. The tools table joins on its name; Spark broadcasts it while it is small.
    """
    out = split_calls(messages, use_repair)
    out = out.join(tools.select("name", "fields"), "name", "left").withColumn("prevalidated", F.col("recoverable") & F.col("fields").isNotNull())
    keys = F.coalesce(F.json_object_keys("args"), F.array().cast("array<string>"))
    fits = validated if validated is not None else F.size(F.array_except("fields", keys)) == 0
    return out.withColumn("executable", F.col("recoverable") & (F.col("fields").isNull() | F.coalesce(fits, F.lit(False))))


def correctable(correct_missing: bool = False, enabled: bool = True) -> Column:
    """Whether a call is worth a model's correction: not if fields are merely missing, unless unknown keys are there."""
    keys = F.coalesce(F.json_object_keys("args"), F.array().cast("array<string>"))
    unknown, lacking = F.size(F.array_except(keys, F.col("fields"))) > 0, F.size(F.array_except(F.col("fields"), keys)) > 0
    worth = ~F.col("recoverable") | F.lit(correct_missing) | ~lacking | unknown
    return F.lit(enabled) & ~F.col("executable") & F.col("answerable") & ~F.col("missing_name") & F.col("fields").isNotNull() & F.coalesce(worth, F.lit(False))


def resolve(plans: DataFrame, policy: str = "feedback") -> DataFrame:
    """Adds outcome (executed, corrected, salvaged, feedback, dropped) and the answer to each call that isn't executed.

    ``raise`` fails the query on the first call that can't be executed.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in plans.columns else F.lit(False)
    done = F.when(flag("salvaged"), "salvaged").when(flag("corrected"), "corrected").otherwise("executed")
    rest = {"feedback": F.when(F.col("answerable"), F.lit("feedback")).otherwise(F.lit("dropped")), "drop": F.lit("dropped"), "raise": F.raise_error(F.lit("a tool call can't be executed")).cast("string")}[policy]
    out = plans.withColumn("outcome", F.when(F.col("executable"), done).otherwise(rest))
    return out.withColumn("feedback", F.when(F.col("outcome") == "feedback", feedback("error_text" in plans.columns)))


def feedback(explained: bool = False) -> Column:
    """The answer to a call that isn't executed: it has no name, its arguments can't be read, or they aren't accepted;
    ``explained`` if the plans say why in error_text."""
    raw = F.left(F.coalesce("raw", F.lit("")), F.lit(500))
    error = F.coalesce("error", F.lit("malformed tool call"))
    nameless = F.concat(F.lit("The call has no tool name and was not executed.\nError: "), error, F.lit("\nArguments received:\n"), raw, F.lit("\nCall again with a tool's name."))
    broken = F.concat(F.lit("The arguments for '"), F.col("name"), F.lit("' could not be read as one JSON object; the call was not executed.\nError: "), error, F.lit("\nArguments received:\n"), raw, F.coalesce(F.concat(F.lit("\nExpected: "), F.array_join("fields", ", ")), F.lit("")))
    lacking = F.concat(F.lit("Missing: "), F.array_join(F.array_except("fields", F.coalesce(F.json_object_keys("args"), F.array().cast("array<string>"))), ", "))
    why = F.coalesce("error_text", lacking) if explained else lacking
    reason = F.when(F.coalesce("rejected_by_validator", F.lit(False)), "were rejected").otherwise("don't fit its schema") if explained else F.lit("don't fit its schema")
    invalid = F.concat(F.lit("The arguments for '"), F.col("name"), F.lit("' "), reason, F.lit("; the call was not executed.\n"), why)
    return F.when(F.col("missing_name"), nameless).when(~F.col("recoverable"), broken).otherwise(invalid)


def checked(plans: DataFrame, registry: Registry, phase: str = "initial", args: str = "args") -> DataFrame:
    """Adds, for each call whose tool has a schema: issues (as ``rules.ISSUE``, of schema and validator), error_text,
    rejected_by_validator, and stored_args, the accepted arguments as they are kept (null: not accepted)."""
    read = registry.by_name(F.col("name"), lambda t: None if t.schema is None else _checked_by(t, F.col(args), phase))
    made = read.cast(f"struct<issues:array<{_ERROR}>,error_text:string,rejected_by_validator:boolean,stored_args:string>")
    rows = once(plans.drop("issues", "error_text", "rejected_by_validator", "stored_args"), made_=F.when(F.col("recoverable"), made))
    return rows.select(*[c for c in rows.columns if c != "made_"], "made_.*")


def _checked_by(tool: Tool, args: Column, phase: str) -> Column:
    schema = tool.own_schema()

    def judged(v: Column) -> Column:
        own = F.transform(v["issues"], lambda i: F.struct(i["field_path"].alias("field_path"), i["category"].alias("category"), i["error_type"].alias("error_type"), i["message"].alias("message"), i["received"].alias("received"), F.lit(True).alias("rejecting"))).cast(rules.ISSUE)
        found = tool.validator(v["record"], phase) if tool.validator is not None else rules.findings()
        rejected = v["record"].isNotNull() & F.exists(found, lambda i: i["rejecting"])
        text = F.when(v["record"].isNull(), F.coalesce(error_text(v["issues"], schema), F.lit("The arguments are not a JSON object."))).when(rejected, rules.feedback(F.filter(found, lambda i: i["rejecting"])))
        return F.struct(F.when(v["record"].isNull(), own).otherwise(found).alias("issues"), text.alias("error_text"), rejected.alias("rejected_by_validator"), F.when(v["record"].isNotNull() & ~rejected, input_json(v["record"], schema)).alias("stored_args"))

    return F.get(F.transform(F.array(validate(args, schema)), judged), F.lit(0))


def correction_prompt(name: Column, description: Column, arguments: Column, error: Column, conversation: Column) -> Column:
    """What a correcting model is asked; parts that are null or empty are left out."""
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(title + "\n"), c))
    return F.concat_ws(
        "\n\n", F.concat(F.lit("A call of the tool '"), name, F.lit("' is not valid.")), part("What the tool does:", description), part("The arguments of the call:", arguments),
        part("What is wrong with them:", error), part("The conversation before it:", conversation), F.lit("Give the arguments anew. Keep what was meant, change only what the schema asks for, and take no value that is neither in the arguments nor in the conversation."),
    )


def corrections(plans: DataFrame, registry: Registry, conversations: DataFrame | None = None) -> DataFrame:
    """The correctable calls with the prompt that asks for their correction: conv_id, turn, id, name, prompt.

    ``conversations`` (conv_id, turn, context) is what ``messages.context_before`` gives."""
    rows = plans.where("correctable")
    if conversations is not None:
        rows = rows.join(conversations.select("conv_id", "turn", "context"), ["conv_id", "turn"], "left")
    context = F.col("context") if conversations is not None else F.lit(None).cast("string")
    told = registry.by_name(F.col("name"), lambda t: F.lit(t.description)).cast("string")
    return rows.select("conv_id", "turn", "id", "name", correction_prompt(F.col("name"), told, F.coalesce("raw", "args"), F.col("error_text"), context).alias("prompt"))


def corrected(plans: DataFrame, replies: DataFrame, registry: Registry, most: int = 3) -> DataFrame:
    """Takes a model's corrections into the plans: ``replies`` are conv_id, turn, id, attempt (from 0), content.

    Of a correctable call's replies, the first among ``most`` that its tool's schema and validator accept replaces its
    arguments. Adds corrected, correction_attempted and correction_retries; a call whose replies all fail stays as it was.
    """
    asked = plans.where("correctable").select("conv_id", "turn", "id", "name")
    rows = with_parsed(asked.join(replies.where(F.col("attempt") < most), ["conv_id", "turn", "id"]), F.coalesce("content", F.lit("")))
    opened = registry.by_name(F.col("name"), lambda t: None if t.schema is None else unwrap_array(F.col("parsed.json"), t.own_schema().known_keys(), t.own_schema().sole_list_field())["json"]).cast("string")
    rows = once(rows, new_=opened).withColumn("recoverable", F.col("new_").isNotNull())
    rows = checked(rows, registry, "correction", "new_")
    won = F.when(F.col("stored_args").isNotNull(), F.col("attempt"))
    best = rows.groupBy("conv_id", "turn", "id").agg(F.min(won).alias("won"), F.max("attempt").alias("last"), F.min_by("stored_args", won).alias("new_args"))
    out = plans.join(best, ["conv_id", "turn", "id"], "left")
    done = F.col("new_args").isNotNull()
    return out.withColumns({
        "corrected": done, "correction_attempted": F.col("correctable"), "correction_retries": F.when(done, F.col("won")).otherwise(F.coalesce(F.col("last") + 1, F.lit(0))).cast("int"),
        "args": F.when(done, F.col("new_args")).otherwise(F.col("args")), "stored_args": F.when(done, F.col("new_args")).otherwise(F.col("stored_args")),
        "executable": F.col("executable") | done, "recoverable": F.col("recoverable") | done, "prevalidated": F.col("prevalidated") | done,
    }).drop("won", "last", "new_args")


def salvaged(plans: DataFrame, registry: Registry, hook: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Asks ``hook`` (name, raw arguments, error text) for other arguments (JSON text; null: none) for each answerable call
    that still can't be executed; those that schema and validator accept make it executable and mark it salvaged."""
    still = ~F.col("executable") & F.col("answerable") & ~F.col("missing_name")
    rows = once(plans, hooked_=F.when(still, hook(F.col("name"), F.coalesce("raw", "args"), F.col("error_text"))).cast("string"))
    tried = checked(rows.withColumn("was_", F.struct("issues", "error_text", "rejected_by_validator", "stored_args", "recoverable")).withColumn("recoverable", F.col("hooked_").isNotNull()), registry, "salvage", "hooked_")
    done = F.col("stored_args").isNotNull()
    out = tried.withColumn("salvaged", done).withColumn("args", F.when(done, F.col("hooked_")).otherwise(F.col("args")))
    for c in ("issues", "error_text", "rejected_by_validator", "stored_args"):
        out = out.withColumn(c, F.when(F.col("salvaged"), F.col(c)).otherwise(F.col(f"was_.{c}")))
    out = out.withColumn("recoverable", F.col("salvaged") | F.col("was_.recoverable")).withColumn("prevalidated", F.col("prevalidated") | F.col("salvaged"))
    return out.withColumn("executable", F.col("executable") | F.col("salvaged")).drop("hooked_", "was_")


def executed(resolved: DataFrame, registry: Registry) -> DataFrame:
    """Results of the calls to be executed: conv_id, turn, id, content, status. A name that no tool has is answered with
    the tools there are. A handler is a column function; ``guarded`` makes one of a Python function."""
    rows = resolved.where(F.col("outcome").isin("executed", "corrected", "salvaged"))
    ran = registry.by_name(F.col("name"), lambda t: None if t.handler is None else t.handler(F.col("args"))).cast("string")
    unknown = registry.unknown(F.col("name"))
    content = F.coalesce(unknown, ran, F.concat(F.lit("Tool '"), F.col("name"), F.lit("' gave no result.")))
    bad = unknown.isNotNull() | F.coalesce(ran.startswith("Tool '") & ran.contains("' raised an error: "), F.lit(False))
    return rows.select("conv_id", "turn", "id", content.alias("content"), F.when(bad, "error").otherwise("success").alias("status"))


def guarded(name: str, run: Callable[[dict], object]) -> Callable[[Column], Column]:
    """A handler of a Python function of the arguments: what it gives becomes text (JSON unless it is text), and what it
    raises, and arguments that aren't an object, become text too, so that no call breaks the query."""

    def handler(args: Column) -> Column:
        def one(text: str | None) -> str | None:
            try:
                given = json.loads(text or "null")
            except ValueError:
                given = text
            if not isinstance(given, dict):
                return f"Invalid arguments for tool '{name}': expected a JSON object, got {type(given).__name__}."
            try:
                out = run(given)
            except Exception as e:  # a handler may raise anything
                return f"Tool '{name}' raised an error: {e}"
            return out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str)

        @F.pandas_udf("string")
        def each(texts: pd.Series) -> pd.Series:
            return texts.map(one)

        return each(args)

    return handler


def tool_node(messages: DataFrame, registry: Registry, replies: DataFrame | None = None, policy: str = "feedback", hook: Callable[[Column, Column, Column], Column] | None = None, correct_missing: bool = False, use_repair: bool = True) -> DataFrame:
    """All steps for each call of ``messages``: plan, validate, correct by ``replies``, salvage by ``hook``, resolve.

    The result, kept by the caller if it is used more than once, goes to ``executed``, ``answers``, ``sanitized`` and
    ``call_stats``.
    """
    plans = split_calls(messages, use_repair)
    plans = plans.withColumn("name", registry.canonical(F.col("name"))).withColumn("fields", registry.fields(F.col("name")))
    plans = checked(plans.withColumn("prevalidated", F.col("recoverable") & F.col("fields").isNotNull()), registry)
    plans = plans.withColumn("executable", F.col("recoverable") & (F.col("fields").isNull() | F.col("stored_args").isNotNull()))
    lacking = F.exists(F.coalesce("issues", F.array().cast(rules.ISSUE)), lambda i: i["category"] == "missing")
    unknown = F.size(F.array_except(F.coalesce(F.json_object_keys("args"), F.array().cast("array<string>")), F.col("fields"))) > 0
    worth = ~F.col("recoverable") | F.coalesce("rejected_by_validator", F.lit(False)) | F.lit(correct_missing) | ~lacking | unknown
    plans = plans.withColumn("correctable", F.lit(replies is not None) & ~F.col("executable") & F.col("answerable") & ~F.col("missing_name") & F.col("fields").isNotNull() & F.coalesce(worth, F.lit(False)))
    if replies is not None:
        plans = corrected(plans, replies, registry)
    if hook is not None:
        plans = salvaged(plans, registry, hook)
    return resolve(plans, policy)


def sanitized(resolved: DataFrame) -> DataFrame:
    """Per message: the calls that stay in its history, in order, with the arguments that are stored, and whether anything
    changed: a call is gone, or its arguments are others than those received."""
    kept = F.col("answerable") & (F.col("outcome") != "dropped")
    stored = F.coalesce("stored_args", "args") if "stored_args" in resolved.columns else F.col("args")
    other = F.col("repaired") | F.coalesce(F.col("outcome").isin("corrected", "salvaged"), F.lit(False))
    used = F.when(other, stored).otherwise(F.col("args"))
    return resolved.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "id", "name", used.alias("args"))))).alias("calls"), F.max(~kept | other).alias("changed"))


def rewritten(blocks: Column, calls: Column) -> Column:
    """Content blocks (struct with type, id, name, input) of a message in step with its sanitized calls: blocks of calls
    that are gone go, the others get the stored name and arguments; other blocks stay."""
    of = lambda b: F.get(F.filter(calls, lambda c: c["id"] == b["id"]), F.lit(0))
    is_call = lambda b: F.coalesce(b["type"].isin("tool_use", "tool_call", "function_call"), F.lit(False))
    stay = F.filter(blocks, lambda b: ~is_call(b) | of(b).isNotNull())
    return F.transform(stay, lambda b: F.when(is_call(b), b.withField("name", of(b)["name"]).withField("input", of(b)["args"])).otherwise(b))


def substituted(messages: Column, turn: Column, message: Column) -> Column:
    """An array of messages with the one of this turn replaced."""
    return F.transform(messages, lambda m: F.when(m["turn"] == turn, message).otherwise(m))


def answers(resolved: DataFrame, results: DataFrame) -> DataFrame:
    """Messages in the order of the calls: results (conv_id, turn, id, content) and feedback, one for each id. Results of
    ids that no call has come behind them, in their own order (a column seq, if there is one)."""
    fed = resolved.where("outcome = 'feedback'").select("conv_id", "turn", "id", "pos", F.col("feedback").alias("content"))
    ran = resolved.where("outcome in ('executed', 'corrected', 'salvaged')").select("conv_id", "turn", "id", "pos")
    own = ran.join(results, ["conv_id", "turn", "id"]).select("conv_id", "turn", "id", "pos", "content")
    seq = F.col("seq") if "seq" in results.columns else F.lit(0)
    other = results.join(resolved.select("conv_id", "turn", "id"), ["conv_id", "turn", "id"], "left_anti").select("conv_id", "turn", "id", (F.lit(1 << 20) + seq).cast("int").alias("pos"), "content")
    return fed.unionByName(own).unionByName(other)


def call_stats(resolved: DataFrame, *keys: str) -> DataFrame:
    """Counts of calls by outcome, and of repaired and validated ones."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(f"{o}_calls")
    return resolved.groupBy(*keys).agg(F.count("*").alias("calls"), *[count(o) for o in ("executed", "corrected", "salvaged", "feedback", "dropped")], F.count_if("repaired").alias("repaired_calls"), F.count_if("prevalidated").alias("prevalidated_calls"))
