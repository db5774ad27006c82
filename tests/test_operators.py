import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import scalars, text
from attestor.operators import agent, analytics, extraction, grounding, replay, rules, scoring, toolcalls
from attestor.operators.schema import Field, RecordSchema, completed, error_text, exactly_one, input_json, needed_if, revalidated, validate
from attestor.sources import messages
from attestor.streaming import quality


def check(spark, make, cases):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
    got = {r.i: r.r.value for r in df.select("i", make(F.col("v")).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_scalar_types(spark):
    check(spark, scalars.iso_date, [("1999-12-31", "1999-12-31"), ("2096-02-29", "2096-02-29"), ("2100-02-29", None), ("1999-6-1", None), ("1999-00-10", None), ("0000-06-01", None), (" 1999-12-31", None), ("", None), (None, None), ("1999-12-31\n", None)])
    # made here: the check digits are worked out for these account numbers
    check(spark, scalars.iban, [("NO93 8601 1117 947", "NO9386011117947"), ("no938601\t1117947", "NO9386011117947"), ("NO94 8601 1117 947", None), ("N093", None), ("NO", None), (None, None), ("NO93" + "7" * 31, None)])
    check(spark, scalars.vat_id, [("se 5560-360.793", "SE5560360793"), ("nl12", "NL12"), ("n l", None), ("S1234", None), ("SE12\t34", None), (None, None)])
    check(spark, scalars.isin, [("AU0000XVGZA3", "AU0000XVGZA3"), ("au 0000 xvgza3", "AU0000XVGZA3"), ("AU0000XVGZA4", None), ("AU0000", None), (None, None)])
    check(spark, scalars.phone, [("+47 22 00 11 22", "+4722001122"), ("0046.8/123-456", "+468123456"), ("+358(9)1", "+35891"), ("22 00 11", None), ("+0 47", None), ("+" + "4" * 16, None), ("", None)])
    check(spark, lambda c: scalars.country(c, scalars.country_codes(spark)), [("\tno\n", "NO"), (" SE", "SE"), ("SU", None), ("Norway", None), (None, None)])
    check(spark, scalars.currency, [("\tnok\n", "NOK"), ("UYW", "UYW"), ("ZWG", "ZWG"), ("DEM", None), ("ATS", None), ("BEF", None), ("kr", None)])
    check(spark, lambda c: scalars.language(c, scalars.language_codes(spark)), [(" NB ", "nb"), ("he", "he"), ("iw", None), ("in", None), ("ji", None), ("mo", None), ("norsk", None)])
    check(spark, scalars.rrule, [("FREQ=MONTHLY;BYMONTHDAY=-1", "FREQ=MONTHLY;BYMONTHDAY=-1"), ("FREQ=YEARLY;COUNT=4", "FREQ=YEARLY;COUNT=4"), ("on Mondays", None), ("FREQ=SOMETIMES", None), ("FREQ=DAILY;INTERVAL=two", None), ("BYDAY=SU", None), (None, None)])
    assert len(set(scalars.CURRENCIES)) == 172 and len(scalars.language_codes(spark)) == 184 and len(scalars.country_codes(spark)) == 249


LINE = RecordSchema("Line", [Field("name"), Field("n", "int", ge=1)])
ORDER = RecordSchema("Order", [Field("id", "int"), Field("ok", "bool", required=False), Field("lines", LINE, many=True), Field("by", LINE, keyed=True, required=False), Field("tag", "str", required=False, nullable=True, choices=()), Field("state", choices=("open", "done"), required=False)])


def issues(spark, doc, schema=ORDER):
    r = spark.createDataFrame([(doc,)], "d string").select(validate(F.col("d"), schema).alias("v"), error_text(validate(F.col("d"), schema)["issues"], schema).alias("t")).first()
    return r.v, r.t


def test_validation(spark):
    v, t = issues(spark, '{"id": "1_000", "ok": "Yes", "lines": [{"name": "a", "n": 2.0}], "by": {"x": {"name": "q", "n": true}}, "tag": null}')
    assert v.issues == [] and t is None and v.record.id == 1000 and v.record.ok is True and v.record.lines[0].n == 2 and v.record.by["x"].name == "q"
    v, t = issues(spark, '{"id": "5.5", "ok": "maybe", "lines": [{"name": 5, "n": 0}, {"n": "x"}, 7], "by": {"k": {"name": "a"}}, "state": "Open"}')
    assert v.record is None
    assert [(i.field_path, i.error_type, i.category) for i in v.issues] == [
        ("id", "int_parsing", "type"), ("ok", "bool_parsing", "type"), ("lines -> 0 -> name", "string_type", "type"), ("lines -> 0 -> n", "greater_than_equal", "value"),
        ("lines -> 1 -> name", "missing", "missing"), ("lines -> 1 -> n", "int_parsing", "type"), ("lines -> 2", "model_type", "type"), ("by -> k -> n", "missing", "missing"), ("state", "literal_error", "enum"),
    ]
    assert [i.received for i in v.issues][2] == "5" and "MISSING" in t and "OTHER" in t and "lines -> 1 -> name" in t
    assert [i.error_type for i in issues(spark, '{"id": 5.5, "lines": 3}')[0].issues] == ["int_from_float", "list_type"]
    assert issues(spark, "not json")[0] is None and issues(spark, "[1]")[0].issues[0].error_type == "model_type"


def test_schema_documents():
    s = ORDER.json_schema()
    assert s["required"] == ["id", "lines"] and s["properties"]["state"]["enum"] == ["open", "done"] and ORDER.strict_problem()
    assert LINE.strict_problem() is None and LINE.json_schema(True)["additionalProperties"] is False and LINE.tool(strict=True)["function"]["strict"]
    assert LINE.listed().sole_list_field() == "items" and ORDER.sole_list_field() is None


def test_schema_hooks(spark):
    place = RecordSchema("Place", [Field("street"), Field("zip", "int")], before=lambda t: F.when(t.contains(", "), F.to_json(F.struct(F.substring_index(t, ", ", 1).alias("street"), F.substring_index(t, ", ", -1).alias("zip")))))
    deal = RecordSchema("Deal", [
        Field("total", "float", before=lambda t: F.regexp_replace(t, "[^0-9.-]", "")), Field("state", choices=("open", "done"), synonyms={"finished": "done"}), Field("who", after=(F.trim, F.upper)),
        Field("mail", required=False, checks=((lambda v: v.contains("@"), "no address"),)), Field("home", place, required=False), Field("n", "int", paths=("$.meta.n",), default=3, required=False),
        Field("opened", "date", required=False), Field("closed", "date", required=False), Field("stops", place, many=True, required=False), Field("phone", required=False),
    ], rules=((lambda r: r["opened"] > r["closed"], "closed before it was opened"), needed_if(lambda r: r["state"] == "done", "closed", "a done deal has a day")), computed=(("twice", lambda r: F.round(r["total"] * 2, 2)),))

    def run(doc, schema=deal):
        df = spark.createDataFrame([(doc,)], "d string").select(validate(F.col("d"), schema).alias("v"))
        return df.select("v", completed(F.col("v.record"), schema).alias("c"), input_json(F.col("v.record"), schema).alias("j"), revalidated(F.col("v.record"), schema)["issues"].alias("again"), error_text(F.col("v.issues"), schema).alias("t")).first()

    r = run('{"total": "EUR 1,250.50", "state": "Finished", "who": " ann ", "home": "Quay, 123", "meta": {"n": "7"}, "opened": "2031-01-02", "closed": "2031-01-03", "stops": ["a, 1", {"street": "b", "zip": 2}]}')
    assert r.v.issues == [] and (r.c.total, r.c.state, r.c.who, r.c.n, r.c.twice) == (1250.5, "done", "ANN", 7, 2501.0) and (r.c.home.zip, [s.street for s in r.c.stops]) == (123, ["a", "b"])
    assert r.again == [] and json.loads(r.j)["opened"] == "2031-01-02" and "mail" not in json.loads(r.j) and "twice" not in json.loads(r.j)
    found = lambda doc, schema=deal: [(i.field_path, i.error_type, i.category) for i in run(doc, schema).v.issues]
    assert found('{"total": 1, "state": "done", "who": "x"}') == [("", "value_error", "value")]
    assert found('{"total": 1, "state": "open", "who": "x", "opened": "2031-02-02", "closed": "2031-02-01"}') == [("", "value_error", "value")]
    assert found('{"total": "", "state": "gone", "who": 1, "mail": "x", "home": "nowhere", "opened": "2031-02-30", "closed": 5}') == [
        ("total", "float_parsing", "type"), ("state", "literal_error", "enum"), ("who", "string_type", "type"), ("mail", "value_error", "value"), ("home", "model_type", "type"), ("opened", "date_from_datetime_parsing", "type"), ("closed", "date_type", "type"),
    ]
    text = run('{"total": "", "state": "gone", "who": 1}').t
    assert "expected: float" in text and "expected: string" in text and "1. Give each" in text and "2. Choose" in text and "…" in text
    either = RecordSchema("Either", [Field("a", required=False), Field("b", required=False)], rules=(exactly_one("a", "b"),))
    assert [len(found(d, either)) for d in ('{"a": "x"}', "{}", '{"a": "x", "b": "y"}')] == [0, 1, 1]
    assert run('{"total": 1, "state": "open", "who": "x"}').c.n == 3 and deal.json_schema()["properties"]["n"]["default"] == 3 and "default" not in deal.json_schema(True)["properties"]["n"]


def simulate(attempts, budgets, fallback):
    """A loop over one run's attempts: what the window query must agree with."""
    out = {"success": False, "primary_retries": 0, "fallback_retries": 0, "format_errors": 0, "failure_reason": None, "candidate": None}
    for rank in (0, 1) if fallback else (0,):
        mine = [a for a in attempts if a[0] == rank]
        for _, n, outcome, record in mine[: budgets[rank]]:
            if outcome == "ok":
                return out | {"success": True, "failure_reason": None, "candidate": None}
            out["failure_reason"] = {"parse": "parse_error", "crash": "parse_error", "llm_error": "llm_error"}.get(outcome, "validation_exhausted")
            if outcome in ("ground", "rule"):
                out["candidate"] = record
            if outcome in ("llm_error", "crash"):
                break
            out["primary_retries" if rank == 0 else "fallback_retries"] += 1
            out["format_errors"] += outcome == "parse"
    return out


@pytest.mark.parametrize("fallback", [True, False])
def test_replay_matches_a_loop(spark, fallback):
    rng, rows, want = random.Random(fallback), [], {}
    for run in range(120):
        mine = [(r, n, rng.choice(["ok", "parse", "schema", "ground", "rule", "llm_error", "crash", "schema"]), f"{run}-{r}-{n}") for r in (0, 1) for n in range(rng.randint(1, 4))]
        rows += [(run, *a, None) for a in mine]
        want[run] = simulate(mine, (3, 2), fallback)
    rows.append((500, 0, 9, "ok", "x", None))
    a = spark.createDataFrame(rows, "run_id int, model_rank int, attempt int, outcome string, record string, error_kind string")
    got = {r.run_id: r for r in replay.replay(a, a.select("run_id").distinct(), 3, 2, fallback).collect()}
    assert all({k: got[run][k] for k in w} == w for run, w in want.items()) and not got[500].success and got[500].attempts_made == 0


def test_error_kinds_levels_and_network(spark):
    df = spark.createDataFrame([("RateLimitError", 0), ("ReadTimeout", 1), ("Odd", 5), (None, 2), ("RemoteProtocolError", 0), ("NetworkError", 0), ("ModelRateLimitError", 0), ("ModelTimeoutError", 0), ("ModelAPIError", 0), ("ContextOverflowError", 0)], "c string, a int").coalesce(1)
    got = df.select(replay.error_kind(F.col("c")), replay.effort(["low", "mid"], F.col("a"))).collect()
    assert [tuple(r) for r in got][:4] == [("rate_limit", "low"), ("timeout", "mid"), ("other", "mid"), (None, "mid")]
    assert [r[0] for r in got][4:] == ["connection", "connection", "rate_limit", "timeout", "server_error", "context_overflow"]
    net = spark.createDataFrame([(["timeout", "rate_limit", "timeout"],), (["timeout"] * 4,), (["other"],), (["rate_limit"] * 91,), ([],)], "e array<string>").coalesce(1)
    run = lambda config: [(r[0].retries, r[0].waited, r[0].gave_up) for r in net.select(replay.network_retry(F.col("e"), config)).collect()]
    assert run(replay.RetryConfig()) == [(2, 13.0, False), (3, 7.0, True), (0, 0.0, True), (0, 900.0, True), (0, 0.0, False)]
    assert run(replay.RetryConfig(most=2, delays=(), rate_interval=2.0, rate_limit=4.0)) == [(2, 4.0, False), (2, 2.0, True), (0, 0.0, True), (0, 4.0, True), (0, 0.0, False)]


def turns(spark, rows):
    return spark.createDataFrame(rows, "run_id int, turn int, kind string, calls array<struct<kind:string,outcome:string,record:string>>")


def test_agent_runs(spark):
    final, helper = lambda o, r="r": ("final", o, r), ("helper", None, None)
    rows = [
        (1, 0, "calls", [helper, helper]), (1, 1, "calls", [final("rule", "a"), final("ok", "b"), final("ok", "c")]), (1, 2, "calls", [helper]),
        *[(2, t, "calls", [final("schema")]) for t in range(6)],
        (3, 0, "none", []), (3, 1, "invalid", []), (3, 2, "recovered", [final("ok", "z")]),
        (4, 0, "calls", [helper]), (4, 1, "llm_error", []), (4, 2, "calls", [final("ok")]),
        *[(5, t, "calls", [helper]) for t in range(20)],
        *[(6, t, "none", []) for t in range(3)], (6, 3, "calls", [final("ground", "k"), helper, final("ok", "v")]),
    ]
    got = {r.run_id: r for r in agent.replay_agent(turns(spark, rows)).collect()}
    assert got[1].success and got[1].record == "c" and got[1].iterations == 2 and got[1].tool_calls == 2 and got[1].validation_retries == 1
    assert not got[2].success and got[2].iterations == 4 and got[2].validation_retries == 3 and got[2].failure_reason == "validation_exhausted"
    assert got[3].success and got[3].record == "z" and got[3].format_errors == 2 and got[3].validation_retries == 2
    assert got[4].failure_reason == "llm_error" and got[4].iterations == 1
    assert got[5].iterations == 12 and got[5].failure_reason == "validation_exhausted" and got[5].tool_calls == 12
    assert got[6].success and got[6].record == "v" and got[6].tool_calls == 1
    js = agent.replay_agent(turns(spark, [(1, 0, "none", [final("parse")]), (1, 1, "none", [final("ok", "q")]), (2, 0, "none", [final("rule", "c")])]), json_mode=True)
    got = {r.run_id: r for r in js.collect()}
    assert got[1].record == "q" and got[1].format_errors == 1 and got[2].candidate == "c" and not got[2].success


def test_tool_calls(spark):
    c = lambda i, n, a: (i, n, a, "bad")
    data = [(1, 0, [c("a", "t", '{"k":1}'), c(None, "t", '{"k":1}'), c("b", "free", "{}"), c("m", "t", '{"z":1}')], [c("d", "t", "<think>x</think>{'k': 2}"), c("e", "t", "[1]"), c("f", None, "{}"), c("", "t", "{}")])]
    msgs = spark.createDataFrame(data, "conv_id int, turn int, calls array<struct<id:string,name:string,args:string,error:string>>, invalid_calls array<struct<id:string,name:string,args:string,error:string>>")
    tools = spark.createDataFrame([("t", ["k"]), ("free", None)], "name string, fields array<string>")
    plans = toolcalls.plan_calls(msgs, tools).withColumn("fix", toolcalls.correctable())
    resolved = toolcalls.resolve(plans)
    got = {(r.id or f"none{r.pos}"): (r.outcome, r.repaired, r.fix) for r in resolved.collect()}
    assert got == {"a": ("executed", False, False), "none1": ("dropped", False, False), "b": ("executed", False, False), "m": ("feedback", False, True), "d": ("executed", True, False), "e": ("feedback", False, True), "f": ("feedback", False, False), "none7": ("dropped", False, False)}
    results = resolved.where("outcome = 'executed'").select("conv_id", "turn", "id", F.lit("ok").alias("content"))
    assert [r.id for r in toolcalls.answers(resolved, results).orderBy("pos").collect()] == ["a", "b", "m", "d", "e", "f"]
    s = toolcalls.sanitized(resolved).first()
    assert s.changed and [x.id for x in s.calls] == ["a", "b", "m", "d", "e", "f"]
    with pytest.raises(Exception, match="can't be executed"):
        toolcalls.resolve(plans, "raise").collect()


def test_grounding_forms(spark):
    r = spark.range(1).select(
        grounding.number_forms(F.lit("8642.5").cast("decimal(10,1)"), F.lit("8642.5"), "de").alias("p"), grounding.number_forms(F.lit("-8642.5").cast("decimal(10,1)"), F.lit("-8642.5"), "de").alias("n"),
        grounding.render_candidates(F.lit(9), "int").alias("w"), grounding.render_candidates(F.lit(datetime.date(2031, 8, 2)), "date").alias("d"), grounding.render_candidates(F.lit(True), "bool").alias("b"), grounding.render_candidates(F.lit("2.5"), "str").alias("s"),
        grounding.render_candidates(F.lit(0.1234567), "float").alias("f"), grounding.render_candidates(F.lit("2031-08-02"), "str").alias("t"), grounding.render_candidates(F.lit(1234.0), "float", F.lit("FR")).alias("h"),
    ).first()
    assert {"8.642,5", "8642,5", "8.642,50", "8,642.50", "8 642,5", "8642", "8'642.50"} <= set(r.p) and {"-8.642,50", "(8.642,50)", "8.642,5-"} <= set(r.n)
    assert {"9", "9.00", "9,00", "nine", "neun", "neuf"} <= set(r.w) and {"2031-08-02", "02.08.2031", "2. August 2031", "August 2, 2031", "2 août 2031", "8/2/2031"} <= set(r.d) and {"True", "yes", "ja", "✓"} <= set(r.b) and {"2.5", "2,50", "2"} <= set(r.s)
    assert {"0.1234567", "0,1234567", "0.12"} <= set(r.f) and "02.08.2031" in r.t and r.h[:3] == ["1234.0", "1234,0", "1 234,0"]


def test_grounded_modes(spark):
    df = spark.createDataFrame([("Nils  HOLM", "bei nils Holm gesehen"), ("Ærø", "AERO"), ("Ångby", "angby"), (None, "x"), ("x", None), ("zz", "yy"), ("", "yy")], "v string, t string").coalesce(1)
    run = lambda g: [r[0] for r in df.select(g.holds(F.col("v"), F.col("t"))).collect()]
    assert run(grounding.Grounded()) == [True, False, True, True, True, False, True]
    assert run(grounding.Grounded("exact")) == [False, False, False, True, True, False, True]
    assert run(grounding.Grounded("fuzzy")) == [True, False, True, True, True, False, False]


def test_fuzzy_agrees_with_a_search_cell_by_cell(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcé ") for _ in range(rng.randint(1, 6))), "".join(rng.choice("abce ") for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    fold = lambda t: " ".join(t.replace("é", "e").split())

    def near(needle, hay):
        row = [0] * (len(hay) + 1)
        for i, ch in enumerate(needle, 1):
            new = [i]
            for j, other in enumerate(hay, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (ch != other)))
            row = new
        return bool(needle) and 1 - min(row) / len(needle) >= 0.7

    got = spark.createDataFrame(rows, "v string, t string").coalesce(1).select(grounding.Grounded("fuzzy", threshold=0.7).holds(F.col("v"), F.col("t"))).collect()
    assert [r[0] for r in got] == [near(fold(v), fold(t)) for v, t in rows]


CREW = RecordSchema("Crew", [Field("name", grounded=grounding.Grounded()), Field("pay", "float", required=False, grounded=grounding.Grounded(locale="de"))])
VOYAGE = RecordSchema("Voyage", [
    Field("tons", "float", grounded=grounding.Grounded(locale_field="land")), Field("land", required=False), Field("sailed", "date", required=False, grounded=grounding.Grounded(on_mismatch="flag")),
    Field("pilot", required=False, grounded=grounding.Grounded("fuzzy", source="log")), Field("insured", "bool", required=False, grounded=grounding.Grounded()), Field("crew", CREW, many=True, required=False),
    Field("by_deck", CREW, keyed=True, required=False), Field("captain", CREW, required=False), Field("mark", required=False, grounded=grounding.FieldCheck(lambda v, t: F.length(v) < 3, "is long")),
])


def test_records_are_walked(spark):
    doc = '{"tons": 2750.5, "land": "DE", "sailed": "2031-03-04", "pilot": "Ingrid Mohlin", "insured": true, "crew": [{"name": "Åke", "pay": 3.25}, {"name": "Bo"}], "by_deck": {"aft": {"name": "Größe"}}, "captain": {"name": "Cleo"}, "mark": "abcd"}'
    text = "2.750,50 t am 3. April 2031, ja; AKE zu 3,25; CLEO; grosse"
    rows = [(1, doc, text, "from ingrid molin"), (2, '{"tons": 9}', "neun", None), (3, '{"tons": 9}', None, None), (4, '{"tons": 9}', "", None), (5, '{"tons": "x"}', "y", None)]
    df = spark.createDataFrame(rows, "k int, d string, t string, log string").withColumn("record", validate(F.col("d"), VOYAGE)["record"])
    got = {r.k: r.grounding for r in grounding.grounded(df, VOYAGE, "record", F.col("t"), {"log": F.col("log")}).collect()}
    assert [(i.field_path, i.rejecting, i.error_type) for i in got[1]] == [("sailed", False, "grounding"), ("crew -> 1 -> name", True, "grounding"), ("mark", True, "grounding")]
    assert got[1][1].received == "Bo" and "'Bo' is not in the source text" == got[1][1].message and got[2] == got[3] == got[5] == [] and [i.field_path for i in got[4]] == ["tons"]
    other = grounding.grounded(df, VOYAGE, "record", F.col("t"), {"log": F.col("log"), "default": F.lit("")}).where("k = 2").first().grounding
    assert [i.field_path for i in other] == ["tons"]
    with pytest.raises(ValueError, match="log"):
        grounding.grounded(df, VOYAGE, "record", F.col("t"))


def test_rules(spark):
    df = spark.createDataFrame([([5, 50, 7],)], "items array<int>")
    found = rules.item_rules(F.col("items"), lambda x: rules.findings(rules.finding(x > 40, "large"), rules.finding(x < 6, "small", "n", reject=False)))
    r = df.select(found.alias("f"), rules.kept_items(F.col("items"), found).alias("k"), rules.feedback(found).alias("t"), rules.item_index(F.lit("items -> 3 -> a")).alias("a"), rules.item_index(F.lit("itemsx")).alias("b")).first()
    assert [x.field_path for x in r.f] == ["items -> 0 -> n", "items -> 1"] and r.k == [5, 7] and r.a == 3 and r.b is None and "items -> 1:\n- large" in r.t
    ground = rules.findings(rules.finding(F.lit(False), "g"))
    c = df.select(rules.check_candidate(ground, rules.findings(rules.finding(F.lit(True), "alone"), rules.finding(F.lit(True), "note", "q", reject=False))).alias("c")).first().c
    assert not c.accepted and c.stage == "rules" and c.feedback == "alone" and len(c.issues) == 2


PET = RecordSchema("Pet", [Field("name", grounded=grounding.Grounded()), Field("age", "int", ge=0)])


def replies_table(spark, rows):
    return spark.createDataFrame(rows, "run_id int, model_rank int, attempt int, content string, error_class string, source string")


def test_extraction_end_to_end(spark):
    rows = [
        (1, 0, 0, '{"name": "Rex", "age": "old"}', None, "Rex is 4"), (1, 0, 1, 'Sure: {"name": "Rex", "age": 4}', None, "Rex is 4"),
        (2, 0, 0, "none", None, "Tom is 3"), (2, 0, 1, '{"name": "Tim", "age": 3}', None, "Tom is 3"), (2, 0, 2, '{"name": "Tom", "age": 99}', None, "Tom is 3"), (2, 1, 0, None, "ReadTimeout", "Tom is 3"),
        (3, 0, 0, '[{"name": "A", "age": 1}, {"name": "B", "age": 2}]', None, "A B"), (4, 0, 0, '[{"name": "A", "age": 1}]', None, None), (5, 0, 0, None, None, "x"),
    ]
    e = extraction.extracted(replies_table(spark, rows), PET, source=F.col("source"), rule=lambda r: rules.findings(rules.finding(r["age"] > 50, "too old", "age")))
    got = {(r.run_id, r.model_rank, r.attempt): r for r in e.collect()}
    assert {k: r.outcome for k, r in got.items()} == {(1, 0, 0): "schema", (1, 0, 1): "ok", (2, 0, 0): "parse", (2, 0, 1): "ground", (2, 0, 2): "rule", (2, 1, 0): "llm_error", (3, 0, 0): "parse", (4, 0, 0): "ok", (5, 0, 0): "parse"}
    assert got[2, 1, 0].error_kind == "timeout" and "2 separate" in got[3, 0, 0].feedback and "too old" in got[2, 0, 2].feedback and "TYPE ERRORS" in got[1, 0, 0].feedback and got[1, 0, 1].feedback is None and got[2, 0, 1].record.name == "Tim"
    done = extraction.runs(e, e.select("run_id").distinct(), PET, capture=F.col("source"))
    saved = {r.run_id: r for r in extraction.salvaged(done, PET, lambda c, i: F.when(F.col("run_id") == 2, F.regexp_replace(c, "99", "49"))).collect()}
    assert saved[1].success and saved[1].record.age == 4 and [(i.field_path, i.attempt) for i in saved[1].field_issues] == [("age", 0)] and saved[1].source_text == "Rex is 4"
    assert saved[2].success and saved[2].salvaged and saved[2].record.age == 49 and saved[2].failure_reason is None and [i.message for i in saved[2].last_rejection] == ["too old"] and saved[2].format_errors == 1
    assert not saved[3].success and saved[3].failure_reason == "parse_error" and saved[3].schema_name == "Pet" and saved[3].item_count is None
    broken = {r.run_id: r for r in extraction.salvaged(done, PET, lambda c, i: F.lit('{"name": 1}')).collect()}
    assert not broken[2].success and broken[2].field_issues[-1].field_path == rules.EXHAUSTED_PATH


def test_extraction_by_tools(spark):
    call = lambda args: ("1", "Pet", args, "cut off")
    rows = [(1, [call('{"name": "a", "age": 1}'), call("{}")], []), (2, [], [call('<think>hm</think>{"name": "b", "age": 2}')]), (3, [], [call('{"name":')]), (4, [], []), (5, [call('{"name": "c", "age": 1}')], [call("{")]), (6, None, None), (7, [], [call("<think>x</think>[1]")])]
    df = spark.createDataFrame([(k, 0, 0, None, c, i) for k, c, i in rows], f"run_id int, model_rank int, attempt int, error_class string, tool_calls {extraction.CALLS}, invalid_tool_calls {extraction.CALLS}")
    got = {r.run_id: r for r in extraction.extracted(df, PET, mode="tools").collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "ok", 2: "ok", 3: "parse", 4: "parse", 5: "parse", 6: "parse", 7: "parse"}
    assert "cut off" in got[3].feedback and "broken" not in got[4].feedback and got[1].record.name == "a"
    with pytest.raises(ValueError):
        extraction.extracted(df, PET, mode="xml")


def test_lists_of_records(spark):
    herd = PET.listed()
    rows = [(1, 0, k, '[{"name": "a", "age": 1}, {"name": "b", "age": 60}, {"name": "c", "age": 3}]', None, None) for k in range(3)] + [(2, 0, 0, '{"items": [{"name": "d", "age": 4}]}', None, None), (3, 0, 0, "[]", None, None)]
    e = extraction.extracted(replies_table(spark, rows), herd, rule=lambda r: rules.item_rules(r["items"], lambda x: rules.findings(rules.finding(x["age"] > 50, "too old", "age"))))
    done = extraction.runs(e, e.select("run_id").distinct(), herd)
    assert {r.run_id: (r.success, r.item_count) for r in done.collect()} == {1: (False, None), 2: (True, 1), 3: (True, 0)}
    saved = extraction.salvaged(done, herd, lambda c, i: extraction.list_salvage(c, i, herd))
    got = sorted((r["run_id"], r["index"], r["item"].name if r["item"] else None) for r in extraction.items(saved, PET).collect())
    assert got == [(1, 0, "a"), (1, 1, "c"), (2, 0, "d"), (3, None, None)]
    assert "JSON Schema of PetList" in extraction.json_prompt(herd)


def test_recorded_and_live_replies(spark):
    asked = spark.createDataFrame([(1, 0, 0, "p"), (2, 0, 0, "q")], "run_id int, model_rank int, attempt int, prompt string")
    table = spark.createDataFrame([(1, 0, 0, "{}", None)], "run_id int, model_rank int, attempt int, content string, error_class string")
    assert {r.run_id: r.error_class for r in messages.recorded(asked, table).collect()} == {1: None, 2: "RepliesExhausted"}
    assert sorted(r.content for r in messages.live(asked, lambda prompts: [p.upper() for p in prompts]).collect()) == ["P", "Q"]
    docs = spark.createDataFrame([(7, "Rex is 4")], "doc_id int, body string")
    m = messages.text_messages(docs, "doc_id", "body").select("conv_id", messages.source_text(F.col("messages")).alias("s")).first()
    assert (m.conv_id, m.s) == (7, "Rex is 4")


def test_blocks_images_and_context(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG1")
    images = messages.image_blocks(spark, str(tmp_path / "*.png"))
    assert images.first().url == "data:image/png;base64,iVBORzE="
    seen = messages.with_images(spark.createDataFrame([(1, "t")], "conv_id int, text string"), images.withColumn("conv_id", F.lit(1))).first()
    assert seen.blocks[0].type == "image_url"
    df = spark.sql("select array(named_struct('type', cast(null as string), 'text', 'a'), named_struct('type', 'image', 'text', 'no'), named_struct('type', 'text', 'text', 'b'), named_struct('type', 'text', 'text', '')) b")
    assert df.select(messages.block_text(df.b)).first()[0] == "a\nb"
    conv = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u" * 9), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "now"), (1, 5, "user", "later"), (2, 0, "assistant", "")], "conv_id int, turn int, role string, text string")
    at = spark.createDataFrame([(1, 4), (2, 0)], "conv_id int, turn int")
    got = {r.conv_id: r.context for r in messages.context_before(conv, at, 3, 5).collect()}
    assert got == {1: "[user] uuuu…\n[assistant] a\n[user] v\n[assistant] now", 2: None}
    assert messages.context_before(conv, at, 0).first().context is None


def test_tool_node(spark):
    book = RecordSchema("Book", [Field("seat", "int", ge=1), Field("row"), Field("user")])
    registry = toolcalls.Registry([
        toolcalls.Tool("book", book, "Books a seat.", toolcalls.guarded("book", lambda a: {"done": 10 // (int(a["seat"]) - 4)}), lambda r, phase: rules.findings(rules.finding(r["row"] == "Z", f"no row Z ({phase})", "row")), ("reserve",), ("user",)),
        toolcalls.Tool("clock", None, "Tells the time.", lambda args: F.lit("noon")),
    ])
    c = lambda i, n, a: (i, n, a, "bad")
    data = [(1, 0, [c("a", "book", '{"seat": 2, "row": "B"}'), c("b", "reserve", '{"seat": 4, "row": "C"}'), c("d", "clock", "{}"), c("e", "fly", "{}"), c("f", "book", '{"seat": 0, "row": "A"}'), c("g", "book", '{"seat": 3}'), c("h", "book", '{"seat": 3, "line": "D"}'), c("i", "book", '{"seat": 5, "row": "Z"}')],
             [c("j", "book", "{'seat': '6', 'row': 'F'"), c("k", "book", "[1]"), c("l", None, "{}"), c(None, "book", "{}")])]
    kind = "array<struct<id:string,name:string,args:string,error:string>>"
    msgs = spark.createDataFrame(data, f"conv_id int, turn int, calls {kind}, invalid_calls {kind}")
    fixes = spark.createDataFrame([(1, 0, "f", 0, '{"seat": 0, "row": "A"}'), (1, 0, "f", 1, '{"seat": 1, "row": "A"}'), (1, 0, "h", 0, "no"), (1, 0, "k", 0, '{"seat": 7, "row": "K"}'), (1, 0, "g", 0, '{"seat": 3, "row": "G"}'), (1, 0, "i", 0, '{"seat": 5, "row": "Z"}')], "conv_id int, turn int, id string, attempt int, content string")
    hook = lambda name, raw, error: F.when(raw.contains("line"), F.regexp_replace(raw, "line", "row")).when(error.contains("no row Z"), F.lit('{"seat": 5, "row": "Z"}'))
    resolved = toolcalls.tool_node(msgs, registry, fixes, hook=hook)
    got = {r.id: r for r in resolved.where("id is not null").collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "executed", "b": "executed", "d": "executed", "e": "executed", "f": "corrected", "g": "feedback", "h": "salvaged", "i": "feedback", "j": "executed", "k": "corrected", "l": "feedback"}
    assert got["f"].correction_retries == 1 and got["h"].correction_retries == 1 and not got["g"].correction_attempted and got["j"].repaired and json.loads(got["f"].args) == {"seat": 1, "row": "A"} and got["b"].name == "book"
    assert "row: Field required" in got["g"].feedback and "were rejected" in got["i"].feedback and "no row Z" in got["i"].feedback and "no tool name" in got["l"].feedback
    ran = {r.id: (r.content, r.status) for r in toolcalls.executed(resolved, registry).collect()}
    assert ran["a"] == ('{"done": -5}', "success") and ran["d"] == ("noon", "success") and ran["e"] == ("Unknown tool 'fly'. Available tools: book, clock.", "error") and ran["b"][0].startswith("Tool 'book' raised an error: ") and ran["b"][1] == "error"
    extra = spark.createDataFrame([(1, 0, "zz", "late")], "conv_id int, turn int, id string, content string")
    order = [r.id for r in toolcalls.answers(resolved, toolcalls.executed(resolved, registry).drop("status").unionByName(extra)).orderBy("pos").collect()]
    assert order == ["a", "b", "d", "e", "f", "g", "h", "i", "j", "k", "l", "zz"]
    stats = toolcalls.call_stats(resolved).first()
    assert (stats.calls, stats.executed_calls, stats.corrected_calls, stats.salvaged_calls, stats.feedback_calls, stats.dropped_calls) == (12, 5, 2, 1, 3, 1)
    s = toolcalls.sanitized(resolved).first()
    assert s.changed and [x.id for x in s.calls] == list("abdefghijkl") and json.loads(s.calls[8].args) == {"seat": 6, "row": "F"}
    blocks = spark.sql("select array(named_struct('type', 'text', 'id', cast(null as string), 'name', cast(null as string), 'input', 'hello'), named_struct('type', 'tool_use', 'id', 'j', 'name', 'reserve', 'input', 'old'), named_struct('type', 'tool_use', 'id', 'gone', 'name', 'x', 'input', 'y')) b")
    kept = blocks.crossJoin(toolcalls.sanitized(resolved)).select(toolcalls.rewritten(F.col("b"), F.col("calls"))).first()[0]
    assert [x.id for x in kept] == [None, "j"] and json.loads(kept[1].input)["seat"] == 6
    plain = toolcalls.tool_node(msgs, registry)
    assert {r.id: r.outcome for r in plain.collect()}["f"] == "feedback" and not plain.where("correctable").count()
    asked = toolcalls.corrections(toolcalls.tool_node(msgs, registry, fixes.limit(0)), registry, spark.createDataFrame([(1, 0, "[user] a seat")], "conv_id int, turn int, context string"))
    prompts = {r.id: r.prompt for r in asked.collect()}
    assert set(prompts) == {"f", "h", "i", "k"} and "Books a seat." in prompts["f"] and "[user] a seat" in prompts["f"] and "greater than or equal" in prompts["f"]
    with pytest.raises(ValueError, match="book"):
        toolcalls.Registry([toolcalls.Tool("book"), toolcalls.Tool("x", aliases=("book",))])
    bad = spark.createDataFrame([("[1]",), ('{"seat": 1}',)], "a string").coalesce(1)
    assert [r[0] for r in bad.select(toolcalls.guarded("t", lambda a: "ok")(F.col("a"))).collect()] == ["Invalid arguments for tool 't': expected a JSON object, got list.", "ok"]
    swapped = spark.sql("select array(named_struct('turn', 0, 'text', 'a'), named_struct('turn', 1, 'text', 'b')) m").select(toolcalls.substituted(F.col("m"), F.lit(1), F.struct(F.lit(1).alias("turn"), F.lit("z").alias("text")))).first()[0]
    assert [x.text for x in swapped] == ["a", "z"]


def test_checks_by_kind(spark):
    df = spark.sql("select 4.5 as n, ' Big Ship' as t, true as b, array('Oslo', 'Bergen') as l, array(map('o', 'Ann', 'd', 'mon')) as m, cast(null as string) as z")
    cases = [("n", scoring.AtLeast(4), (1, 1)), ("n", scoring.Between(5, 6), (0, 1)), ("t", "bigship", (1, 1)), ("t", "ship", (0, 1)), ("b", True, (1, 1)), ("l", ["oslo", "Rome"], (1, 2)), ("l", 2, (1, 1)), ("n", 4.5000001, (1, 1)), ("m", [{"o": "ann", "d": "tue"}], (2, 3)), ("z", "x", (0, 1)), ("l", [], (0, 0))]
    got = df.select(*[scoring.check_field(F.col(c), e, c == "l").alias(f"c{k}") for k, (c, e, _) in enumerate(cases)]).first()
    assert [tuple(x) for x in got] == [w for *_, w in cases] and [scoring.field_total(e) for _, e, _ in cases] == [w[1] for *_, w in cases]
    record = F.struct("n", "t", "l")
    whole = df.select(scoring.record_accuracy(record, F.lit(True), {"n": scoring.AtLeast(4), "t": "x", "l": 2}, ("l",)), scoring.record_accuracy(record, F.lit(False), {"n": scoring.AtLeast(4)}), scoring.record_accuracy(record, F.lit(True), {})).first()
    assert [tuple(x) for x in whole] == [(2, 3), (0, 1), (0, 0)]
    cells = spark.createDataFrame([("a|b\n c",), (None,), ("x" * 70,)], "v string").coalesce(1).select(scoring.cell(F.col("v"))).collect()
    assert [r[0] for r in cells] == ["a\\|b c", "—", "x" * 59 + "…"] and scoring.expected_cell([scoring.AtLeast(2), {"a": None}]) == "≥ 2; a=—" and scoring.expected_cell(scoring.Between(1, 2.5)) == "1 to 2.5"


def test_reports_keep_pipes(spark):
    schema = "run_id int, schema_name string, success boolean, salvaged boolean, field_issues array<struct<field_path:string,category:string,error_type:string,attempt:int,received:string>>"
    rows = [(1, "S", True, True, [("a|b", "type", "late", 0, "x|y"), ("a|b", "type", "early", 0, "p\nq")]), (2, "S", False, False, [("c", "value", "v", 1, None)]), (3, "T", True, False, [])]
    runs = spark.createDataFrame(rows, schema)
    issues = analytics.issue_rows(runs)
    tops = analytics.dominant(issues, "category", "schema_name", "field_path").join(analytics.dominant(issues, "error_type", "schema_name", "field_path"), ["schema_name", "field_path"])
    schemas, fields = analytics.schema_summary(runs), analytics.field_summary(runs)
    text = analytics.report(analytics.markdown(schemas, fields, tops, analytics.field_samples(runs))).first().report
    assert text.startswith("# Field issue report\n\n## S — 50% success (1/2 runs failed, 1 salvaged)\n\n| Field |") and text.endswith("## T — 100% success (0/1 runs failed)\n\n_No field issues recorded._\n")
    assert "| a\\|b | type | early | 2 | 0 | 0% | `x\\|y`, `p q` |" in text and "| c | value | v | 1 | 1 | 0% |  |" in text
    none = analytics.markdown(schemas.limit(0), fields.limit(0), tops.limit(0), analytics.field_samples(runs).limit(0))
    assert analytics.report(none).first().report == "# Field issue report\n\n_No field issues recorded._"
    lines = [r.line for r in analytics.console_summary(schemas, fields, analytics.first_seen_error(issues)).orderBy("schema_name", "line_no").collect()]
    assert lines[0] == "  S: 50% success (1/2 runs failed)" and "top_error=late" in lines[1] + lines[2] and len(lines) == 3
    results = runs.withColumn("model", F.concat(F.lit("m"), F.col("run_id").cast("string"))).withColumn("group", F.lit("g")).withColumn("scenario", F.col("schema_name"))
    assert {r.scenario: (r.total, r.successes, r.failed_models) for r in analytics.group_summary(results).collect()} == {"S": (2, 1, "m2"), "T": (1, 1, "")}
    assert analytics.results_to_runs(results).where("salvaged").count() == 0


def test_sinks(spark, tmp_path):
    schemas = spark.createDataFrame([("S", 2, 1)], "schema_name string, total_runs int, failed_runs int")
    fields = spark.createDataFrame([("S", "a", 11), ("S", "b", 31)], "schema_name string, field_path string, severity int")
    results = spark.createDataFrame([("S", "m", True)], "schema_name string, model string, success boolean")
    messages.write_benchmark(results, fields, schemas, str(tmp_path / "bench"))
    (r,) = spark.read.json(str(tmp_path / "bench")).collect()
    assert [f.field_path for f in r.field_problems] == ["b", "a"] and r.results[0].model == "m" and r.total_runs == 2
    messages.write_results(results, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 1
    with pytest.raises(ValueError):
        messages.benchmark_grid(schemas, fields, most_rows=1)


def test_scopes_and_listeners(spark):
    runs = spark.createDataFrame([(1, True, "secret")], "run_id int, success boolean, candidate string")
    with quality.StatsSink() as outer:
        quality.StatsSink.record(runs)
        with quality.StatsSink() as inner:
            quality.StatsSink.record(runs)
    quality.StatsSink.record(runs)
    assert outer.runs().count() == 2 and inner.runs().count() == 1 and outer.runs().columns == ["run_id", "success"] and quality.StatsSink().runs() is None
    seen, listeners = [], quality.Listeners()
    away = listeners.add(lambda df, n: seen.append((n, df.columns)))
    listeners.add(lambda df, n: 1 / 0)
    listeners.add(lambda df, n: seen.append((n, df.columns)), capture=("candidate",))
    listeners(runs, 5)
    away(), away()
    listeners(runs, 6)
    assert seen == [(5, ["run_id", "success"]), (5, ["run_id", "success", "candidate"]), (6, ["run_id", "success", "candidate"])]


def test_analytics(spark):
    issue = lambda p, a, v: (p, "type", "int_parsing", a, v)
    schema = "run_id int, schema_name string, success boolean, salvaged boolean, field_issues array<struct<field_path:string,category:string,error_type:string,attempt:int,received:string>>"
    runs = spark.createDataFrame([(1, "S", True, False, [issue("a", 0, "1"), issue("a", 1, "1")]), (2, "S", True, True, [issue("a", 1, "2")]), (3, "S", False, False, [issue("a", 0, None), issue("b", 2, "9")]), (4, "S", True, False, [])], schema)
    bare = spark.createDataFrame([("S", "a", "type", "x", 3, v) for v in "3456789"] + [("T", "z", "type", "x", 1, None)], "schema_name string, field_path string, category string, error_type string, attempt int, received string")
    got = {(r.schema_name, r.field_path): r for r in analytics.field_summary(runs, bare).collect()}
    a = got["S", "a"]
    assert (a.total_occurrences, a.runs_with_problem, a.failed_runs_with_problem, a.salvaged_runs_with_problem, a.occurrences_on_successful_runs, a.severity) == (11, 3, 1, 1, 2, 31)
    assert a.recovery_rate == pytest.approx(1 / 3) and a.first_error_attempt_avg == pytest.approx((0 + 1 + 0 + 7 * 3) / 10) and got["T", "z"].recovery_rate == 0 and got["T", "z"].runs_with_problem == 0
    s = {r.schema_name: r for r in analytics.schema_summary(runs, bare).collect()}
    assert (s["S"].total_runs, s["S"].success_rate, s["S"].clean_success_rate, s["T"].success_rate) == (4, 0.75, 0.5, 0.0)
    samples = {(r.schema_name, r.field_path): r.samples for r in analytics.field_samples(runs, bare).collect()}
    assert samples == {("S", "a"): ["1", "2", "3", "4", "5"], ("S", "b"): ["9"]}
    order = analytics.ranked_schemas(analytics.schema_summary(runs, bare), analytics.field_summary(runs, bare)).orderBy("place").collect()
    assert [r.schema_name for r in order] == ["S", "T"]


def test_object_lists(spark):
    df = spark.sql("select array(map('o', 'Jana Berger', 'd', 'mon'), map('o', 'Jana', 'd', 'tue'), map('o', 'Al', 'd', 'x')) a, array(map('o', 'jana', 'd', 'tue'), map('o', 'Jana', 'd', 'mon')) e, cast(null as array<map<string,string>>) n")
    r = df.select(scoring.object_list(df.a, df.e, ["o", "d"]), scoring.object_list(df.n, df.e, ["o", "d"]), scoring.has_length(df.a, F.lit(3))).first()
    assert [tuple(x) for x in r] == [(4, 5), (0, 5), (1, 1)]


def test_streaming_summary_equals_batch(spark, tmp_path):
    schema = "run_id int, schema_name string, success boolean, field_issues array<struct<field_path:string>>"
    rows = [(k, "S" if k % 2 else "T", k % 3 > 0, [("a",)] * (k % 3) + [("b",)]) for k in range(30)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
    q = quality.live_field_summary(stream).writeStream.outputMode("complete").format("memory").queryName("live_fields").trigger(availableNow=True).start()
    q.awaitTermination()
    want = quality.live_field_summary(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.table("live_fields").collect())) == sorted(map(tuple, want.collect()))
    seen = []
    quality.on_runs(spark.readStream.schema(schema).parquet(str(tmp_path / "runs")), lambda df, n: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == 30


def test_fuzzy_search_equals_cell_by_cell():
    rng = random.Random(4)
    for _ in range(3_000):
        letters = "ab" if rng.random() < 0.5 else "abcdé \U0001f600"
        hay = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        needle = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
        if rng.random() < 0.4 and len(hay) > 15:
            at = rng.randrange(len(hay) - 12)
            needle = hay[at : at + 6] + rng.choice(letters) + hay[at + 7 : at + 12]
        for threshold in (0.5, 0.85, 0.9, 1.0, 0.0, -1, 2):
            want = needle in hay or 1 - text.substring_distance(needle, hay) / len(needle) >= threshold
            assert text.fuzzy_hit(needle, hay, threshold) == want, (needle, hay, threshold)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    assert text.fuzzy_hit(long[500:620] + "zz" + long[622:700], long, 0.95) and not text.fuzzy_hit("xyz" * 40, long, 0.85)


def test_forms_of_a_batch_are_found_together():
    got = text.occurring(["he", "she", "hers", "", "x y"], ["ushers", "x  y", ""])
    assert got == [{"he", "she", "hers", ""}, {""}, {""}] and text.occurring([], ["a"]) == [set()] and text.occurring([""], ["a"]) == [{""}]


def test_folded_form_equals_normalized(spark):
    rows = [(x,) for x in ("A  b", " a\tB ", "x", "", "1.234,50", "a\x1cb", "(5)", "\n")]
    for r in spark.createDataFrame(rows, "t string").select(text.folded_form(F.col("t")).alias("a"), text.normalized_ascii(F.col("t")).alias("b")).collect():
        assert r.a == r.b
