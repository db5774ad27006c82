"""Registered queries of extraction, grounding, schemas, tools and benchmark figures, with their SQL.

Replies, arguments and sources are texts made of the tables' columns, the same way in both; the SQL reads the texts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.functions import replies, scalars
from attestor.functions.text import once
from attestor.operators import analytics, extraction, grounding, replay, rules, scoring, toolcalls
from attestor.operators.grounding import Grounded
from attestor.operators.schema import Field, RecordSchema, completed, needed_if, revalidated, validate
from attestor.plans.catalogue import _t, bench_results, middle, order_runs, query
from attestor.sources import messages
from attestor.sources.state import written

VISIT = RecordSchema("Visit", [Field("k", "int", ge=5), Field("kind", grounded=Grounded())])


def event_replies(spark, sf):
    """Each user's events as replies, odd ones of the fallback model, each with the text it was asked about."""
    n, rank = F.col("event_id") % 6, (F.col("event_id") % 2).cast("int")
    doc = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "kind": "'), F.col("event_type"), F.lit('"}'))
    content = (
        F.when(n == 0, doc).when(n == 1, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).when(n == 2, F.regexp_replace(doc, '"k": [0-9]+', '"k": "many"'))
        .when(n == 3, F.concat(F.lit("No answer about "), F.col("event_type"))).when(n == 4, F.replace(doc, F.col("event_type"), F.lit("rocket"))).otherwise(F.concat(F.lit("Here: "), doc, F.lit(" // as asked")))
    )
    failed = F.col("event_id") % 17 == 0
    nth = F.row_number().over(Window.partitionBy("user_id", rank).orderBy("ts", "event_id"))
    rows = _t(spark, sf, "events").withColumn("attempt", nth - 1)
    return rows.select(F.col("user_id").alias("run_id"), rank.alias("model_rank"), "attempt", F.when(~failed, content).alias("content"), F.when(failed, "ReadTimeout").alias("error_class"), F.concat(F.lit("A "), F.upper("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("source"))


def extracted_events(spark, sf):
    return extraction.extracted(event_replies(spark, sf), VISIT, source=F.col("source"), rule=lambda r: rules.findings(rules.finding(r["k"] > 80, "too large", "k")))


_EXTRACTED = """
WITH d AS (SELECT *, regexp_replace(props, '\\}$', '') || ', "kind": "' || event_type || '"}' AS doc, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS attempt FROM events),
replies AS (
  SELECT user_id AS run_id, (event_id % 2)::INT AS model_rank, attempt::INT AS attempt, event_id % 17 = 0 AS failed, 'a ' || event_type || ' by user ' || user_id AS source,
         CASE event_id % 6 WHEN 0 THEN doc WHEN 1 THEN '```json' || chr(10) || doc || chr(10) || '```' WHEN 2 THEN regexp_replace(doc, '"k": [0-9]+', '"k": "many"') WHEN 3 THEN 'No answer about ' || event_type
              WHEN 4 THEN replace(doc, event_type, 'rocket') ELSE 'Here: ' || doc || ' // as asked' END AS content FROM d
), read AS (
  SELECT *, nullif(regexp_extract(content, '\\{.*\\}'), '') AS j FROM replies
), fields AS (
  SELECT *, TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) AS k, json_extract_string(j, '$.kind') AS kind FROM read
), a AS (
  SELECT run_id, model_rank, attempt, k, CASE WHEN failed THEN 'llm_error' WHEN j IS NULL THEN 'parse' WHEN k IS NULL OR k < 5 THEN 'schema' WHEN NOT contains(source, kind) THEN 'ground' WHEN k > 80 THEN 'rule' ELSE 'ok' END AS outcome FROM fields
)
"""


@query(_EXTRACTED + """
SELECT run_id, model_rank, attempt, outcome, CASE WHEN outcome IN ('ok', 'ground', 'rule') THEN k END AS k, CASE WHEN outcome = 'llm_error' THEN 'timeout' END AS error_kind,
       (outcome IN ('schema', 'ground', 'rule'))::INT AS n_issues, outcome IN ('parse', 'schema', 'ground', 'rule') AS has_feedback FROM a
""")
def extract_attempts(spark, sf):
    out = extracted_events(spark, sf)
    return out.select("run_id", "model_rank", "attempt", "outcome", F.col("record.k").cast("long").alias("k"), "error_kind", F.size("issues").alias("n_issues"), F.col("feedback").isNotNull().alias("has_feedback"))


@query(_EXTRACTED + """
, b AS (SELECT *, coalesce(bool_or(outcome IN ('ok', 'llm_error')) OVER (PARTITION BY run_id, model_rank ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM a),
c AS (SELECT *, bool_or(model_rank = 0 AND outcome = 'ok') OVER (PARTITION BY run_id) AS won FROM b WHERE NOT ended AND attempt < 3),
live AS (SELECT * FROM c WHERE model_rank = 0 OR NOT won),
g AS (SELECT run_id, bool_or(outcome = 'ok') AS success, count(*) FILTER (outcome IN ('parse', 'schema', 'ground', 'rule') AND model_rank = 0) AS primary_retries, count(*) FILTER (outcome IN ('parse', 'schema', 'ground', 'rule') AND model_rank = 1) AS fallback_retries,
             count(*) FILTER (outcome = 'parse') AS format_errors, arg_max(outcome, model_rank * 10 + attempt) AS last, max(k) FILTER (outcome = 'ok') AS k, count(*) FILTER (outcome IN ('schema', 'ground', 'rule')) AS n_issues,
             arg_max(outcome, model_rank * 10 + attempt) FILTER (outcome IN ('ground', 'rule')) IS NOT NULL AS has_candidate FROM live GROUP BY run_id)
SELECT r.run_id, coalesce(success, false) AS success, coalesce(primary_retries, 0) AS primary_retries, coalesce(fallback_retries, 0) AS fallback_retries, coalesce(format_errors, 0) AS format_errors, k,
       CASE WHEN success THEN NULL WHEN last = 'parse' THEN 'parse_error' WHEN last = 'llm_error' THEN 'llm_error' WHEN last IS NOT NULL THEN 'validation_exhausted' END AS failure_reason,
       coalesce(n_issues, 0)::INT AS n_issues, coalesce(has_candidate, false) AND NOT success AS has_candidate
FROM (SELECT DISTINCT run_id FROM a) r LEFT JOIN g USING (run_id)
""")
def extract_runs(spark, sf):
    attempts = extracted_events(spark, sf)
    out = extraction.runs(attempts, attempts.select("run_id").distinct(), VISIT)
    return out.select("run_id", "success", "primary_retries", "fallback_retries", "format_errors", F.col("record.k").cast("long").alias("k"), "failure_reason", F.size("field_issues").alias("n_issues"), F.col("candidate").isNotNull().alias("has_candidate"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) AND json_extract(props, '$.k')::BIGINT >= 5 THEN json_extract(props, '$.k')::BIGINT END AS k,
       CASE WHEN event_id % 5 > 1 THEN 'parse' WHEN json_extract(props, '$.k')::BIGINT < 5 THEN 'schema' ELSE 'ok' END AS outcome FROM events
""")
def tool_reply_parse(spark, sf):
    n = F.col("event_id") % 5
    doc = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "kind": "a"}'))
    call = lambda args: F.array(F.struct(F.lit("1").alias("id"), F.lit("Visit").alias("name"), args.alias("args"), F.lit("cut").alias("error")))
    none = F.array().cast(extraction.CALLS)
    calls = F.when(n.isin(0, 4), call(doc)).otherwise(none)
    invalid = F.when(n == 1, call(F.concat(F.lit("<think>so</think>"), doc))).when(n == 2, call(F.lit("{"))).when(n == 4, call(F.lit("[]"))).otherwise(none)
    rows = _t(spark, sf, "events").select("event_id", calls.alias("tool_calls"), invalid.alias("invalid_tool_calls"), F.lit(None).cast("string").alias("error_class"))
    return extraction.extracted(rows, VISIT, mode="tools").select("event_id", F.col("record.k").cast("long").alias("k"), "outcome")


@query("""
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_type AS kind, (event_id % 9 = 8)::INT + 1 AS n FROM events
""")
def reply_repair(spark, sf):
    """Nine kinds of damage; of objects side by side, the first."""
    k, kind, n = F.get_json_object("props", "$.k"), F.col("event_type"), F.col("event_id") % 9
    text = lambda pattern: F.format_string(pattern, k, kind)
    shapes = ['{"k": %s, "kind": "%s",}', '{"k": %s "kind": "%s"}', "{'k': %s, 'kind': '%s'}", '{k: %s, kind: "%s"}', '{"k": +%s, "kind": "%s", "ok": None}', '{"k": %s, "kind": "%s", "more": [1, 2', '{"k": %s, /* so */ "kind": "%s"} // done', 'I say: {"k": %s, "kind": "%s"', '{"k": %s, "kind": "%s"} {"k": -1}']
    content = F.when(n == 0, text(shapes[0]))
    for i, s in enumerate(shapes[1:], 1):
        content = content.when(n == i, text(s))
    rows = replies.with_parsed(_t(spark, sf, "events").select("event_id", content.alias("content")), F.col("content"))
    first = F.when(F.col("parsed.json").startswith("["), F.get_json_object("parsed.json", "$[0]")).otherwise(F.col("parsed.json"))
    size = F.when(F.col("parsed.json").startswith("["), F.json_array_length("parsed.json")).otherwise(1)
    return rows.select("event_id", F.get_json_object(first, "$.k").cast("long").alias("k"), F.get_json_object(first, "$.kind").alias("kind"), size.alias("n"))


QUOTE = RecordSchema("Quote", [Field("text", grounded=Grounded())])
NOTE = RecordSchema("Note", [Field("head", grounded=Grounded()), Field("quotes", QUOTE, many=True), Field("by_place", QUOTE, keyed=True), Field("last", QUOTE), Field("loose", grounded=Grounded(on_mismatch="flag"), required=False)])


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, substr(coalesce(text, ''), greatest(length(coalesce(text, '')) // 2 - 11, 1), 24) AS own FROM documents),
p AS (SELECT a.doc_id, a.text, upper(a.own) AS own, coalesce(b.own, a.own) AS other FROM d a LEFT JOIN d b ON b.doc_id = a.doc_id + 1),
v AS (SELECT doc_id, text, unnest(['head', 'quotes -> 0 -> text', 'quotes -> 1 -> text', 'by_place -> next -> text', 'last -> text', 'loose']) AS field_path, unnest([own, own, other, other, own, other]) AS value, unnest([true, true, true, true, true, false]) AS rejecting FROM p),
f AS (SELECT *, replace(lower(strip_accents(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 'ß', 'ss') AS hay, replace(lower(strip_accents(trim(regexp_replace(value, '\\s+', ' ', 'g')))), 'ß', 'ss') AS needle FROM v)
SELECT doc_id, field_path, rejecting FROM f WHERE NOT contains(hay, needle)
""")
def record_grounding(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("own", middle(F.col("text")))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("own").alias("other")), "doc_id", "left").withColumn("other", F.coalesce("other", "own"))
    own, quote = F.upper("own"), lambda c: F.struct(c.alias("text"))
    doc = F.to_json(F.struct(own.alias("head"), F.array(quote(own), quote(F.col("other"))).alias("quotes"), F.create_map(F.lit("next"), quote(F.col("other"))).alias("by_place"), quote(own).alias("last"), F.col("other").alias("loose")))
    rows = pairs.select("doc_id", "text", validate(doc, NOTE)["record"].alias("record"))
    return grounding.grounded(rows, NOTE, "record", F.col("text")).select("doc_id", F.explode("grounding").alias("i")).select("doc_id", "i.field_path", "i.rejecting")


@query("""
WITH w AS (SELECT p_partkey, p_size % 23 AS n, ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen', 'twenty'] AS words FROM part)
SELECT p_partkey, n <= 20 OR n = 22 AS word_found, (p_partkey % 3 = 0) = (p_partkey % 2 = 0) AS flag_found FROM w
""")
def word_forms_grounding(spark, sf):
    n, words = F.col("p_size") % 23, F.array(*[F.lit(w) for w in grounding.NUMBER_WORDS["en"]])
    source = F.concat(F.lit("He has "), F.coalesce(F.get(words, n.cast("int")), F.when(n == 22, "22").otherwise("many")), F.lit(" pieces"))
    said = F.when(F.col("p_partkey") % 2 == 0, "Answer: JA").otherwise("Answer: nein")
    flag, grounded = F.col("p_partkey") % 3 == 0, Grounded()
    rows = once(_t(spark, sf, "part"), n=n.cast("string"), flag=flag.cast("string"), source=source, said=said, words=grounding.render_candidates(n, "int"), flags=grounding.render_candidates(flag, "bool"))
    return rows.select("p_partkey", grounded.holds(F.col("n"), F.col("source"), F.col("words")).alias("word_found"), grounded.holds(F.col("flag"), F.col("said"), F.col("flags")).alias("flag_found"))


DOCK = RecordSchema("Dock", [Field("name"), Field("bay", "int")], before=lambda t: F.when(t.contains(" / "), F.to_json(F.struct(F.substring_index(t, " / ", 1).alias("name"), F.substring_index(t, " / ", -1).alias("bay")))))
FREIGHT = RecordSchema("Freight", [
    Field("total", "float", before=lambda t: F.regexp_replace(t, "[^0-9.-]", "")), Field("prio", choices=("urgent", "high", "normal"), synonyms={"1-urgent": "urgent", "2-high": "high", "3-medium": "normal", "4-not specified": "normal", "5-low": "normal"}),
    Field("who", after=(F.trim, F.initcap)), Field("dock", DOCK), Field("day", "date"), Field("level", "int", required=False, default=1, paths=("$.meta.level",)),
], computed=(("twice", lambda r: F.round(r["total"] * 2, 2)),))


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS total, CASE left(o_orderpriority, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'normal' END AS prio, 'Clerk ' || o_custkey AS who, 'D' || o_custkey % 7 AS dock, o_custkey % 50 AS bay,
       strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 ELSE 1 END AS level, round(round(o_totalprice, 2) * 2, 2) AS twice FROM orders
""")
def cleaned_records(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    doc = F.concat(
        F.lit('{"total": "USD '), F.format_number("o_totalprice", 2), F.lit('", "prio": "'), F.col("o_orderpriority"), F.lit('", "who": "  CLERK '), cust.cast("string"), F.lit(' ", "dock": "D'), (cust % 7).cast("string"), F.lit(" / "),
        (cust % 50).cast("string"), F.lit('", "day": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"'), F.when(key % 2 == 0, F.concat(F.lit(', "meta": {"level": "'), (key % 9).cast("string"), F.lit('"}'))).otherwise(""), F.lit("}"),
    )
    r = completed(validate(doc, FREIGHT)["record"], FREIGHT)
    out = _t(spark, sf, "orders").select("o_orderkey", r.alias("r"))
    return out.select("o_orderkey", "r.total", "r.prio", "r.who", F.col("r.dock.name").alias("dock"), F.col("r.dock.bay").cast("long").alias("bay"), F.col("r.day").cast("string").alias("day"), F.col("r.level").cast("long").alias("level"), "r.twice")


TERM = RecordSchema("Term", [Field("opened", "date"), Field("closed", "date"), Field("state"), Field("note", required=False), Field("paid", "float", ge=0)], rules=(
    (lambda r: r["opened"] > r["closed"], "closed before it was opened"), needed_if(lambda r: r["state"] == "F", "note", "a finished order needs a note"),
))


@query("""
SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 5 < 2 THEN 'Value error, closed before it was opened' END, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'Value error, a finished order needs a note' END) AS messages FROM orders
""")
def rule_violations(spark, sf):
    return _terms(spark, sf).select("o_orderkey", F.array_join(F.transform(F.col("v.issues"), lambda i: i["message"]), "; ").alias("messages"))


def _terms(spark, sf):
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    doc = F.to_json(F.struct(day.cast("string").alias("opened"), F.date_add(day, (key % 5 - 2).cast("int")).cast("string").alias("closed"), F.col("o_orderstatus").alias("state"), F.when(key % 3 != 0, F.lit("seen")).alias("note"), F.col("o_totalprice").alias("paid")))
    return _t(spark, sf, "orders").select("o_orderkey", "o_totalprice", validate(doc, TERM).alias("v"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'greater_than_equal' END AS error_type FROM orders WHERE NOT (o_orderkey % 5 < 2) AND NOT (o_orderstatus = 'F' AND o_orderkey % 3 = 0)
""")
def revalidated_records(spark, sf):
    rows = _terms(spark, sf).select("o_orderkey", F.col("v.record").alias("r")).where("r is not null")
    changed = F.col("r").withField("paid", F.col("r.paid") - 100000)
    return rows.select("o_orderkey", F.get(revalidated(changed, TERM)["issues"], F.lit(0))["error_type"].alias("error_type"))


LINE = RecordSchema("Line", [Field("q", "int"), Field("flag", choices=("A", "N", "R"))])


def order_lists(spark, sf):
    """One reply for each order: its lines as a JSON array."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("flag")).alias("item"))
    content = F.to_json(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["item"]))
    rows = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(content.alias("content"))
    return rows.select(F.col("l_orderkey").alias("run_id"), F.lit(0).alias("model_rank"), F.lit(0).alias("attempt"), "content", F.lit(None).cast("string").alias("error_class"))


@query("""
SELECT l_orderkey AS run_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1)::INT AS index, l_quantity::BIGINT AS q, l_returnflag AS flag, count(*) OVER (PARTITION BY l_orderkey)::INT AS item_count FROM lineitem
""")
def list_extraction(spark, sf):
    # runs reads its attempts from several sides, each of which would extract them again
    attempts = written(extraction.extracted(order_lists(spark, sf), LINE.listed()), "list-attempts")
    done = extraction.runs(attempts, attempts.select("run_id"), LINE.listed(), 1, 1, False)
    return extraction.items(done, LINE).select("run_id", "index", F.col("item.q").cast("long").alias("q"), F.col("item.flag").alias("flag"), "item_count")


@query("""
SELECT l_orderkey AS run_id, true AS success, bool_or(l_quantity > 45) AS salvaged, count(*) FILTER (l_quantity <= 45)::INT AS n_items, count(*) FILTER (l_quantity > 45)::INT AS n_rejected FROM lineitem GROUP BY 1
""")
def salvaged_lists(spark, sf):
    herd = LINE.listed()
    attempts = written(extraction.extracted(order_lists(spark, sf), herd, rule=lambda r: rules.item_rules(r["items"], lambda x: rules.findings(rules.finding(x["q"] > 45, "too many", "q")))), "list-attempts")
    done = extraction.runs(attempts, attempts.select("run_id"), herd, 1, 1, False)
    out = extraction.salvaged(done, herd, lambda c, i: extraction.list_salvage(c, i, herd))
    return out.select("run_id", "success", "salvaged", F.size("record.items").alias("n_items"), F.coalesce(F.size("last_rejection"), F.lit(0)).alias("n_rejected"))


SHOP = toolcalls.Registry([
    toolcalls.Tool("view", RecordSchema("View", [Field("k", "int", ge=10)])), toolcalls.Tool("click", RecordSchema("Click", [Field("k", "int"), Field("who")]), aliases=("tap",)),
    toolcalls.Tool("purchase", None, handler=lambda args: F.concat(F.lit("sold "), F.get_json_object(args, "$.k"))),
])


def shop_calls(spark, sf):
    """Events as one call each, and what a correcting model would answer to every second one."""
    e, k = _t(spark, sf, "events"), F.col("event_id")
    name = F.when((F.col("event_type") == "click") & (k % 3 == 0), "tap").otherwise(F.col("event_type"))
    args = F.when(F.col("event_type") == "click", F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "user": "u"}'))).otherwise(F.col("props"))
    call = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("id"), name.alias("name"), args.alias("args"), F.lit(None).cast("string").alias("error"))
    calls = e.select(F.col("user_id").alias("conv_id"), k.alias("turn"), F.array(call).alias("calls"), F.array().cast(extraction.CALLS).alias("invalid_calls"))
    better = F.when(F.col("event_type") == "view", F.lit('{"k": 10}')).otherwise(F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "who": "u"}')))
    fixes = e.where(k % 2 == 0).select(F.col("user_id").alias("conv_id"), k.alias("turn"), F.concat(F.lit("c"), k.cast("string")).alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("attempt"), F.lit("no idea").alias("content")), F.struct(F.lit(1).alias("attempt"), better.alias("content")))).alias("x")).select("conv_id", "turn", "id", "x.*")
    return calls, fixes


def shop_resolved(spark, sf):
    calls, fixes = shop_calls(spark, sf)
    hook = lambda name, raw, error: F.when((name == "view") & (F.get_json_object(raw, "$.k").cast("int") < 5), F.lit('{"k": 10}'))
    return toolcalls.tool_node(calls, SHOP, fixes, hook=hook)


_SHOP = """
WITH e AS (SELECT *, json_extract(props, '$.k')::INT AS k FROM events),
o AS (SELECT *, CASE WHEN event_type NOT IN ('view', 'click') OR (event_type = 'view' AND k >= 10) THEN 'executed' WHEN event_id % 2 = 0 THEN 'corrected' WHEN event_type = 'view' AND k < 5 THEN 'salvaged' ELSE 'feedback' END AS outcome FROM e)
"""


@query(_SHOP + """
SELECT event_type AS name, count(*) AS calls, count(*) FILTER (outcome = 'executed') AS executed_calls, count(*) FILTER (outcome = 'corrected') AS corrected_calls, count(*) FILTER (outcome = 'salvaged') AS salvaged_calls,
       count(*) FILTER (outcome = 'feedback') AS feedback_calls, count(*) FILTER (event_type IN ('view', 'click')) AS prevalidated_calls FROM o GROUP BY 1
""")
def tool_node_outcomes(spark, sf):
    return toolcalls.call_stats(shop_resolved(spark, sf), "name").select("name", "calls", "executed_calls", "corrected_calls", "salvaged_calls", "feedback_calls", "prevalidated_calls")


@query(_SHOP + """
SELECT event_id AS turn, CASE WHEN outcome = 'feedback' THEN 'The arguments for ''' || event_type || ''' don''t fit its schema' WHEN event_type = 'purchase' THEN 'sold ' || k
       WHEN event_type IN ('view', 'click') THEN 'Tool ''' || event_type || ''' gave no result.' ELSE 'Unknown tool ''' || event_type || '''. Available tools: view, click, purchase.' END AS content FROM o
""")
def tool_node_answers(spark, sf):
    resolved = shop_resolved(spark, sf)
    out = toolcalls.answers(resolved, toolcalls.executed(resolved, SHOP).drop("status"))
    return out.select("turn", F.when(F.col("content").startswith("The arguments"), F.substring_index("content", ";", 1)).otherwise(F.col("content")).alias("content"))


@query(_SHOP + """
SELECT event_id AS turn, json_extract(CASE WHEN event_type = 'view' AND outcome IN ('corrected', 'salvaged') THEN '{"k": 10}' ELSE props END, '$.k')::INT AS k, event_type AS name, outcome IN ('corrected', 'salvaged') AS changed FROM o
""")
def sanitized_calls(spark, sf):
    out = toolcalls.sanitized(shop_resolved(spark, sf)).select("turn", F.get("calls", F.lit(0)).alias("c"), "changed")
    return out.select("turn", F.get_json_object("c.args", "$.k").cast("int").alias("k"), "c.name", "changed")


@query("""
SELECT n_nationkey, [NULL, NULL, 'UYW', 'XAU', NULL, 'EUR', NULL, 'ZWG', 'CHE', NULL, NULL, 'USN', 'NOK'][n_nationkey % 13 + 1] AS currency, ['de', NULL, 'he', NULL, 'id', NULL, 'yi', NULL, 'ro', 'nb', NULL][n_nationkey % 11 + 1] AS language,
       ['DE', NULL, 'GB', NULL, NULL][n_nationkey % 5 + 1] AS country FROM nation
""")
def code_checks(spark, sf):
    pick = lambda values: F.get(F.array(*[F.lit(x) for x in values]), (F.col("n_nationkey") % len(values)).cast("int"))
    currency = scalars.currency(pick(["DEM", "ATS", "uyw", "\tXAU\n", "BEF", " eur", "", "zwg", "CHE", "ITL", "XXX", "usn", " NOK"]))
    language = scalars.language(pick(["\tde\n", "iw", "HE", "in", "id", "ji", "yi", "mo", "ro", "nb", "xx"]), scalars.language_codes(spark))
    country = scalars.country(pick(["\nde", "UK", "gb\t", "Germany", "XK"]), scalars.country_codes(spark))
    return _t(spark, sf, "nation").select("n_nationkey", currency["value"].alias("currency"), language["value"].alias("language"), country["value"].alias("country"))


@query("""
SELECT n_nationkey, ['connection', 'connection', 'rate_limit', 'timeout', 'server_error', 'context_overflow', 'authentication', 'permission_denied', 'not_found', 'invalid_request', 'other', 'timeout', 'connection'][n_nationkey % 13 + 1] AS kind FROM nation
""")
def error_kinds(spark, sf):
    names = ["RemoteProtocolError", "NetworkError", "ModelRateLimitError", "ModelTimeoutError", "ModelAPIError", "ContextOverflowError", "AuthenticationError", "PermissionDeniedError", "NotFoundError", "BadRequestError", "KeyError", "TimeoutError", "ConnectionError"]
    return _t(spark, sf, "nation").select("n_nationkey", replay.error_kind(F.get(F.array(*[F.lit(x) for x in names]), (F.col("n_nationkey") % len(names)).cast("int"))).alias("kind"))


@query("""
WITH o AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS flags FROM lineitem GROUP BY 1)
SELECT o_orderkey, ((o_totalprice >= 50000)::INT + (o_totalprice BETWEEN 1000 AND 200000)::INT + (len(flags) = 4)::INT + list_contains(flags, 'R')::INT + list_contains(flags, 'A')::INT + (lower(o_orderstatus) = 'f')::INT + (o_orderstatus = 'F')::INT)::BIGINT AS correct, 7::BIGINT AS total
FROM orders JOIN o ON l_orderkey = o_orderkey
""")
def field_dispatch(spark, sf):
    """Every kind of expected value; what holds is decided by its kind."""
    flags = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), lambda x: x["l_returnflag"])
    rows = _t(spark, sf, "orders").join(_t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(flags.alias("flags")), "o_orderkey")
    record = F.struct(F.col("o_totalprice").alias("least"), F.col("o_totalprice").alias("within"), F.col("flags").alias("length"), F.col("flags").alias("some"), F.lower("o_orderstatus").alias("text"), (F.col("o_orderstatus") == "F").alias("done"))
    expected = {"least": scoring.AtLeast(50000), "within": scoring.Between(1000, 200000), "length": 4, "some": ["r", " a "], "text": " F", "done": True}
    return rows.select("o_orderkey", scoring.record_accuracy(record, F.lit(True), expected, ("length", "some")).alias("a")).select("o_orderkey", "a.correct", "a.total")


@query("""
WITH r AS (SELECT l_linestatus AS "group", 's' || l_linenumber AS scenario, 'm' || (l_partkey % 15) AS model, l_returnflag <> 'R' AS success FROM lineitem),
f AS (SELECT DISTINCT "group", scenario, model FROM r WHERE NOT success)
SELECT r."group", r.scenario, count(*) AS total, count(*) FILTER (success) AS successes, (SELECT coalesce(string_agg(model, ', ' ORDER BY model), '') FROM f WHERE f."group" = r."group" AND f.scenario = r.scenario) AS failed_models FROM r GROUP BY 1, 2
""")
def group_summary(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_linestatus").alias("group"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("scenario"), F.concat(F.lit("m"), (F.col("l_partkey") % 15).cast("string")).alias("model"), (F.col("l_returnflag") != "R").alias("success"))
    return analytics.group_summary(rows)


@query("""
WITH runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS schema_name, o_orderstatus <> 'F' AS success, o_orderstatus = 'P' AS salvaged FROM orders),
issues AS (SELECT r.*, l_returnflag AS field_path, 't' || (l_suppkey % 3) AS error_type, row_number() OVER (PARTITION BY run_id ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM runs r JOIN lineitem ON l_orderkey = run_id),
each AS (SELECT run_id, schema_name, field_path, success, salvaged, count(*) AS n FROM issues GROUP BY ALL),
f AS (SELECT schema_name, field_path, sum(n)::BIGINT AS hits, count(*) FILTER (NOT success) AS lost, round_even(100 * count(*) FILTER (success AND NOT salvaged) / count(*), 0)::INT AS recovery, 10 * count(*) FILTER (NOT success OR salvaged) + sum(n) AS severity FROM each GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY schema_name ORDER BY severity DESC, field_path)::INT AS place FROM f),
tn AS (SELECT schema_name, field_path, error_type, count(*) AS n, min((run_id, pos)) AS seen FROM issues GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY schema_name, field_path ORDER BY n DESC, seen) AS k FROM tn)
SELECT schema_name, 0 AS line_no, '  ' || schema_name || ': ' || round_even(100 * count(*) FILTER (success) / count(*), 0)::INT || '% success (' || count(*) FILTER (NOT success) || '/' || count(*) || ' runs failed)' AS line
FROM runs WHERE schema_name IN (SELECT schema_name FROM f) GROUP BY 1
UNION ALL
SELECT p.schema_name, place, '    ' || rpad(p.field_path, 24, ' ') || ' hits=' || rpad(hits::VARCHAR, greatest(3, length(hits::VARCHAR))::INT, ' ') || ' failed_runs=' || rpad(lost::VARCHAR, greatest(3, length(lost::VARCHAR))::INT, ' ') || ' recovery=' || recovery || '%  top_error=' || error_type
FROM p JOIN t ON t.schema_name = p.schema_name AND t.field_path = p.field_path AND t.k = 1 WHERE place <= 2
""")
def console_lines(spark, sf):
    runs = order_runs(spark, sf)
    return analytics.console_summary(analytics.schema_summary(runs), analytics.field_summary(runs), analytics.first_seen_error(analytics.issue_rows(runs)), 2)


@query("""
WITH runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS schema_name, o_orderstatus <> 'F' AS success FROM orders),
n AS (SELECT schema_name, count(*) AS occurrences FROM runs JOIN lineitem ON l_orderkey = run_id GROUP BY 1),
s AS (SELECT schema_name, count(*) FILTER (NOT success) AS failed_runs FROM runs GROUP BY 1)
SELECT s.schema_name, failed_runs, coalesce(occurrences, 0) AS occurrences, row_number() OVER (ORDER BY failed_runs DESC, coalesce(occurrences, 0) DESC, s.schema_name)::INT AS place FROM s LEFT JOIN n USING (schema_name)
""")
def ranked_schemas(spark, sf):
    runs = order_runs(spark, sf)
    return analytics.ranked_schemas(analytics.schema_summary(runs), analytics.field_summary(runs)).select("schema_name", "failed_runs", "occurrences", "place")


@query("SELECT o_orderkey, (o_custkey + o_orderkey % 7)::BIGINT AS tokens_in, (o_orderkey % 5)::BIGINT AS tokens_out FROM orders")
def token_sums(spark, sf):
    part = lambda i, o: F.struct(i.cast("long").alias("i"), o.cast("long").alias("o"))
    usage = F.create_map(F.lit("a"), part(F.col("o_custkey"), F.lit(None)), F.lit("b"), part(F.col("o_orderkey") % 7, F.col("o_orderkey") % 5))
    return _t(spark, sf, "orders").select("o_orderkey", analytics.token_totals(usage, "i").alias("tokens_in"), analytics.token_totals(usage, "o").alias("tokens_out"))


@query("""
WITH a AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant'),
r AS (SELECT a.conv_id, a.turn, c.turn AS t, c.turn = a.turn AS own, CASE WHEN c.turn = a.turn THEN 'assistant' ELSE c.role END AS role, coalesce(c.text, '') AS text FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn <= a.turn
      WHERE (c.turn = a.turn AND coalesce(c.text, '') <> '') OR (c.turn < a.turn AND c.role <> 'system')),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, own ORDER BY t DESC) AS back FROM r),
x AS (SELECT conv_id, turn, string_agg('[' || role || '] ' || CASE WHEN length(text) > 50 THEN left(text, 49) || '…' ELSE text END, chr(10) ORDER BY t) AS context FROM k WHERE own OR back <= 2 GROUP BY 1, 2)
SELECT a.conv_id, a.turn, context FROM a LEFT JOIN x ON x.conv_id = a.conv_id AND x.turn = a.turn
""")
def context_before(spark, sf):
    conversations = _t(spark, sf, "conversations")
    return messages.context_before(conversations, conversations.where("role = 'assistant'"), 2, 50)


@query("""
WITH g AS (SELECT 'm' || (l_partkey % 15) AS model, sum((l_quantity >= 10)::INT) AS correct_checks, count(*) AS total_checks FROM lineitem GROUP BY 1)
SELECT model, correct_checks::BIGINT AS correct_checks, total_checks::BIGINT AS total_checks, round(correct_checks / total_checks, 9) AS field_accuracy FROM g
""")
def benchmark_accuracy(spark, sf):
    rows = bench_results(spark, sf).withColumn("c", scoring.at_least(F.col("duration_s"), 10)).select("*", "c.correct", "c.total")
    return analytics.overall_ranking(rows).select("model", "correct_checks", "total_checks", F.round("field_accuracy", 9).alias("field_accuracy"))
