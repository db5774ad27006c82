"""Registered queries of agent runs with two models, relaxations and streamed figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.operators import agent, benchreport, extraction, relaxations, rules
from attestor.operators.scoring import Between
from attestor.plans.catalogue import SQL, _t, order_runs, query
from attestor.plans.extraction_queries import _EXTRACTED, VISIT, event_replies
from attestor.streaming import figures

_TURNS = """
WITH RECURSIVE e AS (SELECT *, event_id % 2 AS m, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS nth FROM events),
r AS (
  SELECT DISTINCT user_id, m, 0 AS n, 0 AS retries, 0 AS helpers, NULL::VARCHAR AS reason, false AS success, NULL::VARCHAR AS answer, NULL::VARCHAR AS candidate, 0 AS n_issues, false AS done FROM e
  UNION ALL
  SELECT r.user_id, r.m, r.n + 1, retries + CASE WHEN event_type IN ('error', 'signup') AND retries < 2 THEN 1 ELSE 0 END, helpers + CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END,
         CASE event_type WHEN 'error' THEN 'no_tool_call' WHEN 'signup' THEN 'validation_exhausted' ELSE reason END, event_type = 'purchase', CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END,
         CASE WHEN event_type = 'signup' THEN event_id::VARCHAR ELSE candidate END, n_issues + CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END, event_type = 'purchase' OR (event_type IN ('error', 'signup') AND retries >= 2)
  FROM r JOIN e ON e.user_id = r.user_id AND e.m = r.m AND e.nth = r.n + 1 WHERE NOT done AND r.n < 6
), last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, m ORDER BY n DESC) = 1),
p AS (SELECT *, CASE WHEN NOT success THEN coalesce(reason, 'validation_exhausted') END AS why FROM last WHERE m = 0), f AS (SELECT *, CASE WHEN NOT success THEN coalesce(reason, 'validation_exhausted') END AS why FROM last WHERE m = 1),
b AS (SELECT p.user_id AS run_id, p.success AS ps, coalesce(f.success, false) AS fs, f.user_id IS NULL AS none, p, f FROM p LEFT JOIN f ON f.user_id = p.user_id)
"""


def _recorded(spark, sf):
    """A user's events as turns of two models: purchases are accepted, sign-ups rejected, errors hold no call."""
    rank = (F.col("event_id") % 2).cast("int")
    e = _t(spark, sf, "events").withColumn("model_rank", rank)
    e = e.withColumn("turn", F.row_number().over(Window.partitionBy("user_id", "model_rank").orderBy("ts", "event_id")))
    issue = F.struct(F.lit("k").alias("field_path"), F.lit("other").alias("category"), F.lit("validator").alias("error_type"), F.lit("no").alias("message"), F.col("event_type").alias("received"), F.lit(True).alias("rejecting"))
    final = F.when(F.col("event_type") == "purchase", "ok").otherwise("rule")
    issues = F.when(F.col("event_type") == "signup", F.array(issue)).otherwise(F.array().cast("array<struct<field_path:string,category:string,error_type:string,message:string,received:string,rejecting:boolean>>"))
    call = F.struct(F.when(F.col("event_type").isin("purchase", "signup"), "final").otherwise("helper").alias("kind"), final.alias("outcome"), F.col("event_id").cast("string").alias("record"), issues.alias("issues"))
    kind = F.when(F.col("event_type") == "error", "none").otherwise("calls")
    return e.select(F.col("user_id").alias("run_id"), "model_rank", "turn", kind.alias("kind"), F.filter(F.array(call), lambda c: kind == "calls").alias("calls"), F.lit(None).cast("string").alias("error_class"))


@query(_TURNS + """
SELECT run_id, ps OR fs AS success, NOT ps AS fallback_used, p.n + CASE WHEN ps THEN 0 ELSE coalesce(f.n, 0) END AS iterations, p.retries + CASE WHEN ps THEN 0 ELSE coalesce(f.retries, 0) END AS validation_retries,
       p.helpers + CASE WHEN ps THEN 0 ELSE coalesce(f.helpers, 0) END AS tool_calls, CASE WHEN NOT (ps OR fs) THEN CASE WHEN none THEN 'llm_error' ELSE f.why END END AS failure_reason, CASE WHEN ps THEN p.answer WHEN fs THEN f.answer END AS record,
       CASE WHEN NOT (ps OR fs) THEN coalesce(f.candidate, p.candidate) END AS candidate, (p.n_issues + CASE WHEN ps THEN 0 ELSE coalesce(f.n_issues, 0) END)::INT AS n_issues,
       CASE WHEN NOT (ps OR fs) AND coalesce(f.candidate, p.candidate) IS NOT NULL THEN 'signup' END AS rejected_value, CASE WHEN none AND NOT ps THEN 'other' END AS llm_error_kind
FROM b
""")
def agent_fallback_runs(spark, sf):
    """Runs of at most six turns and two retries a model; the second model takes over where the first has failed."""
    out = agent.replay_agents(_recorded(spark, sf), most_iterations=6, most_retries=2)
    return out.select("run_id", "success", "fallback_used", "iterations", "validation_retries", "tool_calls", "failure_reason", "record", "candidate", F.size("field_issues").alias("n_issues"), F.get("last_rejection", F.lit(0))["received"].alias("rejected_value"), "llm_error_kind")


@query("""
WITH RECURSIVE c AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, event_id % 9 AS k FROM events
), r AS (
  SELECT DISTINCT user_id, 0 AS n, 0 AS attempts, true AS strict, false AS sr, false AS fr, false AS success, false AS done, NULL::VARCHAR AS reason, NULL::VARCHAR AS kind, 0 AS fe, 0 AS before FROM c
  UNION ALL
  SELECT r.user_id, r.n + 1, attempts + CASE WHEN k IN (2, 3, 7) THEN 1 ELSE 0 END, strict AND NOT (k = 0 AND NOT sr) AND NOT (k IN (1, 8) AND NOT fr), sr OR (k = 0 AND strict), fr OR (k IN (1, 8)),
         k = 4, CASE WHEN k = 4 THEN true WHEN k IN (2, 3, 7) THEN attempts + 1 >= 3 WHEN k = 0 THEN sr OR NOT strict WHEN k IN (1, 8) THEN fr ELSE true END,
         CASE k WHEN 2 THEN 'validation_exhausted' WHEN 3 THEN 'validation_exhausted' WHEN 7 THEN 'parse_error' WHEN 4 THEN reason WHEN 0 THEN CASE WHEN sr OR NOT strict THEN 'llm_error' ELSE reason END
           WHEN 5 THEN 'llm_error' WHEN 6 THEN 'llm_error' ELSE CASE WHEN fr THEN 'llm_error' ELSE reason END END,
         CASE k WHEN 0 THEN 'invalid_request' WHEN 5 THEN 'rate_limit' WHEN 6 THEN 'invalid_request' WHEN 8 THEN 'invalid_request' WHEN 1 THEN 'other' END, fe + CASE WHEN k = 7 THEN 1 ELSE 0 END, attempts
  FROM r JOIN c ON c.user_id = r.user_id AND c.nth = r.n + 1 WHERE NOT done AND r.n < 5
), last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id AS run_id, n AS calls, attempts, sr AS strict_relaxed, fr AS flags_relaxed, success, CASE WHEN NOT done THEN 'llm_error' WHEN NOT success THEN reason END AS failure_reason,
       CASE WHEN NOT done THEN 'other' WHEN NOT success AND reason = 'llm_error' THEN kind END AS llm_error_kind, fe AS format_errors,
       CASE least(CASE WHEN done THEN before ELSE attempts END, 1) WHEN 0 THEN 'low' ELSE 'high' END AS reasoning_effort FROM last
""")
def relaxed_attempts(spark, sf):
    """A user's events as calls to a provider that refuses strict schemas, tool flags and reasoning levels now and then."""
    k = F.col("event_id") % 9
    failed = (
        F.when(k == 0, F.struct(F.lit("BadRequestError").alias("c"), F.lit("the response schema is too complex").alias("t"), F.lit(400).alias("s")))
        .when(k == 1, F.struct(F.lit("TypeError").alias("c"), F.lit("got an unexpected keyword argument 'tool_choice'").alias("t"), F.lit(None).cast("int").alias("s")))
        .when(k == 5, F.struct(F.lit("RateLimitError").alias("c"), F.lit("slow down").alias("t"), F.lit(429).alias("s"))).when(k == 6, F.struct(F.lit("TypeError").alias("c"), F.lit("unexpected keyword argument 'reasoning_effort'").alias("t"), F.lit(None).cast("int").alias("s")))
        .when(k == 8, F.struct(F.lit("BadRequestError").alias("c"), F.lit("parallel_tool_calls is not supported").alias("t"), F.lit(None).cast("int").alias("s")))
    )
    outcome = F.when(k == 2, "schema").when(k == 3, "ground").when(k == 4, "ok").when(k == 7, "parse")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    calls = _t(spark, sf, "events").withColumn("n", nth).withColumn("e", failed).select(F.col("user_id").alias("run_id"), "n", outcome.alias("outcome"), F.col("e.c").alias("error_class"), F.col("e.t").alias("error_text"), F.col("e.s").alias("status"))
    return relaxations.relaxed_attempts(calls, budget=3, levels=("low", "high"))


@query(SQL["issue_summary_field"])
def merged_field_figures(spark, sf):
    """The field summary out of partial figures of three shares of the runs, merged."""
    runs = order_runs(spark, sf)
    parts = [figures.partial_figures(runs.where(F.pmod(F.xxhash64("run_id"), F.lit(3)) == k)) for k in range(3)]
    out = figures.field_summary_of(figures.merged_figures(*parts))
    return out.withColumns({c: F.round(c, 9) for c in ("first_error_attempt_avg", "recovery_rate")})


_EXPECTED = {"size": Between(10, 30), "brand": "Brand#23", "words": ["green", "almond", "blue"], "kind": "steel"}


@query("""
WITH p AS (SELECT p_partkey, p_size, replace(p_brand, '|', '\\|') AS p_brand, p_name, string_split(p_name, ' ') AS w, p_size BETWEEN 10 AND 30 AS s, lower(replace(p_brand, ' ', '')) = 'brand#23' AS b FROM part),
c AS (SELECT *, len(list_filter(['green', 'almond', 'blue'], lambda e: len(list_filter(w, lambda a: a <> '' AND (contains(lower(a), e) OR contains(e, lower(a))))) > 0)) AS n FROM p)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '—' ELSE CASE WHEN s THEN '🟢' ELSE '🔴' END || ' size=' || p_size || CASE WHEN s THEN '' ELSE ', expected: 10 to 30' END || '<br>' || CASE WHEN b THEN '🟢' ELSE '🔴' END || ' brand=' || p_brand || CASE WHEN b THEN '' ELSE ', expected: Brand#23' END
  || '<br>' || CASE WHEN n = 3 THEN '🟢' WHEN n > 0 THEN '🟡' ELSE '🔴' END || ' words=[' || len(w) || '] (' || n || '/3)' || CASE WHEN n < 3 THEN ', expected: green; almond; blue' ELSE '' END || '<br>🔴 kind=∅, expected: steel' || CASE WHEN p_partkey % 2 = 0 THEN '<br>⚪ note=seen' ELSE '' END END AS detail FROM c
""")
def value_details(spark, sf):
    """Parts as records, each field held against what a scenario expects."""
    record = F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.split("p_name", " ").alias("words"), F.lit(None).cast("string").alias("kind"), F.when(F.col("p_partkey") % 2 == 0, "seen").alias("note"))
    rows = _t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, record).alias("r"))
    return rows.select("p_partkey", benchreport.value_detail(F.col("r"), ["size", "brand", "words", "kind", "note"], _EXPECTED, ("words",)).alias("detail"))


@query(_EXTRACTED.replace("WHEN k > 80 THEN 'rule'", "WHEN k > 80 AND NOT (attempt >= 2 AND model_rank = 1) THEN 'rule'") + """
SELECT run_id, model_rank, attempt, outcome, (outcome IN ('schema', 'ground', 'rule') OR (outcome = 'ok' AND k > 80))::INT AS n_issues, CASE WHEN k > 80 AND outcome IN ('ok', 'rule') THEN 'attempt ' || (attempt + 1) || ' of 3 with ' || CASE WHEN attempt = 0 THEN 'low' ELSE 'high' END END AS message FROM a
""")
def contextual_rules(spark, sf):
    """A rule that rejects large values until the last attempt of the last model, where it only notes them."""
    def rule(r, at):
        told = F.concat(F.lit("attempt "), at["attempt"].cast("string"), F.lit(" of "), at["max_attempts"].cast("string"), F.lit(" with "), at["reasoning_effort"])
        large = rules.finding(r["k"] > 80, told, "k")
        return F.transform(rules.findings(large), lambda i: i.withField("rejecting", ~at["is_final"]))

    out = extraction.extracted(event_replies(spark, sf), VISIT, source=F.col("source"), rule=rules.contextual(rule), levels=("low", "high"))
    last = F.when(F.col("outcome").isin("ok", "rule"), F.get("issues", F.lit(0))["message"])
    return out.select("run_id", "model_rank", "attempt", "outcome", F.size("issues").alias("n_issues"), last.alias("message"))
