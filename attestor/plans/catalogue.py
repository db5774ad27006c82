"""The registered queries over the shared tables, each with its SQL where SQL can say it.

The tables hold no replies, identifiers or tool calls, so inputs are derived from keys, the same way in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import replies, scalars, text
from attestor.functions.text import once
from attestor.operators import agent, analytics, grounding, replay, rules, scoring, toolcalls
from attestor.operators.schema import Field, RecordSchema, validate
from attestor.sources import messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flat(df: DataFrame, key: str, result) -> DataFrame:
    return df.select(key, result.alias("r")).select(key, "r.value", "r.error")


@query("""
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN d WHEN 1 THEN replace(d, '-', '.') WHEN 2 THEN left(d, 5) || '13-40' WHEN 3 THEN left(d, 5) || '02-30' WHEN 4 THEN d || 'T00:00' ELSE right(d, 5) END AS v FROM d)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN v END AS value,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 IN (2, 3) THEN 'not a real calendar date' ELSE 'expected YYYY-MM-DD' END AS error
FROM v
""")
def iso_date_check(spark, sf):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    n = F.col("o_orderkey") % 6
    v = F.when(n == 0, d).when(n == 1, F.replace(d, F.lit("-"), F.lit("."))).when(n == 2, F.concat(F.left(d, F.lit(5)), F.lit("13-40"))).when(n == 3, F.concat(F.left(d, F.lit(5)), F.lit("02-30"))).when(n == 4, F.concat(d, F.lit("T00:00"))).otherwise(F.right(d, F.lit(5)))
    return _flat(_t(spark, sf, "orders"), "o_orderkey", scalars.iso_date(v))


@query("""
WITH v AS (SELECT c_custkey, lpad(((c_custkey * 7) % 97 + 2)::VARCHAR, 2, '0') AS chk, lpad(c_custkey::VARCHAR, 18, '0') AS b FROM customer),
w AS (SELECT *, (b || '1314' || chk)::HUGEINT % 97 = 1 AS ok FROM v)
SELECT c_custkey, CASE WHEN ok THEN 'DE' || chk || b END AS value, CASE WHEN NOT ok THEN 'IBAN checksum is wrong' END AS error FROM w
""")
def iban_check(spark, sf):
    chk = F.lpad(((F.col("c_custkey") * 7) % 97 + 2).cast("string"), 2, "0")
    return _flat(_t(spark, sf, "customer"), "c_custkey", scalars.iban(F.concat(F.lit("de "), chk, F.lit(" "), F.lpad(F.col("c_custkey").cast("string"), 18, "0"))))


@query("""
WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'DE' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'ATU' || c_custkey WHEN 2 THEN 'D1' ELSE 'XX' END AS v FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(v, '[A-Z]{2}[A-Z0-9]{2,12}') THEN v END AS value, CASE WHEN NOT regexp_full_match(v, '[A-Z]{2}[A-Z0-9]{2,12}') THEN 'not a VAT id' END AS error FROM v
""")
def vat_id_check(spark, sf):
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, F.concat(F.lit("DE "), F.lpad(k.cast("string"), 9, "0"))).when(k % 4 == 1, F.concat(F.lit("at.u-"), k.cast("string"))).when(k % 4 == 2, F.lit("D1")).otherwise(F.lit("x x"))
    return _flat(_t(spark, sf, "customer"), "c_custkey", scalars.vat_id(v))


@query("""
WITH v AS (SELECT p_partkey, '3028' || lpad(p_partkey::VARCHAR, 9, '0') || (p_partkey % 10) AS d, 'US' || lpad(p_partkey::VARCHAR, 9, '0') || (p_partkey % 10) AS v FROM part),
s AS (SELECT *, list_sum(list_transform(range(1, 15), lambda i: CASE WHEN i % 2 = 0 THEN d[15 - i]::INT * 2 - CASE WHEN d[15 - i]::INT > 4 THEN 9 ELSE 0 END ELSE d[15 - i]::INT END)) % 10 = 0 AS ok FROM v)
SELECT p_partkey, CASE WHEN ok THEN v END AS value, CASE WHEN NOT ok THEN 'ISIN checksum is wrong' END AS error FROM s
""")
def isin_check(spark, sf):
    k = F.col("p_partkey")
    return _flat(_t(spark, sf, "part"), "p_partkey", scalars.isin(F.concat(F.lit("us "), F.lpad(k.cast("string"), 9, "0"), (k % 10).cast("string"))))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+4969' || c_custkey WHEN 1 THEN '+1415' || c_custkey END AS value,
       CASE WHEN c_custkey % 4 > 1 THEN 'not an international phone number' END AS error FROM customer
""")
def phone_check(spark, sf):
    k = F.col("c_custkey")
    s = k.cast("string")
    v = F.when(k % 4 == 0, F.concat(F.lit("0049 69/"), s)).when(k % 4 == 1, F.concat(F.lit("+1 (415) "), s)).when(k % 4 == 2, F.concat(F.lit("069 "), s)).otherwise(F.concat(F.lit("+0"), s))
    return _flat(_t(spark, sf, "customer"), "c_custkey", scalars.phone(v))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN lang END AS value, CASE WHEN doc_id % 3 = 2 OR lang IS NULL THEN 'not a language code' END AS error FROM documents
""")
def language_check(spark, sf):
    k, v = F.col("doc_id") % 3, F.col("lang")
    v = F.when(k == 0, F.upper(v)).when(k == 1, F.concat(F.lit(" "), v)).otherwise(F.concat(v, F.lit("x")))
    return _flat(_t(spark, sf, "documents"), "doc_id", scalars.language(v, scalars.language_codes(spark)))


@query("""
WITH v AS (SELECT n_nationkey, [ 'DE', 'GB', NULL, NULL ][n_nationkey % 4 + 1] AS country, [ 'EUR', 'USD', NULL, 'CHF', NULL ][n_nationkey % 5 + 1] AS currency FROM nation)
SELECT * FROM v
""")
def country_currency_check(spark, sf):
    pick = lambda values: F.get(F.array(*[F.lit(x) for x in values]), (F.col("n_nationkey") % len(values)).cast("int"))
    a, b = scalars.country(pick(["de", " gb ", "UK", "Germany"]), scalars.country_codes(spark)), scalars.currency(pick(["eur", "usd", "XYZ", "Chf", "€"]))
    return _t(spark, sf, "nation").select("n_nationkey", a["value"].alias("country"), b["value"].alias("currency"))


@query("""
SELECT c_custkey, ['FREQ=WEEKLY;BYDAY=MO,WE,FR', 'FREQ=DAILY;COUNT=10', NULL, NULL, NULL][c_custkey % 5 + 1] AS value, c_custkey % 5 < 2 AS valid FROM customer
""")
def rrule_check(spark, sf):
    given = ("FREQ=WEEKLY;BYDAY=MO,WE,FR", "FREQ=DAILY;COUNT=10", "on Mondays", "FREQ=SOMETIMES", "COUNT=3")
    pick = F.get(F.array(*[F.lit(x) for x in given]), (F.col("c_custkey") % 5).cast("int"))
    return _flat(_t(spark, sf, "customer"), "c_custkey", scalars.rrule(pick)).select("c_custkey", "value", F.col("error").isNull().alias("valid"))


def _replies(spark, sf):
    n, p = F.col("event_id") % 5, F.col("props")
    content = F.when(n == 0, p).when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 2, F.concat(F.lit("<think>{\"k\": -1}</think>\n"), p)).when(n == 3, F.concat(F.lit("The answer is "), p, F.lit(" as asked."))).otherwise(F.concat(F.rtrim(p, F.lit("}")), F.lit(", // done\n")))
    return _t(spark, sf, "events").select("event_id", content.alias("content"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def reply_parse(spark, sf):
    return _replies(spark, sf).select("event_id", replies.parsed("content").alias("p")).select("event_id", F.get_json_object("p.json", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events")
def reply_parse_strict(spark, sf):
    clean = text.strip_fence(text.strip_thinking(F.col("content")))
    return _replies(spark, sf).select("event_id", F.try_variant_get(F.try_parse_json(clean), "$.k", "long").alias("k"))


EVENT = RecordSchema("Event", [Field("k", "int", ge=10, le=90), Field("value", "float", ge=0), Field("kind", "str", choices=("view", "click", "purchase")), Field("active", "bool"), Field("note", "str", required=False, nullable=True)])


def _event_docs(spark, sf):
    e = _t(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    n = F.col("event_id") % 4
    shown = F.when(n == 0, k).when(n == 1, F.concat(F.lit('" '), k, F.lit('.0"'))).when(n == 2, F.concat(k, F.lit(".5"))).otherwise(F.lit('"many"'))
    flag = F.get(F.array(F.lit("true"), F.lit('"YES"'), F.lit("2"), F.lit("null"), F.lit("0")), (F.col("event_id") % 5).cast("int"))
    doc = F.concat(F.lit('{"k":'), shown, F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(',"value":'), F.lit('"1e3"'))), F.lit(',"kind":"'), F.col("event_type"), F.lit('","active":'), flag, F.lit("}"))
    return e.select("event_id", doc.alias("doc"))


@query("""
WITH e AS (SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, 'k' AS field_path, 'value' AS category, CASE WHEN k < 10 THEN 'greater_than_equal' ELSE 'less_than_equal' END AS error_type FROM e WHERE event_id % 4 < 2 AND (k < 10 OR k > 90)
UNION ALL SELECT event_id, 'k', 'other', 'int_from_float' FROM e WHERE event_id % 4 = 2
UNION ALL SELECT event_id, 'k', 'type', 'int_parsing' FROM e WHERE event_id % 4 = 3
UNION ALL SELECT event_id, 'value', 'missing', 'missing' FROM e WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 'kind', 'enum', 'literal_error' FROM e WHERE event_type NOT IN ('view', 'click', 'purchase')
UNION ALL SELECT event_id, 'active', 'type', CASE event_id % 5 WHEN 2 THEN 'bool_parsing' ELSE 'bool_type' END FROM e WHERE event_id % 5 IN (2, 3)
""")
def coercion_issues(spark, sf):
    out = _event_docs(spark, sf).select("event_id", F.explode(validate(F.col("doc"), EVENT)["issues"]).alias("i"))
    return out.select("event_id", "i.field_path", "i.category", "i.error_type")


@query("""
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, 1000.0::DOUBLE AS value, event_id % 5 IN (0, 1) AS active FROM events
WHERE event_id % 4 < 2 AND json_extract(props, '$.k')::BIGINT BETWEEN 10 AND 90 AND event_id % 7 <> 0 AND event_type IN ('view', 'click', 'purchase') AND event_id % 5 IN (0, 1, 4)
""")
def valid_records(spark, sf):
    out = _event_docs(spark, sf).select("event_id", validate(F.col("doc"), EVENT)["record"].alias("r")).where("r is not null")
    return out.select("event_id", F.col("r.k").cast("long").alias("k"), "r.value", "r.active")


def order_runs(spark, sf):
    """Orders as runs, their lines as issues."""
    issue = F.struct(F.col("l_returnflag").alias("field_path"), F.lower("l_linestatus").alias("category"), F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")).alias("error_type"), (F.col("l_linenumber") - 1).alias("attempt"), F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("int").cast("string")).alias("received"))
    lines = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", issue.alias("i")))).alias("s"))
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("schema_name"), (F.col("o_orderstatus") != "F").alias("success"), (F.col("o_orderstatus") == "P").alias("salvaged"))
    none = F.array().cast("array<struct<field_path:string,category:string,error_type:string,attempt:int,received:string>>")
    return orders.join(lines, F.col("run_id") == F.col("l_orderkey"), "left").select("run_id", "schema_name", "success", "salvaged", F.coalesce(F.transform("s", lambda x: x["i"]), none).alias("field_issues"))


_RUNS = """
WITH runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS schema_name, o_orderstatus <> 'F' AS success, o_orderstatus = 'P' AS salvaged FROM orders),
issues AS (SELECT r.*, l_returnflag AS field_path, lower(l_linestatus) AS category, 't' || (l_suppkey % 3) AS error_type, l_linenumber - 1 AS attempt,
                  CASE WHEN l_quantity > 5 THEN l_quantity::INT::VARCHAR END AS received, l_linenumber, l_partkey, l_suppkey FROM runs r JOIN lineitem ON l_orderkey = run_id)
"""


@query(_RUNS + """
, each AS (SELECT run_id, schema_name, field_path, success, salvaged, count(*) AS n, min(attempt) AS first FROM issues GROUP BY ALL)
SELECT schema_name, field_path, sum(n)::BIGINT AS total_occurrences, count(*) AS runs_with_problem, count(*) FILTER (NOT success) AS failed_runs_with_problem,
       count(*) FILTER (success AND salvaged) AS salvaged_runs_with_problem, coalesce(sum(n) FILTER (success AND NOT salvaged), 0)::BIGINT AS occurrences_on_successful_runs,
       round(avg(first), 9) AS first_error_attempt_avg, round(count(*) FILTER (success AND NOT salvaged) / count(*), 9) AS recovery_rate,
       (10 * count(*) FILTER (NOT success OR salvaged) + sum(n))::BIGINT AS severity
FROM each GROUP BY schema_name, field_path
""")
def issue_summary_field(spark, sf):
    return analytics.field_summary(order_runs(spark, sf)).withColumn("first_error_attempt_avg", F.round("first_error_attempt_avg", 9)).withColumn("recovery_rate", F.round("recovery_rate", 9))


@query(_RUNS + """
SELECT schema_name, count(*) AS total_runs, count(*) FILTER (NOT success) AS failed_runs, count(*) FILTER (success AND salvaged) AS salvaged_runs,
       round(count(*) FILTER (success) / count(*), 9) AS success_rate, round(count(*) FILTER (success AND NOT salvaged) / count(*), 9) AS clean_success_rate FROM runs GROUP BY schema_name
""")
def issue_summary_schema(spark, sf):
    return analytics.schema_summary(order_runs(spark, sf)).withColumn("success_rate", F.round("success_rate", 9)).withColumn("clean_success_rate", F.round("clean_success_rate", 9))


@query(_RUNS + """
, bare AS (SELECT event_type AS schema_name, 'value' AS field_path, event_id % 3 AS attempt FROM events)
SELECT event_type AS schema_name, 'value' AS field_path, count(*) AS total_occurrences, 0::BIGINT AS runs_with_problem, round(avg(event_id % 3), 9) AS first_error_attempt_avg, 0.0::DOUBLE AS recovery_rate, count(*) AS severity FROM events GROUP BY 1
""")
def bare_issue_summary(spark, sf):
    bare = _t(spark, sf, "events").select(F.col("event_type").alias("schema_name"), F.lit("value").alias("field_path"), F.lit("value").alias("category"), F.lit("t").alias("error_type"), (F.col("event_id") % 3).cast("int").alias("attempt"), F.col("props").alias("received"))
    out = analytics.field_summary(order_runs(spark, sf).where(F.lit(False)), bare)
    return out.select("schema_name", "field_path", "total_occurrences", "runs_with_problem", F.round("first_error_attempt_avg", 9).alias("first_error_attempt_avg"), "recovery_rate", "severity")


@query(_RUNS + """
, n AS (SELECT schema_name, field_path, error_type, count(*) AS n FROM issues GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY schema_name, field_path ORDER BY n DESC, error_type) AS k FROM n)
SELECT schema_name, field_path, error_type AS top_error_type FROM r WHERE k = 1
""")
def dominant_error(spark, sf):
    return analytics.dominant(analytics.issue_rows(order_runs(spark, sf)), "error_type", "schema_name", "field_path")


@query(_RUNS + """
, n AS (SELECT schema_name, category, count(*) AS n FROM issues GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY schema_name ORDER BY n DESC, category)::INT AS rank FROM n
""")
def category_histogram(spark, sf):
    return analytics.histogram(analytics.issue_rows(order_runs(spark, sf)), "category", "schema_name")


@query(_RUNS + """
, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM issues),
f AS (SELECT schema_name, field_path, received, min((run_id, pos)) AS place FROM o WHERE received IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY schema_name, field_path ORDER BY place, received) AS k FROM f)
SELECT schema_name, field_path, string_agg(received, '|' ORDER BY k) AS samples FROM r WHERE k <= 5 GROUP BY 1, 2
""")
def first_samples(spark, sf):
    return analytics.field_samples(order_runs(spark, sf)).withColumn("samples", F.array_join("samples", "|"))


@query(_RUNS + """
, each AS (SELECT run_id, schema_name, field_path, success, salvaged, count(*) AS n FROM issues GROUP BY ALL),
f AS (SELECT schema_name, field_path, 10 * count(*) FILTER (NOT success OR salvaged) + sum(n) AS severity FROM each GROUP BY ALL)
SELECT schema_name, field_path, row_number() OVER (PARTITION BY schema_name ORDER BY severity DESC, field_path)::INT AS place FROM f
""")
def ranked_fields(spark, sf):
    return analytics.ranked_fields(analytics.field_summary(order_runs(spark, sf))).select("schema_name", "field_path", "place")


@query(_RUNS + """
, each AS (SELECT run_id, schema_name, field_path, success, salvaged, count(*) AS n FROM issues GROUP BY ALL),
f AS (SELECT schema_name, field_path, sum(n)::BIGINT AS hits, count(*) FILTER (NOT success) AS lost, 10 * count(*) FILTER (NOT success OR salvaged) + sum(n) AS severity,
             round_even(100 * count(*) FILTER (success AND NOT salvaged) / count(*), 0)::INT AS recovery FROM each GROUP BY ALL),
cn AS (SELECT schema_name, field_path, category, count(*) AS n FROM issues GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY schema_name, field_path ORDER BY n DESC, category) AS k FROM cn),
tn AS (SELECT schema_name, field_path, error_type, count(*) AS n FROM issues GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY schema_name, field_path ORDER BY n DESC, error_type) AS k FROM tn),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM issues),
pn AS (SELECT schema_name, field_path, received, min((run_id, pos)) AS place FROM o WHERE received IS NOT NULL GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY schema_name, field_path ORDER BY place, received) AS k FROM pn),
samples AS (SELECT schema_name, field_path, string_agg('`' || received || '`', ', ' ORDER BY k) AS shown FROM p WHERE k <= 3 GROUP BY ALL),
lines AS (SELECT f.schema_name, string_agg('| ' || f.field_path || ' | ' || c.category || ' | ' || t.error_type || ' | ' || hits || ' | ' || lost || ' | ' || recovery || '% | ' || coalesce(shown, '') || ' |', chr(10) ORDER BY severity DESC, f.field_path) AS body
          FROM f JOIN c ON c.schema_name = f.schema_name AND c.field_path = f.field_path AND c.k = 1 JOIN t ON t.schema_name = f.schema_name AND t.field_path = f.field_path AND t.k = 1
               LEFT JOIN samples s ON s.schema_name = f.schema_name AND s.field_path = f.field_path GROUP BY f.schema_name),
s AS (SELECT schema_name, count(*) AS total, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success AND salvaged) AS saved, round_even(100 * count(*) FILTER (success) / count(*), 0)::INT AS rate FROM runs GROUP BY 1)
SELECT s.schema_name, '## ' || s.schema_name || ' — ' || rate || '% success (' || failed || '/' || total || ' runs failed' || CASE WHEN saved > 0 THEN ', ' || saved || ' salvaged' ELSE '' END || ')' || chr(10) || chr(10)
       || '| Field | Category | Top error | Hits | In failed runs | Recovery | Samples |' || chr(10) || '| --- | --- | --- | ---: | ---: | ---: | --- |' || chr(10) || body AS section
FROM s JOIN lines USING (schema_name)
""")
def markdown_report(spark, sf):
    runs = order_runs(spark, sf)
    rows = analytics.issue_rows(runs)
    tops = analytics.dominant(rows, "category", "schema_name", "field_path").join(analytics.dominant(rows, "error_type", "schema_name", "field_path"), ["schema_name", "field_path"])
    return analytics.markdown(analytics.schema_summary(runs), analytics.field_summary(runs), tops, analytics.field_samples(runs)).drop("place")


def event_attempts(spark, sf):
    """Each user's events as attempts, odd ones of the fallback model; the replay keeps to its budgets."""
    rank = (F.col("event_id") % 2).cast("int")
    e = _t(spark, sf, "events").withColumn("rank", rank)
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "rank").orderBy("ts", "event_id")))
    outcome = F.create_map(*[F.lit(x) for x in ("purchase", "ok", "view", "schema", "click", "parse", "signup", "rule", "error", "llm_error")])[F.col("event_type")]
    return e.select(F.col("user_id").alias("run_id"), F.col("rank").alias("model_rank"), (F.col("n") - 1).alias("attempt"), outcome.alias("outcome"), F.when(outcome == "llm_error", replay.error_kind(F.lit("ReadTimeout"))).alias("error_kind"), F.col("event_id").cast("string").alias("record"))


_ATTEMPTS = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT user_id AS run_id, (event_id % 2)::INT AS model_rank, (n - 1)::INT AS attempt, event_id::VARCHAR AS record,
             CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'schema' WHEN 'click' THEN 'parse' WHEN 'signup' THEN 'rule' ELSE 'llm_error' END AS outcome FROM n),
b AS (SELECT *, coalesce(bool_or(outcome IN ('ok', 'llm_error')) OVER (PARTITION BY run_id, model_rank ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM a),
c AS (SELECT *, bool_or(model_rank = 0 AND outcome = 'ok') OVER (PARTITION BY run_id) AS won FROM b WHERE NOT ended AND attempt < 3),
live AS (SELECT * FROM c WHERE model_rank = 0 OR NOT won)
"""


@query(_ATTEMPTS + """
, g AS (SELECT run_id, bool_or(outcome = 'ok') AS success, count(*) FILTER (outcome IN ('parse', 'schema', 'rule') AND model_rank = 0) AS primary_retries,
               count(*) FILTER (outcome IN ('parse', 'schema', 'rule') AND model_rank = 1) AS fallback_retries, count(*) FILTER (outcome = 'parse') AS format_errors, count(*) AS attempts_made,
               arg_max(outcome, model_rank * 10 + attempt) AS last, arg_max(model_rank, model_rank * 10 + attempt) AS last_rank, arg_max(record, model_rank * 10 + attempt) FILTER (outcome = 'rule') AS candidate
        FROM live GROUP BY run_id)
SELECT run_id, success, primary_retries, fallback_retries, format_errors, attempts_made,
       CASE WHEN success THEN NULL WHEN last = 'parse' THEN 'parse_error' WHEN last = 'llm_error' THEN 'llm_error' ELSE 'validation_exhausted' END AS failure_reason,
       CASE WHEN NOT success AND last = 'llm_error' THEN 'timeout' END AS llm_error_kind, NOT (success AND last_rank = 0) AS fallback_used, CASE WHEN NOT success THEN candidate END AS candidate
FROM g
""")
def replay_runs(spark, sf):
    a = event_attempts(spark, sf)
    return replay.replay(a, a.select("run_id").distinct())


@query(_ATTEMPTS + "SELECT run_id, model_rank, attempt, outcome, ['low', 'high'][least(attempt + 1, 2)] AS effort FROM live")
def live_attempts(spark, sf):
    return replay.live_attempts(event_attempts(spark, sf)).select("run_id", "model_rank", "attempt", "outcome", replay.effort(["low", "high"], F.col("attempt")).alias("effort"))


@query(_ATTEMPTS + "SELECT run_id % 10 AS bucket, count(DISTINCT run_id) AS runs, count(*) FILTER (outcome = 'ok') AS successes, count(*) FILTER (outcome = 'parse') AS format_errors FROM live GROUP BY 1")
def merged_stats(spark, sf):
    a = event_attempts(spark, sf)
    stats = replay.replay(a, a.select("run_id").distinct()).withColumn("bucket", F.col("run_id") % 10)
    return replay.merged_stats(stats, "bucket").select("bucket", "runs", "successes", "format_errors")


@query("""
WITH o AS (SELECT l_orderkey, l_returnflag, min(l_linenumber::BIGINT * 1000000000 + l_partkey) AS place FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS run_id, string_agg(l_returnflag, ',' ORDER BY place) AS fields FROM o GROUP BY 1
""")
def problem_fields(spark, sf):
    """Flags of each order's lines, whether or not the order is there; flags without a place come last. Flags of equal
    place, which the SQL leaves open, are taken as they first come in the table, as DuckDB does on one thread."""
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_returnflag", (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("place"), F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))
    flags = lines.groupBy("run_id", "l_returnflag").agg(F.min("place").alias("place"), F.min("row").alias("row"))
    flag = F.struct(F.col("place").isNull().alias("last"), "place", "row", F.struct(F.col("l_returnflag").alias("field_path")).alias("i"))
    runs = flags.groupBy("run_id").agg(F.array_sort(F.collect_list(flag)).alias("s"))
    fields = F.array_compact(replay.problem_fields(F.transform("s", lambda x: x["i"])))
    return once(runs, fields=fields).select("run_id", F.when(F.size("fields") > 0, F.array_join("fields", ",")).alias("fields"))


@query("""
WITH RECURSIVE kinds AS (SELECT DISTINCT event_id % 12 AS g, event_id % 6 + 1 AS n FROM events),
f AS (
  SELECT g, n, 0 AS i, 0 AS retries, 0.0::DOUBLE AS waited, 0.0::DOUBLE AS limited, false AS gave_up FROM kinds
  UNION ALL
  SELECT g, n, i + 1,
         retries + CASE WHEN kind IN (0, 2) AND retries < 3 THEN 1 ELSE 0 END,
         waited + CASE WHEN kind = 1 AND limited < 900 THEN 10.0 WHEN kind IN (0, 2) AND retries < 3 THEN [1.0, 2.0, 4.0][retries + 1] ELSE 0.0 END,
         limited + CASE WHEN kind = 1 AND limited < 900 THEN 10.0 ELSE 0.0 END,
         kind = 3 OR (kind = 1 AND limited >= 900) OR (kind IN (0, 2) AND retries >= 3)
  FROM (SELECT *, (g + i) % 4 AS kind FROM f) WHERE NOT gave_up AND i < n
), last AS (SELECT g, arg_max(retries, i) AS retries, arg_max(waited, i) AS waited, arg_max(gave_up, i) AS gave_up FROM f GROUP BY g)
SELECT event_id, retries, waited::DOUBLE AS waited, gave_up FROM events JOIN last ON g = event_id % 12
""")
def network_retries(spark, sf):
    kinds = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 6).cast("int")), lambda i: F.get(F.array(F.lit("timeout"), F.lit("rate_limit"), F.lit("server_error"), F.lit("other")), ((F.col("event_id") + i) % 4).cast("int")))
    return _t(spark, sf, "events").select("event_id", replay.network_retry(kinds).alias("r")).select("event_id", "r.retries", "r.waited", "r.gave_up")


def middle(text):
    """The 24 characters in the middle of a text, or all of a shorter one."""
    return F.substring(text, F.greatest((F.length(text) / 2).cast("int") - 11, F.lit(1)), F.lit(24))


def quoted_pairs(spark, sf):
    """Pieces of documents and where they may stand: in their own document, and in the one with the next id."""
    docs = _t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = docs.select("doc_id", middle(F.col("text")).alias("piece"))
    beside = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.lit(True).alias("next"), "text").unionByName(docs.select("doc_id", F.lit(False).alias("next"), "text"))
    return own.join(beside, "doc_id")


_PAIRS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, substr(coalesce(text, ''), greatest(length(coalesce(text, '')) // 2 - 11, 1), 24) AS piece FROM documents),
pairs AS (SELECT a.doc_id, false AS next, a.piece, a.text FROM d a UNION ALL SELECT a.doc_id, true, a.piece, b.text FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
"""


@query(_PAIRS + "SELECT doc_id, next, contains(text, piece) AS found FROM pairs")
def ground_exact(spark, sf):
    return quoted_pairs(spark, sf).select("doc_id", "next", grounding.Grounded("exact").holds(F.col("piece"), F.col("text")).alias("found"))


@query(_PAIRS + """
, f AS (SELECT doc_id, next, replace(lower(strip_accents(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 'ß', 'ss') AS text, replace(lower(strip_accents(trim(regexp_replace(piece, '\\s+', ' ', 'g')))), 'ß', 'ss') AS v FROM pairs)
SELECT doc_id, next, contains(text, v) AS found FROM f
""")
def ground_normalized(spark, sf):
    loud = F.regexp_replace(F.upper("piece"), " ", "  ")
    return quoted_pairs(spark, sf).select("doc_id", "next", grounding.Grounded().holds(loud, F.col("text")).alias("found"))


@query("SELECT o_orderkey, o_orderkey % 4 < 3 AS found FROM orders")
def number_forms_grounding(spark, sf):
    v = F.col("o_totalprice").cast("decimal(15,2)")
    n, plain = F.col("o_orderkey") % 4, v.cast("string")
    english = F.format_number(v, 2)
    german = F.translate(english, ",.", ".,")
    source = F.concat(F.lit("Betrag:  "), F.when(n == 0, german).when(n == 1, english).when(n == 2, plain).otherwise("unbekannt"), F.lit(" EUR"))
    rows = once(_t(spark, sf, "orders"), plain=plain, source=source, forms=grounding.number_forms(v, plain, "de"))
    return rows.select("o_orderkey", grounding.Grounded().holds(F.col("plain"), F.col("source"), F.col("forms")).alias("found"))


@query("SELECT o_orderkey, o_orderkey % 4 < 3 AS found FROM orders")
def date_forms_grounding(spark, sf):
    d, n = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    source = F.when(n == 0, F.date_format(d, "dd.MM.yyyy")).when(n == 1, F.concat(F.lit("on "), F.date_format(d, "MMMM d, yyyy"))).when(n == 2, F.date_format(d, "d MMM yyyy")).otherwise("no date")
    rows = once(_t(spark, sf, "orders"), plain=d.cast("string"), source=source, forms=grounding.date_forms(d))
    return rows.select("o_orderkey", grounding.Grounded().holds(F.col("plain"), F.col("source"), F.col("forms")).alias("found"))


@query()
def ground_fuzzy(spark, sf):
    """Pieces with every e misread; tested against a search cell by cell."""
    return quoted_pairs(spark, sf).select("doc_id", "next", grounding.Grounded("fuzzy", threshold=0.7).holds(F.regexp_replace("piece", "e", "c"), F.col("text")).alias("found"))


@query("""
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user' AND text <> '') AS source FROM conversations GROUP BY conv_id
""")
def source_text(spark, sf):
    return messages.message_arrays(_t(spark, sf, "conversations")).select("conv_id", messages.source_text(F.col("messages")).alias("source"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_assistant(spark, sf):
    return messages.last_assistant(_t(spark, sf, "conversations"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system')
SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END, chr(10) ORDER BY turn) AS context FROM r WHERE k <= 5 GROUP BY conv_id
""")
def context_lines(spark, sf):
    return messages.context_lines(_t(spark, sf, "conversations"), 5, 60)


def event_calls(spark, sf):
    """Events as assistant messages with one tool call each; some are malformed, nameless or without an id."""
    e, k = _t(spark, sf, "events"), F.col("event_id")
    call = F.struct(F.when(k % 11 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("id"), F.when(k % 13 != 0, F.col("event_type")).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("<think>x</think>"), F.col("props"))).when(k % 5 == 0, F.lit("[1]")).otherwise(F.col("props")).alias("args"), F.lit("bad").alias("error"))
    none = F.array().cast("array<struct<id:string,name:string,args:string,error:string>>")
    bad = (k % 3 == 0) | (k % 5 == 0) | (k % 13 == 0)
    return e.select(F.col("user_id").alias("conv_id"), k.alias("turn"), F.when(~bad, F.array(call)).otherwise(none).alias("calls"), F.when(bad, F.array(call)).otherwise(none).alias("invalid_calls"))


def event_tools(spark):
    return spark.createDataFrame([("view", ["k"]), ("click", ["k", "who"]), ("purchase", None)], "name string, fields array<string>")


@query("""
WITH c AS (SELECT event_type, event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 13 = 0 AS bad, event_id % 11 <> 0 AS has_id, event_id % 13 <> 0 AS has_name,
                  event_id % 3 = 0 OR event_id % 5 <> 0 AS readable FROM events),
p AS (SELECT CASE WHEN has_name THEN event_type END AS name, has_id, bad AND has_id AND has_name AND readable AS repaired, has_id AND (NOT bad OR (has_name AND readable)) AS recoverable FROM c),
r AS (SELECT *, recoverable AND coalesce(name, '') <> 'click' AS executable FROM p)
SELECT name, count(*) AS calls, count(*) FILTER (executable) AS executed_calls, count(*) FILTER (NOT executable AND has_id) AS feedback_calls, count(*) FILTER (NOT executable AND NOT has_id) AS dropped_calls, count(*) FILTER (repaired) AS repaired_calls FROM r GROUP BY name
""")
def tool_outcomes(spark, sf):
    resolved = toolcalls.resolve(toolcalls.plan_calls(event_calls(spark, sf), event_tools(spark)))
    return toolcalls.call_stats(resolved, "name").select("name", "calls", "executed_calls", "feedback_calls", "dropped_calls", "repaired_calls")


@query("""
WITH c AS (SELECT user_id AS conv_id, event_id AS turn, event_type, props, event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 13 = 0 AS bad, 'c' || event_id AS id, event_id % 13 <> 0 AS has_name, event_id % 3 = 0 OR event_id % 5 <> 0 AS readable,
                  CASE WHEN event_id % 3 = 0 THEN '<think>x</think>' || props WHEN event_id % 5 = 0 THEN '[1]' ELSE props END AS raw FROM events WHERE event_id % 11 <> 0)
SELECT conv_id, turn, id, 0 AS pos,
  CASE WHEN bad AND NOT has_name THEN 'The call has no tool name and was not executed.' || chr(10) || 'Error: bad' || chr(10) || 'Arguments received:' || chr(10) || raw || chr(10) || 'Call again with a tool''s name.'
       WHEN bad AND NOT readable THEN 'The arguments for ''' || event_type || ''' could not be read as one JSON object; the call was not executed.' || chr(10) || 'Error: bad' || chr(10) || 'Arguments received:' || chr(10) || raw
            || CASE event_type WHEN 'view' THEN chr(10) || 'Expected: k' WHEN 'click' THEN chr(10) || 'Expected: k, who' ELSE '' END
       WHEN event_type = 'click' AND has_name THEN 'The arguments for ''click'' don''t fit its schema; the call was not executed.' || chr(10) || 'Missing: who'
       ELSE 'done' END AS content
FROM c
""")
def tool_answers(spark, sf):
    resolved = toolcalls.resolve(toolcalls.plan_calls(event_calls(spark, sf), event_tools(spark)))
    results = resolved.where("outcome = 'executed'").select("conv_id", "turn", "id", F.lit("done").alias("content"))
    return toolcalls.answers(resolved, results)


@query("""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
r AS (
  SELECT DISTINCT user_id, 0 AS n, 0 AS retries, 0 AS helpers, NULL::VARCHAR AS reason, false AS success, NULL::VARCHAR AS answer, NULL::VARCHAR AS candidate, false AS done FROM e
  UNION ALL
  SELECT r.user_id, r.n + 1, retries + CASE WHEN event_type IN ('error', 'signup') AND retries < 3 THEN 1 ELSE 0 END, helpers + CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END,
         CASE event_type WHEN 'error' THEN 'no_tool_call' WHEN 'signup' THEN 'validation_exhausted' ELSE reason END, event_type = 'purchase', CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END,
         CASE WHEN event_type = 'signup' THEN event_id::VARCHAR ELSE candidate END, event_type = 'purchase' OR (event_type IN ('error', 'signup') AND retries >= 3)
  FROM r JOIN e ON e.user_id = r.user_id AND e.nth = r.n + 1 WHERE NOT done AND r.n < 12
), last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM r)
SELECT user_id AS run_id, success, n AS iterations, retries AS validation_retries, 0 AS format_errors, helpers AS tool_calls, CASE WHEN NOT success THEN coalesce(reason, 'validation_exhausted') END AS failure_reason,
       answer AS record, CASE WHEN NOT success THEN candidate END AS candidate FROM last WHERE k = 1
""")
def agent_runs(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = _t(spark, sf, "events").withColumn("turn", n)
    final = F.when(F.col("event_type") == "purchase", "ok").otherwise("rule")
    call = F.struct(F.when(F.col("event_type").isin("purchase", "signup"), "final").otherwise("helper").alias("kind"), final.alias("outcome"), F.col("event_id").cast("string").alias("record"))
    kind = F.when(F.col("event_type") == "error", "none").otherwise("calls")
    return agent.replay_agent(e.select(F.col("user_id").alias("run_id"), "turn", kind.alias("kind"), F.when(kind == "calls", F.array(call)).otherwise(F.array().cast("array<struct<kind:string,outcome:string,record:string>>")).alias("calls")))


def bench_results(spark, sf):
    return _t(spark, sf, "lineitem").select(F.concat(F.lit("m"), (F.col("l_partkey") % 15).cast("string")).alias("model"), (F.col("l_returnflag") != "R").alias("success"), F.col("l_quantity").alias("duration_s"), (F.col("l_linenumber") - 1).alias("retries"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).alias("tokens_in"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("tokens_out"))


_RESULTS = "WITH r AS (SELECT 'm' || (l_partkey % 15) AS model, l_returnflag <> 'R' AS success, l_quantity AS duration_s, l_linenumber - 1 AS retries, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey END AS tokens_in, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS tokens_out FROM lineitem)"


@query(_RESULTS + """, g AS (SELECT model, avg(duration_s) AS s, count(*) AS n FROM r WHERE success GROUP BY model) SELECT model, round(s, 6) AS avg_s, n, row_number() OVER (ORDER BY s, model)::INT AS place FROM g""")
def speed_ranking(spark, sf):
    return analytics.speed_ranking(bench_results(spark, sf)).withColumn("avg_s", F.round("avg_s", 6))


@query(_RESULTS + """, g AS (SELECT model, count(*) FILTER (success) AS successes, count(*) AS total FROM r GROUP BY model) SELECT *, round(successes / total, 9) AS rate, row_number() OVER (ORDER BY successes / total DESC, model)::INT AS place FROM g""")
def quality_ranking(spark, sf):
    return analytics.quality_ranking(bench_results(spark, sf)).withColumn("rate", F.round("rate", 9))


@query(_RESULTS + """
, g AS (SELECT model, count(*) AS total, count(*) FILTER (success) AS successes, count(*) FILTER (success AND retries = 0) AS one_shot, round(avg(retries) FILTER (success), 9) AS avg_retries, round(avg(duration_s) FILTER (success), 6) AS avg_s,
               sum(duration_s) AS total_s, round(avg(tokens_in), 6) AS avg_tokens_in, round(avg(tokens_out), 6) AS avg_tokens_out FROM r GROUP BY model)
SELECT *, round(successes / total, 9) AS rate, round(one_shot / successes, 9) AS one_shot_rate, row_number() OVER (ORDER BY successes / total DESC, avg_s, model)::INT AS place FROM g
""")
def overall_ranking(spark, sf):
    out = analytics.overall_ranking(bench_results(spark, sf))
    for c, n in (("avg_retries", 9), ("avg_s", 6), ("avg_tokens_in", 6), ("avg_tokens_out", 6), ("rate", 9), ("one_shot_rate", 9)):
        out = out.withColumn(c, F.round(c, n))
    return out


@query("""
SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + 1 + (CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice BETWEEN 50000 AND 200000 THEN 1 ELSE 0 END) END)::BIGINT AS correct, 4::BIGINT AS total FROM orders
""")
def field_accuracy(spark, sf):
    price = F.col("o_totalprice")
    checks = [
        scoring.equals_text(F.concat(F.lit(" "), F.upper("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("none")),
        scoring.equals_number((price * (1 + 1e-8)).cast("string"), price), scoring.at_least(price, 100000), scoring.between(price, 50000, 200000),
    ]
    return _t(spark, sf, "orders").select("o_orderkey", scoring.accuracy(F.col("o_orderstatus") != "F", *checks).alias("a")).select("o_orderkey", "a.correct", "a.total")


@query("""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, list_value(upper(p_name[1:4]), 'Zz', ' ' || p_brand) AS e FROM part)
SELECT p_partkey, len(list_filter(e, lambda x: len(list_filter(a, lambda y: contains(replace(lower(trim(y)), ' ', ''), replace(lower(trim(x)), ' ', '')) OR contains(replace(lower(trim(x)), ' ', ''), replace(lower(trim(y)), ' ', '')))) > 0))::BIGINT AS correct, 3::BIGINT AS total FROM p
""")
def scalar_list_match(spark, sf):
    expected = F.array(F.upper(F.substr("p_name", F.lit(1), F.lit(4))), F.lit("Zz"), F.concat(F.lit(" "), F.col("p_brand")))
    return _t(spark, sf, "part").select("p_partkey", scoring.scalar_list(F.split("p_name", " "), expected).alias("s")).select("p_partkey", "s.correct", "s.total")


@query("""
WITH c AS (SELECT c_custkey, [('own' || c_custkey % 3, 'mon'), ('own' || c_custkey % 5, 'tue'), ('own' || c_custkey % 3, 'wed')] AS actual FROM customer)
SELECT c_custkey, (list_max(list_transform(actual, lambda a: CASE WHEN a[1] = 'own' || c_custkey % 3 THEN 1 + (a[2] = 'wed')::INT ELSE 0 END))
                 + list_max(list_transform(actual[1:2], lambda a: CASE WHEN a[1] = 'own' || c_custkey % 5 THEN 1 + (a[2] = 'mon')::INT ELSE 0 END)))::BIGINT AS correct, 5::BIGINT AS total FROM c
""")
def object_list_match(spark, sf):
    owner = lambda k: F.concat(F.lit("own"), (F.col("c_custkey") % k).cast("string"))
    item = lambda o, d: F.create_map(F.lit("owner"), o, F.lit("due"), d)
    actual = F.array(item(owner(3), F.lit("mon")), item(owner(5), F.lit("tue")), item(owner(3), F.lit("wed")))
    expected = F.array(item(owner(3), F.lit("wed")), item(owner(5), F.lit("mon")))
    return _t(spark, sf, "customer").select("c_custkey", scoring.object_list(actual, expected, ["owner", "due"]).alias("s")).select("c_custkey", "s.correct", "s.total")


@query("""
SELECT l_orderkey, count(*) AS n_items, count(*) FILTER (l_quantity <= 45) AS n_kept, coalesce(sum(l_quantity) FILTER (l_quantity <= 45), 0)::DOUBLE AS kept FROM lineitem GROUP BY 1
""")
def item_salvage(spark, sf):
    orders = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("items"))
    found = rules.item_rules(F.col("items"), lambda x: rules.findings(rules.finding(x > 45, "too many", value=x), rules.finding(x < 3, "few", reject=False)))
    kept = rules.kept_items(F.col("items"), found)
    return orders.select("l_orderkey", F.size("items").cast("long").alias("n_items"), F.size(kept).cast("long").alias("n_kept"), F.aggregate(kept, F.lit(0.0), lambda a, x: a + x).alias("kept"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'grounding' WHEN o_totalprice > 150000 THEN 'rules' END AS stage, o_orderstatus <> 'F' AND o_totalprice <= 150000 AS accepted,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE (CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) END::INT AS n_issues FROM orders
""")
def candidate_checks(spark, sf):
    price = F.col("o_totalprice")
    ground = rules.findings(rules.finding(F.col("o_orderstatus") == "F", "not in the source", "status"))
    user = rules.findings(rules.finding(price > 150000, "too dear", "price"), rules.finding(price > 100000, "rather dear", "price", reject=False))
    return _t(spark, sf, "orders").select("o_orderkey", rules.check_candidate(ground, user).alias("c")).select("o_orderkey", "c.stage", "c.accepted", F.size("c.issues").alias("n_issues"))


@query("SELECT s AS scenario, m AS model FROM (SELECT DISTINCT event_type AS s FROM events) CROSS JOIN (SELECT DISTINCT c_mktsegment AS m FROM customer)")
def benchmark_grid(spark, sf):
    return messages.benchmark_grid(_t(spark, sf, "events").select(F.col("event_type").alias("scenario")).distinct(), _t(spark, sf, "customer").select(F.col("c_mktsegment").alias("model")).distinct())


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Events as replies, three attempts a user: parse, validate, replay the runs, and sum up which fields fail."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = _t(spark, sf, "events").withColumn("attempt", n - 1).where("attempt < 3")
    schema = RecordSchema("Props", [Field("k", "int", ge=0, le=90)])
    checked = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("schema_name"), "attempt", validate(F.col("props"), schema).alias("v"))
    issues = F.transform("v.issues", lambda i: F.struct(i["field_path"].alias("field_path"), i["category"].alias("category"), i["error_type"].alias("error_type"), F.col("attempt").cast("int").alias("attempt"), i["received"].alias("received")))
    ended = F.coalesce(F.max(F.col("v.record").isNotNull()).over(Window.partitionBy("run_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    live = checked.withColumn("ended", ended).where(~F.col("ended")).withColumn("i", issues)
    runs = live.groupBy("run_id").agg(F.min_by("schema_name", "attempt").alias("schema_name"), F.max(F.col("v.record").isNotNull()).alias("success"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "i"))), lambda x: x["i"])).alias("field_issues")).withColumn("salvaged", F.lit(False))
    return analytics.field_summary(runs)
