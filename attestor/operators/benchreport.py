"""A benchmark's report as lines of Markdown: rankings of models, then every result with its values held against what was
expected. Lines are rows, so the report of any number of results is written by a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.analytics import escaped, overall_ranking
from attestor.operators.scoring import cell, check_field, expected_cell

#: Marks of a field: right, partly right, wrong, nothing expected.
RIGHT, PARTLY, WRONG, OPEN = "🟢", "🟡", "🔴", "⚪"
_RANKING = ("| # | Model | Success | One-shot | Ø retries | Field accuracy | Ø time | Tokens in / out |", "|---|---|---|---|---|---|---|---|")
_RESULTS = ("| Model | OK | Time | Retries | Tokens in / out | Accuracy | Values |", "|---|---|---|---|---|---|---|")


def value_detail(record: Column, fields: list[str], expected: dict[str, object], lists: tuple[str, ...] = ()) -> Column:
    """The fields of a record, each with its mark, and what was expected where it is not all right; null fields that
    nothing is expected of are left out. A null record is a dash."""
    parts = []
    for name in fields:
        value = F.concat(F.lit("["), F.size(record[name]).cast("string"), F.lit("]")) if name in lists else cell(record[name])
        shown = F.concat(F.lit(f" {name}="), F.when(record[name].isNotNull(), value).otherwise("∅"))
        if name not in expected:
            parts.append(F.when(record[name].isNotNull(), F.concat(F.lit(OPEN), shown)))
            continue
        c = check_field(record[name], expected[name], name in lists)
        mark = F.when(c["correct"] >= c["total"], RIGHT).when(c["correct"] > 0, PARTLY).otherwise(WRONG)
        share = F.when(c["total"] > 1, F.concat(F.lit(" ("), c["correct"].cast("string"), F.lit("/"), c["total"].cast("string"), F.lit(")"))).otherwise("")
        wanted = F.when(c["correct"] < c["total"], f", expected: {expected_cell(expected[name])}").otherwise("")
        parts.append(F.concat(mark, shown, share, wanted))
    return F.when(record.isNull(), "—").otherwise(F.coalesce(F.nullif(F.concat_ws("<br>", *parts), F.lit("")), F.lit("—")))


def _share(part: Column, whole: Column) -> Column:
    percent = F.bround((part * 100).cast("decimal(30,10)") / whole, 0).cast("int").cast("string")
    return F.when(whole > 0, F.concat(part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(" ("), percent, F.lit("%)"))).otherwise("—")


def _tenth(c: Column) -> Column:
    return F.bround(c.cast("decimal(38,10)"), 1).cast("decimal(38,1)").cast("string")


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), *[x for c in cells for x in (c, F.lit(" | "))][:-1], F.lit(" |"))


def ranking_lines(results: DataFrame, title: str = "Ranking") -> DataFrame:
    """section 1: a title, a table's head and a line for each model, best first; place orders them."""
    r = overall_ranking(results)
    checks = _share(F.col("correct_checks"), F.col("total_checks")) if "correct_checks" in r.columns else F.lit("—")
    tokens = F.coalesce(F.concat(F.bround("avg_tokens_in", 0).cast("long").cast("string"), F.lit(" / "), F.bround("avg_tokens_out", 0).cast("long").cast("string")), F.lit("—"))
    line = _row(F.col("place").cast("string"), F.concat(F.lit("`"), "model", F.lit("`")), _share(F.col("successes"), F.col("total")), _share(F.col("one_shot"), F.col("successes")), F.coalesce(_tenth(F.col("avg_retries")), F.lit("—")), checks, F.coalesce(F.concat(_tenth(F.col("avg_s")), F.lit("s")), F.lit("—")), tokens)
    head = results.sparkSession.createDataFrame([(k - 3, t) for k, t in enumerate((f"## {title}", *_RANKING))], "place int, line string")
    rows = head.unionByName(r.select(F.col("place").cast("int").alias("place"), line.alias("line")))
    return rows.select(F.lit(1).alias("section"), F.lit("").alias("group"), F.lit("").alias("scenario"), "place", "line")


def result_lines(results: DataFrame) -> DataFrame:
    """section 2: for each group and scenario a title, a table's head and a line for each result, by model.

    ``results``: group, scenario, model, success, duration_s, retries, tokens_in, tokens_out, correct, total, detail (see
    ``value_detail``) and error; a failed run shows its error instead of values.
    """
    known = F.coalesce(F.concat(F.col("tokens_in").cast("string"), F.lit(" / "), F.col("tokens_out").cast("string")), F.lit("—"))
    right = F.when(F.col("total") > 0, F.concat(F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string"))).otherwise("—")
    shown = F.when(F.col("success"), F.coalesce("detail", F.lit("—"))).otherwise(F.concat(F.lit("ERROR: "), F.left(escaped(F.coalesce("error", F.lit("—"))), F.lit(80))))
    line = _row(F.concat(F.lit("`"), "model", F.lit("`")), F.when(F.col("success"), "✅").otherwise("❌"), F.concat(_tenth(F.col("duration_s")), F.lit("s")), F.col("retries").cast("string"), known, right, shown)
    nth = F.row_number().over(Window.partitionBy("group", "scenario").orderBy("model", line))
    rows = results.select("group", "scenario", nth.alias("place"), line.alias("line"))
    heads = results.select("group", "scenario").distinct().select("group", "scenario", F.inline(F.array(*[F.struct(F.lit(k - 3).alias("place"), t.alias("line")) for k, t in enumerate((F.concat(F.lit("### "), "group", F.lit(": "), "scenario"), *map(F.lit, _RESULTS)))])))
    return heads.unionByName(rows).select(F.lit(2).alias("section"), "group", "scenario", "place", "line")


def benchmark_report(results: DataFrame, title: str = "Benchmark report", issues: DataFrame | None = None) -> DataFrame:
    """All lines in order of section, group, scenario and place. ``issues`` are lines (place, line) to be put last, such as those
    of ``analytics.markdown``."""
    total = results.agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models"))
    told = (F.lit(f"# {title}"), F.concat(F.lit("- Runs: "), F.col("n").cast("string"), F.lit(" ("), F.col("ok").cast("string"), F.lit(" successful)")), F.concat(F.lit("- Models: "), "models"))
    head = total.select(F.posexplode(F.array(*told)).alias("place", "line")).select(F.lit(0).alias("section"), F.lit("").alias("group"), F.lit("").alias("scenario"), "place", "line")
    out = head.unionByName(ranking_lines(results)).unionByName(result_lines(results))
    if issues is not None:
        out = out.unionByName(issues.select(F.lit(3).alias("section"), F.lit("").alias("group"), F.lit("").alias("scenario"), F.col("place").cast("int").alias("place"), "line"))
    return out.orderBy("section", "group", "scenario", "place")
