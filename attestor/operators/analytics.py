"""Quality analytics: which fields of which schemas fail, how, and whether they recover.

``runs``: run_id, schema_name, success, salvaged, field_issues array<struct<field_path, category, error_type,
attempt, received>>. ``bare``: single issues without a run. Every aggregate combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a failed or salvaged run weighs against one occurrence.
FAILED_WEIGHT = 10
MOST_SAMPLES = 5


def issue_rows(runs: DataFrame, bare: DataFrame | None = None) -> DataFrame:
    """One row for each issue with its run's outcome; bare issues have no run."""
    out = runs.select("run_id", "schema_name", "success", "salvaged", F.posexplode("field_issues").alias("pos", "issue")).select("run_id", "schema_name", "success", "salvaged", "pos", "issue.*")
    if bare is not None:
        out = out.unionByName(bare.withColumn("run_id", F.lit(None).cast(out.schema["run_id"].dataType)), allowMissingColumns=True)
    return out


def field_summary(runs: DataFrame, bare: DataFrame | None = None) -> DataFrame:
    """A row for each (schema, field): counts, recovery, average first attempt, severity."""
    rows = issue_rows(runs, bare)
    loose = F.col("run_id").isNull()
    each = rows.where(~loose).groupBy("run_id", "schema_name", "field_path", "success", "salvaged").agg(F.count("*").alias("n"), F.min("attempt").alias("first"))
    counted = each.withColumn("is_run", F.lit(1))
    if bare is not None:
        counted = counted.unionByName(rows.where(loose).select("schema_name", "field_path", F.lit(1).cast("long").alias("n"), F.col("attempt").alias("first"), F.lit(0).alias("is_run")), allowMissingColumns=True)
    run, ok, saved = F.col("is_run") == 1, F.col("success"), F.coalesce("salvaged", F.lit(False))
    out = counted.groupBy("schema_name", "field_path").agg(
        F.sum("n").alias("total_occurrences"),
        F.sum("is_run").cast("long").alias("runs_with_problem"),
        F.count_if(run & ~ok).alias("failed_runs_with_problem"),
        F.count_if(run & ok & saved).alias("salvaged_runs_with_problem"),
        F.coalesce(F.sum(F.when(run & ok & ~saved, F.col("n"))), F.lit(0)).alias("occurrences_on_successful_runs"),
        F.avg("first").alias("first_error_attempt_avg"),
    )
    lost = F.col("failed_runs_with_problem") + F.col("salvaged_runs_with_problem")
    return out.withColumn("recovery_rate", F.coalesce(F.try_divide(F.col("runs_with_problem") - lost, "runs_with_problem"), F.lit(0.0))).withColumn("severity", lost * FAILED_WEIGHT + F.col("total_occurrences"))


def field_samples(runs: DataFrame, bare: DataFrame | None = None) -> DataFrame:
    """First five distinct received values of each (schema, field), in order of run and position, bare ones last.

    The first place of each distinct value is a grouped minimum, and places are ranked within a field with a
    limit, which prunes before the shuffle; no list of a field's values is ever gathered whole.
    """
    rows = issue_rows(runs, bare).where("received is not null")
    place = F.struct(F.col("run_id").isNull().alias("loose"), F.col("run_id").alias("run"), F.coalesce("pos", F.lit(0)).alias("pos"))
    firsts = rows.groupBy("schema_name", "field_path", "received").agg(F.min(place).alias("place"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("schema_name", "field_path").orderBy("place", "received"))).where(F.col("rank") <= MOST_SAMPLES)
    return ranked.groupBy("schema_name", "field_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "received"))), lambda s: s["received"]).alias("samples"))


def schema_summary(runs: DataFrame, bare: DataFrame | None = None) -> DataFrame:
    """A row for each schema: runs, failures, success rate (salvaged count), clean rate (they don't)."""
    base = runs.select("schema_name", F.lit(1).alias("r"), (~F.col("success")).alias("f"), (F.col("success") & F.coalesce("salvaged", F.lit(False))).alias("s"))
    if bare is not None:
        base = base.unionByName(bare.select("schema_name", F.lit(0).alias("r"), F.lit(False).alias("f"), F.lit(False).alias("s")))
    out = base.groupBy("schema_name").agg(F.sum("r").alias("total_runs"), F.count_if("f").alias("failed_runs"), F.count_if("s").alias("salvaged_runs"))
    rate = lambda n: F.coalesce(F.try_divide(n, F.col("total_runs")), F.lit(0.0))
    return out.withColumn("success_rate", rate(F.col("total_runs") - F.col("failed_runs"))).withColumn("clean_success_rate", rate(F.col("total_runs") - F.col("failed_runs") - F.col("salvaged_runs")))


def histogram(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Counts by value within keys, and the share's place: the dominant value has rank 1, ties alphabetical."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value)))


def dominant(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The most frequent value of each group; the alphabetically first of ties."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(f"top_{value}"))


def ranked_fields(fields: DataFrame) -> DataFrame:
    """Report order of fields within their schema: most severe first, then by path."""
    return fields.withColumn("place", F.row_number().over(Window.partitionBy("schema_name").orderBy(F.desc("severity"), "field_path")))


def ranked_schemas(schemas: DataFrame, fields: DataFrame) -> DataFrame:
    """Report order of schemas: most failed runs, then most occurrences, then by name. One row for each schema."""
    total = fields.groupBy("schema_name").agg(F.sum("total_occurrences").alias("occurrences"))
    out = schemas.join(total, "schema_name", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("failed_runs"), F.desc("occurrences"), "schema_name")))


def escaped(c: Column) -> Column:
    """A text as a cell of a Markdown table."""
    return F.replace(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


#: The report's table head, and what stands where there is nothing.
_TABLE = "| Field | Category | Top error | Hits | In failed runs | Recovery | Samples |\n| --- | --- | --- | ---: | ---: | ---: | --- |"
_TITLE, _NOTHING, _NONE = "# Field issue report", "_No field issues recorded._", "—"
SHOWN_SAMPLES = 3


def markdown(schemas: DataFrame, fields: DataFrame, tops: DataFrame, samples: DataFrame) -> DataFrame:
    """One report section for each schema, with its place. ``tops``: top_category and top_error_type by (schema, field)."""
    rows = ranked_fields(fields).join(tops, ["schema_name", "field_path"], "left").join(samples, ["schema_name", "field_path"], "left")
    shown = F.array_join(F.transform(F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, SHOWN_SAMPLES), lambda x: F.concat(F.lit("`"), escaped(x), F.lit("`"))), ", ")
    line = F.format_string("| %s | %s | %s | %d | %d | %s | %s |", escaped(F.col("field_path")), F.coalesce("top_category", F.lit(_NONE)), F.coalesce("top_error_type", F.lit(_NONE)), "total_occurrences", "failed_runs_with_problem", percent(F.col("recovery_rate")), shown)
    body = rows.withColumn("line", line).groupBy("schema_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    saved = F.when(F.col("salvaged_runs") > 0, F.format_string(", %d salvaged", "salvaged_runs")).otherwise("")
    head = F.format_string("## %s — %s success (%d/%d runs failed%s)\n\n", "schema_name", percent(F.col("success_rate")), "failed_runs", "total_runs", saved)
    table = F.when(F.col("body").isNull(), F.lit(_NOTHING)).otherwise(F.concat(F.lit(_TABLE + "\n"), F.col("body")))
    return ranked_schemas(schemas, fields).join(body, "schema_name", "left").select("schema_name", "place", F.concat(head, table).alias("section"))


def report(sections: DataFrame) -> DataFrame:
    """The sections of ``markdown``, one for each schema, as one document; a note if there are none."""
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"]), "\n\n")
    return sections.agg(F.concat(F.lit(_TITLE + "\n\n"), F.when(F.count("*") > 0, F.concat(every, F.lit("\n"))).otherwise(_NOTHING)).alias("report"))


def console_summary(schemas: DataFrame, fields: DataFrame, first_errors: DataFrame, top_n: int = 5) -> DataFrame:
    """Lines (schema_name, line_no, line) of the worst ``top_n`` fields of each schema that has any. ``first_errors``: the
    most frequent error type by (schema, field), of ties the one seen first (see ``first_seen_error``)."""
    worst = ranked_fields(fields).where(F.col("place") <= top_n).join(first_errors, ["schema_name", "field_path"], "left")
    padded = lambda c: F.rpad(F.col(c).cast("string"), F.greatest(F.lit(3), F.length(F.col(c).cast("string"))), F.lit(" "))
    line = F.concat(F.lit("    "), F.rpad("field_path", F.greatest(F.lit(24), F.length("field_path")), F.lit(" ")), F.format_string(" hits=%s failed_runs=%s recovery=%s  top_error=%s", padded("total_occurrences"), padded("failed_runs_with_problem"), percent(F.col("recovery_rate")), F.coalesce("top_error", F.lit(_NONE))))
    head = schemas.join(fields.select("schema_name").distinct(), "schema_name", "left_semi")
    heads = head.select("schema_name", F.lit(0).alias("line_no"), F.format_string("  %s: %s success (%d/%d runs failed)", "schema_name", percent(F.col("success_rate")), "failed_runs", "total_runs").alias("line"))
    return heads.unionByName(worst.select("schema_name", F.col("place").alias("line_no"), line.alias("line")))


def first_seen_error(rows: DataFrame) -> DataFrame:
    """``top_error`` of each (schema, field): the most frequent error type; of ties the one that was seen first."""
    place = F.struct(F.col("run_id").isNull().alias("loose"), F.col("run_id").alias("run"), F.coalesce("pos", F.lit(0)).alias("pos"))
    counts = rows.groupBy("schema_name", "field_path", "error_type").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    return counts.groupBy("schema_name", "field_path").agg(F.min_by("error_type", F.struct(-F.col("n"), F.col("place"))).alias("top_error"))


def results_to_runs(results: DataFrame) -> DataFrame:
    """Benchmark results as runs: what ``field_summary`` and ``schema_summary`` take. No result counts as salvaged."""
    return results.select("run_id", "schema_name", "success", F.lit(False).alias("salvaged"), F.coalesce("field_issues", F.array().cast(results.schema["field_issues"].dataType)).alias("field_issues"))


def group_summary(results: DataFrame) -> DataFrame:
    """By group and scenario of a benchmark: results, successes, and the models that failed, in order."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("success"), F.col("model"))))
    return results.groupBy("group", "scenario").agg(F.count("*").alias("total"), F.count_if("success").alias("successes"), F.array_join(failed, ", ").alias("failed_models"))


def percent(c: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(c.cast("decimal(20,10)") * 100, 0).cast("int").cast("string"), F.lit("%"))


def speed_ranking(results: DataFrame) -> DataFrame:
    """Mean seconds of successful runs by model, fastest first."""
    out = results.where("success").groupBy("model").agg(F.avg("duration_s").alias("avg_s"), F.count("*").alias("n"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("avg_s", "model")))


def quality_ranking(results: DataFrame) -> DataFrame:
    out = results.groupBy("model").agg(F.count_if("success").alias("successes"), F.count("*").alias("total"))
    out = out.withColumn("rate", F.col("successes") / F.col("total"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), "model")))


def overall_ranking(results: DataFrame) -> DataFrame:
    """All figures by model in one pass: rate, one-shot share and retries of successes, field accuracy where checks are
    (columns correct and total), tokens where known."""
    ok = F.col("success")
    checked = [F.sum("correct").alias("correct_checks"), F.sum("total").alias("total_checks")] if {"correct", "total"} <= set(results.columns) else []
    out = results.groupBy("model").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successes"),
        F.count_if(ok & (F.col("retries") == 0)).alias("one_shot"), F.avg(F.when(ok, F.col("retries"))).alias("avg_retries"),
        F.avg(F.when(ok, F.col("duration_s"))).alias("avg_s"), F.sum("duration_s").alias("total_s"),
        F.avg("tokens_in").alias("avg_tokens_in"), F.avg("tokens_out").alias("avg_tokens_out"), *checked,
    )
    if checked:
        out = out.withColumn("field_accuracy", F.try_divide("correct_checks", "total_checks"))
    out = out.withColumn("rate", F.col("successes") / F.col("total")).withColumn("one_shot_rate", F.coalesce(F.try_divide("one_shot", "successes"), F.lit(0.0)))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), F.asc_nulls_last("avg_s"), "model")))


def token_totals(usage: Column, part: str) -> Column:
    """Sum of a part of a map of usage structs over its models; null counts as none."""
    return F.aggregate(F.map_values(usage), F.lit(0).cast("long"), lambda a, u: a + F.coalesce(u[part].cast("long"), F.lit(0).cast("long")))
