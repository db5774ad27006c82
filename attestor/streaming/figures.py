"""Quality figures of a stream of runs that equal those of a batch, however the stream is cut.

What is kept is a small table of partial figures: sums by field, counts by value, the first places of samples, sums by
schema. Partial figures of two sets of runs merge into those of both, so a batch adds its own to the last state and
writes the next one under its number; a batch that is run again writes the same state again. Each run arrives once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestor.operators.analytics import FAILED_WEIGHT, MOST_SAMPLES, issue_rows

_SUMS = ("total", "runs", "failed", "salvaged", "clean", "first_sum", "first_n")
_KEYS = ("kind", "schema_name", "field_path", "name", "value")


def partial_figures(runs: DataFrame) -> DataFrame:
    """Partial figures of ``runs`` (see ``operators.analytics``): one row for each field, each category and error type of a
    field, each of a field's first samples, and each schema."""
    rows = issue_rows(runs)
    saved = F.coalesce("salvaged", F.lit(False))
    each = rows.groupBy("run_id", "schema_name", "field_path", "success", "salvaged").agg(F.count("*").alias("n"), F.min("attempt").alias("first"))
    none = F.lit(None).cast("string")
    place = F.struct("run_id", "pos")
    no_place = F.lit(None).cast(rows.select(place.alias("p")).schema["p"].dataType)

    def made(df: DataFrame, kind: str, name=none, value=none, field=F.col("field_path"), at=no_place, **sums) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "schema_name", field.cast("string").alias("field_path"), name.alias("name"), value.cast("string").alias("value"), at.alias("place"), *[sums.get(s, F.lit(0)).cast("long").alias(s) for s in _SUMS])

    fields = made(each, "field", total=F.col("n"), runs=F.lit(1), failed=~F.col("success"), salvaged=F.col("success") & saved, clean=F.when(F.col("success") & ~saved, F.col("n")).otherwise(0), first_sum=F.coalesce("first", F.lit(0)), first_n=F.col("first").isNotNull())
    pairs = rows.select("schema_name", "field_path", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("category", "error_type")])))
    values = made(pairs, "value", F.col("name"), F.col("value"), total=F.lit(1))
    samples = made(rows.where("received is not null"), "sample", none, F.col("received"), at=place)
    schemas = made(runs.withColumn("field_path", none), "schema", runs=F.lit(1), failed=~F.col("success"), salvaged=F.col("success") & saved)
    return merged_figures(fields.unionByName(values).unionByName(samples).unionByName(schemas))


def merged_figures(*parts: DataFrame) -> DataFrame:
    """Partial figures of all the runs that some partial figures are of; no run may be in two of them."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    out = rows.groupBy(*_KEYS).agg(F.min("place").alias("place"), *[F.sum(s).alias(s) for s in _SUMS])
    # of samples only the first are kept: a later one in a part is a later one in the whole
    plain, samples = out.where("kind <> 'sample'"), out.where("kind = 'sample'")
    first = samples.withColumn("rank_", F.row_number().over(Window.partitionBy("schema_name", "field_path").orderBy("place", "value")))
    return plain.unionByName(first.where(F.col("rank_") <= MOST_SAMPLES).drop("rank_"))


def field_summary_of(figures: DataFrame) -> DataFrame:
    """What ``analytics.field_summary`` gives for the runs."""
    lost = F.col("failed") + F.col("salvaged")
    return figures.where("kind = 'field'").select(
        "schema_name", "field_path", F.col("total").alias("total_occurrences"), F.col("runs").alias("runs_with_problem"), F.col("failed").alias("failed_runs_with_problem"), F.col("salvaged").alias("salvaged_runs_with_problem"),
        F.col("clean").alias("occurrences_on_successful_runs"), F.try_divide(F.col("first_sum").cast("double"), "first_n").alias("first_error_attempt_avg"),
        F.coalesce(F.try_divide(F.col("runs") - lost, "runs"), F.lit(0.0)).alias("recovery_rate"), (lost * FAILED_WEIGHT + F.col("total")).alias("severity"),
    )


def field_samples_of(figures: DataFrame) -> DataFrame:
    """What ``analytics.field_samples`` gives for the runs."""
    rows = figures.where("kind = 'sample'").groupBy("schema_name", "field_path")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("samples"))


def dominant_of(figures: DataFrame, name: str) -> DataFrame:
    """What ``analytics.dominant`` gives for the runs' issues: the most frequent category or error_type of each field."""
    rows = figures.where((F.col("kind") == "value") & (F.col("name") == name)).groupBy("schema_name", "field_path")
    return rows.agg(F.min_by("value", F.struct((-F.col("total")).alias("n"), "value")).alias(f"top_{name}"))


def schema_summary_of(figures: DataFrame) -> DataFrame:
    """What ``analytics.schema_summary`` gives for the runs."""
    rate = lambda n: F.coalesce(F.try_divide(n, F.col("runs")), F.lit(0.0))
    return figures.where("kind = 'schema'").select(
        "schema_name", F.col("runs").alias("total_runs"), F.col("failed").alias("failed_runs"), F.col("salvaged").alias("salvaged_runs"), rate(F.col("runs") - F.col("failed")).alias("success_rate"), rate(F.col("runs") - F.col("failed") - F.col("salvaged")).alias("clean_success_rate")
    )


def _state(spark: SparkSession, folder: str) -> tuple[int, object]:
    """Number of the last whole state below ``folder`` (-1: none), and the file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [int(p.getName()[6:]) for p in found if p.getName().startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(whole, default=-1), fs


def keep_figures(runs: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the figures of a stream of completed runs below ``folder`` (shared, as ``checkpoint`` is). The last two states
    stay. ``trigger`` is as for ``DataStreamWriter.trigger``."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = partial_figures(batch)
        before = number - 1
        if number:
            own = merged_figures(spark.read.parquet(f"{folder}/batch={before}"), own)
        own.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        _, fs = _state(spark, folder)
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={number - 2}"), True)

    return runs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kept_figures(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of all batches so far."""
    last, _ = _state(spark, folder)
    if last < 0:
        raise ValueError(f"no figures below {folder}")
    return spark.read.parquet(f"{folder}/batch={last}")
