import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import analytics, replay
from attestor.streaming import figures, replays

OUTCOMES = ["ok", "parse", "schema", "ground", "rule", "llm_error", "crash"]


def attempts(seed, runs=60):
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    rows = []
    for run in range(runs):
        for rank in (0, 1):
            for n in range(rng.choice([0, 1, 2, 3, 5]) if rank else rng.randrange(1, 5)):
                outcome = rng.choices(OUTCOMES, [1, 3, 3, 2, 2, 1, 0.3])[0]
                rows.append((run, rank, n, outcome, "timeout" if outcome == "llm_error" and rng.random() < 0.5 else None, f"r{run}.{rank}.{n}", start + datetime.timedelta(seconds=rng.randrange(300))))
    return rows


SCHEMA = "run_id long, model_rank int, attempt int, outcome string, error_kind string, record string, at timestamp"


def test_told_equals_replay(spark):
    for fallback, budgets in ((True, (3, 2)), (False, (3,)), (True, (3, 0))):
        rows = attempts(3)
        df = spark.createDataFrame(rows, SCHEMA)
        want = {r.run_id: tuple(r[c] for c in ("success", "primary_retries", "fallback_retries", "format_errors", "attempts_made", "failure_reason", "llm_error_kind", "fallback_used", "candidate")) for r in replay.replay(df, df.select("run_id").distinct(), 3, budgets[1] if fallback else 0, fallback).collect()}
        held = {}
        for run, rank, n, outcome, kind, record, _ in rows:
            held.setdefault(run, {})[rank, n] = (outcome, kind, record)
        assert {run: replays.told(a, budgets) for run, a in held.items()} == want
        # what has ended stays as it is, whatever comes
        for a in held.values():
            if replays.ended(a, budgets):
                now = replays.told(a, budgets)
                later = {(r, n): ("ok", None, "late") for r, n in itertools.product((0, 1), range(9))} | a
                assert replays.told(later, budgets) == now


def test_stream_equals_replay_under_any_order(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = attempts(8)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in replay.replay(df, df.select("run_id").distinct(), 3, 2).select("run_id", "success", "primary_retries", "fallback_retries", "format_errors", "attempts_made", "failure_reason", "llm_error_kind", "fallback_used", "candidate").collect()}
    shuffled = rows + rows[::7]  # some come twice
    random.Random(1).shuffle(shuffled)
    clock = [(10_000 + k, 0, 0, "ok", None, "", datetime.datetime(2024, 1, 1, 5 + 3 * k)) for k in range(2)]
    for k in range(3):
        part = shuffled[k::3]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    for k, row in enumerate(clock):  # the last times let the timers of runs that stopped go off
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{3 + k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = replays.replay_stream(stream, "at", 3, 2).where("run_id < 10000")
    q = out.writeStream.format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table("told").collect()]
    assert len(got) == len(set(got)) == 60 and set(got) == want


def test_stream_needs_a_store_with_timers(spark):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="RocksDB"):
        replays.replay_stream(spark.createDataFrame([], SCHEMA), "at")


RUNS = "run_id long, schema_name string, success boolean, salvaged boolean, field_issues array<struct<field_path:string,category:string,error_type:string,attempt:int,received:string>>"


def runs(seed, n=80):
    rng = random.Random(seed)
    issue = lambda: (rng.choice(["a", "b", "c -> d"]), rng.choice(["type", "value"]), rng.choice(["int_type", "x", "y"]), rng.choice([0, 1, 2, None]), rng.choice([None, *"pqrstuvw"]))
    return [(k, rng.choice(["S", "T"]), rng.random() < 0.6, rng.choice([True, False, None]), [issue() for _ in range(rng.randrange(5))]) for k in range(n)]


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def equal_to_batch(state, whole):
    same(figures.field_summary_of(state), analytics.field_summary(whole))
    same(figures.field_samples_of(state), analytics.field_samples(whole))
    same(figures.schema_summary_of(state), analytics.schema_summary(whole))
    for name in ("category", "error_type"):
        same(figures.dominant_of(state, name), analytics.dominant(analytics.issue_rows(whole), name, "schema_name", "field_path"))


def test_figures_merge_however_runs_are_cut(spark):
    rows = runs(2)
    whole = spark.createDataFrame(rows, RUNS)
    random.Random(5).shuffle(rows)
    parts = [figures.partial_figures(spark.createDataFrame(rows[a:b], RUNS)) for a, b in ((0, 3), (3, 50), (50, 50), (50, 80))]
    equal_to_batch(figures.merged_figures(figures.merged_figures(*parts[2:]), *parts[:2]), whole)


def test_figures_of_a_stream(spark, tmp_path):
    rows = runs(9)
    whole = spark.createDataFrame(rows, RUNS)
    for k in range(3):
        spark.createDataFrame(rows[k::3], RUNS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    figures.keep_figures(stream(), f"{tmp_path}/state", f"{tmp_path}/c").awaitTermination()
    equal_to_batch(figures.kept_figures(spark, f"{tmp_path}/state"), whole)
    more = runs(11, 10)
    more = [(1000 + r[0], *r[1:]) for r in more]
    spark.createDataFrame(more, RUNS).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    figures.keep_figures(stream(), f"{tmp_path}/state", f"{tmp_path}/c").awaitTermination()
    equal_to_batch(figures.kept_figures(spark, f"{tmp_path}/state"), whole.union(spark.createDataFrame(more, RUNS)))
    with pytest.raises(ValueError, match="no figures"):
        figures.kept_figures(spark, f"{tmp_path}/elsewhere")
