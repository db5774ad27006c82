import os
import subprocess
import sys
import textwrap

import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from attestor.operators import extraction, rules, schema
from attestor.operators.schema import Field, OneOf, Parts, RecordSchema
from attestor.sources import sink
from attestor.streaming import observed

RUNS = "run_id long, schema_name string, success boolean, salvaged boolean, record string, field_issues array<struct<field_path:string,error_type:string>>"


def rows(a, b):
    return [(k, "S", k % 2 == 0, k % 4 == 0, f"r{k}" if k % 2 == 0 else None, [("a", "x")] * (k % 3)) for k in range(a, b)]


def test_one_commit_of_all_tables(spark, tmp_path):
    spark.dataSource.register(sink.ResultSink)
    path = f"file://{tmp_path}/out"
    for a, b in ((0, 10), (10, 14)):
        spark.createDataFrame(rows(a, b), RUNS).repartition(3).write.format("attestor_results").mode("append").save(path)
    assert sorted(map(tuple, sink.read_results(spark, path).collect())) == [r[:5] for r in rows(0, 14)]
    assert sorted(r.run_id for r in sink.read_results(spark, path, "issues").collect()) == [k for k in range(14) for _ in range(k % 3)]
    assert sink.read_figures(path) == {"runs": 14, "successes": 7, "salvaged": 4, "issues": 13}
    spark.createDataFrame(rows(0, 2), RUNS).write.format("attestor_results").mode("overwrite").save(path)
    assert sink.read_results(spark, path).count() == 2 and sink.read_figures(path)["runs"] == 2
    spark.createDataFrame([], RUNS).write.format("attestor_results").mode("append").save(path)
    assert sink.read_figures(path)["runs"] == 2
    with pytest.raises(ValueError, match="no records"):
        sink.read_results(spark, f"file://{tmp_path}/none")
    with pytest.raises(Exception, match="runs need"):
        spark.range(1).write.format("attestor_results").mode("append").save(path)


def test_a_task_that_runs_again_leaves_no_row_twice(tmp_path):
    """In a session of its own, whose tasks may fail."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from attestor.sources import sink
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()
        spark.dataSource.register(sink.ResultSink)
        def run(frames):
            for n, df in enumerate(frames):
                if n == 3 and TaskContext.get().attemptNumber() == 0:
                    raise RuntimeError("lost")
                yield df
        runs = spark.range(40).selectExpr("id AS run_id", "true AS success", "array(named_struct('field_path', 'a')) AS field_issues").coalesce(2)
        out = runs.mapInPandas(run, runs.schema)
        out.write.format("attestor_results").mode("append").save("file://{tmp_path}/out")
        got = [r.run_id for r in sink.read_results(spark, "file://{tmp_path}/out").collect()]
        assert sorted(got) == list(range(40)), sorted(got)
        assert sink.read_figures("file://{tmp_path}/out") == dict(runs=40, successes=40, salvaged=0, issues=40)
        print("whole")
    """)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": root})
    assert "whole" in done.stdout, done.stderr[-2000:]


def test_files_of_a_task_that_broke_off_are_not_listed(tmp_path):
    batch = pa.record_batch({"run_id": [1, 2], "success": [True, False], "field_issues": pa.array([[{"field_path": "a"}], []])})
    writer = sink._Writer(f"{tmp_path}/out", False)

    def broken():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    twice = writer.write(iter([batch]))
    writer.commit([None, writer.write(iter([batch, batch]))])
    files, _ = sink._listed(f"{tmp_path}/out")
    assert len(os.listdir(f"{tmp_path}/out/parts")) == 6 and [len(files[k]) for k in ("records", "issues")] == [1, 1]
    assert sink.read_figures(f"{tmp_path}/out") == {"runs": 4, "successes": 2, "salvaged": 0, "issues": 2}
    writer.abort([twice, None])
    assert len(os.listdir(f"{tmp_path}/out/parts")) == 4


def test_figures_come_with_the_write(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def seen(frames):
        for df in frames:
            ran.add(len(df))
            yield df

    runs = spark.createDataFrame(rows(0, 20), RUNS).withColumn("failure_reason", F.when(~F.col("success"), "llm_error"))
    made = Observation("runs of a batch")
    observed.counted(runs.mapInPandas(seen, runs.schema), made).write.parquet(f"{tmp_path}/out")
    got = made.get
    assert (got["runs"], got["successes"], got["failures"], got["salvaged"], got["issues"], got["llm_error"]) == (20, 10, 10, 5, 19, 10) and ran.value == 20
    calls = Observation("calls")
    observed.counted(spark.createDataFrame([("executed", True), ("salvaged", False), ("executed", None)], "outcome string, repaired boolean"), calls, observed.call_figures).collect()
    assert calls.get["executed"] == 2 and calls.get["salvaged"] == 1 and calls.get["repaired"] == 1


def test_figures_of_a_stream_as_it_runs(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(rows(k * 5, k * 5 + 5), RUNS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    told = []
    listener = observed.Progress(lambda name, batch, own: told.append((name, batch, own["runs"])) or 1 / 0)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = observed.counted(stream, "live").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if len(told) >= 3:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = listener.figures("live")
    assert (got["runs"], got["successes"], got["issues"]) == (15, 8, 15) and [t[2] for t in told[:3]] == [5, 5, 5] and listener.figures("none") == {}


PAIR = RecordSchema("Pair", [Field("a", "int"), Field("b", "date")])


def test_python_rules_and_their_attempt(spark):
    def check(record, attempt):
        if record["a"] == 0:
            return None
        if record["a"] == 1:
            return "one is wrong"
        if record["a"] == 2:
            return [rules.Finding("only noted", "a", reject=not attempt["is_final"], received=record["a"]), ""]
        if record["a"] == 3:
            raise ValueError()
        return ["first", rules.Finding(record["b"], "b")]

    replies = spark.createDataFrame([(k, rank, n, f'{{"a": {k}, "b": "2024-01-0{k + 1}"}}', None) for k in range(5) for rank, n in ((0, 0), (1, 1))], "run_id int, model_rank int, attempt int, content string, error_class string")
    out = {(r.run_id, r.model_rank): r for r in extraction.extracted(replies, PAIR, rule=rules.python_rule(check, with_attempt=True), budgets=(2, 2), levels=("low",)).collect()}
    short = lambda r: (r.outcome, [(i.field_path, i.message, i.received, i.rejecting) for i in r.issues])
    assert short(out[0, 0]) == ("ok", []) and short(out[1, 0]) == ("rule", [(rules.VALIDATOR_PATH, "one is wrong", None, True)]) and out[1, 0].feedback == "one is wrong"
    assert short(out[2, 0]) == ("rule", [("a", "only noted", "2", True)]) and short(out[2, 1]) == ("ok", [("a", "only noted", "2", False)])
    assert short(out[3, 0]) == ("rule", [(rules.VALIDATOR_PATH, "ValueError was raised by the rule", None, True)])
    assert short(out[4, 1]) == ("rule", [(rules.VALIDATOR_PATH, "first", None, True), ("b", "2024-01-05", None, True)])
    plain = extraction.extracted(replies, PAIR, rule=rules.python_rule(lambda r: r["a"] > 2 and "much"))
    assert {r.run_id for r in plain.where("outcome = 'rule'").collect()} == {3, 4}
    with pytest.raises(Exception, match="a rule gives None"):
        extraction.extracted(replies, PAIR, rule=rules.python_rule(lambda r: 7)).select("issues").collect()


def test_schemas_for_models(spark):
    node = RecordSchema("Node", [Field("name", default="x", required=False, description="What it is called.")])
    node.fields.append(Field("kids", node, many=True, nullable=True))
    made = node.json_schema()
    assert made["properties"]["kids"]["anyOf"][0] == {"type": "array", "items": {"$ref": "#/$defs/Node"}} and made["$defs"]["Node"]["properties"]["name"]["default"] == "x"
    strict = node.json_schema(True)
    assert strict["properties"]["name"] == {"type": "string", "description": 'What it is called. Default: "x"'} and node.strict_problem() == "Node contains itself"
    some = RecordSchema("Some", [Field("n", OneOf(("int", schema.ListOf("any")))), Field("p", Parts(("date", "decimal")))])
    assert some.strict_problem() == "n: free values" and some.json_schema()["properties"]["p"]["prefixItems"][0]["format"] == "date"
    holder = RecordSchema("Holder", [Field("inner", node)])
    assert holder.strict_problem() == "inner -> Node contains itself" and "$defs" in holder.json_schema() and not holder.is_recursive()
