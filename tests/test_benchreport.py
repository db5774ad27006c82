from pyspark.sql import functions as F

from attestor.operators import benchreport

SCHEMA = "group string, scenario string, model string, success boolean, duration_s double, retries int, tokens_in int, tokens_out int, correct long, total long, detail string, error string"


def test_report_in_order(spark):
    rows = [
        ("g", "b", "m2", True, 2.25, 1, 10, 20, 3, 4, "🟢 a=1", None), ("g", "b", "m1", False, 9.0, 3, None, None, 0, 4, None, "bad | thing\nhere"), ("g", "a", "m2", True, 1.0, 0, 30, 41, 2, 2, None, None), ("g", "a", "m1", True, 4.0, 0, None, None, 0, 0, "x", None),
    ]
    issues = spark.createDataFrame([(0, "## Issues")], "place int, line string")
    lines = [r.line for r in benchreport.benchmark_report(spark.createDataFrame(rows, SCHEMA), issues=issues).collect()]
    assert lines[:3] == ["# Benchmark report", "- Runs: 4 (3 successful)", "- Models: m1, m2"] and lines[3] == "## Ranking" and lines[-1] == "## Issues"
    assert lines[6:8] == ["| 1 | `m2` | 2/2 (100%) | 1/2 (50%) | 0.5 | 5/6 (83%) | 1.6s | 20 / 30 |", "| 2 | `m1` | 1/2 (50%) | 1/1 (100%) | 0.0 | 0/4 (0%) | 4.0s | — |"]
    assert lines[8] == "### g: a" and lines[11:13] == ["| `m1` | ✅ | 4.0s | 0 | — | — | x |", "| `m2` | ✅ | 1.0s | 0 | 30 / 41 | 2/2 | — |"]
    assert lines[16:18] == ["| `m1` | ❌ | 9.0s | 3 | — | 0/4 | ERROR: bad \\| thing here |", "| `m2` | ✅ | 2.2s | 1 | 10 / 20 | 3/4 | 🟢 a=1 |"]
    assert [r.line for r in benchreport.benchmark_report(spark.createDataFrame([], SCHEMA)).collect()][1] == "- Runs: 0 (0 successful)"


def test_details_of_nothing(spark):
    df = spark.range(1).select(F.struct(F.lit(None).cast("string").alias("a"), F.lit("p|q").alias("b")).alias("r"))
    got = df.select(benchreport.value_detail(F.col("r"), ["a"], {}).alias("x"), benchreport.value_detail(F.col("r"), ["a", "b"], {"a": "z"}).alias("y")).first()
    assert (got.x, got.y) == ("—", "🔴 a=∅, expected: z<br>⚪ b=p\\|q")
