import duckdb
import pytest

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, data string, fp string, h int, key long, score string, root long, shard string, n_lines string, g int, line_all_ string, line_key_ int, line_drop_ string, file_key_ string, file_row_ int, row_key_ int, node string, id int, file string, row int, dk int, path string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) rows with extra columns whose names clash with inner ones."""

    def make(rows, path=None):
        df = spark.createDataFrame([(i, t, "en", None, None, "x", "y", 1, None, "s", 5, "z", "n", 9, "u", 2, None, "f", 3, 4, "v", None, "w", 5, 6, None) for i, t in rows], _SCHEMA)
        if path is not None:
            df.write.mode("overwrite").parquet(str(path))
            df = spark.read.parquet(str(path))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeats, ties and a long text."""
    long = " ".join(f"wort{k % 997} und{k % 31}." for k in range(30_000))
    return [(1, None), (2, ""), (None, "a b c d e f"), (3, "  \n\t "), (4, "a b c d e f"), (4, "a b c d e f"), (5, long), (6, "ünïcode ÀB 漢字 \U0001f600 é"), (7, "x"), (None, None), (8, "!!! ???")]


@pytest.fixture(scope="session")
def small():
    con = duckdb.connect()
    return lambda table, sf=SMALL: con.sql(f"select * from '{sf}/{table}.parquet'").df()
