"""Finished runs in one commit: records, issues and figures become visible together, or not at all.

``spark.dataSource.register(ResultSink)``, then ``runs.write.format("attestor_results").mode("append").save(path)``. Every
task writes its own files below ``parts``; when all have ended, the driver writes one manifest that lists them. Only listed
files are read, so what a failed task left, or one that ran twice, is in no result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ISSUES = "field_issues"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """An Arrow file system and the path in it. A path without a scheme is a local one."""
    return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith(("/", "file:/")) and "://" not in path else path)


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    files: dict
    figures: dict


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _place(self.path)
        fs.create_dir(f"{root}/parts", recursive=True)
        mark, writers, files = uuid.uuid4().hex, {}, {}
        figures = dict.fromkeys(("runs", "successes", "salvaged", "issues"), 0)

        def add(name: str, table: pa.Table) -> None:
            if name not in writers:
                files[name] = f"parts/{name}-{mark}.parquet"
                writers[name] = pq.ParquetWriter(f"{root}/{files[name]}", table.schema, filesystem=fs, compression="zstd")
            writers[name].write_table(table)

        try:
            for batch in iterator:
                runs = pa.Table.from_batches([batch])
                lists = runs.column(ISSUES).combine_chunks()
                own = runs.column("run_id").combine_chunks().take(pa.compute.list_parent_indices(lists))
                flat = lists.flatten()
                issues = pa.table([own, *flat.flatten()], names=["run_id", *[f.name for f in flat.type]])
                add("records", runs.drop_columns([ISSUES]))
                if len(issues):
                    add("issues", issues)
                yes = lambda c: pa.compute.sum(runs.column(c).cast(pa.int64())).as_py() or 0 if c in runs.column_names else 0
                for k, n in (("runs", len(runs)), ("successes", yes("success")), ("salvaged", yes("salvaged")), ("issues", len(issues))):
                    figures[k] += n
        finally:
            for w in writers.values():
                w.close()
        return Written(files, figures)

    def commit(self, messages: list) -> None:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        body = {"files": {k: [m.files[k] for m in done if k in m.files] for k in ("records", "issues")}, "figures": {k: sum(m.figures[k] for m in done) for k in ("runs", "successes", "salvaged", "issues")}, "overwrite": self.overwrite}
        number = 1 + max((int(f.base_name[9:17]) for f in _manifests(fs, root)), default=0)
        temporary = f"{root}/.manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as out:
            out.write(json.dumps(body).encode())
        fs.move(temporary, f"{root}/manifest-{number:08d}.json")

    def abort(self, messages: list) -> None:
        fs, root = _place(self.path)
        for m in messages:
            for file in m.files.values() if m is not None else ():
                fs.delete_file(f"{root}/{file}")


def _manifests(fs: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if f.base_name.startswith("manifest-")), key=lambda f: f.base_name)


class ResultSink(DataSource):
    """Runs with run_id and field_issues (array of structs, not null), and whatever other columns; one job at a time writes to
    a path. ``mode("overwrite")`` makes earlier manifests count no more."""

    @classmethod
    def name(cls) -> str:
        return "attestor_results"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if missing := {"run_id", ISSUES} - set(schema.names):
            raise ValueError(f"runs need {', '.join(sorted(missing))}")
        return _Writer(self.options["path"], overwrite)


def _listed(path: str) -> tuple[dict, list[dict]]:
    fs, root = _place(path.rstrip("/"))
    bodies = [json.loads(fs.open_input_stream(f.path).readall()) for f in _manifests(fs, root)]
    last = max((k for k, b in enumerate(bodies) if b["overwrite"]), default=0)
    bodies = bodies[last:]
    return {k: [f"{path.rstrip('/')}/{f}" for b in bodies for f in b["files"][k]] for k in ("records", "issues")}, bodies


def read_results(spark: SparkSession, path: str, what: str = "records") -> DataFrame:
    """``records`` or ``issues`` of all commits at a path; an error if there are none."""
    files, _ = _listed(path)
    if not files[what]:
        raise ValueError(f"no {what} at {path}")
    return spark.read.parquet(*files[what])


def read_figures(path: str) -> dict:
    """Sums over all commits: runs, successes, salvaged, issues. They were committed with the rows they are of."""
    _, bodies = _listed(path)
    return {k: sum(b["figures"][k] for b in bodies) for k in ("runs", "successes", "salvaged", "issues")}
