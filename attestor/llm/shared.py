"""What the corpus operators share: the shared work folder, written tables, and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of narrow rows may be broadcast if it has at most so many.
SMALL_ROWS = 50_000
#: Rows of a file: of narrow tables, and of those whose rows are heavy to make.
ROWS_A_FILE, HEAVY_ROWS_A_FILE = 200_000, 20_000
ARROW_ROWS = 1000
_OWN: dict[str, str] = {}
_KEPT: list[DataFrame] = []
_HELD: list[Callable[[], None]] = []


def on_release(empty: Callable[[], None]) -> None:
    """Have ``empty`` called when a task of ``tidy`` ends: what a worker keeps beyond a task is emptied there."""
    _HELD.append(empty)


def release() -> None:
    """Give a worker's unused memory back to the system; workers live on, and idle ones would hold it."""
    for empty in _HELD:
        empty()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU library has it
        pass


def let_go(spark: SparkSession) -> None:
    """Have the driver let go of what a finished stage leaves: plans that only cycles of Python objects hold, what the
    virtual machine holds for them, and with these the shuffles and broadcasts that Spark then cleans up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    release()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of Arrow batches that releases its worker's memory when the task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def work_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is unset and driver and
    executors are one process (a local master, as in tests) a temporary folder is made; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="attestor-")
        base = _OWN[app]
    return base.rstrip("/") if "://" in base or base.startswith("file:") else "file://" + base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{work_dir(spark)}/attestor/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.deleteOnExit(target)
    return path


def written(df: DataFrame, name: str, rows: int | None = None, heavy: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again.

    ``rows``, if known, is how many rows there are at most: they go to few files, as many small ones would cost more to
    open, and on some file systems a process each, than what they hold. Rows that are ``heavy`` to make keep all cores
    busy.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        least = 2 * spark.sparkContext.defaultParallelism if heavy else 1
        df = df.coalesce(max(least, -(-rows // (HEAVY_ROWS_A_FILE if heavy else ROWS_A_FILE))))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Results of whole texts in files of some size: as many partitions as ``docs`` has rows for, and two for each core at
    least."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(2 * cores, -(-docs.count() // HEAVY_ROWS_A_FILE)))


def kept(df: DataFrame) -> DataFrame:
    """A table that is read more than once before its results are written: executors keep it on their disks, and what a
    lost one had is made anew. ``drop_kept`` lets go of it. Plans grow with kept tables made of kept tables: write one
    now and then."""
    _KEPT.append(df.persist(StorageLevel.DISK_ONLY))
    return _KEPT[-1]


def drop_kept() -> None:
    """Let go of all kept tables, once the results that were made of them are written."""
    while _KEPT:
        _KEPT.pop().unpersist()


def _folders(df: DataFrame) -> list:
    """Hadoop paths and file systems of the folders that a written table is in."""
    spark = df.sparkSession
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})]
    return [(p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())) for p in paths]


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` as soon as nothing reads it any more."""
    for path, fs in _folders(df):
        fs.delete(path, True)


def beside(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a written or kept table: it is broadcast if it has at most ``SMALL_ROWS`` rows (narrow ones: a few
    numbers or a short list), else both are shuffled, and rows of a hot key are split by the adaptive skew join, as
    only ``rows`` can hold a key often."""
    return rows.join(F.broadcast(table) if table.count() <= SMALL_ROWS else table, on, how)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def located(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns, and their names, that say where a row stands: a hash of its file's path, and its
    number there. They are the same in every scan, however it is split. What isn't a scan of files is written first."""
    short_batches(docs.sparkSession)
    names = [unused(docs, "file_key_"), unused(docs, "file_row_")]
    try:
        at = docs.metadataColumn("_metadata")
        return docs.withColumns({names[0]: F.xxhash64(at["file_path"]), names[1]: at["row_index"]}), names
    except AnalysisException:
        return located(written(docs, "rows"))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """An Arrow file system and the path in it; used on executors for non-tabular files."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def utf8(column: str) -> Column:
    """The text as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def fold_of(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def short_batches(spark: SparkSession) -> None:
    """Have Arrow batches of the session hold ``ARROW_ROWS`` rows at most: whole texts go through them, and a batch is
    several times in memory, outside the heap too. A lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """These columns alone, so that extra columns of the input can never clash with those made here."""
    short_batches(df.sparkSession)
    return df.select(*[df[c] for c in columns])


def components(edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b: long) as rows (node, root), root the smallest node; the root
    itself has no row.

    Alternating large-star and small-star contraction: every round is two grouped minima (combined before
    the shuffle) and two joins, so no neighbourhood is ever gathered in one place. Each round is written to
    the shared folder. Nodes without an edge don't appear. Self-loops are ignored; an empty table gives none.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().persist(StorageLevel.DISK_ONLY)
    first, e = e, written(e, name, e.count())
    first.unpersist()

    def digest(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    seen = digest(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        # large star: every neighbour above a node goes to the least of its neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: a node and its lower neighbours go to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        nxt = small.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u <> v").union(least.select(F.col("m").alias("u"), "v")).distinct()
        nxt = written(nxt, name, seen[0])
        now = digest(nxt)
        drop_written(e)
        e = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
