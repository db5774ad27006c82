"""Models that are called while a query runs: bounded calls side by side, retries by kind of error, each reply kept once.

A client is made once a task by a function that travels with it, and takes a prompt (text) to a reply (text). What it
raises decides what happens next; it ends as a row's ``error_class``, never as the task's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.replay import ERROR_KINDS, RetryConfig

REPLY = "content string, error_class string, error_text string, retries int, waits int"


def kind_of(error: BaseException) -> str:
    """Kind of an error by the names of its class and of those it comes from; the first kind in order wins."""
    names = {c.__name__ for c in type(error).__mro__}
    return next((kind for kind, known in ERROR_KINDS if names & set(known)), "other")


def _class_name(error: BaseException) -> str:
    """The class whose name says the kind: the error's own, or the first it comes from that is known."""
    known = {n for _, names in ERROR_KINDS for n in names}
    return next((c.__name__ for c in type(error).__mro__ if c.__name__ in known), type(error).__name__)


def call(client: Callable[[str], str], prompt: str, config: RetryConfig = RetryConfig(), sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> tuple:
    """One reply as a row of ``REPLY``. Transient errors are tried again ``config.most`` times after their delays; a rate
    limit is waited out at its interval until ``config.rate_limit`` seconds have gone by since the first, and costs no
    retry; any other error is final."""
    retries = waits = 0
    since = None
    while True:
        try:
            return client(prompt), None, None, retries, waits
        except Exception as error:  # a client may raise anything
            kind = kind_of(error)
            if kind == "rate_limit":
                since = clock() if since is None else since
                if clock() - since < config.rate_limit:
                    waits += 1
                    sleep(config.rate_interval)
                    continue
            elif kind in config.transient and retries < config.most:
                sleep(config.delays[min(retries, len(config.delays) - 1)] if config.delays else 1.0)
                retries += 1
                continue
            return None, _class_name(error), str(error)[:1000].encode("utf-8", "replace").decode(), retries, waits


def asked(prompts: DataFrame, make_client: Callable[[], Callable[[str], str]], prompt_col: str = "prompt", side_by_side: int = 8, config: RetryConfig = RetryConfig()) -> DataFrame:
    """``prompts`` with the columns of ``REPLY``; a task keeps ``side_by_side`` calls open at most.

    How many calls a cluster makes at once is that times its tasks: ``repartition`` or ``coalesce`` the prompts to
    bound it. A null prompt is asked as an empty one. Replies aren't deterministic: use ``answered``, or write them,
    before they are read more than once.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    at = prompts.columns.index(prompt_col)
    schema = prompts.sparkSession.createDataFrame([], REPLY).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        with ThreadPoolExecutor(side_by_side) as pool:
            for batch in batches:
                rows = list(pool.map(lambda text: call(client, text or "", config), batch.column(at).to_pylist()))
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], [*batch.schema.names, *schema.names])

    return prompts.mapInArrow(run, f"{fields}, {REPLY}")


def answered(prompts: DataFrame, store: str, keys: list[str], make_client: Callable[[], Callable[[str], str]], prompt_col: str = "prompt", side_by_side: int = 8, config: RetryConfig = RetryConfig()) -> DataFrame:
    """``prompts`` with their replies, kept in a table at ``store`` by ``keys`` (not null): a prompt that has a reply there
    isn't asked again, so a job that is run again goes on where the last one ended. Of repeated keys one is asked.

    What a lost task had asked is asked again, but only tasks that end are committed to the table, so each reply is in it
    once. One job writes to a store at a time.
    """
    spark = prompts.sparkSession
    once = prompts.dropDuplicates(keys)
    try:
        todo = once.join(spark.read.parquet(store).select(*keys), keys, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # no store yet
            raise
        todo = once
    replies = asked(todo, make_client, prompt_col, side_by_side, config).select(*keys, *[c.split()[0] for c in REPLY.split(", ")])
    replies.write.mode("append").parquet(store)
    return prompts.join(spark.read.parquet(store), keys)


def scripted(script: dict[str, list]) -> Callable[[], Callable[[str], str]]:
    """A client for tests and replays: for each prompt a list of what happens call by call, a reply, or the name of an
    error's class after an exclamation mark. The last one repeats; an unknown prompt is an error."""

    def make() -> Callable[[str], str]:
        made: dict[str, int] = {}

        def client(prompt: str) -> str:
            if prompt not in script:
                raise type("RepliesExhausted", (Exception,), {})(prompt)
            n = made[prompt] = made.get(prompt, -1) + 1
            said = script[prompt][min(n, len(script[prompt]) - 1)]
            if said.startswith("!"):
                raise type(said[1:], (Exception,), {})("as the script says")
            return said

        return client

    return make


def counts(replies: DataFrame) -> DataFrame:
    """Calls by outcome: error_class (null: answered), replies, retries and rate-limit waits."""
    return replies.groupBy("error_class").agg(F.count("*").alias("replies"), F.sum("retries").alias("retries"), F.sum("waits").alias("waits"))
