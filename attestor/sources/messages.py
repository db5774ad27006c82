"""Conversations as sources of text, and recorded replies as the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_PROMPT = "Extract the requested fields from the text. Use only what the text says."


def message_arrays(conversations: DataFrame) -> DataFrame:
    """One row for each conversation with its messages in order of turn."""
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def text_messages(docs: DataFrame, id_col: str, text_col: str, prompt: str = DEFAULT_PROMPT) -> DataFrame:
    """A system and a user message for each text."""
    message = lambda turn, role, text: F.struct(F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    return docs.select(F.col(id_col).alias("conv_id"), F.array(message(0, "system", F.lit(prompt)), message(1, "user", F.col(text_col))).alias("messages"))


def source_text(messages: Column) -> Column:
    """What the user said, joined by newlines; empty turns are left out, and no text at all is null."""
    said = F.filter(messages, lambda m: (m["role"] == "user") & (F.coalesce(m["text"], F.lit("")) != ""))
    return F.nullif(F.array_join(F.transform(said, lambda m: m["text"]), "\n"), F.lit(""))


def block_text(blocks: Column) -> Column:
    """Text of a message whose content is a list of blocks struct(type, text): plain strings (type null) and text blocks."""
    read = F.filter(blocks, lambda b: (b["type"].isNull() | (b["type"] == "text")) & (F.coalesce(b["text"], F.lit("")) != ""))
    return F.array_join(F.transform(read, lambda b: b["text"]), "\n")


def image_blocks(spark: SparkSession, path: str, kind: str = "image/png") -> DataFrame:
    """Files as messages for a model that sees: path and the data URL of the bytes, read by Spark's binary source."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.concat(F.lit(f"data:{kind};base64,"), F.base64("content")).alias("url"))


def with_images(messages: DataFrame, images: DataFrame, by: str = "conv_id") -> DataFrame:
    """A text scenario as an image scenario: the user's text is replaced by an image block of the same key."""
    return messages.join(images.select(by, "url"), by).withColumn("blocks", F.array(F.struct(F.lit("image_url").alias("type"), F.col("url").alias("text"))))


def last_assistant(conversations: DataFrame) -> DataFrame:
    return conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def _shortened(c: Column, most_chars: int) -> Column:
    return F.when(F.length(c) > most_chars, F.concat(F.left(c, F.lit(most_chars - 1)), F.lit("…"))).otherwise(c)


def context_lines(conversations: DataFrame, n: int = 5, most_chars: int = 2000) -> DataFrame:
    """The last ``n`` messages that aren't the system's, each cut, as one text for each conversation."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = conversations.where("role <> 'system'").withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), _shortened(F.col("text"), most_chars)).alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def context_before(conversations: DataFrame, at: DataFrame, n: int = 5, most_chars: int = 2000) -> DataFrame:
    """For each message of ``at`` (conv_id, turn): the last ``n`` messages before it that aren't the system's, oldest
    first, each cut, then the message's own text as the assistant's; null if there is nothing, or ``n`` is 0."""
    if n <= 0:
        return at.select("conv_id", "turn", F.lit(None).cast("string").alias("context"))
    line = lambda role, c: F.concat(F.lit("["), role, F.lit("] "), _shortened(c, most_chars))
    said = conversations.select("conv_id", F.col("turn").alias("t"), "role", "text")
    rows = at.select("conv_id", "turn").distinct().join(said, "conv_id").where("t <= turn")
    own = F.col("t") == F.col("turn")
    rows = rows.where(own & (F.coalesce("text", F.lit("")) != "") | ~own & (F.col("role") != "system"))
    back = F.row_number().over(Window.partitionBy("conv_id", "turn", own).orderBy(F.desc("t")))
    rows = rows.withColumn("back", back).where(own | (F.col("back") <= n)).withColumn("line", line(F.when(own, "assistant").otherwise(F.col("role")), F.coalesce("text", F.lit(""))))
    lines = F.array_sort(F.collect_list(F.struct("t", "line")))
    each = rows.groupBy("conv_id", "turn").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))
    return at.select("conv_id", "turn").distinct().join(each, ["conv_id", "turn"], "left")


def recorded(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies from a table (run_id, model_rank, attempt, content, error_class); a missing one is an llm_error."""
    out = prompts.join(replies, ["run_id", "model_rank", "attempt"], "left")
    return out.withColumn("error_class", F.when(F.col("content").isNull() & F.col("error_class").isNull(), "RepliesExhausted").otherwise(F.col("error_class")))


def live(prompts: DataFrame, client: Callable, prompt_col: str = "prompt") -> DataFrame:
    """Replies from ``client`` (an iterator of prompt batches, lists of strings, to lists of replies), run on executors.

    Not deterministic: write the result before it is used more than once.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def ask(frames):
        for df in frames:
            yield df.assign(content=client(df[prompt_col].tolist()))

    return prompts.mapInPandas(ask, f"{fields}, content string")


def benchmark_grid(scenarios: DataFrame, models: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """Every scenario with every model, models outermost: two hand-written dimensions, whose sizes are checked."""
    if max(scenarios.count(), models.count()) > most_rows:
        raise ValueError(f"a benchmark has at most {most_rows} scenarios and models")
    return models.crossJoin(scenarios)


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write runs, records and statistics together, a row each, nested as they are."""
    df.write.mode("overwrite").format(kind).save(path)


def write_benchmark(results: DataFrame, fields: DataFrame, schemas: DataFrame, path: str) -> None:
    """Write benchmark results as JSON, one document a schema: its results, its figures and those of its fields. A benchmark's
    size is bounded (``benchmark_grid``); tables of any size go to ``sources.sink``."""
    each = results.groupBy("schema_name").agg(F.collect_list(F.struct(*[c for c in results.columns if c != "schema_name"])).alias("results"))
    problems = fields.groupBy("schema_name").agg(F.sort_array(F.collect_list(F.struct("severity", *[c for c in fields.columns if c not in ("schema_name", "severity")])), asc=False).alias("field_problems"))
    schemas.join(problems, "schema_name", "left").join(each, "schema_name", "left").write.mode("overwrite").json(path)
