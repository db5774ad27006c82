"""Conversations as training text with a loss mask, and back; DataFrame functions only.

A turn's text is escaped before it is shuffled: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no text holds a
control string. The turns of a conversation are collected as structs and sorted, adjacent turns of one role are gathered
into a block by slices between the places where the role changes, and blocks are joined:

    <|im_start|>role, line feed, text, <|im_sep|>, text of the same role, <|im_end|>, line feed

Everything is a fixed number of passes over a conversation's turns, none of them quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once for each row: a generator keeps the optimizer from copying an array's
    expression into the lambda functions that index it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each conversation: ``conv_col`` and ``segments``, an array of struct(text, loss).

    The formatted conversation is the segments' texts joined (``formatted``); those with loss are what a model is trained
    on: the texts of turns whose role is in ``trained``, without marks and separators. Turns are ordered by turn, role
    and text, so ties and repeated rows have one order; null turns come first. A null text or role is empty. Rows with
    a null conversation are one conversation. Extra columns play no part, and an empty table gives no rows.

    A conversation is one value in Spark, 2 GB at most.
    """
    # a line end would end the role's line: it is escaped too
    role = F.replace(_escaped(F.coalesce(F.col(role_col).cast("string"), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("c"), F.struct(F.col(turn_col).alias("turn"), plain.alias("plain"), text.alias("raw"), role.alias("role"), _escaped(text).alias("text"), plain.isin(*trained).alias("loss")).alias("t"))
    turns = turns.groupBy("c").agg(F.collect_list("t").alias("t"))
    turns = _once(turns, s=F.transform(F.array_sort("t"), lambda t: F.struct(t["role"], t["text"], t["loss"]))).select("c", "s")
    # places where a block begins, and where the last one ends
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get(F.col("s"), i)["role"] != F.get(F.col("s"), i - 1)["role"]))
    turns = _once(turns, b=F.concat(starts, F.array(F.size("s")))).select("c", "s", "b")
    blocks = F.transform(F.slice("b", 1, F.size("b") - 1), lambda start, k: F.slice("s", start + 1, F.get(F.col("b"), k + 1) - start))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)

    def merged(block: Column) -> Column:
        head = F.array(segment(F.concat(F.lit(START), F.get(block, F.lit(0))["role"], F.lit("\n")), no))
        body = F.flatten(F.transform(block, lambda t, k: F.when(k == 0, F.array(segment(t["text"], t["loss"]))).otherwise(F.array(segment(F.lit(SEPARATOR), no), segment(t["text"], t["loss"])))))
        return F.concat(head, body, F.array(segment(F.lit(END + "\n"), no)))

    return turns.select(F.col("c").alias(conv_col), F.flatten(F.transform(blocks, merged)).alias("segments"))


def formatted(segments: Column) -> Column:
    """The whole text of formatted segments."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: _unescaped(s["text"])), "")


def turns_of(text: Column) -> Column:
    """The turns of a formatted conversation, array of struct(role, texts): a struct for each block, its texts in order."""

    def block(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END) - 1)
        line_ends = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
        return F.struct(_unescaped(line_ends).alias("role"), F.transform(F.split(body, r"<\|im_sep\|>", -1), _unescaped).alias("texts"))

    blocks = F.split(text, r"<\|im_start\|>", -1)
    return F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), block)


def digests(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What formatted conversations hold, read back from them: ``conv_col``, n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars."""
    read = _once(conversations, whole=formatted(F.col("segments")), learned=loss_text(F.col("segments")))
    read = _once(read, back=turns_of(F.col("whole")))
    line = lambda b: F.array_join(F.transform(b["texts"], lambda x: F.concat(b["role"], F.lit("\n"), x, F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.aggregate("back", F.lit(0), lambda n, b: n + F.size(b["texts"])).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = """
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), placed AS (
  SELECT *, row_number() OVER t AS k, lag(role) OVER t AS before,
         length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS text_chars, length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) AS role_chars
  FROM given WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN before IS NULL THEN 12 + role_chars + 1 + 11 WHEN before <> role THEN 12 + role_chars + 1 + 11 ELSE 10 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""
