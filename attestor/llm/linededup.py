"""Repeated runs of lines, found by winnowing and deleted wherever they are not the first; DataFrame functions only.

The unit is a non-blank line. A run of lines is long enough if it has ``min_lines`` lines or ``min_words`` words; a
line goes if it lies in a run, long enough, that also stands in an earlier place (by id, then line). All runs that are
long enough are made of windows of up to ``min_lines`` lines that are, so these decide.

Texts are split and hashed once, into a small table of line hashes that is kept. Of every window the line with the least hash
is its fingerprint, so equal windows select equal lines. Positions of fingerprints are joined on their hash, and those
that occur once are out, with every window that selected them. From each position that is left, the match is extended
both ways to the windows that selected it; these are hashed whole and the first place of each is joined back. Windows
found in an earlier place cover the repeated runs, whose lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.shared import beside, kept, unused


def _hash2(*columns: Column) -> Column:
    """128 bits: two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(7919), *columns).alias("g"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _blank(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\r")) == ""


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once for each row: a generator between projections keeps the optimizer
    from copying a whole array's expression into the lambda functions that index it."""
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(made))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_words: int) -> DataFrame:
    """A row for each document with non-blank lines: id ``d``, key ``dk`` (two hashes of id and text), of each such line
    its number ``q`` in the text, its words ``w`` (inner spaces plus one) and two hashes ``h`` and ``g``, and the
    fingerprints ``chosen`` by its windows: struct(fp, p), the hash and the line's place among these."""
    base = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    base = base.select("d", _hash2(F.col("d"), F.col("t")).alias("dk"), F.filter(F.transform(_lines(F.col("t")), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~_blank(s["x"])).alias("s"))
    base = _once(base.where(F.size("s") > 0), s2=F.col("s")).select("d", "dk", F.col("s2").alias("s"))
    words = lambda s: F.length(F.trim(s["x"])) - F.length(F.replace(F.trim(s["x"]), F.lit(" "), F.lit(""))) + 1
    out = base.select("d", "dk", F.transform("s", lambda s: s["i"]).alias("q"), F.transform("s", words).alias("w"), F.transform("s", lambda s: F.xxhash64(s["x"])).alias("h"), F.transform("s", lambda s: F.xxhash64(F.lit(7919), s["x"])).alias("g"))
    out = _once(out.select("d", "dk", "q", "w", "h", "g"), h2=F.col("h"), w2=F.col("w")).select("d", "dk", "q", F.col("w2").alias("w"), F.col("h2").alias("h"), "g")
    return out.withColumn("chosen", F.expr(f"array_distinct(transform({_windows(min_lines, min_words)}, v -> struct(h[v.p] as fp, v.p as p)))"))


def _windows(min_lines: int, min_words: int, keep: str = "true") -> str:
    """SQL of the windows of a row of ``line_hashes``: struct(i, k, p) of first line, number of lines and fingerprint's
    place, those for which ``keep`` holds."""
    place = "i + cast(array_position(slice(h, i + 1, k), array_min(slice(h, i + 1, k))) as int) - 1"
    each = [
        f"transform(filter(sequence(0, size(h) - {k}), i -> {f'aggregate(slice(w, i + 1, {k}), 0, (a, b) -> a + b) >= {min_words}' if k < min_lines else 'true'}), i -> struct(i, {k} as k, {place.replace('k)', f'{k})')} as p))"
        for k in range(1, min_lines + 1)
    ]
    return f"filter(concat({', '.join(f'if(size(h) >= {k}, {e}, array())' for k, e in enumerate(each, 1))}), v -> {keep})"


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """Per document with repeated runs: its key ``dk`` (two hashes of id and text) and ``drop``, the numbers
    (from 0, in no order) of the lines to delete."""
    lines = kept(line_hashes(docs, id_col, text_col, min_lines, min_words))
    chosen = lines.select("dk", F.explode("chosen").alias("x")).select("dk", "x.fp", "x.p")
    again = chosen.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    marks = chosen.join(again, "fp", "left_semi").groupBy("dk").agg(F.collect_set("p").alias("marks"))
    found = lines.drop("chosen").join(marks, "dk").select("d", "dk", "q", "h", "g", F.expr(_windows(min_lines, min_words, "array_contains(marks, v.p)")).alias("v")).where("size(v) > 0")
    found = kept(found.select("d", "dk", F.expr("inline(transform(v, v -> struct(v.i as p, slice(q, v.i + 1, v.k) as q, xxhash64(slice(h, v.i + 1, v.k)) as a, xxhash64(slice(g, v.i + 1, v.k)) as b)))")))
    place = F.struct(F.col("d").isNull().alias("z"), "d", "dk", "p")
    first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = found.join(first, ["a", "b"]).where("not (first.dk = dk and first.p = p)")
    return later.select("dk", F.explode("q").alias("p")).groupBy("dk").agg(F.collect_set("p").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """All columns of ``docs`` with ``text_col`` cut, plus n_lines and n_removed (non-blank lines).

    Null and empty texts have no lines and stay as they are. Blank lines stay. Within a document too, later
    repeats go and the first stays. Rows equal in id and text are one document written twice: they get equal
    results. Null ids come last in the order. Columns named n_lines or n_removed are replaced, all others stay,
    whatever their names. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    key, drop, lines = (unused(docs, n) for n in ("line_key_", "line_drop_", "line_all_"))
    found = kept(repeated_lines(docs, id_col, text_col, min_lines, min_words).select(F.col("dk").alias(key), F.col("drop").alias(drop)))
    text = F.col(text_col).cast("string")
    out = beside(docs.withColumn(key, _hash2(F.col(id_col).cast("long"), F.coalesce(text, F.lit("")))), found, key, "left")
    out = _once(out, **{lines: _lines(F.col(text_col))})
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = out.withColumn("n_lines", F.size(F.filter(lines, lambda x: ~_blank(x)))).withColumn("n_removed", F.coalesce(F.array_size(drop), F.lit(0)))
    return out.withColumn(text_col, F.when(F.col(drop).isNull(), text).otherwise(rest)).drop(key, drop, lines)


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln
  FROM documents
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i, length(trim(x, ' ')) - length(replace(trim(x, ' '), ' ', '')) + 1 AS w
  FROM lines WHERE trim(x, ' ' || chr(9) || chr(13)) <> ''
), ahead AS (
  SELECT *, lead(x, 1) OVER d AS x2, lead(x, 2) OVER d AS x3, lead(w, 1) OVER d AS w2, lead(ln, 1) OVER d AS l2, lead(ln, 2) OVER d AS l3
  FROM kept WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, i, [ln] AS lns, x AS run FROM ahead WHERE w >= 50
  UNION ALL SELECT doc_id, i, [ln, l2], x || chr(10) || x2 FROM ahead WHERE w + w2 >= 50
  UNION ALL SELECT doc_id, i, [ln, l2, l3], x || chr(10) || x2 || chr(10) || x3 FROM ahead WHERE l3 IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS r FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(lns) AS ln FROM ranked WHERE r > 1
), texts AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.ln IS NULL THEN x END, chr(10) ORDER BY l.ln) AS text, count(g.ln) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.ln = g.ln GROUP BY l.doc_id
)
SELECT d.doc_id, (SELECT count(*) FROM kept k WHERE k.doc_id = d.doc_id) AS n_lines, coalesce(t.n_removed, 0) AS n_removed,
       CASE WHEN coalesce(t.n_removed, 0) = 0 THEN d.text ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id
"""
