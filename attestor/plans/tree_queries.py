"""Registered queries of schemas that contain themselves, unions, and grounding at any depth, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators import trees
from attestor.operators.grounding import Grounded
from attestor.operators.schema import Field, RecordSchema
from attestor.plans.catalogue import _t, query

NODE = RecordSchema("Node", [Field("name"), Field("size", "int", ge=0)])
NODE.fields.append(Field("children", NODE, many=True, required=False, default=[]))
DEPTH = 5


def _told(rows: DataFrame, key: str) -> DataFrame:
    """Records and their issues as one text."""
    out = trees.records(rows, key)
    return out.select(key, "record", F.array_join(F.transform("issues", lambda i: F.concat(i["field_path"], F.lit(": "), i["error_type"])), "; ").alias("issues"))


def _tree_sql() -> str:
    """Trees of a part, from the deepest level up: the record, and its issues in the order of the document."""
    parts, last = [], "''"
    for k in range(DEPTH - 1, -1, -1):
        leaf = f"""'{{"name":"leaf {k}","size":{k},"children":[]}}'"""
        more = f"CASE WHEN p_partkey % {DEPTH} > {k} THEN '[' || {last} || ',' || {leaf} || ']' ELSE '[]' END"
        parts.append(f"""'{{"name":"' || p_brand || ' {k}","size":' || (p_size + {k}) || ',"children":' || {more} || '}}' AS n{k}""")
        last = f"n{k}"
    steps, source = [], "part"
    for k, part in zip(range(DEPTH - 1, -1, -1), parts):
        steps.append(f"s{k} AS (SELECT *, {part} FROM {source})")
        source = f"s{k}"
    sizes = ", ".join(f"CASE WHEN p_partkey % {DEPTH} >= {k} AND (p_partkey + {k}) % 7 = 0 THEN '{'children -> 0 -> ' * k}size: int_parsing' END" for k in range(DEPTH))
    leaves = ", ".join(f"CASE WHEN p_partkey % {DEPTH} > {k} AND p_partkey % 11 = 0 THEN '{'children -> 0 -> ' * k}children -> 1 -> name: missing' END" for k in range(DEPTH - 1, -1, -1))
    return f"WITH {', '.join(steps)}, i AS (SELECT p_partkey, n0, concat_ws('; ', {sizes}, {leaves}) AS issues FROM s0) SELECT p_partkey, CASE WHEN issues = '' THEN n0 END AS record, issues FROM i"


@query(_tree_sql())
def tree_records(spark, sf):
    """Trees of one to five levels; some nodes have a size that is no number, some leaves have no name."""
    key, doc = F.col("p_partkey"), None
    for k in range(DEPTH - 1, -1, -1):
        name = F.when(key % 11 == 0, "").otherwise(f'"name": "leaf {k}", ')
        leaf = F.concat(F.lit("{"), name, F.lit(f'"size": "{k}"}}'))
        size = F.when((key + k) % 7 == 0, '"big"').when(F.lit(k % 2 == 1), F.concat(F.lit('" '), (F.col("p_size") + k).cast("string"), F.lit('"'))).otherwise((F.col("p_size") + k).cast("string"))
        more = F.when(key % 2 == 0, "").otherwise(', "children": []')
        if doc is not None:
            more = F.when(key % DEPTH > k, F.concat(F.lit(', "children": ['), doc, F.lit(", "), leaf, F.lit("]"))).otherwise(more)
        doc = F.concat(F.lit('{"size": '), size, F.lit(', "name": "'), F.col("p_brand"), F.lit(f' {k}"'), more, F.lit("}"))
    rows = _t(spark, sf, "part").select("p_partkey", doc.alias("doc"))
    return _told(trees.nodes(rows, "p_partkey", "doc", NODE), "p_partkey")


CARD = RecordSchema("Card", [Field("card", "int", ge=1000)])
BANK = RecordSchema("Bank", [Field("iban"), Field("bic", required=False)])
PAYMENT = RecordSchema("Payment", [Field("ref", trees.OneOf(("int", "date", "datetime"))), Field("amount", "decimal", le=1000000), Field("span", trees.Parts(("int", "float"))), Field("target", trees.OneOf((CARD, BANK))), Field("extra", "any", required=False)])


@query("""
WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
i AS (SELECT k, d, concat_ws('; ',
  CASE WHEN k % 5 = 3 THEN 'ref -> int: int_parsing; ref -> date: date_from_datetime_parsing; ref -> datetime: datetime_from_date_parsing' END,
  CASE WHEN k % 7 = 6 THEN 'amount: decimal_parsing' WHEN k % 7 = 5 THEN 'amount: less_than_equal' END, CASE WHEN k % 6 = 5 THEN 'span -> 1: missing' END,
  CASE WHEN k % 4 = 2 THEN 'target -> Card -> card: greater_than_equal; target -> Bank -> iban: missing' END) AS issues FROM o)
SELECT k AS o_orderkey, issues, CASE WHEN issues = '' THEN '{"ref":' || CASE k % 5 WHEN 0 THEN k::VARCHAR WHEN 1 THEN '"' || d || '"' WHEN 2 THEN '"' || d || 'T10:20:00Z"' ELSE '42' END || ',"amount":"' || k || CASE WHEN k % 2 = 0 THEN '.5' ELSE '.50' END || '","span":[' || k || ',2.5],"target":'
  || CASE k % 4 WHEN 0 THEN '{"card":' || k + 4000 || '}' ELSE '{"iban":"DE' || k || '","bic":"B"}' END || CASE WHEN k % 2 = 0 THEN ',"extra":[1,{"a":null}]' ELSE '' END || '}' END AS record FROM i
""")
def union_records(spark, sf):
    """Each alternative is taken somewhere, and in some rows none fits."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = lambda pattern, *c: F.format_string(pattern, *c)
    ref = F.when(key % 5 == 0, key.cast("string")).when(key % 5 == 1, text('"%s"', day)).when(key % 5 == 2, text('"%s 10:20Z"', day)).when(key % 5 == 3, '"soon"').otherwise('"42"')
    amount = F.when(key % 7 == 6, '"a lot"').when(key % 7 == 5, "2e9").when(key % 2 == 0, text("%d.50", key)).otherwise(text('"+%d.50"', key))
    span = F.when(key % 6 == 5, text("[%d]", key)).otherwise(text('["%d", "2.5"]', key))
    target = F.when(key % 4 == 0, text('{"card": %d}', key + 4000)).when(key % 4 == 1, text('{"iban": "DE%d", "bic": "B"}', key)).when(key % 4 == 2, '{"card": 12}').otherwise(text('{"card": 5000, "iban": "DE%d", "bic": "B"}', key))
    extra = F.when(key % 2 == 0, ', "extra": [1, {"a": null}]').otherwise("")
    doc = F.concat(F.lit('{"ref": '), ref, F.lit(', "amount": '), amount, F.lit(', "span": '), span, F.lit(', "target": '), target, extra, F.lit("}"))
    rows = _t(spark, sf, "orders").select("o_orderkey", doc.alias("doc"))
    return _told(trees.nodes(rows, "o_orderkey", "doc", PAYMENT), "o_orderkey")


SEEN = RecordSchema("Seen", [Field("name", grounded=Grounded(source="tree"))])
SEEN.fields.append(Field("inner", SEEN, required=False))


@query("""
SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN ['inner -> name', 'inner -> inner -> name'] WHEN p_partkey % 3 = 0 THEN ['inner -> name'] WHEN p_partkey % 2 = 1 THEN ['inner -> inner -> name'] ELSE [] END) AS field_path FROM part
""")
def tree_grounding(spark, sf):
    """Names at three depths, looked for in a named source that lacks some of them."""
    key, name = F.col("p_partkey"), lambda c: F.concat(F.lit('{"name": '), F.to_json(c.cast("variant")))
    doc: Column = F.concat(name(F.col("p_brand")), F.lit(', "inner": '), name(F.concat(F.upper("p_type"), F.lit("_A"))), F.lit(', "inner": '), name(F.concat(F.lit("B_"), "p_name")), F.lit("}}}"))
    text = F.concat_ws(" ", F.lower("p_brand"), F.when(key % 3 != 0, F.concat("p_type", F.lit("_a"))), F.when(key % 2 == 0, F.concat(F.lit(" b_"), "p_name")))
    rows = _t(spark, sf, "part").select("p_partkey", doc.alias("doc"), text.alias("text"))
    found = trees.grounding_of(trees.nodes(rows, "p_partkey", "doc", SEEN), "p_partkey", rows.select("p_partkey", F.lit("tree").alias("name"), "text"))
    return found.select("p_partkey", "field_path")
