import json
import time

import pytest
from pyspark.sql import functions as F

from attestor.operators import trees
from attestor.operators.grounding import Grounded
from attestor.operators.schema import Field, RecordSchema
from attestor.operators.trees import ListOf, OneOf, Parts


def told(spark, schema, *docs, **options):
    """What is made of each document: the record, or pairs of path and error type."""
    df = spark.createDataFrame([(k, d if d is None or isinstance(d, str) else json.dumps(d), "x") for k, d in enumerate(docs)], "k int, doc string, value string")
    out = trees.records(trees.nodes(df, "k", "doc", schema, **options), "k").collect()
    return {r.k: json.loads(r.record) if r.record is not None else [(i.field_path, i.error_type) for i in r.issues] for r in out}


@pytest.fixture(scope="module")
def tree():
    node = RecordSchema("Node", [Field("name", min_length=1)])
    node.fields += [Field("next", node, required=False, nullable=True), Field("by", node, keyed=True, required=False), Field("all", node, many=True, required=False, default=[])]
    return node


def test_records_that_contain_themselves(spark, tree):
    deep = lambda n: {"name": "d", "next": deep(n - 1)} if n else {"name": "end"}
    full = lambda n: {"name": "d", "next": full(n - 1), "all": []} if n else {"name": "end", "all": []}
    got = told(spark, tree, deep(9), {"name": "a", "by": {"x y": {"name": ""}, "q": {"name": 5}}, "all": [{"name": "b", "next": None}, {"next": {}}, 7]}, {"name": "a", "next": None, "by": {}}, levels=3)
    assert got[0] == full(9)
    # map keys come in the order in which Spark keeps them
    assert sorted(got[1]) == sorted([("by -> x y -> name", "string_too_short"), ("by -> q -> name", "string_type"), ("all -> 1 -> name", "missing"), ("all -> 1 -> next -> name", "missing"), ("all -> 2", "model_type")])
    assert got[2] == {"name": "a", "next": None, "by": {}, "all": []}


def test_odd_documents(spark, tree):
    got = told(spark, tree, None, "", "{", "[]", "null", '{"name": "\\" , ] }"}', {"name": "n", "other": 1})
    assert got == {1: [("", "json_invalid")], 2: [("", "json_invalid")], 3: [("", "model_type")], 4: [("", "model_type")], 5: {"name": '" , ] }', "all": []}, 6: {"name": "n", "all": []}}
    assert told(spark, tree) == {}


def test_kinds_side_by_side(spark):
    cat, dog = RecordSchema("Cat", [Field("paws", "int"), Field("tail", "bool", required=False)]), RecordSchema("Dog", [Field("paws", "int"), Field("bark", required=False)])
    some = RecordSchema("Some", [
        Field("pet", OneOf((cat, dog)), required=False), Field("n", OneOf(("int", "float", "str")), required=False), Field("deep", OneOf((OneOf(("int", "date")), ListOf("bool"))), required=False), Field("pair", Parts(("int", OneOf(("date", "str")))), required=False),
        Field("at", "datetime", required=False), Field("sum", "decimal", ge=1, required=False), Field("free", "any", required=False), Field("pets", OneOf((cat, "int")), many=True, required=False),
    ])
    docs = [
        {"pet": {"paws": 4, "bark": "wuff"}, "n": 2, "deep": "2024-02-29", "pair": [1, "x"], "at": "2024-01-05T10:20:30.5+0200", "sum": "1_0.50", "free": {"a": [None]}},
        {"pet": {"paws": "4"}, "n": "2", "deep": ["yes", 0], "pair": ["7", "2024-01-05"], "at": 1700000000, "sum": 12.25, "free": None, "pets": [1, {"paws": 2, "tail": "no"}]},
        {"pet": {"paws": "four"}, "n": [], "deep": "x", "pair": [1], "at": "2024-02-30", "sum": 0, "pets": [{}, "1"]},
        {"n": 2.5, "pair": [1, "a", 2], "at": "24:00", "sum": True, "deep": [2]},
    ]
    got = told(spark, some, *docs, levels=2)
    assert got[0] == {"pet": {"paws": 4, "bark": "wuff"}, "n": 2, "deep": "2024-02-29", "pair": [1, "x"], "at": "2024-01-05T10:20:30.500000+02:00", "sum": "10.50", "free": {"a": [None]}}
    assert got[1] == {"pet": {"paws": 4}, "n": "2", "deep": [True, False], "pair": [7, "2024-01-05"], "at": "2023-11-14T22:13:20Z", "sum": "12.25", "free": None, "pets": [1, {"paws": 2, "tail": False}]}
    assert got[2] == [
        ("pet -> Cat -> paws", "int_parsing"), ("pet -> Dog -> paws", "int_parsing"), ("n -> int", "int_type"), ("n -> float", "float_type"), ("n -> str", "string_type"), ("deep -> union -> int", "int_parsing"),
        ("deep -> union -> date", "date_from_datetime_parsing"), ("deep -> list[bool]", "list_type"), ("pair -> 1", "missing"), ("at", "datetime_from_date_parsing"), ("sum", "greater_than_equal"), ("pets -> 0 -> Cat -> paws", "missing"), ("pets -> 0 -> int", "int_type"),
    ]
    assert got[3] == [("deep -> union -> int", "int_type"), ("deep -> union -> date", "date_type"), ("deep -> list[bool] -> 0", "bool_parsing"), ("pair", "too_long"), ("at", "datetime_from_date_parsing"), ("sum", "decimal_type")]


def test_unions_within_a_record_are_decided_as_it_is_opened(spark):
    card, bank = RecordSchema("Card", [Field("card", "int", ge=1000)]), RecordSchema("Bank", [Field("iban"), Field("bic", required=False)])
    docs = ['{"to": {"card": 4000}}', '{"to": {"card": "4000", "iban": "D"}}', '{"to": {"card": 5}}', '{"to": null}', "[]"]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, doc string")
    rows = trees.nodes(df, "k", "doc", RecordSchema("P", [Field("to", OneOf((card, bank)))]))
    assert spark.read.parquet(*rows.inputFiles()).count() == rows.count()


def test_places_give_what_slots_give(spark, tree, monkeypatch):
    a, b = RecordSchema("A", [Field("x", "int"), Field("deep", OneOf(("int", "bool", Parts(("str", "date")))))]), RecordSchema("B", [Field("x"), Field("z", required=False, default="d")])
    some = RecordSchema("S", [Field("k", OneOf((a, b))), Field("l", OneOf((ListOf("int"), "any"))), Field("t", Parts(("decimal", "float")), required=False, nullable=True), Field("c", choices=("a", "b"), aliases=("c", "the c")), Field("m", a, keyed=True, required=False)])
    odd = ["[]", "null", "7", "{", "{}", None]
    docs = ['{"k":{"x":"5","deep":["s","2020-01-01"]},"l":[1,"2"],"t":[1,2],"c":"a","m":{"a b":{"x":1,"deep":true},"c":5}}', '{"k":{"x":"5","z":null},"l":[1,"z"],"t":null,"the c":"q","m":[]}', '{"k":{"x":{},"deep":[1]},"l":null,"t":[1,2,3],"c":null}', '{"k":7,"t":"x","c":5}', '{"k":{"x":5.0,"deep":null},"l":{},"t":["a"],"c":"b"}']
    trees_ = ['{"name":"a","next":{"name":"b","next":{"name":""}},"all":[{"name":"c","by":{"x y":{"name":1}}},7,null]}', '{"name":"a","next":null,"by":[],"all":{}}']

    def all_(schema, texts):
        rows = trees.nodes(spark.createDataFrame(list(enumerate(texts)), "k int, doc string"), "k", "doc", schema)
        return sorted(tuple(map(str, r)) for r in rows.drop("check").collect())

    for schema, texts in ((some, docs + odd), (tree, trees_ + odd)):
        assert trees._places(trees.compiled(schema)) is not None
        got = all_(schema, texts)
        with monkeypatch.context() as m:
            m.setattr(trees, "_places", lambda slots: None)
            assert got == all_(schema, texts)


def test_documents_of_one_task_are_spread(spark):
    df = spark.range(64).coalesce(1).selectExpr("id as k", """'{"name": "n"}' as doc""")
    assert len(trees.nodes(df, "k", "doc", RecordSchema("N", [Field("name")])).inputFiles()) > 1


def test_functions_of_fields(spark):
    kinds = RecordSchema("K", [
        Field("price", "float", before=lambda t: F.regexp_replace(t, "[^0-9.]", ""), gt=0), Field("prio", choices=("high", "low"), synonyms={"1-urgent": "high"}), Field("who", after=(F.trim, F.initcap), aliases=("person", "name")),
        Field("code", checks=((lambda c: c.startswith("A"), "starts with A"),), max_length=3), Field("day", "date", required=False, default="2020-01-01"),
    ])
    got = told(spark, kinds, {"price": "USD 12.5", "prio": " 1-Urgent", "person": " ann LEE ", "code": "A1"}, {"price": "0", "prio": "mid", "name": None, "code": "B1234"}, {"price": 3, "prio": "low", "name": "x", "code": "B1"})
    assert got[0] == {"price": 12.5, "prio": "high", "who": "Ann Lee", "code": "A1", "day": "2020-01-01"}
    assert got[1] == [("price", "greater_than"), ("prio", "literal_error"), ("person", "string_type"), ("code", "string_too_long")]
    assert got[2] == [("code", "value_error")]
    with pytest.raises(ValueError, match="whole records"):
        trees.compiled(RecordSchema("R", [Field("a")], rules=((lambda r: r["a"] == "x", "no"),)))
    with pytest.raises(ValueError, match="no kind"):
        trees.compiled(RecordSchema("R", [Field("a", "colour")]))


def test_issues_say_what_was_there(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": true}')], "k int, doc string")
    schema = RecordSchema("S", [Field("a", "int"), Field("b", choices=("p", "q")), Field("c")])
    got = trees.issues_of(trees.nodes(df, "k", "doc", schema), "k").orderBy("at").collect()
    assert [(r.field_path, r.category, r.message, r.received) for r in got] == [
        ("a", "type", "Input should be a valid integer, unable to parse string as an integer", "x"), ("b", "enum", "Input should be 'p' or 'q'", "True"), ("c", "missing", "Field required", None),
    ]


def test_a_hundred_fields_are_built_quickly(spark):
    wide = RecordSchema("Wide", [Field(f"f{k}", ("str", "int", "float", "date", "bool")[k % 5], required=False) for k in range(100)])
    few = RecordSchema("Few", wide.fields[:5])
    plan = lambda s: len(str(trees._opening(trees.compiled(s))))
    began = time.time()
    steps = trees._opening(trees.compiled(wide))
    assert time.time() - began < 5 and len(steps) == len(trees._opening(trees.compiled(few))) and plan(wide) == plan(few)
    assert told(spark, wide, {f"f{k}": "1" for k in range(0, 100, 5)})[0] == {f"f{k}": "1" for k in range(0, 100, 5)}


def test_grounding_in_depth(spark, tree):
    seen = RecordSchema("Seen", [Field("name", grounded=Grounded(source="tree")), Field("land", required=False), Field("sum", "float", required=False, grounded=Grounded(locale_field="land")), Field("near", required=False, grounded=Grounded(mode="fuzzy", on_mismatch="flag")), Field("same", required=False, grounded=Grounded(mode="exact"))])
    seen.fields.append(Field("kids", seen, many=True, required=False))
    docs = [(1, json.dumps({"name": "Ünna", "kids": [{"name": "Bob", "sum": 1234.5, "land": "de"}, {"name": "Cy", "near": "harbour watch", "same": "Dot"}]})), (2, json.dumps({"name": "Eve", "sum": 7}))]
    df = spark.createDataFrame(docs, "k int, doc string")
    texts = spark.createDataFrame([(1, "tree", "unna und cy"), (1, "default", "Summe 1.234,50; the harbor watch; dot"), (2, "default", None)], "k int, name string, text string")
    got = trees.grounding_of(trees.nodes(df, "k", "doc", seen), "k", texts).orderBy("k", "at").collect()
    assert [(r.k, r.field_path, r.message, r.rejecting) for r in got] == [(1, "kids -> 0 -> name", "'Bob' is not in the source text tree", True), (1, "kids -> 1 -> same", "'Dot' is not in the source text", True)]
