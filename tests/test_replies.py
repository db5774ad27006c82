import json
import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import replies, text

#: A shipment of tea, told in the ways in which replies go wrong.
CASES = [
    ('{"tea": "sencha", "grams": 250}', {"tea": "sencha", "grams": 250}),
    ('```\n{"crates": [4, 9]}\n```', {"crates": [4, 9]}),
    ('<thinking>is it {"crates": 0}?</thinking>{"crates": 12}', {"crates": 12}),
    ('The harbour log reads {"ship": "Adele", "berth": 7}, signed by the clerk.', {"ship": "Adele", "berth": 7}),
    ('{"berth": 7, // by the crane\n "tide": "low" /* at noon */}', {"berth": 7, "tide": "low"}),
    ('{"berth": 7 "tide": "low"}', {"berth": 7, "tide": "low"}),
    ('{"holds": [{"no": 1, "tea": ["oolong", "assam",]}, {"no": 2}], "sealed": true,}', {"holds": [{"no": 1, "tea": ["oolong", "assam"]}, {"no": 2}], "sealed": True}),
    ('{"draught": +3, "list": -0.5, "load": 4E3}', {"draught": 3, "list": -0.5, "load": 4000.0}),
    ('{"pilot": None, "tug": True, "fog": False}', {"pilot": None, "tug": True, "fog": False}),
    ("{'mate': 'Ines', 'crew': ['Bo', 'Lev']}", {"mate": "Ines", "crew": ["Bo", "Lev"]}),
    ('{"hold": {"no": 3, "tea": ["darjeeling"', {"hold": {"no": 3, "tea": ["darjeeling"]}}),
    ('{"note": "left unfinish', {"note": "left unfinish"}),
    ('{"hold": 1} {"hold": 2},\n{"hold": 3}', [{"hold": 1}, {"hold": 2}, {"hold": 3}]),
    ('{port: "Leith", quay: 2}', {"port": "Leith", "quay": 2}),
    ('{"call": "\\u00c9toile", "said": "\\"ahoy\\""}', {"call": "Étoile", "said": '"ahoy"'}),
    ("The captain's entry: {\"owner\": \"D'Arcy\", \"mark\": \"a // b\"}", {"owner": "D'Arcy", "mark": "a // b"}),
    ('{"chart": ftp://quay.example/7, "sheet": 7}', {"chart": "ftp://quay.example/7", "sheet": 7}),
    ('{"big": 123456789012345678901234567890}', {"big": 123456789012345678901234567890}),
    ('{"weights": {"net": 1.25, "tare": 0.5}} ]', {"weights": {"net": 1.25, "tare": 0.5}}),
]


@pytest.mark.parametrize("raw,want", CASES)
def test_extract(raw, want):
    assert replies.extract_json(raw) == want


@pytest.mark.parametrize("raw", ["", "\t\r\n", "No cargo today.", "<think>{\"cargo\": 1}</think> none"])
def test_no_object(raw):
    with pytest.raises(ValueError):
        replies.extract_json(raw)


def test_comments_stand_outside_quotes_and_addresses():
    quoted = ('"a // b"', '"say \\" // more"', "'it /* holds */'", "x-y+z.1://host/p", "the mate's log")
    for whole in quoted:
        assert replies.strip_comments(whole) == whole
        assert replies.strip_comments(f"[{whole}] // gone\n[{whole}]/* gone */") == f"[{whole}] \n[{whole}] "
    assert replies.strip_comments("[1, /* never closed") == "[1,  " and replies.strip_comments('["never closed // kept') == '["never closed // kept'
    assert replies.strip_comments("/**/[//\n]") == " [\n]"


def test_split_needs_objects_alone():
    assert replies._several('{"a": "}{"} {"b": [{}]}') == [{"a": "}{"}, {"b": [{}]}]
    for other in ("", '{"a": 1}', '{"a": 1} {"b": }', '{"a": 1} [2]', '{"a": 1} and {"b": 2}', '{"a": 1} {"b": 2} x'):
        assert replies._several(other) is None


def test_columns(spark):
    odd = [(90, None), (91, "nothing"), (92, '{"a": 1}] }'), (93, '{"a": 1}, {"b": 2}')]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(CASES)] + odd, "k int, c string")
    got = {r.k: r.p for r in df.select("k", replies.parsed("c").alias("p")).collect()}
    assert all(json.loads(got[k].json) == w for k, (_, w) in enumerate(CASES)) and got[90].json is None and got[91].error
    assert json.loads(got[92].json) == {"a": 1} and json.loads(got[93].json) == [{"a": 1}, {"b": 2}]
    args = spark.createDataFrame([("<think>hm</think>{\"net\": 4}",), ("[4]",), ("{net: 4",), (None,)], "c string")
    assert [r[0] for r in args.select(replies.repair_args(args.c)).collect()] == ['{"net":4}', None, '{"net":4}', None]


def test_strict_replies_never_reach_python(spark):
    df = spark.createDataFrame([('```json\n{"net": 1.50}\n```',)], "c string")
    assert df.select(replies.parsed("c")["json"]).first()[0] == '{"net": 1.50}'  # as it stands, not written anew


def test_arrays(spark):
    docs = ['{"no":1}', '[{"no":1}]', '[{"far":1}]', '[{"no":1},{"no":2}]', "[]", "[7]", '"no"']
    df = spark.createDataFrame([(d,) for d in docs], "d string").coalesce(1)
    plain = [tuple(r[0]) for r in df.select(replies.unwrap_array(df.d, ["no", "tea"])).collect()]
    assert [p[0] for p in plain] == ['{"no":1}', '{"no":1}', None, None, None, None, None] and "2 separate" in plain[3][1]
    listed = [r[0].json for r in df.select(replies.unwrap_array(df.d, ["holds"], "holds")).collect()]
    assert json.loads(listed[3]) == {"holds": [{"no": 1}, {"no": 2}]} and json.loads(listed[4]) == {"holds": []} and listed[5] is None


def test_blocks(spark):
    df = spark.sql("select array(named_struct('type', 'text', 'text', 'fore'), named_struct('type', 'reasoning', 'text', 'hm'), named_struct('type', 'image', 'text', cast(null as string)), named_struct('type', 'function_call', 'text', 'aft')) b, '```\nsail\n```' f")
    r = df.select(text.flatten_blocks(df.b), text.plain_text(df.b), text.strip_fence(df.f)).first()
    assert tuple(r) == ("fore\naft", "fore [reasoning] [image]", "sail")


def test_fold(spark):
    assert text.fold(" \tTwo\n  Masts ") == "two masts" and text.fold("Ångström") == text.fold("angstrom") and text.fold("GROSS") == text.fold("Groß")
    df = spark.createDataFrame([("Two \n MASTS",), ("Groß É",), (None,), ("",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(text.normalized(F.col("t"))).collect()] == ["two masts", "gross e", None, ""]


def distance(needle, haystack):
    """Least edits to any substring, cell by cell."""
    row = [0] * (len(haystack) + 1)
    for i, ch in enumerate(needle, 1):
        left = [i]
        for j, other in enumerate(haystack, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (ch != other)))
        row = left
    return min(row)


def test_fuzzy():
    for needle, haystack in (("spinnaker", "the spinaker tore"), ("mast", ""), ("keel", "keel"), ("rudder", "udde"), ("bow", "stern")):
        assert text.substring_distance(needle, haystack) == distance(needle, haystack)
    assert text.fuzzy_hit("spinnaker", "the spinaker tore", 0.85) and not text.fuzzy_hit("bow", "stern", 0.5) and not text.fuzzy_hit("", "bow", 0.1)


def test_no_reply_ends_the_job(spark):
    """Half characters, depth, cut and random texts: a row out for each row in, and what was cut stays readable."""
    rng = random.Random(5)
    bits = ['{', '}', '[', ']', '"', "'", ":", ",", "\\", "\\u", "\\ud83d", "\\udc00", "\ud83d\ude00", "a", " ", "\n", "1", "-", "1e999", "null", "//", "/*", "*/", "```", "<think>", "</think>", "\x00", "“", "”", "NaN", "9" * 5000]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(2_000)]
    rows += ['Here: {"a": "\\ud83d"}', 'Here: {"a": "\\ud83d\\ude00"}', "x " + "[" * 20_000, "x " + '{"a":' * 20_000, "[" * 20_000, "{" * 300 + "}" * 300, '{"a": ' * 150 + "1", "x {'a': '" + "b" * 200_000, "x " + '"a" ' * 50_000, None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = {r.k: r for r in df.select("k", replies.parsed("t").alias("p"), replies.repair_args(F.col("t")).alias("args")).collect()}
    assert len(got) == len(rows) and all((r.p.json is None) != (r.p.error is None) for r in got.values())
    n = rows.index('Here: {"a": "\\ud83d"}')
    assert [got[n].p.json, got[n + 1].p.json] == ['{"a":"\ufffd"}', '{"a":"\U0001f600"}'] and got[n].args == '{"a":"\ufffd"}'
    assert "deep" in got[n + 2].p.error and "deep" in got[n + 3].p.error and got[n + 2].args is None
    assert got[n + 6].p.json == '{"a":' * 150 + "1" + "}" * 150
