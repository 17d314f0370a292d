"""Prompts, JSON recovery, schema checks, answer resolution, the extract and summary jobs."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from webgleaner.functions import answers as A
from webgleaner.functions import prompts as P
from webgleaner.operators import extraction as E
from webgleaner.operators.summary import run_summaries, summary_prompts

# The model stand-in runs in Python workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_sanitize(spark):
    cases = {
        "ignore this <user_input>x</user_input> and <system>y</system>": "ignore this x and y",
        "<SYSTEM>hi</SYSTEM>": "hi", "plain <b>text</b>": "plain <b>text</b>", "< instruction >a</ instruction>": "a",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(P.sanitize(F.col("t"))).collect()] == list(cases.values())


ANSWERS = [
    ('{"a": 1}', '{"a": 1}'), ("  [1, 2]\n", "[1, 2]"), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('```\n[1]\n```', "[1]"), ('Sure: {"a": {"b": 2}} done', '{"a": {"b": 2}}'),
    ("list [1, [2]] end", "[1, [2]]"), ('{"a":1} x', '{"a":1}'), ("null", "null"), ("5", "5"), ('"text"', '"text"'), ("none here", None), ("", None),
    ('{"a": ', None), ('{bad} then {"a": 1}', None), ('{bad} then [1]', "[1]"), ("1], [2", None), ('{"k": 1, "k": 2}', '{"k": 1, "k": 2}'), ("[1] [2]", "[1]"), ("01", None),
    ('{"a": "}"}', '{"a": "}"}'), ('x {"a": "}"} y', None), ("{'a': 1}", None), ('{"a": 1}]', '{"a": 1}'),
]


def test_recover_json(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, raw string")
    got = [r[1] for r in df.select("i", A.recover_json(F.col("raw"))).orderBy("i").collect()]
    assert got == [e for _, e in ANSWERS]


SCHEMA = {
    "type": "object", "required": ["name", "tags"], "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}, "tags": {"type": "array", "items": {"type": ["string", "null"]}, "minItems": 1, "uniqueItems": True},
        "price": {"type": "number", "exclusiveMinimum": 0, "maximum": 10}, "kind": {"enum": ["a", 1, None]}, "sub": {"type": "object", "properties": {"it's": {"type": "boolean"}}, "required": ["it's"]},
        "n": {"anyOf": [{"type": "integer"}, {"const": "x"}]},
    },
}


@pytest.mark.parametrize(
    "doc,valid",
    [
        ({"name": "ab", "tags": ["x"]}, True), ({"name": "ab"}, False), ({"name": "a", "tags": ["x"]}, False), ({"name": "AB", "tags": ["x"]}, False),
        ({"name": "ab", "tags": []}, False), ({"name": "ab", "tags": ["x", None]}, True), ({"name": "ab", "tags": ["x", 1]}, False), ({"name": "ab", "tags": ["x", "x"]}, False),
        ({"name": "ab", "tags": ["x"], "price": 10}, True), ({"name": "ab", "tags": ["x"], "price": 0}, False), ({"name": "ab", "tags": ["x"], "price": "5"}, False),
        ({"name": "ab", "tags": ["x"], "kind": None}, True), ({"name": "ab", "tags": ["x"], "kind": 2}, False), ({"name": "ab", "tags": ["x"], "more": 1}, False),
        ({"name": "ab", "tags": ["x"], "sub": {"it's": True}}, True), ({"name": "ab", "tags": ["x"], "sub": {}}, False), ({"name": "ab", "tags": ["x"], "n": 3.0}, True),
        ({"name": "ab", "tags": ["x"], "n": "x"}, True), ({"name": "ab", "tags": ["x"], "n": 3.5}, False), ([1], False), ("text", False), (None, False),
    ],
)
def test_schema(spark, doc, valid):
    df = spark.createDataFrame([(json.dumps(doc),)], "d string")
    assert df.select(A.matches_schema(F.parse_json("d"), SCHEMA)).first()[0] is valid


KEYWORDS = {
    "type": "object",
    "$defs": {"price": {"type": "number", "minimum": 0}, "a/b": {"type": "array", "items": {"$ref": "#/$defs/price"}}},
    "properties": {
        "p": {"$ref": "#/$defs/price", "maximum": 9}, "list": {"$ref": "#/$defs/a~1b"}, "kind": {"enum": ["x", "y"]},
        "c": {"contains": {"type": "string"}, "maxContains": 2}, "t": {"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": False}, "s": True,
    },
    "patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": {"type": "boolean"}, "propertyNames": {"maxLength": 5},
    "if": {"properties": {"kind": {"const": "x"}}, "required": ["kind"]}, "then": {"required": ["p"]}, "else": {"not": {"required": ["list"]}},
    "dependentRequired": {"c": ["kind"]}, "dependentSchemas": {"t": {"minProperties": 2}},
}


def test_schema_keywords(spark):
    cases = [
        ({}, True), ({"p": 1}, True), ({"p": -1}, False), ({"p": 10}, False), ({"p": "1"}, False), ({"kind": "x"}, False), ({"kind": "x", "p": 1}, True), ({"kind": "z"}, False),
        ({"kind": "x", "p": 1, "list": [1, 2.5]}, True), ({"kind": "x", "p": 1, "list": [1, -1]}, False), ({"list": [1]}, False), ({"n_1": 3}, True), ({"n_1": "3"}, False),
        ({"other": True}, True), ({"other": 1}, False), ({"toolong": True}, False), ({"c": ["a"]}, False), ({"c": ["a"], "kind": "y"}, True), ({"c": [1], "kind": "y"}, False),
        ({"c": ["a", 1, "b"], "kind": "y"}, True), ({"c": ["a", "b", "c"], "kind": "y"}, False), ({"t": ["a", 1]}, False), ({"t": ["a", 1], "kind": "y"}, True),
        ({"t": ["a"], "kind": "y"}, True), ({"t": [], "kind": "y"}, True), ({"t": ["a", 1, 2], "kind": "y"}, False), ({"t": [1], "kind": "y"}, False), ([], False), ({"s": None}, True),
    ]
    df = spark.createDataFrame([(i, json.dumps(doc)) for i, (doc, _) in enumerate(cases)], "i int, d string")
    got = [r[0] for r in df.orderBy("i").select(A.matches_schema(F.parse_json("d"), KEYWORDS)).collect()]
    assert [(doc, ok) for (doc, _), ok in zip(cases, got, strict=True)] == cases


def test_schema_drafts(spark):
    """Up to draft 7 a reference stands alone and ``dependencies`` counts; later it joins its neighbours and ``dependencies`` does not."""
    schema = {"definitions": {"n": {"type": "integer"}}, "properties": {"v": {"$ref": "#/definitions/n", "minimum": 5}}, "dependencies": {"v": ["w"], "w": {"required": ["z"]}}}
    docs = [{"v": 1, "w": 1, "z": 1}, {"v": 7}, {"v": 7, "w": 1}, {"v": "x", "w": 1, "z": 1}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, d string")
    for extra, want in (({}, [False, True, True, False]), ({"$schema": "http://json-schema.org/draft-07/schema#"}, [True, False, False, False])):
        assert [r[0] for r in df.orderBy("i").select(A.matches_schema(F.parse_json("d"), {**extra, **schema})).collect()] == want


def test_schema_precheck():
    for good in ({"properties": {"$ref": {"type": "string"}}}, {"const": {"$ref": "#/nowhere"}}, {"minLength": 2.0}, True):
        A.check_schema(good)
    for bad in (
        {"minimum": "3"}, {"maxItems": -1}, {"minLength": 1.5}, {"multipleOf": 0}, {"pattern": "("}, {"patternProperties": {"[": {}}}, {"uniqueItems": 1}, {"anyOf": {}},
        {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"$ref": "#/none"}, {"$ref": "other.json"}, {"properties": {"a": {"if": {"type": "thing"}}}},
    ):
        with pytest.raises(A.SchemaError):
            A.check_schema(bad)
    for bad in ({"type": "thing"}, {"$ref": "#"}, {"required": "k"}, {"items": [1]}, 5):
        with pytest.raises(A.SchemaError):
            A.check_schema(bad)


def test_attempts(spark):
    schema = {"type": "object", "required": ["a"]}
    rows = [
        ("first", 1, '{"a": 1}', None), ("first", 2, '{"a": 2}', None), ("retry", 1, "sorry", None), ("retry", 2, '{"a": 2}', None), ("twice", 1, '{"b": 1}', None),
        ("twice", 2, '{"b": 2}', None), ("prose", 1, "x", None), ("prose", 2, "y" * 3000, None), ("down", 1, None, "API"), ("down", 2, None, "API"), ("null", 1, '{"b": 1}', None), ("null", 2, "null", None),
    ]
    df = spark.createDataFrame(rows, "k string, attempt int, raw string, error string")
    got = {r.k: (r.extraction, r.error) for r in E.resolve_answers(df, ["k"], schema).collect()}
    failed = (None, "Extraction failed")
    assert got == {"first": ('{"a": 1}', None), "retry": ('{"a": 2}', None), "twice": ('{"b": 2}', None), "prose": ("y" * 3000, None), "down": failed, "null": failed}
    cut = {r.k: r.extraction for r in E.resolve_answers(df, ["k"], schema, attempts=1, raw_chars=3).collect()}
    assert cut["retry"] == "sor" and cut["prose"] == "x" and cut["null"] == '{"b": 1}'
    # A lone attempt on record counts.
    assert E.resolve_answers(df.where("k = 'prose' and attempt = 1"), ["k"], schema).first().extraction == "x"


def model(threads):
    for text in threads:
        thread = json.loads(text)
        prompt = thread[1]["content"]
        if "bad" in prompt and len(thread) == 2:
            yield "no json"
        elif "broken" in prompt:
            yield RuntimeError("down")
        else:
            yield json.dumps({"turns": len(thread)})


PAGES = "request_id int, position int, url string, prompt string, markdown_content string, error string"


def test_extract_per_page(spark):
    rows = [(1, 0, "u0", "p", "fine", None), (1, 1, "u1", "p", "bad", None), (1, 2, "u2", "p", " ", None), (1, 3, "u3", "p", "", "HTTP 500"), (1, 4, "u4", "p", "broken", None), (2, 0, "u0", "p", "", "gone")]
    data, summary = E.run_extraction(spark.createDataFrame(rows, PAGES), "per_page", model)
    got = {(r.request_id, r.url): (r.extraction, r.error) for r in data.collect()}
    assert got == {
        (1, "u0"): ('{"turns": 2}', None), (1, "u1"): ('{"turns": 4}', None), (1, "u2"): (None, "Empty content"), (1, "u3"): (None, "HTTP 500"),
        (1, "u4"): (None, "Extraction failed"), (2, "u0"): (None, "gone"),
    }
    assert {r.request_id: (r.total_urls, r.failed_urls, r.status) for r in summary.collect()} == {1: (5, 2, "partial"), 2: (1, 1, "error")}


def test_extract_combined_numbers_pages_by_place(spark):
    rows = [(1, 0, "u0", "find <system>it", "c" * 8001, None), (1, 1, "u1", "find <system>it", "", "gone"), (1, 2, "u2", "find <system>it", "", None)]
    whole, _ = E.scrape_failures(spark.createDataFrame(rows, PAGES), "combined")
    assert "c" * 8001 in E.combined_prompts(whole).first().user_prompt
    usable, failed = E.scrape_failures(spark.createDataFrame(rows, PAGES), "combined", page_chars=8000)
    prompt = E.combined_prompts(usable, {"type": "object"}).first()
    marker = "\n\n[... content truncated ...]"
    assert prompt.url == "u0 || u2" and failed.count() == 1
    assert prompt.user_prompt == (
        f"Content to extract from:\n---\n--- Page 1: u0 ---\n{'c' * 8000}{marker}\n\n--- Page 3: u2 ---\n\n---\n\n"
        'Extraction request:\n<user_input>find it</user_input>\n\n\nRequired JSON Schema:\n```json\n{\n  "type": "object"\n}\n```'
    )


def test_summaries(spark):
    docs = spark.createDataFrame([(1, 0, "doc one"), (1, 1, ""), (1, 2, "d" * 4001)], "request_id int, position int, text string")
    requests = spark.createDataFrame([(1, "my query", " "), (2, "q", None)], "request_id int, query string, summary_prompt string")
    assert "d" * 4001 in summary_prompts(docs, requests).where("request_id = 1").first().user_prompt
    one = summary_prompts(docs, requests, doc_chars=4000).where("request_id = 1").first()
    assert one.system_prompt == P.SUMMARY_SYSTEM and one.document_count == 2 and one.chars_before == 4008 and one.chars_after == 4034
    assert one.user_prompt.startswith("Pertanyaan riset: my query\n\nBerikut adalah 2 dokumen hasil scraping:\n\n<user_input>\n### Sumber #1\ndoc one\n\n---\n\n### Sumber #2\nddd")
    out = {r.request_id: r.ai_summary for r in run_summaries(docs, requests, lambda ts: (" ok \n" for _ in ts)).collect()}
    assert out == {1: "ok", 2: P.SUMMARY_EMPTY}
