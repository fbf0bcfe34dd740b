"""Tool-call extraction and parsing against Python's own re and json."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agentlake.functions import calls as C
from agentlake.functions import json_text as J
from agentlake.functions import text as T
from agentlake.operators import parsers
from agentlake.operators.tokens import decoder_kind

TEXTS = [
    'a <tool_call>{"name": "x", "arguments": {"k": 1}}</tool_call> b <tool_call>\n{"name":"y","arguments":{}}\n</tool_call>',
    '<tool_call>bad</tool_call> ```json {"name": "x", "arguments": {}} ```',
    '<|im_start|>{"name":"a","arguments":{"q":"it"}}',
    '<|im_start|> one <|im_end|> two <|im_start|>three\n',
    '```tool_call\n{"name":"a","arguments":{}}\n``` and ```tool_call {"name":"b","arguments":null}```',
    '```json\n{"x": 1, "name": "n", "arguments": {"a": [1, 2]}}\n```',
    '```json\n{"arguments": {}, "name": "n"}\n```',
    '<｜tool▁call▁begin｜>function<｜tool▁sep｜>go\n```json\n{"name":"go","arguments":{"a":"ü"}}\n```',
    "<tool_call>{'name': 'a', 'arguments': {'k': 1}}</tool_call>",
    "<tool_call></tool_call>",
    "no calls at all",
    "",
    '<tool_call> {"name":"a","arguments":{}} </tool_call>',
]

RAWS = [
    '{"name":"a","arguments":{}} junk',
    '{"name":"a","arguments":{"z": 1.5, "a":[1, 2,"x"]}}',
    "{'name':'a','arguments':{'k':1}}",
    '{"name":"a","arguments":null}',
    '{"name":"a"}',
    '{"arguments":{}}',
    "[1]",
    "5",
    '"name arguments"',
    "null",
    "",
    '{"a":01}',
    '{"a":"x\ny"}',
    '{"a":1},{"b":2}',
    '{"a":1}]',
    '{"a":1} ,',
    ' {"name":"b","arguments":[]}\n',
    '{"name":"it\'s","arguments":{}}',
    '{"a":+1}',
    "{a:1}",
    '{"a":tru}',
    '{"name":1,"arguments":"text"}',
]


def python_matches(text):
    for name, _, pattern in C.CALL_FORMATS:
        found = [m.group(1) for m in re.finditer(pattern, text, re.DOTALL)]
        if found:
            return name, found
    return None


def python_call(raw):
    for attempt in (raw, raw.replace("'", '"')):
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(value, dict) and "name" in value and "arguments" in value:
            return value
        return None
    return None


def test_first_matching_format(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", C.matched_calls(F.col("t")).alias("m"))
    for row in df.collect():
        got = (row.m.fmt, list(row.m.raws)) if row.m else None
        assert got == python_matches(row.t), row.t


def test_parse_call_json(spark):
    df = spark.createDataFrame([(r,) for r in RAWS], "r string").select("r", C.parse_call_json(F.col("r")).alias("c"))
    for row in df.collect():
        want = python_call(row.r)
        assert (row.c is None) == (want is None), row.r
        if want is not None:
            assert row.c.name == str(want["name"])
            if isinstance(want["arguments"], (dict, list)):
                assert json.loads(row.c.arguments) == want["arguments"]
            else:
                assert row.c.arguments == want["arguments"]


def test_bad_json_in_first_format_hides_later_ones(spark):
    df = spark.createDataFrame([(TEXTS[1],)], "t string")
    assert df.select(F.size(C.parse_calls(F.col("t")))).first()[0] == 0


def valid(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=4), inner, max_size=3),
    max_leaves=8,
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(json_values, st.sampled_from(["", " ", " x", "}", "]", ",1", '"', "'"])), min_size=20, max_size=40))
def test_is_json_agrees_with_python(spark, cases):
    texts = [json.dumps(value) + tail for value, tail in cases]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", J.is_json(F.col("t")).alias("ok"))
    for row in df.collect():
        assert row.ok == valid(row.t), row.t


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ('{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1}', True),
        ('{"a":1}', '{"a":1.0}', False),
        ("[1,2]", "[2,1]", False),
        ("[1,1.0]", "[1.0,1]", False),
        ("true", "1", False),
        ("{", "{", False),
        (None, "1", False),
    ],
)
def test_json_equal(spark, a, b, equal):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(J.json_equal(F.col("a"), F.col("b"))).first()[0] is equal


def test_json_equal_of_batches_without_a_text(spark):
    rows = [(i, None if i < 40 else "bad" if i < 60 else f'{{"a": {i % 3}}}') for i in range(100)]
    df = spark.createDataFrame(rows, "i int, t string").repartitionByRange(5, "i")
    kinds = df.select("i", J.json_equal(F.col("t"), F.lit('{"a": 1}')).alias("same"), decoder_kind(F.col("t"), J.canonical_json).alias("kind"))
    got = {r.i: (r.same, r.kind) for r in kinds.collect()}
    assert got == {i: (i >= 60 and i % 3 == 1, "naive") for i in range(100)}



@pytest.mark.parametrize(
    "text, want",
    [
        ('{"name":"f","parameters":{"x":1}}', ("f", '{"x":1}', None)),
        ('{"name":"f","parameters":{"x":1},"arguments":{"y":2}}', ("f", '{"y":2}', None)),
        ('f({"x":1})', ("f", '{"x":1}', None)),
        ('f ({"x":\n1}) ', ("f", '{"x":\n1}', None)),
        ("hello", (None, None, "Could not parse tool call: hello")),
        ("f(nope)", (None, None, "Could not parse tool call: f(nope)")),
        ("y" * 150, (None, None, "Could not parse tool call: " + "y" * 100)),
    ],
)
def test_normalize_call(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(C.normalize_call(F.col("t")).alias("c")).first().c
    assert (row.name, row.arguments, row.error) == want


def test_parsers_by_format_and_udtf(spark):
    df = spark.createDataFrame(
        [(1, TEXTS[0], "json_tools"), (2, 'f({"x":1})', "python_tag"), (3, "q", "other")], "id int, text string, fmt string"
    )
    rows = parsers.parse_calls(df).orderBy("id", "name").collect()
    assert [(r.id, r.name, r.error) for r in rows] == [
        (1, "x", None), (1, "y", None), (2, "f", None), (3, None, "No parser for format: other"),
    ]
    own = {**parsers.ROW_PARSERS, "other": lambda text: [(word, "{}", None) for word in text.split()]}
    parsers.register_udtf(spark, "split_calls", own)
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, c.name FROM texts, LATERAL split_calls(text, fmt) c ORDER BY id, c.name").collect()
    assert [(r.id, r.name) for r in got] == [(1, "x"), (1, "y"), (2, "f"), (3, "q")]


def test_lateral_parser_equals_the_expressions(spark):
    texts = [*TEXTS, *RAWS, 'f({"x": 1})', "f(bad)", ' {"name": "n", "parameters": {"a": 1}} ', '{"parameters": 1}', None]
    rows = [(i, t, f) for i, t in enumerate(texts) for f in ("json_tools", "python_tag", "mistral", None)]
    df = spark.createDataFrame(rows, "id int, text string, fmt string").where("text IS NOT NULL")
    order = ["id", "fmt", "name", "arguments"]
    a = parsers.parse_calls(df).orderBy(*order).collect()
    b = parsers.parse_calls_lateral(df).orderBy(*order).collect()
    for x, y in zip(a, b, strict=True):
        assert (x.id, x.fmt, x.name, x.error) == (y.id, y.fmt, y.name, y.error)
        assert x.arguments == y.arguments or json.loads(x.arguments) == json.loads(y.arguments)
    none = spark.createDataFrame([(1, None, "json_tools"), (2, "", "json_tools")], "id int, text string, fmt string")
    assert parsers.parse_calls_lateral(none).collect() == []


def test_chat_response_errors(spark):
    cases = {
        '{"error":"down","choices":[]}': "down",
        '{"error":null}': "null",
        '{"choices":[]}': "Empty choices in response",
        "{}": "Empty choices in response",
        "oops": "Response is not a JSON object",
        '{"choices":[{"message":null}]}': None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", T.flatten_chat_response(F.col("raw")).alias("r"))
    for row in df.collect():
        assert row.r.error == cases[row.raw]
        assert (row.r.content, row.r.reasoning, row.r.tokens, row.r.total_tokens) == ("", "", 0, 0)


@pytest.mark.parametrize(
    "text, host, path",
    [("n1:~/a:b", "n1", "/home/u/a:b"), ("n1:/x~", "n1", "/x~"), (":p", "", "p"), ("nocolon", None, None)],
)
def test_remote_path(spark, text, host, path):
    row = spark.createDataFrame([(text,)], "t string").select(T.parse_remote_path(F.col("t"), "/home/u").alias("p")).first().p
    assert (row.host, row.path) == (host, path) if host is not None else row is None


def test_wired_gb(spark):
    df = spark.createDataFrame([("Pages wired down:    1400000.",)], "line string")
    gb = df.select(T.wired_gb(F.col("line")).alias("gb"))
    assert gb.first().gb == 21
    assert gb.select(T.over_wired_limit(F.col("gb"))).first()[0]


def test_native_calls_with_bad_arguments(spark):
    df = spark.sql(
        """SELECT 'c' AS content, array(named_struct('function', named_struct('name', 'a"b', 'arguments', '{"x":1}')),
           named_struct('function', named_struct('name', 'n', 'arguments', '{"x":')),
           named_struct('function', named_struct('name', 'm', 'arguments', CAST(NULL AS STRING)))) AS calls"""
    )
    text = df.select(C.native_calls_to_tags(F.col("content"), F.col("calls"))).first()[0]
    bodies = [json.loads(b) for b in re.findall(r"<tool_call>\n(.*?)\n</tool_call>", text)]
    assert bodies == [{"name": 'a"b', "arguments": {"x": 1}}, {"name": "n", "arguments": {}}, {"name": "m", "arguments": {}}]
