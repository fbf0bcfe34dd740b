"""Tool calls inside model responses: finding, parsing and normalising them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentlake.functions.binding import let
from agentlake.functions.json_text import (
    has_keys,
    is_json,
    is_json_object,
    json_fields,
    opens_object,
    quote,
)

# The call formats in the order they are tried, as (name, marker, pattern).
CALL_FORMATS = [
    ("tool_call_tag", "<tool_call>", r"<tool_call>\s*(.*?)\s*</tool_call>"),
    ("im_block", "<|im_start|>", r"<\|im_start\|>\s*(.*?)\s*(?:<\|im_end\|>|$)"),
    ("fenced_tool_call", "```tool_call", r"```tool_call\s*(.*?)\s*```"),
    (
        "fenced_json",
        "```json",
        r'```json\s*(\{[^`]*"name"[^`]*"arguments"[^`]*\})\s*```',
    ),
    (
        "begin_sep_fence",
        "<｜tool▁call▁begin｜>",
        r"<｜tool▁call▁begin｜>.*?<｜tool▁sep｜>\w+\s*```json\s*(.*?)\s*```",
    ),
]

# Template markers in the order they are tested, with the parser they select.
TEMPLATE_MARKERS = [
    ("minimax_m2", ["<minimax:tool_call>"]),
    ("function_gemma", ["<start_function_call>"]),
    ("longcat", ["<longcat_tool_call>"]),
    ("glm47", ["<arg_key>"]),
    ("pythonic", ["<|tool_list_start|>"]),
    ("qwen3_coder", ["<tool_call>\\n<function=", "<tool_call>\n<function="]),
    ("kimi_k2", ["<|tool_calls_section_begin|>"]),
    ("mistral", ["[TOOL_CALLS]"]),
]
JSON_TOOLS = ("json_tools", ["<tool_call>", "tool_call.name"])

CALL_TYPE = "struct<name:string,arguments:string>"
# Dot matches newlines, "$" sees only "\n", and \s and \w cover Unicode.
_FLAGS = "(?sdU)"


def matched_calls(text: Column) -> Column:
    """``STRUCT<fmt, raws>`` of the first format with any match, else NULL.

    Later formats are not tried once one has matched, even if its JSON is bad. The
    plain substring test in front of each pattern keeps the regex engine away from
    texts that cannot match.
    """

    def attempt(bound, name, marker, pattern):
        raws = F.when(bound.contains(marker), F.regexp_extract_all(bound, F.lit(_FLAGS + pattern), F.lit(1)))
        return let(raws, lambda r: F.when(F.size(r) > 0, F.struct(F.lit(name).alias("fmt"), r.alias("raws"))))

    return let(text, lambda bound: F.coalesce(*[attempt(bound, *fmt) for fmt in CALL_FORMATS]))


def call_body(raw: Column) -> Column:
    """The JSON text of a call: as written, or with quotes repaired, else NULL."""
    repaired = F.replace(raw, F.lit("'"), F.lit('"'))
    return F.when(is_json(raw), raw).when(is_json(repaired), repaired)


def parse_call_json(raw: Column) -> Column:
    """``STRUCT<name, arguments>``; NULL unless an object with both keys.

    Keys are looked up only where a value is missing: a null value still counts.
    """

    def call(body):
        def checked(fields):
            whole = fields["name"].isNotNull() & fields["arguments"].isNotNull()
            return F.when(whole | has_keys(body, "name", "arguments"), fields)

        return F.when(opens_object(body), let(json_fields(body, CALL_TYPE), checked))

    return let(call_body(raw), call)


def parse_calls(text: Column) -> Column:
    """All usable calls of one response, in order; empty when there are none."""
    none = F.array().cast(f"array<{CALL_TYPE}>")
    parsed = F.transform(matched_calls(text)["raws"], parse_call_json)
    return F.coalesce(F.filter(parsed, lambda call: call.isNotNull()), none)


def infer_tool_format(template: Column) -> Column:
    """Name of the call format a chat template asks for, NULL when unknown."""
    chain = None
    for name, markers in TEMPLATE_MARKERS:
        hit = template.contains(markers[0])
        for other in markers[1:]:
            hit = hit | template.contains(other)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    name, markers = JSON_TOOLS
    return chain.when(template.contains(markers[0]) & template.contains(markers[1]), name)


def normalize_call(text: Column) -> Column:
    """``STRUCT<name, arguments, error>`` from a JSON call or ``name({...})``.

    ``parameters`` stands in for ``arguments`` when only the former is present. Text
    in neither form yields an error column, not an exception.
    """
    pattern = r"(?sdU)^(\w+)\s*\((.+)\)\s*$"
    missing = F.lit(None).cast("string")

    def result(name, arguments, error):
        return F.struct(name.alias("name"), arguments.alias("arguments"), error.alias("error"))

    def parsed(body):
        def from_object(fields):
            arguments = F.when(has_keys(body, "arguments"), fields["arguments"]).otherwise(fields["parameters"])
            return result(fields["name"], arguments, missing)

        def from_function(inner):
            name = F.regexp_extract(body, pattern, 1)
            return F.when((inner != "") & is_json(inner), result(name, inner, missing))

        fields = json_fields(body, "struct<name:string,parameters:string,arguments:string>")
        unreadable = F.concat(F.lit("Could not parse tool call: "), F.substring(body, 1, 100))
        return F.when(is_json_object(body), let(fields, from_object)).otherwise(
            F.coalesce(let(F.regexp_extract(body, pattern, 2), from_function), result(missing, missing, unreadable))
        )

    return let(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), parsed)


def native_calls_to_tags(content: Column, calls: Column) -> Column:
    """Content followed by one ``<tool_call>`` block per native call.

    ``calls`` is ``ARRAY<STRUCT<function: STRUCT<name, arguments>>>``; arguments
    that are not valid JSON become ``{}``.
    """

    def block(call):
        function = call["function"]
        arguments = F.when(is_json(function["arguments"]), function["arguments"]).otherwise(F.lit("{}"))
        return F.concat(
            F.lit('\n<tool_call>\n{"name":'),
            quote(function["name"]),
            F.lit(',"arguments":'),
            arguments,
            F.lit("}\n</tool_call>\n"),
        )

    blocks = F.array_join(F.transform(calls, block), "")
    return F.concat(F.coalesce(content, F.lit("")), F.coalesce(blocks, F.lit("")))
