"""Scalar text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentlake.functions.binding import let
from agentlake.functions.json_text import has_keys, is_json_object

# Thinking delimiters, in order of priority.
THINK_MARKERS = [("<think>", "</think>"), ("<longcat_think>", "</longcat_think>")]
# Shell commands that may run.
ALLOWED_COMMANDS = ["pip install", "ls", "tree", "cat", "wc", "find", "head"]

CHAT_RESPONSE = (
    "struct<error:string,"
    "choices:array<struct<message:struct<content:string,reasoning_content:string,"
    "tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>,"
    "usage:struct<completion_tokens:bigint,total_tokens:bigint>>"
)


def preview(text: Column, n: int, ellipsis: str = "...") -> Column:
    """At most ``n`` characters, followed by the ellipsis only when cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(ellipsis))).otherwise(text)


def parse_remote_path(text: Column, home: str) -> Column:
    """``STRUCT<host, path>`` split at the first colon; NULL without a colon."""
    path = F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1)
    return F.when(
        text.contains(":"),
        F.struct(
            F.regexp_extract(text, r"(?s)^([^:]*):", 1).alias("host"),
            F.when(path.startswith("~"), F.concat(F.lit(home), F.substring(path, F.lit(2), F.length(path))))
            .otherwise(path)
            .alias("path"),
        ),
    )


def link_state(output: Column) -> Column:
    """First port state named in a device's output, ``TIMEOUT`` when there is none."""
    state = F.regexp_extract(output, "PORT_ACTIVE|PORT_DOWN", 0)
    return F.coalesce(F.nullif(state, F.lit("")), F.lit("TIMEOUT"))


def wired_gb(line: Column) -> Column:
    """Whole GB from a memory status line counted in 16 KB pages; dots are dropped."""
    pages = F.replace(F.regexp_extract(line, r"wired\D*([0-9.]+)", 1), F.lit("."), F.lit(""))
    return F.floor(pages.try_cast("bigint") * 16 / 1048576).cast("bigint")


def over_wired_limit(gb: Column, limit: int = 20) -> Column:
    return gb > limit


def answer_matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Does a response hold the wanted answer: a pattern, or a plain substring?"""
    return text.rlike("(?i)" + pattern) if ignore_case else text.contains(pattern)


def flag_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """True when any phrase occurs in the lower-cased text."""
    lowered = F.lower(text)
    flagged = F.lit(False)
    for phrase in phrases:
        flagged = flagged | lowered.contains(phrase)
    return flagged


def extract_doc_ref(text: Column) -> Column:
    """First slash-led reference in the text, empty when there is none."""
    return F.regexp_extract(text, r'(/[^\s"]+)', 1)


def usable_lookup(text: Column) -> Column:
    """A lookup result counts when it is non-empty and does not mention a failure."""
    return F.coalesce((F.length(text) > 0) & ~F.lower(text).contains("failed"), F.lit(False))


def flatten_rpc_result(raw: Column) -> Column:
    """Content texts joined by newline; without content, the whole result as text."""
    def flattened(text):
        def texts(content):
            joined = F.array_join(F.transform(content, lambda c: F.coalesce(c["text"], F.lit(""))), "\n")
            return F.when(F.size(content) > 0, joined)

        parsed = F.from_json(text, "struct<result:struct<content:array<struct<text:string>>>>")
        whole = F.coalesce(F.get_json_object(text, "$.result"), F.lit("{}"))
        return F.coalesce(let(parsed["result"]["content"], texts), whole)

    return let(raw, flattened)


def split_reasoning(text: Column) -> Column:
    """``STRUCT<reasoning, content>``: thinking spans apart from the answer.

    The first delimiter pair found in the text is used; several spans are joined by
    a newline.
    """
    chain = None
    for start, end in THINK_MARKERS:
        span = f"(?s){start}(.*?){end}"
        value = F.struct(
            F.array_join(F.regexp_extract_all(text, F.lit(span), F.lit(1)), "\n").alias("reasoning"),
            F.regexp_replace(text, span, "").alias("content"),
        )
        hit = text.contains(start) & text.contains(end)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(F.struct(F.lit("").alias("reasoning"), text.alias("content")))


def flatten_chat_response(raw: Column) -> Column:
    """``STRUCT<content, reasoning, tool_calls, error, tokens, total_tokens>``.

    An ``error`` key wins over everything else, then empty choices; missing fields
    get their neutral default.
    """
    def flattened(text):
        data = F.when(is_json_object(text), F.from_json(text, CHAT_RESPONSE))
        return let(data, lambda d: fields(text, d))

    def fields(text, data):
        message = F.try_element_at(data["choices"], F.lit(1))["message"]
        error = (
            F.when(data.isNull(), F.lit("Response is not a JSON object"))
            .when(has_keys(text, "error"), F.coalesce(data["error"], F.lit("null")))
            .when(F.coalesce(F.size(data["choices"]), F.lit(0)) < 1, F.lit("Empty choices in response"))
        )
        return let(error, lambda e: response(e, message, data["usage"]))

    def response(error, message, usage):
        def unless_error(value, default):
            return F.when(error.isNull(), F.coalesce(value, default)).otherwise(default)

        none = F.lit(0).cast("bigint")
        return F.struct(
            unless_error(message["content"], F.lit("")).alias("content"),
            unless_error(message["reasoning_content"], F.lit("")).alias("reasoning"),
            F.when(error.isNull(), message["tool_calls"]).alias("tool_calls"),
            error.alias("error"),
            unless_error(usage["completion_tokens"], none).alias("tokens"),
            unless_error(usage["total_tokens"], none).alias("total_tokens"),
        )

    return let(raw, flattened)


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<n>"))


def unescape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("<n>"), F.lit("\n"))


def strip_bos_eos(tokens: Column, bos: Column, eos: Column) -> Column:
    """Drop a leading BOS and, after that, a trailing EOS; empty input is unchanged."""

    def without_last(seq):
        ends = F.coalesce(F.try_element_at(seq, F.lit(-1)) == eos, F.lit(False))
        return F.when(ends, F.slice(seq, F.lit(1), F.size(seq) - 1)).otherwise(seq)

    starts = F.coalesce(F.try_element_at(tokens, F.lit(1)) == bos, F.lit(False))
    return F.when(starts, without_last(F.slice(tokens, F.lit(2), F.size(tokens)))).otherwise(without_last(tokens))


def allowed_command(command: Column, prefixes: Sequence[str] = tuple(ALLOWED_COMMANDS)) -> Column:
    """The trimmed command starts with an allowed prefix (``cat`` allows ``catfoo``)."""
    trimmed = F.regexp_replace(command, r"(?U)^\s+|\s+$", "")
    allowed = F.lit(False)
    for prefix in prefixes:
        allowed = allowed | trimmed.startswith(prefix)
    return allowed


def command_rejection(prefixes: Sequence[str] = tuple(ALLOWED_COMMANDS)) -> str:
    return f"ERROR: Command not allowed. Allowed: {list(prefixes)}"
