"""Tool-call parsers by format name."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from agentlake.functions.calls import CALL_FORMATS, normalize_call
from agentlake.functions.calls import parse_calls as tagged_calls

CALL = "struct<name:string,arguments:string,error:string>"
Row = tuple[str | None, str | None, str | None]


def _tagged(text: Column) -> Column:
    return F.transform(
        tagged_calls(text),
        lambda c: F.struct(c["name"], c["arguments"], F.lit(None).cast("string").alias("error")),
    )


# A parser turns a text column into ARRAY<STRUCT<name, arguments, error>>.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "json_tools": _tagged,
    "python_tag": lambda text: F.array(normalize_call(text)),
}


def register_parser(fmt: str, parser: Callable[[Column], Column]) -> None:
    """Add a format's parser, a Column builder or a pandas UDF."""
    PARSERS[fmt] = parser


def parse_calls(df: DataFrame, text: str = "text", fmt: str = "fmt") -> DataFrame:
    """One row per call of ``text``, parsed as its row's ``fmt`` says.

    A format without a parser yields one error row. The built-in parsers are plain
    expressions, so no Python worker is involved.
    """
    unknown = F.array(
        F.struct(
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("arguments"),
            F.concat(F.lit("No parser for format: "), F.coalesce(F.col(fmt), F.lit("NULL"))).alias("error"),
        )
    )
    chain = None
    for name, parser in PARSERS.items():
        hit, value = F.col(fmt) == name, parser(F.col(text)).cast(f"array<{CALL}>")
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    calls = df.withColumn("_calls", chain.otherwise(unknown.cast(f"array<{CALL}>")))
    return calls.select(*df.columns, F.inline("_calls"))


def _object(text: str):
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _field(value) -> str | None:
    """A value as the expressions give it: text as it is, anything else as compact JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def tagged_rows(text: str) -> Iterator[Row]:
    """Calls of the first tagged format with any match, as ``calls.parse_calls`` finds them."""
    for _, marker, pattern in CALL_FORMATS:
        raws = re.findall(pattern, text, re.DOTALL) if marker in text else []
        for raw in raws:
            call = _object(raw) or _object(raw.replace("'", '"')) or {}
            if "name" in call and "arguments" in call:
                yield _field(call["name"]), _field(call["arguments"]), None
        if raws:
            return


def bare_rows(text: str) -> Iterator[Row]:
    """The one call of a text that is JSON or ``name({...})``, as ``calls.normalize_call`` reads it."""
    body = text.strip()
    call, shaped = _object(body), re.match(r"^(\w+)\s*\((.+)\)\s*$", body, re.DOTALL)
    if call is not None:
        yield _field(call.get("name")), _field(call["arguments"] if "arguments" in call else call.get("parameters")), None
    elif shaped and _is_json(shaped.group(2)):
        yield shaped.group(1), shaped.group(2), None
    else:
        yield None, None, f"Could not parse tool call: {body[:100]}"


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


# Row parsers of the lateral function, by the names that ``calls.infer_tool_format`` gives and ``python_tag``.
ROW_PARSERS: dict[str, Callable[[str], Iterable[Row]]] = {"json_tools": tagged_rows, "python_tag": bare_rows}


def lateral_parser(parsers: dict[str, Callable[[str], Iterable[Row]]] | None = None):
    """A table function ``(text, fmt)`` that gives one row per call: ``name, arguments, error``.

    Each row's ``fmt`` chooses its parser, so any mix of formats is read in one pass, and a
    user's Python parser stands beside the built-in ones. A format without a parser, NULL
    included, gives one error row; a NULL text none. Use it in a lateral join, or register it
    for SQL with ``register_udtf``. Rows travel in Arrow batches.
    """
    chosen = dict(ROW_PARSERS if parsers is None else parsers)

    class ParseCalls:
        def eval(self, text: str, fmt: str):
            if text is None:
                return
            parser = chosen.get(fmt)
            if parser is None:
                yield None, None, f"No parser for format: {'NULL' if fmt is None else fmt}"
            else:
                yield from parser(text)

    return udtf(ParseCalls, returnType="name string, arguments string, error string", useArrow=True)


def parse_calls_lateral(df: DataFrame, text: str = "text", fmt: str = "fmt", parsers: dict | None = None) -> DataFrame:
    """``df`` with one row per call, ``name, arguments, error`` added, by ``lateral_parser``."""
    return df.lateralJoin(lateral_parser(parsers)(F.col(text).outer(), F.col(fmt).outer()))


def register_udtf(spark: SparkSession, name: str = "parse_calls", parsers: dict | None = None) -> None:
    """Makes the parsers usable as ``LATERAL name(text, fmt)`` in SQL."""
    spark.udtf.register(name, lateral_parser(parsers))
