"""JSON held as text: strict validity, object keys, deep equality."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRICT = {"allowSingleQuotes": "false"}


def is_json(raw: Column) -> Column:
    """True when the text is one complete JSON value and nothing else.

    Spark's JSON functions stop after the first value, so ``{"a":1} junk`` would
    pass. The text is therefore parsed as the first item of an array whose second
    item is the text's own digest: trailing junk, a missing value or a second value
    makes that digest unreachable. Runs in the JVM, no Python worker.
    """
    digest = F.md5(raw)
    wrapped = F.concat(F.lit("["), raw, F.lit(',"'), digest, F.lit('"]'))
    items = F.from_json(wrapped, "array<string>", _STRICT)
    # Second place means exactly one value came before it.
    return F.coalesce(F.array_position(items, digest) == 2, F.lit(False))


def opens_object(raw: Column) -> Column:
    """The first character that is not whitespace is a brace."""
    return F.ltrim(F.translate(raw, "\t\r\n", "   ")).startswith("{")


def is_json_object(raw: Column) -> Column:
    return opens_object(raw) & is_json(raw)


def json_fields(raw: Column, schema: str) -> Column:
    """Parse valid JSON text; nested values asked for as STRING stay JSON text."""
    return F.from_json(raw, schema, _STRICT)


def object_keys(raw: Column) -> Column:
    """Top-level keys of a JSON object, keys with a null value included."""
    return F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))


def has_keys(raw: Column, *names: str) -> Column:
    wanted = F.array(*[F.lit(name) for name in names])
    return F.size(F.array_intersect(wanted, object_keys(raw))) == len(names)


def quote(text: Column) -> Column:
    """The text as a JSON string literal, quotes included."""
    wrapped = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("s")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - F.lit(6))


def canonical_text(text: str | None) -> str | None:
    """Key-sorted JSON text that keeps ``1`` and ``1.0`` apart; None for invalid JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """``canonical_text`` of a Column.

    Spark's VARIANT prints 1 and 1.0 as ``1``, hence this Arrow-batched helper. Each
    distinct text of a batch is read once.
    """
    distinct = raw.dropna().unique()
    texts = raw.map(dict(zip(distinct, map(canonical_text, distinct), strict=True)), na_action="ignore")
    return texts.astype(object)  # a batch of NULLs only would otherwise become numbers


def json_equal(a: Column, b: Column) -> Column:
    """Deep, type-strict equality: key order is ignored, list order is not."""
    return F.coalesce(canonical_json(a) == canonical_json(b), F.lit(False))
