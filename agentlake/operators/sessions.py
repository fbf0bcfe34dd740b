"""Agent sessions: responses, tool calls, truncation and summaries.

A *turn* is one model response: ``(session_id, seq, tokens, elapsed, is_error,
content)`` with ``seq`` unique within its session.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlake.functions.calls import CALL_TYPE, matched_calls, parse_call_json, parse_calls
from agentlake.functions.json_text import object_keys
from agentlake.operators import scans

# Fixed value: model responses a session may use.
MAX_ITERATIONS = 10


@dataclass(frozen=True)
class Tool:
    """One registry entry; the registry is code, so its size is known."""

    name: str
    description: str
    required: Sequence[str] = ()
    optional: Sequence[str] = ()


# The tool registry, in order.
TOOLS = [
    Tool("search_docs", "Search library documentation. Args: library (str), query (str)", ("library", "query")),
    Tool("execute_python", "Execute Python code and return output. Args: code (str)", ("code",)),
    Tool("write_file", "Write a file to the project workspace. Args: path (str), content (str)", ("path", "content")),
    Tool("read_file", "Read a file from the project workspace. Args: path (str)", ("path",)),
    Tool("run_tests", "Run pytest on the workspace or a specific test file. Args: test_path (str, optional)", (), ("test_path",)),
    Tool("shell", "Run a whitelisted shell command (pip install, ls, tree, cat, find). Args: command (str)", ("command",)),
]


def tool_table(spark: SparkSession, tools: Sequence[Tool]) -> DataFrame:
    def names(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(t.name).alias("name"),
            F.lit(t.description).alias("description"),
            names(t.required).alias("required"),
            names(t.optional).alias("optional"),
        )
        for i, t in enumerate(tools)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def extract_tool_calls(turns: DataFrame, text: str = "content") -> DataFrame:
    """One row per matched call: the input columns, ``call_no``, ``fmt``, ``raw``."""
    matched = turns.withColumn("_m", matched_calls(F.col(text)))
    calls = matched.select(*turns.columns, F.col("_m.fmt").alias("fmt"), F.posexplode_outer("_m.raws").alias("call_no", "raw"))
    # Filtering on the exploded column keeps the pattern search out of a pushed-down
    # filter, where it would run a second time.
    return calls.where("call_no IS NOT NULL").withColumn("call_no", F.col("call_no").cast("bigint"))


def parsed_calls(turns: DataFrame, text: str = "content") -> DataFrame:
    """Usable calls only: ``extract_tool_calls`` plus ``name`` and ``arguments``.

    ``call_no`` is the position among all matched calls, dropped ones included.
    """

    def parsed(raw):
        return F.struct(raw.alias("raw"), parse_call_json(raw).alias("call"))

    matched = turns.withColumn("_m", matched_calls(F.col(text)))
    calls = matched.select(
        *turns.columns,
        F.col("_m.fmt").alias("fmt"),
        F.posexplode_outer(F.transform("_m.raws", parsed)).alias("call_no", "_c"),
    )
    return calls.where("_c.call IS NOT NULL").select(
        *turns.columns, "fmt", F.col("call_no").cast("bigint").alias("call_no"), "_c.raw", "_c.call.name", "_c.call.arguments"
    )


def truncate_sessions(turns: DataFrame, cap: int = MAX_ITERATIONS) -> DataFrame:
    """Responses a session really used, with ``iteration``, ``calls``, ``is_final``.

    The first ``cap`` responses by ``seq`` are numbered; everything after the first
    call-free, error-free one is dropped. The rank filter becomes a group limit below
    the shuffle, so even a session with most of the table sends at most ``cap`` rows
    per task, and responses past the cap are never parsed.
    """
    by_seq = Window.partitionBy("session_id").orderBy("seq")
    numbered = turns.withColumn("iteration", F.row_number().over(by_seq)).where(F.col("iteration") <= cap)
    numbered = numbered.withColumn("iteration", F.col("iteration").cast("bigint"))
    none = F.array().cast(f"array<{CALL_TYPE}>")
    parsed = numbered.withColumn("calls", F.when(F.col("is_error"), none).otherwise(parse_calls(F.col("content"))))
    done = ~F.col("is_error") & (F.size("calls") == 0)
    first_done = F.min(F.when(done, F.col("iteration"))).over(Window.partitionBy("session_id"))
    kept = parsed.withColumn("_done", first_done).where("_done IS NULL OR iteration <= _done")
    return kept.withColumn("is_final", F.coalesce(F.col("iteration") == F.col("_done"), F.lit(False))).drop("_done")


def session_summary(turns: DataFrame, cap: int = MAX_ITERATIONS) -> DataFrame:
    """One row per session: iterations, calls, tokens, time, final text, success.

    Errors use up an iteration but add no tokens. A session that never produced a
    call-free response is unsuccessful; its final text is the last usable one.
    """
    answered = F.when(~F.col("is_error"), F.col("iteration"))
    return (
        truncate_sessions(turns, cap)
        .groupBy("session_id")
        .agg(
            F.max("iteration").alias("iterations"),
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("iteration", "calls"))), lambda r: r["calls"]
                )
            ).alias("tool_calls"),
            F.coalesce(F.sum(F.when(~F.col("is_error"), F.col("tokens"))), F.lit(0)).cast("bigint").alias("total_tokens"),
            F.sum("elapsed").alias("total_time"),
            F.coalesce(F.max_by("content", answered), F.lit("")).alias("final_output"),
            F.bool_or("is_final").alias("success"),
        )
    )


def session_calls(turns: DataFrame, cap: int = MAX_ITERATIONS) -> DataFrame:
    """One row per executed call: ``(session_id, iteration, call_no, name, arguments)``."""
    return truncate_sessions(turns, cap).select(
        "session_id", "iteration", F.posexplode("calls").alias("call_no", "call")
    ).select("session_id", "iteration", F.col("call_no").cast("bigint").alias("call_no"), "call.name", "call.arguments")


def tool_histogram(calls: DataFrame) -> DataFrame:
    """Uses per tool and session, most used first, ties in order of first use.

    Each session's rows stand together and in order; there is no order among sessions,
    which would cost a shuffle.
    """
    position = F.struct("iteration", "call_no")
    counted = calls.groupBy("session_id", "name").agg(
        F.count(F.lit(1)).alias("uses"), F.min(position).alias("_first")
    )
    # By session only, so that its rows meet; they are one per tool by now.
    counted = counted.repartition("session_id")
    return counted.sortWithinPartitions("session_id", F.desc("uses"), "_first").drop("_first")


def dispatch_lookup(calls: DataFrame, tools: Sequence[Tool] = tuple(TOOLS)) -> DataFrame:
    """Calls with their registry entry; unknown names get an error text.

    The registry comes from code, so broadcasting it is safe at any data size.
    """
    table = tool_table(calls.sparkSession, tools)
    names = [t.name for t in tools]
    joined = calls.join(F.broadcast(table), "name", "left")
    unknown = F.concat(F.lit("ERROR: Unknown tool '"), F.col("name"), F.lit(f"'. Available: {names}"))
    return joined.withColumn("error", F.when(F.col("ord").isNull(), unknown))


def validate_arguments(calls: DataFrame, tools: Sequence[Tool] = tuple(TOOLS)) -> DataFrame:
    """Known calls with ``missing`` and ``unexpected`` argument names and ``ok``."""
    keys = object_keys(F.col("arguments"))
    known = dispatch_lookup(calls, tools).where("error IS NULL")
    checked = known.withColumn("missing", F.array_except("required", keys)).withColumn(
        "unexpected", F.array_except(keys, F.concat("required", "optional"))
    )
    ok = (F.size("missing") == 0) & (F.size("unexpected") == 0)
    return checked.withColumn("ok", ok).drop("ord", "description", "required", "optional", "error")


def cumulative_tokens(
    turns: DataFrame, limit: int, keys: Sequence[str] = ("session_id",), reset: str | None = None, block: int = scans.BLOCK
) -> DataFrame:
    """Tokens held by a session's cache after each turn, and whether over ``limit``.

    The count starts over where ``reset`` is true. Sessions of any length are scanned
    in blocks.
    """
    if reset is None:
        out = scans.running(turns, keys, "seq", "tokens", "cached_tokens", block=block)
    else:
        out = scans.running_since_reset(turns, keys, "seq", "tokens", reset, "cached_tokens", block=block)
    return out.withColumn("over_limit", F.col("cached_tokens") > limit)
