"""Chat messages: prompts, tool results, ordered transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where a prompt template takes the tool lines.
PLACEHOLDER = "{tool_descriptions}"

SEGMENT = 1024


def render_system_prompt(tools: DataFrame, template: str) -> DataFrame:
    """One row with the prompt: a line per tool, in order, put into the template.

    ``tools(ord, name, description)`` is a registry, small by nature.
    """
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("**: "), F.col("description"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda r: r["line"]), "\n")
    return tools.agg(F.replace(F.lit(template), F.lit(PLACEHOLDER), lines).alias("prompt"))


def tool_result_block(name, result):
    """One ``<tool_result>`` block with compact, escaped JSON."""
    body = F.to_json(F.struct(F.coalesce(name, F.lit("")).alias("name"), F.coalesce(result, F.lit("")).alias("result")))
    return F.concat(F.lit("\n<tool_result>\n"), body, F.lit("\n</tool_result>\n"))


def render_tool_results(results: DataFrame) -> DataFrame:
    """The user message after each response: its result blocks in call order.

    ``results(session_id, iteration, call_no, name, result)`` of truncated sessions;
    a group is the calls of one response.
    """
    blocks = F.array_sort(F.collect_list(F.struct("call_no", tool_result_block(F.col("name"), F.col("result")).alias("b"))))
    return results.groupBy("session_id", "iteration").agg(
        F.array_join(F.transform(blocks, lambda r: r["b"]), "").alias("content")
    )


def build_messages(turns: DataFrame, key: str, order: str, segment: int = SEGMENT) -> DataFrame:
    """Ordered ``ARRAY<STRUCT<role, content>>`` per conversation.

    ``order`` is a unique non-negative integer within its conversation. Longer
    conversations come as several rows of ``segment`` order values each, numbered
    ``segment``, so no array grows without bound; their arrays in order make the whole.
    """
    parts = turns.withColumn("segment", F.floor(F.col(order) / segment).cast("bigint"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", "content")))
    return parts.groupBy(key, "segment").agg(
        F.transform(listed, lambda m: F.struct(m["role"], m["content"])).alias("messages")
    )


def render_transcript(messages: DataFrame) -> DataFrame:
    """``role: content`` lines of each segment of ``build_messages``."""
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return messages.withColumn("transcript", F.array_join(lines, "\n")).drop("messages")


def message_append(prior: DataFrame, replies: DataFrame, results: DataFrame) -> DataFrame:
    """All messages of a session in long form, with ``(iteration, kind)`` as order.

    ``prior(session_id, position, role, content)`` come first; then every response
    that made calls, followed by its results. A final response is not appended.
    """
    first = prior.select("session_id", F.lit(0).cast("bigint").alias("iteration"), F.col("position").cast("int").alias("kind"), "role", "content")
    spoken = replies.where(F.size("calls") > 0).select(
        "session_id", "iteration", F.lit(0).alias("kind"), F.lit("assistant").alias("role"), "content"
    )
    heard = results.select(
        "session_id", "iteration", F.lit(1).alias("kind"), F.lit("user").alias("role"), "content"
    )
    return first.unionByName(spoken).unionByName(heard)
