"""Result files, chat responses, run logs, vector files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Both writers' columns: one counts calls as ``tools_used``, the other as ``tools``.
RESULT_SCHEMA = (
    "model string, task string, task_name string, score double, iterations bigint, tools_used bigint, "
    "tools bigint, time bigint, tests_pass boolean, code_runs boolean, checks map<string,boolean>"
)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON record per (model, task) in a folder per model; time in whole seconds."""
    rounded = results.withColumn("time", F.bround("total_time", 0).cast("bigint")).drop("total_time")
    rounded.write.mode("append").partitionBy("model").json(path)


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Result records of either writer, one record or a list of records per file."""
    read = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(list(paths))
    return read.withColumn("tools", F.coalesce("tools_used", "tools")).drop("tools_used")


def read_result_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Records written by ``write_results``: one per line, so large files are split."""
    read = spark.read.schema(RESULT_SCHEMA).json(list(paths))
    return read.withColumn("tools", F.coalesce("tools_used", "tools")).drop("tools_used")


def read_chat_responses(spark: SparkSession, path: str) -> DataFrame:
    """One raw JSON response per line, as ``raw``."""
    return spark.read.text(path).withColumnRenamed("value", "raw")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_log(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_run_log(lines: DataFrame) -> DataFrame:
    """Runner log lines with their kind and fields.

    Kinds: iteration, model, tool, score, check and other. ``ts_text`` is the time in
    front of a logged message.
    """
    message = F.regexp_replace("line", r"^\[\d\d:\d\d:\d\d\] ", "")
    # The line formats the runners write.
    iteration = r"^--- Iteration (\d+)/(\d+) ---$"
    model = r"^Model \((\d+) tok, ([\d.]+)s\): (.*)$"
    tool = r"^  Tool: (\w+)\((.*)\)$"
    score = r"^Score: ([\d.]+)/100$"
    check = r"^  ([✓✗]) (\w+)$"

    def part(pattern, group):
        return F.nullif(F.regexp_extract("message", pattern, group), F.lit(""))

    kind = (
        F.when(F.col("message").rlike(iteration), "iteration")
        .when(F.col("message").rlike(model), "model")
        .when(F.col("message").rlike(tool), "tool")
        .when(F.col("message").rlike(score), "score")
        .when(F.col("message").rlike(check), "check")
        .otherwise("other")
    )
    return lines.select(
        *lines.columns, F.nullif(F.regexp_extract("line", r"^\[(\d\d:\d\d:\d\d)\] ", 1), F.lit("")).alias("ts_text"), message.alias("message")
    ).select(
        "*",
        kind.alias("kind"),
        part(iteration, 1).cast("bigint").alias("iteration"),
        part(model, 1).cast("bigint").alias("tokens"),
        part(model, 2).cast("double").alias("seconds"),
        part(tool, 1).alias("tool"),
        part(tool, 2).alias("arguments"),
        part(score, 1).cast("double").alias("score"),
        part(check, 2).alias("check"),
        F.when(F.col("message").rlike(check), part(check, 1) == "✓").alias("passed"),
    )


def read_keyed_vectors(vectors: DataFrame, key: str = "key") -> DataFrame:
    """Vectors stored under ``layer_<i>`` with their index as ``layer_idx``."""
    return vectors.withColumn("layer_idx", F.split_part(F.col(key), F.lit("_"), F.lit(2)).cast("int")).drop(key)


def wide_to_keyed(wide: DataFrame) -> DataFrame:
    """One row per ``layer_<i>`` column of a table that stores vectors side by side."""
    layers = [c for c in wide.columns if c.startswith("layer_")]
    rest = [c for c in wide.columns if c not in layers]
    return wide.unpivot(rest, layers, "key", "vec")


def write_report(lines: DataFrame, path: str) -> None:
    """The report's lines in order, as text; part files sort in line order."""
    lines.orderBy("section", "model", "task", "line_no").select("line").write.mode("overwrite").text(path)
