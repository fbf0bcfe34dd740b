"""Queries that write tables to files and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import text as T
from agentlake.operators import rules, scoreboards, transfers
from agentlake.plans.registry import ORACLES, query
from agentlake.plans.rule_queries import report_lines as report
from agentlake.plans.session_queries import chat_responses
from agentlake.plans.tables import RESULTS_SQL, TURNS_SQL, results, table, turns
from agentlake.plans.vector_queries import cells, embeddings
from agentlake.session import shared_dir
from agentlake.sources import records, workspaces


def _workspaces(spark, sf_dir):
    """Documents written as text files of bounded numbers of rows, a folder per source: a file is read whole."""
    path = shared_dir(spark, "workspaces")
    documents = table(spark, sf_dir, "documents")
    documents.select("text", F.col("source").alias("run")).write.option("maxRecordsPerFile", 4096).partitionBy("run").text(path)
    return workspaces.roots_table(documents, "source", f"{path}/run=")


@query("""SELECT source AS run_id, CAST(sum(length(text) + 1) AS BIGINT) AS chars,
  CAST(sum(length(text) - length(replace(text, 'e', ''))) AS BIGINT) AS letters FROM documents GROUP BY source""")
def scan_workspaces(spark, sf_dir):
    read = workspaces.scan_workspaces(_workspaces(spark, sf_dir))
    return read.groupBy("run_id").agg(
        F.sum(F.length("content")).alias("chars"),
        F.sum(F.length("content") - F.length(F.replace("content", F.lit("e"), F.lit("")))).alias("letters"),
    )


@query("""SELECT source AS run_id, row_number() OVER (PARTITION BY source ORDER BY concat('lang=', lang), concat('part=', doc_id % 23)) - 1 AS ord,
  concat('lang=', lang, '/part=', doc_id % 23) AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size
FROM documents GROUP BY source, lang, doc_id % 23""")
def scan_manifest(spark, sf_dir):
    """Every file of a tree of folders with its position; each folder holds one file."""
    path = shared_dir(spark, "manifest")
    documents = table(spark, sf_dir, "documents").select("text", F.col("source").alias("run"), "lang", (F.col("doc_id") % 23).alias("part"))
    documents.repartition("run", "lang", "part").write.partitionBy("run", "lang", "part").text(path)
    roots = workspaces.roots_table(documents, "run", f"{path}/run=")
    visible = rules.filter_workspace_files(workspaces.list_files(roots))
    found = transfers.manifest_order(visible, ("run_id",))
    return found.select("run_id", "ord", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "size")


@query(f"""WITH {RESULTS_SQL} SELECT model, task, score, iterations, tool_calls AS tools,
  CAST(round_even(total_time, 0) AS BIGINT) AS time, tests_pass, code_runs FROM scored""")
def write_read_results(spark, sf_dir):
    """Both writers' records side by side in one folder tree."""
    path = shared_dir(spark, "results")
    scored = scoreboards.with_score(results(spark, sf_dir)).select(
        "model", "task", "score", "iterations", "tool_calls", "total_time", "tests_pass", "code_runs"
    )
    for condition, name in (("task <> 'en'", "tools_used"), ("task = 'en'", "tools")):
        records.write_results(scored.where(condition).withColumnRenamed("tool_calls", name), path)
    read = records.read_result_lines(spark, path)
    return read.select("model", "task", "score", "iterations", "tools", "time", "tests_pass", "code_runs")


@query(f"""WITH {TURNS_SQL}
SELECT CASE WHEN is_error THEN 'error' WHEN seq % 31 = 0 THEN 'empty' ELSE 'ok' END AS outcome, count(*) AS responses,
  CAST(sum(CASE WHEN is_error OR seq % 31 = 0 THEN 0 ELSE tokens END) AS BIGINT) AS tokens,
  CAST(sum(CASE WHEN is_error OR seq % 31 = 0 THEN 0 ELSE length(content) END) AS BIGINT) AS chars
FROM turns GROUP BY ALL""")
def read_chat_responses(spark, sf_dir):
    path = shared_dir(spark, "responses")
    chat_responses(spark, sf_dir).select("raw").write.text(path)
    flat = records.read_chat_responses(spark, path).select(T.flatten_chat_response(F.col("raw")).alias("r")).select("r.*")
    outcome = F.when(F.col("error").isNull(), "ok").when(F.col("error").startswith("Empty"), "empty").otherwise("error")
    return flat.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("responses"), F.sum("tokens").alias("tokens"), F.sum(F.length("content")).cast("bigint").alias("chars")
    )


_LOG_LINES = """inline(array(
  named_struct('line', concat('--- Iteration ', seq % 10 + 1, '/10 ---')),
  named_struct('line', concat('Model (', tokens, ' tok, ', format_number(tokens / 4, '0.0'), 's): turn ', seq)),
  named_struct('line', concat('  Tool: view({"k":', tokens, '})')),
  named_struct('line', concat('[12:00:0', seq % 10, '] Score: ', tokens % 100, '.5/100')),
  named_struct('line', concat('  ', CASE WHEN is_error THEN '✗' ELSE '✓' END, ' has_', seq % 3)),
  named_struct('line', concat('plain ', seq))))"""


@query(f"""WITH {TURNS_SQL}
SELECT 'iteration' AS kind, NULL AS ts_text, seq % 10 + 1 AS iteration, NULL AS tokens, NULL AS tool, NULL AS arguments, NULL::DOUBLE AS score, NULL AS "check", NULL::BOOLEAN AS passed, count(*) AS n FROM turns GROUP BY ALL
UNION ALL SELECT 'model', NULL, NULL, tokens, NULL, NULL, NULL, NULL, NULL, count(*) FROM turns GROUP BY ALL
UNION ALL SELECT 'tool', NULL, NULL, NULL, 'view', concat('{{"k":', tokens, '}}'), NULL, NULL, NULL, count(*) FROM turns GROUP BY ALL
UNION ALL SELECT 'score', concat('12:00:0', seq % 10), NULL, NULL, NULL, NULL, tokens % 100 + 0.5, NULL, NULL, count(*) FROM turns GROUP BY ALL
UNION ALL SELECT 'check', NULL, NULL, NULL, NULL, NULL, NULL, concat('has_', seq % 3), NOT is_error, count(*) FROM turns GROUP BY ALL
UNION ALL SELECT 'other', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM turns""")
def read_run_log(spark, sf_dir):
    path = shared_dir(spark, "log")
    turns(spark, sf_dir).selectExpr(_LOG_LINES).write.text(path)
    fields = ["kind", "ts_text", "iteration", "tokens", "tool", "arguments", "score", "check", "passed"]
    return records.read_run_log(spark, path).groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(vec_id AS INT) AS layer_idx, unnest(range(len(embedding))) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0::DOUBLE AS x FROM embeddings""")
def read_keyed_vectors(spark, sf_dir):
    path = shared_dir(spark, "vectors")
    keyed = embeddings(spark, sf_dir).select(F.concat(F.lit("layer_"), F.col("vec_id")).alias("key"), "vec")
    keyed.write.parquet(path)
    return cells(records.read_keyed_vectors(spark.read.parquet(path)).withColumn("vec", F.col("vec").cast("array<double>")), "vec")


@query(f"SELECT line, count(*) AS n FROM ({ORACLES['report_lines']}) GROUP BY line")
def write_report(spark, sf_dir):
    path = shared_dir(spark, "report")
    records.write_report(report(spark, sf_dir), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


