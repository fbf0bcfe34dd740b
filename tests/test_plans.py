"""Physical plans: no pair floods, no whole table in one task, pushdown, no Python in the hot path."""

import re

import pytest

from agentlake.plans import all_queries

QUERIES = all_queries()[0]

# These start streams or write files first; their plans are those of the operators inside.
WRITING = {name for name in QUERIES if name.startswith("stream_")} | {
    "scan_workspaces", "scan_manifest", "write_read_results", "read_chat_responses", "read_run_log", "read_keyed_vectors",
    "write_report", "quarantine_requests",
}
# Listing files, type-strict JSON equality, a user's parsers and objectives have no built-in expression.
PYTHON = {"json_equal", "decoder_kind", "detokenize_by_kind", "parse_calls_lateral", "trial_front"}
# Global aggregates of one row (levels in use, for ranges; the models of a board), and the top of the numbering scan.
ONE_TASK = {"render_system_prompt", "leaderboard", "report_lines", "dense_index", "equal_split", "assign_ranges"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_plan(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert any(word in text for word in ("Python", "InPandas", "InArrow")) == (name in PYTHON)
    if name not in ONE_TASK:
        assert "Exchange SinglePartition" not in text


def test_sessions_are_limited_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["session_summary"](spark, sf_dir))
    partial = text.index("row_number(), 10, Partial")
    assert text.index("row_number(), 10, Final") < text.index("Exchange hashpartitioning(session_id") < partial
    assert len(re.findall(r"Exchange hashpartitioning\(session_id", text)) == 1, "one shuffle from responses to summary"
    assert "Exchange hashpartitioning(event_id" not in text


@pytest.mark.parametrize(
    "name, columns",
    [
        ("check_requests", "o_orderkey:bigint,o_custkey:bigint"),
        ("class_mean_vector", "label:int,embedding:array<float>"),
        ("traversal_order", "l_orderkey:bigint,l_linenumber:int,l_extendedprice:double,l_returnflag:string"),
        ("phrase_rate", "text:string,lang:string"),
    ],
)
def test_scans_read_only_needed_columns(spark, sf_dir, name, columns):
    text = plan(QUERIES[name](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", text)
    assert any(set(columns.split(",")) == set(re.split(r",(?![^<]*>)", s)) for s in schemas), schemas


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["lookup_docs"](spark, sf_dir))
    assert "EqualTo(quality,1)" in text


def test_no_broadcast_hint_on_data(spark, sf_dir):
    """With automatic broadcasts off, only what has a proven size is broadcast.

    That is tables held in code.
    """
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = {
            name for name in set(QUERIES) - WRITING
            if "BroadcastHashJoin" in plan(QUERIES[name](spark, sf_dir))
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert hinted == {"dispatch_lookup", "validate_arguments", "vocab_bytes"}
