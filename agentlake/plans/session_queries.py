"""Queries over model responses and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import calls as C
from agentlake.functions import json_text as J
from agentlake.functions import text as T
from agentlake.functions.numbers import overall_score
from agentlake.operators import messages, parsers, sessions
from agentlake.operators.sessions import Tool
from agentlake.plans.registry import query
from agentlake.plans.tables import CALLS_SQL, TURNS_SQL, conv, table, turns

# "purchase" is left out on purpose, so it is an unknown tool.
SHOP_TOOLS = [Tool("click", "Click an item", ("k",)), Tool("view", "View an item", ("k", "depth"))]


def name_list(calls):
    return F.array_join(F.transform(calls, lambda c: c["name"]), ",")


@query(f"WITH {CALLS_SQL} SELECT session_id, seq, fmt, call_no, raw FROM matched")
def extract_tool_calls(spark, sf_dir):
    found = sessions.extract_tool_calls(turns(spark, sf_dir))
    return found.select("session_id", "seq", "fmt", "call_no", "raw")


@query(f"""WITH {CALLS_SQL}
SELECT session_id, seq, fmt, call_no, name, concat('{{"k":', k, '}}') AS arguments FROM calls""")
def parse_call_json(spark, sf_dir):
    return sessions.parsed_calls(turns(spark, sf_dir)).select(
        "session_id", "seq", "fmt", "call_no", "name", "arguments"
    )


_TEMPLATES = [marker for _, markers in C.TEMPLATE_MARKERS for marker in markers] + ["<tool_call>{{ tool_call.name }}", "<tool_call>", "plain"]
_TEMPLATE_NAMES = ["minimax_m2", "function_gemma", "longcat", "glm47", "pythonic", "qwen3_coder", "qwen3_coder", "kimi_k2", "mistral", "json_tools", None, None]


def _case(values, literal):
    return " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values))


@query(f"""SELECT doc_id, CASE doc_id % 13 {_case(_TEMPLATE_NAMES, lambda v: "NULL" if v is None else f"'{v}'")} END AS parser
FROM documents""")
def infer_tool_format(spark, sf_dir):
    number = F.col("doc_id") % 13
    marker = F.get(F.array(*[F.lit(m) for m in _TEMPLATES]), number.cast("int"))
    template = F.when(number < len(_TEMPLATES), F.concat("text", marker, "text"))
    return table(spark, sf_dir, "documents").select("doc_id", C.infer_tool_format(template).alias("parser"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_type END AS name,
  CASE event_id % 4 WHEN 3 THEN NULL ELSE replace(props, ' ', '') END AS arguments,
  CASE event_id % 4 WHEN 3 THEN concat('Could not parse tool call: ', substr(concat(event_type, ' with ', props, ' ', repeat('x', 100)), 1, 100)) END AS error
FROM events""")
def normalize_call(spark, sf_dir):
    text = F.expr("""CASE event_id % 4
      WHEN 0 THEN concat(' {"name": "', event_type, '", "parameters": ', props, '}', chr(10))
      WHEN 1 THEN concat(event_type, ' (', props, ')  ')
      WHEN 2 THEN concat('{"arguments": ', props, ', "parameters": {}, "name": "', event_type, '"}')
      ELSE concat(event_type, ' with ', props, ' ', repeat('x', 100)) END""")
    call = C.normalize_call(text)
    return table(spark, sf_dir, "events").select("event_id", call.alias("c")).select(
        "event_id", "c.name", F.replace("c.arguments", F.lit(" "), F.lit("")).alias("arguments"), "c.error"
    )


@query("""SELECT event_id, concat('note ', event_id,
  CASE WHEN event_type = 'error' THEN '' ELSE concat(chr(10), '<tool_call>', chr(10), '{"name":"', event_type, '","arguments":',
    CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END, '}', chr(10), '</tool_call>', chr(10)) END) AS content
FROM events""")
def native_calls_to_tags(spark, sf_dir):
    arguments = F.expr("CASE WHEN event_id % 3 = 0 THEN concat(props, '!') ELSE props END")
    call = F.struct(F.struct(F.col("event_type").alias("name"), arguments.alias("arguments")).alias("function"))
    native = F.when(F.col("event_type") != "error", F.array(call))
    content = F.concat(F.lit("note "), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", C.native_calls_to_tags(content, native).alias("content"))


_RESPONSE = """CASE WHEN is_error THEN '{"error": {"code": 500}}'
  WHEN seq % 31 = 0 THEN '{"choices": [], "usage": {}}'
  ELSE concat('{"choices":[{"message":{"content":', q_content, ',"reasoning_content":', CASE WHEN seq % 2 = 0 THEN 'null' ELSE '"r"' END,
              '}}],"usage":{"completion_tokens":', tokens, ',"total_tokens":', tokens + 7, '}}') END"""


def chat_responses(spark, sf_dir):
    return turns(spark, sf_dir).withColumn("q_content", J.quote(F.col("content"))).selectExpr(
        "session_id", "seq", f"{_RESPONSE} AS raw"
    )


@query(f"""WITH {TURNS_SQL}
SELECT session_id, seq, CASE WHEN is_error OR seq % 31 = 0 THEN '' ELSE content END AS content,
  CASE WHEN is_error OR seq % 31 = 0 OR seq % 2 = 0 THEN '' ELSE 'r' END AS reasoning,
  CASE WHEN is_error THEN '{{"code":500}}' WHEN seq % 31 = 0 THEN 'Empty choices in response' END AS error,
  CASE WHEN is_error OR seq % 31 = 0 THEN 0 ELSE tokens END AS tokens,
  CASE WHEN is_error OR seq % 31 = 0 THEN 0 ELSE tokens + 7 END AS total_tokens
FROM turns""")
def flatten_chat_response(spark, sf_dir):
    flat = chat_responses(spark, sf_dir).withColumn("r", T.flatten_chat_response(F.col("raw")))
    return flat.select("session_id", "seq", "r.content", "r.reasoning", "r.error", "r.tokens", "r.total_tokens")


@query("SELECT conv_id, turn, role AS reasoning, text AS content FROM conversations")
def split_reasoning(spark, sf_dir):
    parts = conv(spark, sf_dir).withColumn("p", T.split_reasoning(F.col("content")))
    return parts.select("conv_id", "turn", "p.reasoning", "p.content")


@query(f"""WITH {CALLS_SQL}
SELECT session_id, iteration,
  string_agg(concat(chr(10), '<tool_result>', chr(10), '{{"name":"', name, '","result":"ran ', name, ' with {{\\"k\\":', k, '}}"}}', chr(10), '</tool_result>', chr(10)), '' ORDER BY call_no) AS content
FROM calls JOIN kept USING (session_id, seq) WHERE NOT is_error GROUP BY session_id, iteration""")
def render_tool_results(spark, sf_dir):
    return messages.render_tool_results(tool_results(spark, sf_dir))


def tool_results(spark, sf_dir):
    """A made-up outcome for every executed call."""
    outcome = F.concat(F.lit("ran "), F.col("name"), F.lit(" with "), F.col("arguments"))
    return sessions.session_calls(turns(spark, sf_dir)).withColumn("result", outcome)


@query("""WITH lines AS (SELECT event_type, concat('- **', event_type, '**: Handles ', event_type, ' events') AS line FROM events GROUP BY event_type)
SELECT user_id, concat('Tools:', chr(10), (SELECT string_agg(line, chr(10) ORDER BY event_type) FROM lines), chr(10), 'Call one.') AS prompt
FROM (SELECT DISTINCT user_id FROM events)""")
def render_system_prompt(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    described = F.concat(F.lit("Handles "), F.col("event_type"), F.lit(" events"))
    tools = events.select(F.col("event_type").alias("ord"), F.col("event_type").alias("name"), described.alias("description")).distinct()
    prompt = messages.render_system_prompt(tools, "Tools:\n{tool_descriptions}\nCall one.").scalar()
    return events.select("user_id").distinct().withColumn("prompt", prompt)


@query("""SELECT conv_id, CAST(turn // 1024 AS BIGINT) AS segment,
  string_agg(concat(role, ': <think>', role, '</think>', text), chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY ALL""")
def build_messages(spark, sf_dir):
    return messages.render_transcript(messages.build_messages(conv(spark, sf_dir), "conv_id", "turn"))


@query(f"""WITH {CALLS_SQL}, blocks AS (
  SELECT session_id, iteration,
    string_agg(concat(chr(10), '<tool_result>', chr(10), '{{"name":"', name, '","result":"ran ', name, ' with {{\\"k\\":', k, '}}"}}', chr(10), '</tool_result>', chr(10)), '' ORDER BY call_no) AS content
  FROM calls JOIN kept USING (session_id, seq) WHERE NOT is_error GROUP BY session_id, iteration)
SELECT session_id, 0 AS iteration, 0 AS kind, 'system' AS role, 'Be exact.' AS content FROM (SELECT DISTINCT session_id FROM turns)
UNION ALL SELECT session_id, 0, 1, 'user', concat('Serve session ', session_id) FROM (SELECT DISTINCT session_id FROM turns)
UNION ALL SELECT session_id, iteration, 0, 'assistant', content FROM kept WHERE n_calls > 0
UNION ALL SELECT session_id, iteration, 1, 'user', content FROM blocks""")
def message_append(spark, sf_dir):
    used = turns(spark, sf_dir)
    prior = used.select("session_id").distinct().selectExpr(
        "session_id",
        "inline(array(named_struct('position', 0, 'role', 'system', 'content', 'Be exact.'), "
        "named_struct('position', 1, 'role', 'user', 'content', concat('Serve session ', session_id))))",
    )
    return messages.message_append(
        prior, sessions.truncate_sessions(used), messages.render_tool_results(tool_results(spark, sf_dir))
    )


@query(f"""WITH {CALLS_SQL}
SELECT session_id, seq, iteration, n_calls, is_final, content FROM kept""")
def truncate_sessions(spark, sf_dir):
    kept = sessions.truncate_sessions(turns(spark, sf_dir))
    return kept.select(
        "session_id", "seq", "iteration",
        F.size("calls").cast("bigint").alias("n_calls"), "is_final", "content",
    )


SESSION_SUMMARY_SQL = f"""WITH {CALLS_SQL}, names AS (
  SELECT session_id, string_agg(name, ',' ORDER BY iteration, call_no) AS tool_calls, count(*) AS n_calls
  FROM calls JOIN kept USING (session_id, seq) WHERE NOT is_error GROUP BY session_id)
SELECT s.session_id, max(iteration) AS iterations, coalesce(max(names.tool_calls), '') AS tool_calls,
  coalesce(CAST(sum(CASE WHEN NOT is_error THEN tokens END) AS BIGINT), 0) AS total_tokens,
  round(sum(elapsed), 4) AS total_time,
  coalesce(arg_max(content, CASE WHEN NOT is_error THEN iteration END), '') AS final_output, bool_or(is_final) AS success
FROM kept s LEFT JOIN names USING (session_id) GROUP BY s.session_id"""


@query(SESSION_SUMMARY_SQL)
def session_summary(spark, sf_dir):
    summary = sessions.session_summary(turns(spark, sf_dir))
    return summary.withColumn("tool_calls", name_list("tool_calls")).withColumn("total_time", F.round("total_time", 4))


@query(f"""WITH {CALLS_SQL}
SELECT session_id, name, count(*) AS uses FROM calls JOIN kept USING (session_id, seq) WHERE NOT is_error GROUP BY ALL""")
def tool_histogram(spark, sf_dir):
    return sessions.tool_histogram(sessions.session_calls(turns(spark, sf_dir)))


@query(f"""WITH {CALLS_SQL}
SELECT session_id, seq, call_no, name,
  CASE name WHEN 'click' THEN 'Click an item' WHEN 'view' THEN 'View an item' END AS description,
  CASE WHEN name NOT IN ('click', 'view') THEN concat('ERROR: Unknown tool ''', name, '''. Available: [''click'', ''view'']') END AS error
FROM calls""")
def dispatch_lookup(spark, sf_dir):
    found = sessions.dispatch_lookup(sessions.parsed_calls(turns(spark, sf_dir)), SHOP_TOOLS)
    return found.select("session_id", "seq", "call_no", "name", "description", "error")


@query(f"""WITH {CALLS_SQL}
SELECT session_id, seq, call_no, name, CASE name WHEN 'view' THEN 'depth' ELSE '' END AS missing,
  CASE WHEN name IN ('click', 'view') THEN '' END AS unexpected, name = 'click' AS ok
FROM calls WHERE name IN ('click', 'view')""")
def validate_arguments(spark, sf_dir):
    checked = sessions.validate_arguments(sessions.parsed_calls(turns(spark, sf_dir)), SHOP_TOOLS)
    return checked.select(
        "session_id", "seq", "call_no", "name",
        F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), "ok",
    )


CACHE_LIMIT = 100
CUMULATIVE_SQL = f"""WITH {TURNS_SQL}, grouped AS (
  SELECT *, count(CASE WHEN is_error THEN 1 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS resets FROM turns)
SELECT session_id, seq, cached_tokens, cached_tokens > {CACHE_LIMIT} AS over_limit FROM (
  SELECT session_id, seq, CAST(sum(tokens) OVER (PARTITION BY session_id, resets ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cached_tokens
  FROM grouped)"""


@query(CUMULATIVE_SQL)
def cumulative_tokens(spark, sf_dir):
    used = turns(spark, sf_dir).select("session_id", "seq", "tokens", "is_error")
    return sessions.cumulative_tokens(used, CACHE_LIMIT, reset="is_error").select(
        "session_id", "seq", "cached_tokens", "over_limit"
    )


@query(f"""WITH {CALLS_SQL}, per_session AS (
  SELECT session_id, max(iteration) AS iterations, bool_or(is_final) AS success,
    coalesce(CAST(sum(CASE WHEN NOT is_error THEN tokens END) AS BIGINT), 0) AS total_tokens FROM kept GROUP BY session_id)
SELECT (session_id // 1000) % 20 AS model, count(*) AS sessions, round(avg(iterations), 6) AS avg_iterations,
  round(avg(total_tokens), 6) AS avg_tokens, round(avg(round_even(10 * CAST(success AS INT), 1)), 6) AS avg_score
FROM per_session GROUP BY ALL""")
def model_session_averages(spark, sf_dir):
    """Average score, iterations and tokens per model: responses all the way to a board."""
    summary = sessions.session_summary(turns(spark, sf_dir)).withColumn("model", F.expr("session_id div 1000 % 20"))
    scored = summary.withColumn("score", overall_score(agent_success=F.col("success")))
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(F.avg("iterations"), 6).alias("avg_iterations"),
        F.round(F.avg("total_tokens"), 6).alias("avg_tokens"),
        F.round(F.avg("score"), 6).alias("avg_score"),
    )


#: A chat template for each call format that can be inferred, in the order of its number.
_TURN_TEMPLATES = [markers[0] for _, markers in C.TEMPLATE_MARKERS] + ["<tool_call>{{ tool_call.name }}"]
_FORMATS = [name for name, _ in C.TEMPLATE_MARKERS] + ["json_tools", "python_tag"]
_FMT_SQL = f"[{', '.join(repr(f) for f in _FORMATS)}][CAST(seq % 10 AS INT) + 1]"


@query(f"""WITH {CALLS_SQL}
SELECT session_id, seq, 'json_tools' AS fmt, name, concat('{{"k":', k, '}}') AS arguments, CAST(NULL AS VARCHAR) AS error FROM calls WHERE seq % 10 = 8
UNION ALL
SELECT user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5, event_id, 'python_tag', event_type, replace(props, ' ', ''), NULL FROM events WHERE event_id % 10 = 9
UNION ALL
SELECT session_id, seq, {_FMT_SQL}, NULL, NULL, concat('No parser for format: ', {_FMT_SQL}) FROM turns WHERE seq % 10 < 8""")
def parse_calls_lateral(spark, sf_dir):
    """Texts of ten formats, each told by its chat template and parsed by what that selects."""
    template = F.when(F.col("seq") % 10 < 9, F.array(*map(F.lit, _TURN_TEMPLATES))[(F.col("seq") % 10).cast("int")]).otherwise("plain")
    texts = turns(spark, sf_dir).select(
        "session_id", "seq", F.coalesce(C.infer_tool_format(template), F.lit("python_tag")).alias("fmt"), F.col("content").alias("text")
    )
    bare = table(spark, sf_dir, "events").selectExpr("event_id AS seq", """concat('{"name": "', event_type, '", "parameters": ', props, '}') AS bare""")
    mixed = texts.join(bare, "seq").withColumn("text", F.when(F.col("fmt") == "python_tag", F.col("bare")).otherwise(F.col("text")))
    return parsers.parse_calls_lateral(mixed).select("session_id", "seq", "fmt", "name", "arguments", "error")


@query(f"""WITH {CALLS_SQL}
SELECT session_id, seq, name, concat('{{"k":', k, '}}') AS arguments, CAST(NULL AS VARCHAR) AS error FROM calls
UNION ALL
SELECT user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5, event_id, event_type, replace(props, ' ', ''), NULL
FROM events
""")
def parse_calls_by_format(spark, sf_dir):
    """Calls of two formats in one table, each text parsed by its own format's parser."""
    tagged = turns(spark, sf_dir).select("session_id", "seq", F.col("content").alias("text"), F.lit("json_tools").alias("fmt"))
    bare = table(spark, sf_dir, "events").selectExpr(
        "user_id * 1000 + datediff(CAST(ts AS DATE), DATE'2024-01-01') div 5 AS session_id", "event_id AS seq",
        """concat('{"name": "', event_type, '", "parameters": ', props, '}') AS text""", "'python_tag' AS fmt",
    )
    return parsers.parse_calls(tagged.unionByName(bare)).select("session_id", "seq", "name", "arguments", "error")
