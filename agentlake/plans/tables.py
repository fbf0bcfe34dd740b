"""Input tables, and the agent-shaped tables derived from them.

Each derived table exists twice: as a DataFrame and as a SQL common table
expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.functions.bytes import byte_level_token
from agentlake.operators.scans import PART_ROWS, parts_for
from agentlake.operators.transfers import chunk_plan
from agentlake.streaming.run import RELEASE, settings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How intermediate tables are kept: dictionaries may hold half a million ids.
_STORED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


def store(df: DataFrame, path: str, **options) -> None:
    """Write a table, or more of it; the shuffle files behind it are dropped."""
    with settings(df.sparkSession, RELEASE):
        df.write.mode("append").options(**_STORED, **options).parquet(path)


# One call in the shapes a model may write it, chosen by event id; valid in both dialects.
_CALL = """concat('{"name": "', event_type, '", "arguments": ', props, '}')"""
TURN_CONTENT = f"""CASE
    WHEN event_type = 'error' THEN ''
    WHEN event_id % 17 = 0 THEN '<tool_call>oops</tool_call>'
    WHEN event_id % 13 = 0 THEN concat('```tool_call', chr(10), {_CALL}, chr(10), '```')
    WHEN event_id % 19 = 0 THEN concat('<|im_start|>', {_CALL}, '<|im_end|>')
    WHEN event_id % 23 = 0 THEN concat('<｜tool▁call▁begin｜>function<｜tool▁sep｜>', event_type, chr(10), '```json', chr(10), {_CALL}, chr(10), '```')
    WHEN event_id % 29 = 0 THEN concat('<tool_call>', {_CALL}, '</tool_call> and <tool_call>', {_CALL}, ' junk</tool_call><tool_call>', {_CALL}, '</tool_call>')
    WHEN event_type = 'click' THEN concat('<tool_call>', chr(10), {_CALL}, chr(10), '</tool_call>')
    WHEN event_type = 'view' THEN concat('ok ```json', chr(10), {_CALL}, chr(10), '```')
    WHEN event_type = 'purchase' THEN concat('<tool_call>', replace({_CALL}, '"', chr(39)), '</tool_call>')
    ELSE concat('done ', CAST(event_id AS STRING)) END"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses: a user's events of five days form a session, ordered by event."""
    return turns_of(table(spark, sf_dir, "events"))


def turns_of(events: DataFrame, *more: str) -> DataFrame:
    """The responses, with ``more`` columns of their events."""
    return events.selectExpr(
        "user_id * 1000 + datediff(CAST(ts AS DATE), DATE'2024-01-01') div 5 AS session_id",
        "event_id AS seq",
        "CAST(floor(value) AS BIGINT) AS tokens",
        "value / 10 AS elapsed",
        "event_type = 'error' AS is_error",
        f"{TURN_CONTENT} AS content",
        *more,
    )


TURNS_SQL = f"""turns AS (
  SELECT user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5 AS session_id,
         event_id AS seq, CAST(floor(value) AS BIGINT) AS tokens, value / 10 AS elapsed,
         event_type = 'error' AS is_error, {TURN_CONTENT} AS content
  FROM events)"""

_PATTERNS = [
    ("tool_call_tag", r"<tool_call>\s*(.*?)\s*</tool_call>"),
    ("im_block", r"<\|im_start\|>\s*(.*?)\s*(?:<\|im_end\|>|$)"),
    ("fenced_tool_call", r"```tool_call\s*(.*?)\s*```"),
    ("fenced_json", r'```json\s*(\{[^`]*"name"[^`]*"arguments"[^`]*\})\s*```'),
    ("begin_sep_fence", r"<｜tool▁call▁begin｜>.*?<｜tool▁sep｜>\w+\s*```json\s*(.*?)\s*```"),
]
_MATCHES = ", ".join(f"regexp_extract_all(content, '{p}', 1, 's') AS m{i}" for i, (_, p) in enumerate(_PATTERNS))
_PICK = " ".join(f"WHEN len(m{i}) > 0 THEN m{i}" for i in range(len(_PATTERNS)))
_NAME = " ".join(f"WHEN len(m{i}) > 0 THEN '{n}'" for i, (n, _) in enumerate(_PATTERNS))

# matched: one row per raw call; calls: the usable ones, parsed.
CALLS_SQL = f"""{TURNS_SQL},
picked AS (SELECT *, CASE {_PICK} ELSE [] END AS raws, CASE {_NAME} END AS fmt FROM (SELECT *, {_MATCHES} FROM turns)),
matched AS (
  SELECT session_id, seq, fmt, unnest(range(len(raws))) AS call_no, unnest(raws) AS raw FROM picked),
bodies AS (
  SELECT *, CASE WHEN json_valid(raw) THEN raw
                 WHEN json_valid(replace(raw, chr(39), '"')) THEN replace(raw, chr(39), '"') END AS body FROM matched),
calls AS (
  SELECT session_id, seq, fmt, call_no, body ->> '$.name' AS name, body -> '$.arguments' AS args,
         CAST(CAST(body ->> '$.arguments.k' AS BIGINT) AS VARCHAR) AS k
  FROM bodies WHERE body IS NOT NULL AND json_type(body) = 'OBJECT'
    AND list_contains(json_keys(body), 'name') AND list_contains(json_keys(body), 'arguments')),
per_turn AS (
  SELECT t.*, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS iteration,
         CASE WHEN is_error THEN 0 ELSE coalesce(n, 0) END AS n_calls
  FROM turns t LEFT JOIN (SELECT session_id, seq, count(*) AS n FROM calls GROUP BY ALL) c USING (session_id, seq)),
kept AS (
  SELECT *, coalesce(iteration = first_done, false) AS is_final FROM (
    SELECT *, min(CASE WHEN NOT is_error AND n_calls = 0 THEN iteration END) OVER (PARTITION BY session_id) AS first_done
    FROM per_turn WHERE iteration <= 10)
  WHERE first_done IS NULL OR iteration <= first_done)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of one run per source."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS run_id", "concat(lang, '/', doc_id, '.txt') AS path", "text AS content"
    )


FILES_SQL = "files AS (SELECT source AS run_id, concat(lang, '/', doc_id, '.txt') AS path, text AS content FROM documents)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files of a transfer; line 7 gives empty files.

    Few lines share a file, so large tables are dealt out before they are summed up, in
    partitions of bounded size: sums over a whole split of the table only fill memory.
    """
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 50 AS transfer_id",
        """concat('d', l_orderkey % 13, '/', l_orderkey, '/', l_linenumber,
             CASE l_returnflag WHEN 'A' THEN '_test_.py' WHEN 'R' THEN '.py' ELSE '.bin' END) AS path""",
        "CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(floor(l_extendedprice * 1000) AS BIGINT) END AS size",
    )
    parts = parts_for(spark, lines.count(), PART_ROWS // 2)
    if parts:
        lines = lines.repartition(parts, "transfer_id", "path")
    return lines.groupBy("transfer_id", "path").agg(F.sum("size").cast("bigint").alias("size"))


MANIFEST_SQL = """manifest AS (
  SELECT transfer_id, path, CAST(sum(size) AS BIGINT) AS size FROM (
    SELECT l_orderkey % 50 AS transfer_id,
           concat('d', l_orderkey % 13, '/', l_orderkey, '/', l_linenumber,
                  CASE l_returnflag WHEN 'A' THEN '_test_.py' WHEN 'R' THEN '.py' ELSE '.bin' END) AS path,
           CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(floor(l_extendedprice * 1000) AS BIGINT) END AS size
    FROM lineitem) GROUP BY transfer_id, path)"""


def received(sent: DataFrame) -> DataFrame:
    """What arrived: some paths lost, some a byte short, some under another name."""
    arrived = sent.where("length(path) % 11 <> 0").withColumn(
        "size", F.expr("CASE WHEN size % 13 = 1 THEN size - 1 ELSE size END")
    )
    return arrived.withColumn("path", F.expr("CASE WHEN size % 17 = 3 THEN concat(path, '~') ELSE path END"))


RECEIVED_SQL = """received AS (
  SELECT transfer_id, CASE WHEN size % 17 = 3 THEN concat(path, '~') ELSE path END AS path, size
  FROM (SELECT transfer_id, path, CASE WHEN size % 13 = 1 THEN size - 1 ELSE size END AS size
        FROM manifest WHERE length(path) % 11 <> 0))"""

CHUNK = 16 * 1024 * 1024


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows of the manifest with arrival times, a second per chunk."""
    return chunks_of(manifest(spark, sf_dir))


def chunks_of(sent: DataFrame) -> DataFrame:
    """Chunk rows of a manifest that is there already."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    planned = chunk_plan(sent, CHUNK)
    ts = F.timestamp_seconds(start.cast("bigint") + F.col("chunk_no") + 1)
    return planned.withColumn("start_ts", start).withColumn("ts", ts)


def chunk_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions for the chunk rows; lines that share a file have no fewer chunks apart than together."""
    size = F.greatest(F.floor(F.col("l_extendedprice") * 1000), F.lit(0))
    rows = table(spark, sf_dir, "lineitem").agg(F.sum(F.ceil(size / CHUNK) + 1).cast("bigint")).first()[0]
    return parts_for(spark, rows or 0)


CHUNKS_SQL = f"""{MANIFEST_SQL},
planned AS (
  SELECT transfer_id, path, size, unnest(range(CAST(ceil(size / {CHUNK}.0) AS BIGINT) + 1)) AS chunk_no,
         CAST(ceil(size / {CHUNK}.0) AS BIGINT) AS n FROM manifest),
chunks AS (
  SELECT transfer_id, path, chunk_no, chunk_no = n AS is_end,
         CASE WHEN chunk_no = n THEN size ELSE chunk_no * {CHUNK} END AS "offset",
         CASE WHEN chunk_no = n THEN 0 ELSE least({CHUNK}, size - chunk_no * {CHUNK}) END AS actual_size
  FROM planned)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations of (model, task) pairs: source and language of labelled documents."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = documents.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id")
    return joined.groupBy(F.col("source").alias("model"), F.col("lang").alias("task")).agg(
        F.expr("(sum(quality) % 5) / CAST(4 AS DOUBLE)").alias("file_score"),
        F.expr("(count(*) % 9) / CAST(8 AS DOUBLE)").alias("check_score"),
        F.expr("max(quality) = 1").alias("tests_pass"),
        F.expr("min(toxic) = 0").alias("code_runs"),
        F.expr("sum(n_chars) % 2 = 0").alias("agent_success"),
        F.expr("count(*)").alias("iterations"),
        F.expr("count(*) % 7").alias("tool_calls"),
        F.expr("CAST(sum(n_chars) AS BIGINT)").alias("total_tokens"),
        F.expr("sum(n_chars) / CAST(8 AS DOUBLE)").alias("total_time"),
    )


RESULTS_SQL = """results AS (
  SELECT d.source AS model, d.lang AS task, (sum(l.quality) % 5) / CAST(4 AS DOUBLE) AS file_score,
         (count(*) % 9) / CAST(8 AS DOUBLE) AS check_score, max(l.quality) = 1 AS tests_pass,
         min(l.toxic) = 0 AS code_runs, sum(d.n_chars) % 2 = 0 AS agent_success,
         count(*) AS iterations, count(*) % 7 AS tool_calls, CAST(sum(d.n_chars) AS BIGINT) AS total_tokens,
         sum(d.n_chars) / CAST(8 AS DOUBLE) AS total_time
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source, d.lang),
scored AS (
  SELECT *, round_even(15 * file_score + 35 * check_score + 30 * CAST(tests_pass AS INT)
                       + 10 * CAST(code_runs AS INT) + 10 * CAST(agent_success AS INT), 1) AS score
  FROM results)"""


def words(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Space-separated words of every document: ``(stream_id, pos, word)``, and ``more`` columns of the document."""
    # Computed below the generator: once for a document, not for each of its words.
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), *more, F.split("text", " ").alias("_words"))
    kept = [c for c in documents.columns if c != "_words"]
    return documents.select(*kept, F.posexplode("_words").alias("pos", "word")).withColumn("pos", F.col("pos").cast("bigint"))


def word_id(token: str = "token"):
    """A number for a token: the first 60 bits of its digest."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint")


def _spaced() -> Column:
    return F.when(F.col("pos") > 0, F.concat(F.lit(" "), F.col("word"))).otherwise(F.col("word"))


def spaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that a document has, with the space before it: ``(spaced)``."""
    return words(spark, sf_dir).select(_spaced().alias("spaced")).distinct()


def tokens_and_vocab(spark: SparkSession, sf_dir: str, kind: str, known: DataFrame | None = None):
    """Every document as a token stream, and the vocabulary of its words.

    A word after the first carries its leading space; ids are whole digests. Each seventh
    document ends with an id that no vocabulary has. The last token of a document is marked
    by ``is_end``. ``known`` is ``spaced_words``, if it is there already.
    """
    n_words = F.size(F.split("text", " ")).cast("bigint")
    spelled, word_digest = words(spark, sf_dir, n_words.alias("n")).withColumn("spaced", _spaced()), F.unhex(F.md5("spaced"))
    is_end = (F.col("pos") == F.col("n") - 1) & (F.col("stream_id") % 7 != 0)
    streams = spelled.withColumn("id", word_digest).withColumn("is_end", is_end)
    text = F.col("spaced")
    if kind == "byte_level":
        token = byte_level_token(text)
    else:
        token = text if kind == "naive" else F.replace(text, F.lit(" "), F.lit("▁"))
    vocab = (spaced_words(spark, sf_dir) if known is None else known).select(word_digest.alias("id"), token.alias("token"))
    unknown = table(spark, sf_dir, "documents").where("doc_id % 7 = 0 AND text IS NOT NULL").select(
        F.col("doc_id").alias("stream_id"), n_words.alias("pos"), F.unhex(F.lit("00")).alias("id"), F.lit(True).alias("is_end")
    )
    return streams.select("stream_id", "pos", "id", "is_end").unionByName(unknown), vocab


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the nodes of one cluster per region, supplier balances as capacity in GB."""
    nation = table(spark, sf_dir, "nation")
    balance = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum(F.abs("s_acctbal")).alias("capacity"))
    joined = nation.join(balance, nation.n_nationkey == balance.s_nationkey, "left")
    return joined.selectExpr(
        "n_regionkey AS cluster_id", "CAST(n_nationkey div 5 AS INT) AS rank", "round(capacity, 2) * 1048576 AS capacity"
    )


NODES_SQL = """nodes AS (
  SELECT n_regionkey AS cluster_id, CAST(n_nationkey // 5 AS INT) AS rank, round(capacity, 2) * 1048576 AS capacity
  FROM nation LEFT JOIN (SELECT s_nationkey, sum(abs(s_acctbal)) AS capacity FROM supplier GROUP BY s_nationkey)
    ON n_nationkey = s_nationkey)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation pairs of a sale as links, one cluster per line number."""
    sales = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return sales.groupBy(
        F.col("l_linenumber").alias("cluster_id"), F.col("c_nationkey").cast("int").alias("src"), F.col("s_nationkey").cast("int").alias("dst")
    ).agg(F.count(F.lit(1)).alias("n"), F.expr("CASE WHEN count(*) % 5 = 0 THEN 'PORT_DOWN' ELSE 'PORT_ACTIVE' END").alias("state"))


LINKS_SQL = """links AS (
  SELECT l_linenumber AS cluster_id, CAST(c_nationkey AS INT) AS src, CAST(s_nationkey AS INT) AS dst, count(*) AS n,
         CASE WHEN count(*) % 5 = 0 THEN 'PORT_DOWN' ELSE 'PORT_ACTIVE' END AS state
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as expert tensors, one checkpoint per 80 orders."""
    return (
        table(spark, sf_dir, "lineitem").selectExpr(
            "l_orderkey div 80 AS checkpoint_id",
            """concat('model.layers.', l_linenumber - 1, '.block_sparse_moe.experts.', l_partkey % 4,
                 '.w', l_suppkey % 3 + 1, '.weight') AS name""",
            "CAST(l_quantity AS BIGINT) * 1024 AS nbytes",
        ).groupBy("checkpoint_id", "name").agg(F.sum("nbytes").cast("bigint").alias("nbytes"))
    )


TENSORS_SQL = """tensors AS (
  SELECT checkpoint_id, name, CAST(sum(nbytes) AS BIGINT) AS nbytes FROM (
    SELECT l_orderkey // 80 AS checkpoint_id,
           concat('model.layers.', l_linenumber - 1, '.block_sparse_moe.experts.', l_partkey % 4,
                  '.w', l_suppkey % 3 + 1, '.weight') AS name,
           CAST(l_quantity AS BIGINT) * 1024 AS nbytes FROM lineitem) GROUP BY ALL)"""


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a thinking span in front of every message."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", "concat('<think>', role, '</think>', text) AS content"
    )


CONV_SQL = "conv AS (SELECT conv_id, turn, role, concat('<think>', role, '</think>', text) AS content FROM conversations)"
