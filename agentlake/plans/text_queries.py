"""Queries of the scalar text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import json_text as J
from agentlake.functions import numbers as N
from agentlake.functions import text as T
from agentlake.operators import tokens
from agentlake.plans.registry import query
from agentlake.plans.tables import MANIFEST_SQL, conv, manifest, table


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS shown,
  substr(text, 1, 1000) AS cut FROM documents""")
def preview(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.preview(text, 200).alias("shown"), T.preview(text, 1000, "").alias("cut")
    )


@query("""SELECT page_id, split_part(u, ':', 1) AS host,
  regexp_replace(substr(u, instr(u, ':') + 1), '^~', '/home/runner') AS path, NOT contains(u, ':') AS invalid
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat('node', page_id, ':~/', url) ELSE concat('node', page_id, ':/tmp') END AS u FROM pages)""")
def parse_remote_path(spark, sf_dir):
    targets = table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat('node', page_id, ':~/', url) ELSE concat('node', page_id, ':/tmp') END AS u",
    )
    parsed = targets.withColumn("p", T.parse_remote_path(F.col("u"), "/home/runner"))
    return parsed.select("page_id", "p.host", "p.path", F.col("p").isNull().alias("invalid"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'PORT_ACTIVE' WHEN 'click' THEN 'PORT_DOWN' WHEN 'purchase' THEN 'PORT_DOWN' ELSE 'TIMEOUT' END AS state FROM events""")
def link_state(spark, sf_dir):
    output = F.expr("""CASE event_type WHEN 'view' THEN concat('hca_id: rdma', chr(10), ' state: PORT_ACTIVE (4)')
      WHEN 'click' THEN ' state: PORT_DOWN (1)' WHEN 'purchase' THEN ' PORT_DOWN then PORT_ACTIVE' WHEN 'error' THEN NULL ELSE 'no device' END""")
    return table(spark, sf_dir, "events").select("event_id", T.link_state(output).alias("state"))


@query("""SELECT event_id, gb, gb > 20 AS over_limit FROM (
  SELECT event_id, (CAST(floor(value * 10000) AS BIGINT) * 16) // 1048576 AS gb FROM events)""")
def wired_gb(spark, sf_dir):
    line = F.expr("concat('Pages wired down:      ', CAST(floor(value * 10000) AS BIGINT), '.')")
    gb = table(spark, sf_dir, "events").select("event_id", T.wired_gb(line).alias("gb"))
    return gb.withColumn("over_limit", T.over_wired_limit(F.col("gb")))


@query("""SELECT conv_id, turn, regexp_matches(text, '(?i)der|tion') AS matches, contains(text, 'content') AS holds FROM conversations""")
def answer_matches(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.answer_matches(text, "der|tion").alias("matches"),
        T.answer_matches(text, "content", ignore_case=False).alias("holds"),
    )


@query("""SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'the ') OR contains(lower(text), 'not able') AS flagged FROM documents""")
def flag_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.flag_phrases(F.col("text"), ["license", "the ", "not able"]).alias("flagged")
    )


@query("""SELECT page_id, regexp_extract(html, '(/[^\\s"]+)', 1) AS ref FROM pages""")
def extract_doc_ref(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.extract_doc_ref(F.col("html")).alias("ref"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(text, chr(10), chr(10), lang) WHEN 1 THEN '{"content":[]}' ELSE '{}' END AS text FROM documents""")
def flatten_rpc_result(spark, sf_dir):
    raw = F.when(
        F.col("doc_id") % 3 == 0,
        F.concat(
            F.lit('{"result":{"content":[{"text":'), J.quote(F.col("text")), F.lit('},{"type":"image"},{"text":'),
            J.quote(F.col("lang")), F.lit("}]}}"),
        ),
    ).when(F.col("doc_id") % 3 == 1, F.lit('{"result": {"content": []}}')).otherwise(F.lit('{"id": 1}'))
    return table(spark, sf_dir, "documents").select("doc_id", T.flatten_rpc_result(raw).alias("text"))


@query("SELECT event_id, event_id % 5 IN (0, 1, 4) AS equal FROM events")
def json_equal(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('{\"a\": [1, 2.5, \"x\"], \"p\": ', props, '}') AS a",
        """CASE event_id % 5 WHEN 0 THEN concat('{"p":', replace(props, ' ', ''), ',"a":[1,2.5,"x"]}')
             WHEN 1 THEN concat('{"a": [1, 25e-1, "x"], "p": ', props, '}')
             WHEN 2 THEN concat('{"a": [1.0, 2.5, "x"], "p": ', props, '}')
             WHEN 3 THEN concat('{"a": [2.5, 1, "x"], "p": ', props, '}')
             ELSE concat('{"a": [1, 2.50, "x"], "p": ', props, '}') END AS b""",
    )
    return pairs.select("event_id", J.json_equal(F.col("a"), F.col("b")).alias("equal"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'spm' WHEN 1 THEN 'spm_no_strip' WHEN 2 THEN 'byte_level' ELSE 'naive' END AS kind FROM events""")
def decoder_kind(spark, sf_dir):
    step = F.concat(F.lit('{"type":"ByteLevel","k":'), F.col("props"), F.lit("}"))
    decoder = (
        F.when(F.col("event_id") % 5 == 0, F.replace(F.lit(tokens.SPM_DECODER), F.lit(","), F.lit(", ")))
        .when(F.col("event_id") % 5 == 1, F.lit(tokens.SPM_DECODER_NO_STRIP))
        .when(F.col("event_id") % 5 == 2, step)
        .when(F.col("event_id") % 5 == 3, F.replace(F.lit(tokens.SPM_DECODER), F.lit('"start":1'), F.lit('"start":1.0')))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", tokens.decoder_kind(decoder, J.canonical_json).alias("kind")
    )


@query("SELECT doc_id, replace(text, chr(10), '<n>') AS escaped, text AS restored FROM documents")
def escape_newlines(spark, sf_dir):
    escaped = T.escape_newlines(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", escaped.alias("escaped"), T.unescape_newlines(escaped).alias("restored")
    )


@query("""SELECT doc_id, array_to_string(CASE WHEN len(r) > 0 AND r[len(r)] = 'de' THEN r[:len(r) - 1] ELSE r END, ' ') AS kept FROM (
  SELECT doc_id, CASE WHEN w[1] = lang THEN w[2:] ELSE w END AS r FROM (
    SELECT doc_id, lang, string_split(CASE WHEN doc_id % 2 = 0 THEN concat(lang, ' ', text, ' de') ELSE text END, ' ') AS w FROM documents))""")
def strip_bos_eos(spark, sf_dir):
    marked = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang", "split(CASE WHEN doc_id % 2 = 0 THEN concat(lang, ' ', text, ' de') ELSE text END, ' ') AS w"
    )
    return marked.select("doc_id", F.array_join(T.strip_bos_eos(F.col("w"), F.col("lang"), F.lit("de")), " ").alias("kept"))


@query(f"WITH {MANIFEST_SQL} SELECT transfer_id, path, (4 - size % 4) % 4 AS pad, size + (4 - size % 4) % 4 AS padded FROM manifest")
def pad_to(spark, sf_dir):
    pad = N.padding(F.col("size"))
    return manifest(spark, sf_dir).select("transfer_id", "path", pad.alias("pad"), (F.col("size") + pad).alias("padded"))


@query(f"""WITH {MANIFEST_SQL} SELECT transfer_id, path,
  CASE WHEN length(path) % 4 > 0 THEN size / (length(path) % 4)::DOUBLE / 1e9 ELSE 0::DOUBLE END AS gbps FROM manifest""")
def transfer_rate(spark, sf_dir):
    gbps = N.rate_gbps(F.col("size"), F.length("path") % 4)
    return manifest(spark, sf_dir).select("transfer_id", "path", gbps.alias("gbps"))


@query("""SELECT event_id, CASE WHEN value / 10 >= 30 THEN 'TIMEOUT' ELSE 'HEALTHY' END AS health, value / 10 < 2 AS within_slo FROM events""")
def latency_health(spark, sf_dir):
    seconds = F.col("value") / 10
    return table(spark, sf_dir, "events").select(
        "event_id", N.latency_health(seconds).alias("health"), N.within_slo(seconds).alias("within_slo")
    )


@query("""SELECT conv_id, role, round(avg(length(text)), 6) AS avg_length, round(1 - least(avg(length(text)) / 200, 1), 6) AS quality
FROM conversations GROUP BY ALL""")
def length_quality(spark, sf_dir):
    average = F.avg(F.length(T.split_reasoning(F.col("content"))["content"]))
    grouped = conv(spark, sf_dir).groupBy("conv_id", "role").agg(average.alias("avg_length"))
    return grouped.select(
        "conv_id", "role", F.round("avg_length", 6).alias("avg_length"),
        F.round(N.length_quality(F.col("avg_length")), 6).alias("quality"),
    )
