"""Streams against their batch operators, with input cut into many small batches."""

import random
from datetime import datetime

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agentlake.operators import sessions as S
from agentlake.operators import transfers as X
from agentlake.streaming import gaps
from agentlake.streaming.run import ROCKSDB, drain, mark_end, milliseconds
from agentlake.streaming.sessions import stream_cache_growth, stream_sessions
from agentlake.streaming.transfers import stream_transfer_progress


def call(name):
    return f'<tool_call>{{"name": "{name}", "arguments": {{}}}}</tool_call>'


SESSIONS = {
    1: [("call", call("a")), ("call", call("b") + call("c")), ("text", "done"), ("call", call("late"))],
    2: [("error", ""), ("text", "finished")],
    3: [("call", call("x"))] * 12,
    4: [("error", "")] * 11,
    5: [("text", "")],
    6: [("text", "<tool_call>broken</tool_call>")],
    7: [("call", call("open"))],
}


@pytest.fixture(scope="module")
def responses(spark):
    rows = [
        (s, i, 10 * s + i, 0.5, kind == "error", content)
        for s, turns in SESSIONS.items()
        for i, (kind, content) in enumerate(turns)
    ]
    return spark.createDataFrame(
        rows, "session_id bigint, seq bigint, tokens bigint, elapsed double, is_error boolean, content string"
    )


def as_stream(spark, df, path, parts):
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_batch_summary(responses):
    got = {r.session_id: r for r in S.session_summary(responses).collect()}
    assert (got[1].iterations, got[1].success, got[1].final_output, [c.name for c in got[1].tool_calls]) == (3, True, "done", ["a", "b", "c"])
    assert got[1].total_tokens == 10 + 11 + 12 and got[1].total_time == 1.5
    assert (got[2].iterations, got[2].success, got[2].total_tokens) == (2, True, 21)
    assert (got[3].iterations, got[3].success, len(got[3].tool_calls)) == (10, False, 10)
    assert (got[4].iterations, got[4].success, got[4].total_tokens, got[4].final_output) == (10, False, 0, "")
    assert (got[5].iterations, got[5].success, got[5].final_output) == (1, True, "")
    assert got[6].success, "an unparseable call cannot be told from completion"
    assert (got[7].iterations, got[7].success, got[7].final_output) == (1, False, call("open"))


def test_stream_sessions_equal_batch(spark, responses, tmp_path):
    parts = ["seq < 1", "seq >= 1 AND seq < 3", "seq >= 3"]
    stream = as_stream(spark, responses, str(tmp_path / "in"), parts)
    got = drain(spark, stream_sessions(stream, position="seq"), str(tmp_path / "run"), partitions=2)
    want = batch_of(responses).where("success OR iterations = 10")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def batch_of(responses):
    names = F.array_join(F.transform("tool_calls", lambda c: c["name"]), ",")
    columns = ["session_id", "iterations", "tool_calls", "total_tokens", "total_time", "final_output", "success"]
    return S.session_summary(responses).withColumn("tool_calls", names).select(columns)


def timed(responses):
    return responses.withColumn("at", F.expr("timestamp_seconds(1704067200 + 600 * seq)"))


@pytest.mark.parametrize("parts", [["seq % 3 = 2", "seq % 3 = 0", "seq % 3 = 1"], ["seq > 6", "seq <= 6 AND seq > 0", "seq = 0"], ["true"]])
def test_end_of_input_closes_open_sessions(spark, responses, tmp_path, parts):
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    df = timed(responses)
    stream = as_stream(spark, df, source, parts)
    mark_end(spark, df.schema, source, "at")
    got = drain(spark, stream_sessions(stream, position="seq", clock="at", late="1 day"), run, partitions=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch_of(responses).collect()))
    assert left_in(spark, run, "session") == left_in(spark, run, "due") == 0


def left_in(spark, run, name):
    """Keys that a state variable of a finished stream still holds."""
    return spark.read.format("statestore").option("stateVarName", name).load(f"{run}/checkpoint").count()


def test_gap_that_never_closes_is_given_up(spark, responses, tmp_path):
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    df = timed(responses.where("session_id = 1 AND seq <> 1"))
    stream = as_stream(spark, df, source, ["seq = 2", "seq = 0", "seq = 3"])
    mark_end(spark, df.schema, source, "at")
    row = drain(spark, stream_sessions(stream, position="seq", clock="at", late="1 day"), run, partitions=2).collect()
    assert [(r.iterations, r.success, r.final_output, r.tool_calls) for r in row] == [(2, True, "done", "a")]


def test_idle_session_ends_while_others_go_on(spark, tmp_path):
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    rows = [(1, 0, 5, 0.5, False, call("x"), datetime(2024, 1, 1)), (2, 0, 5, 0.5, False, call("y"), datetime(2024, 1, 2)), (2, 1, 5, 0.5, False, call("z"), datetime(2024, 1, 2)), (1, 1, 5, 0.5, False, "late", datetime(2024, 1, 1, 0, 5))]
    df = spark.createDataFrame(rows, "session_id bigint, position bigint, tokens bigint, elapsed double, is_error boolean, content string, at timestamp")
    stream = as_stream(spark, df, source, ["session_id = 1 AND position = 0", "session_id = 2 AND position = 0", "session_id = 2 AND position = 1", "content = 'late'"])
    got = drain(spark, stream_sessions(stream, clock="at", late="10 minutes", idle="1 hour"), run, partitions=1).collect()
    # Session 1 ends as it is; what comes for it after the watermark is late.
    assert [(r.session_id, r.iterations, r.success) for r in got] == [(1, 1, False)]
    assert milliseconds("1 hour") == 3_600_000


class Map(dict):
    """Keyed state as the processors see it."""

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]


class Handle:
    def getMapState(self, name, key, value):
        return Map()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(0, 1000), st.sampled_from([1, 3, 256]))
def test_gap_buffer_orders_what_arrives(positions, seed, span):
    rng, saved = random.Random(seed), gaps.SPAN
    gaps.SPAN = span
    try:
        buffer = gaps.GapBuffer(Handle(), "w", {"position": "bigint", "v": "string"})
        expected, first, out = 0, None, []
        while positions:
            n = rng.randint(1, 8)
            batch, positions = positions[:n], positions[n:]
            for run, expected, first in buffer.pass_on(pd.DataFrame({"position": batch, "v": list(map(str, batch)), "clock": 0}), expected, first):
                out += run["v"].tolist()
            seen = set(map(int, out)) | {p for k in buffer.waiting for p in buffer.waiting[k][0]}
            assert expected == len(out) and expected not in seen
            assert first == min((p for p in seen if p > expected), default=None)
        rest = [v for rows in buffer.remaining() for v in rows["v"]]
        assert list(map(int, out)) == list(range(len(out)))
        assert list(map(int, out + rest)) == sorted(set(map(int, out + rest)))
    finally:
        gaps.SPAN = saved


def test_stream_resumes_from_its_checkpoint(spark, responses, tmp_path):
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    as_stream(spark, responses, source, ["seq < 2"])
    schema = responses.schema
    first = drain(spark, stream_sessions(spark.readStream.schema(schema).parquet(source), position="seq"), run, partitions=2)
    assert {r.session_id for r in first.collect()} == {2, 5, 6}
    as_stream(spark, responses, source, ["seq >= 2"])
    second = drain(spark, stream_sessions(spark.readStream.schema(schema).parquet(source), position="seq"), run, partitions=2)
    assert sorted(r.session_id for r in second.collect()) == [1, 2, 3, 4, 5, 6]


def test_abandoned_session_ends_after_its_ttl(spark, responses, tmp_path):
    import time

    source = str(tmp_path / "in")
    as_stream(spark, responses, source, ["session_id = 7"])
    stream = stream_sessions(spark.readStream.schema(responses.schema).parquet(source), position="seq", ttl_ms=500)
    query = (
        stream.writeStream.format("memory").queryName("abandoned").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds")
    )
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    running = query.start()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not spark.sql("SELECT * FROM abandoned").count():
            time.sleep(0.5)
        row = spark.sql("SELECT * FROM abandoned").first()
        assert (row.session_id, row.iterations, row.success) == (7, 1, False)
    finally:
        running.stop()


@pytest.mark.parametrize("parts", [["seq < 50", "seq >= 50 AND seq < 51", "seq >= 51"], ["position % 3 = 2", "position % 3 = 1", "position % 3 = 0"], ["position >= 70", "position < 70"]])
def test_stream_cache_equals_batch(spark, tmp_path, parts):
    usage = spark.range(400).selectExpr(
        "id % 3 AS session_id", "id AS seq", "id div 3 AS position", "id % 11 AS tokens", "id % 97 = 0 AS fresh"
    )
    stream = as_stream(spark, usage, str(tmp_path / "in"), parts)
    got = drain(spark, stream_cache_growth(stream, 60, "fresh"), str(tmp_path / "run"), partitions=2)
    want = S.cumulative_tokens(usage, 60, reset="fresh").where("over_limit").select(got.columns)
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_cache_past_a_lost_row(spark, tmp_path):
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    usage = spark.range(30).selectExpr("1L AS session_id", "10 * id AS seq", "id AS position", "7L AS tokens", "id = 20 AS fresh", "timestamp_seconds(1704067200 + id) AS at").where("position <> 4")
    stream = as_stream(spark, usage, source, ["position % 2 = 1", "position % 2 = 0"])
    mark_end(spark, usage.schema, source, "at")
    got = drain(spark, stream_cache_growth(stream, 50, "fresh", clock="at", late="1 hour"), run, partitions=1)
    want = S.cumulative_tokens(usage, 50, reset="fresh").where("over_limit").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert left_in(spark, run, "cached") == 0


def test_stream_transfers(spark, tmp_path):
    manifest = spark.createDataFrame(
        [(1, "a", 10), (1, "empty", 0), (2, "b", 8), (2, "wrong", 5), (3, "open", 9)], "transfer_id bigint, path string, size bigint"
    )
    planned = X.chunk_plan(manifest, 4).selectExpr(
        "transfer_id", "path", "chunk_no", "actual_size", "TIMESTAMP'2024-01-01 00:00:00' AS start_ts",
        "timestamp_seconds(1704067200 + chunk_no + 1) AS ts",
    )
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    # The last batches repeat chunks of files that are closed by then; one file stays open.
    parts = ["chunk_no = 2 AND path <> 'open'", "chunk_no = 0", "chunk_no = 1", "chunk_no = 3", "path IN ('a', 'empty')", "path = 'a' AND chunk_no = 3"]
    stream = as_stream(spark, planned, source, parts)
    expected = manifest.where("path <> 'b'").replace({5: 6}, subset="size")
    progress = stream_transfer_progress(stream, expected, late="1 hour")
    out = drain(spark, progress, run, partitions=2)
    want = [("a", 3, 10, 4.0, True), ("b", 2, 8, 3.0, False), ("empty", 0, 0, 1.0, True), ("wrong", 2, 5, 3.0, False)]
    assert sorted((r.path, r.chunks, r.bytes, r.elapsed, r.size_ok) for r in out.collect()) == want
    assert left_in(spark, run, "file") == 5
    # The end of the input passes all marks; rows that come after it are late.
    mark_end(spark, planned.schema, source, "ts")
    drain(spark, progress, run, partitions=2)
    assert left_in(spark, run, "file") == 0
    as_stream(spark, planned, source, ["path = 'b'"])
    again = drain(spark, progress, run, partitions=2)
    assert sorted((r.path, r.chunks, r.bytes, r.elapsed, r.size_ok) for r in again.collect()) == want
    assert left_in(spark, run, "file") == 0


def test_hot_file_is_combined_before_the_shuffle(spark, tmp_path):
    hot = spark.range(5000).selectExpr(
        "1L AS transfer_id", "'hot' AS path", "id AS chunk_no", "IF(id = 4999, 0L, 3L) AS actual_size", "TIMESTAMP'2024-01-01 00:00:00' AS start_ts", "timestamp_seconds(1704067200 + id) AS ts"
    )
    from agentlake.streaming.transfers import _PART, _combined

    assert hot.coalesce(2).mapInArrow(_combined, _PART).count() <= 2
    expected = spark.createDataFrame([(1, "hot", 4999 * 3)], "transfer_id bigint, path string, size bigint")
    got = drain(spark, stream_transfer_progress(as_stream(spark, hot, str(tmp_path / "in"), ["true"]), expected), str(tmp_path / "run"), partitions=2).collect()
    assert [(r.chunks, r.bytes, r.size_ok) for r in got] == [(4999, 4999 * 3, True)]


def test_files_share_entries_of_the_state(spark, tmp_path, monkeypatch):
    from agentlake.streaming import buckets

    monkeypatch.setattr(buckets, "BUCKETS", 4)
    chunks = spark.range(600).selectExpr(
        "1L AS transfer_id", "concat('f', id % 200) AS path", "id div 200 AS chunk_no", "IF(id < 400, 5L, 0L) AS actual_size",
        "TIMESTAMP'2024-01-01 00:00:00' AS start_ts", "timestamp_seconds(1704067201 + id div 200) AS ts",
    ).where("path <> 'f7' OR chunk_no <> 1")
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    expected = chunks.groupBy("transfer_id", "path").agg(F.sum("actual_size").alias("size"))
    progress = stream_transfer_progress(as_stream(spark, chunks, source, ["chunk_no = 2", "chunk_no = 0", "chunk_no = 1"]), expected, late="1 hour")
    got = drain(spark, progress, run, partitions=2).collect()
    assert sorted((r.path, r.chunks, r.bytes, r.elapsed, r.size_ok) for r in got) == sorted((f"f{i}", 2, 10, 3.0, True) for i in range(200) if i != 7)
    assert 0 < left_in(spark, run, "file") <= 4
    mark_end(spark, chunks.schema, source, "ts")
    drain(spark, progress, run, partitions=2)
    assert left_in(spark, run, "file") == 0


def shuffle_blocks(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}


def test_disk_does_not_follow_the_number_of_batches(spark, tmp_path):
    """Shuffle files go with their batch, old versions of the state and of the logs with later ones."""
    import time

    chunks = spark.range(600).selectExpr(
        "1L AS transfer_id", "concat('a/rather/long/path/of/file/', id % 60) AS path", "id div 60 AS chunk_no", "IF(id < 540, 5L, 0L) AS actual_size",
        "TIMESTAMP'2024-01-01 00:00:00' AS start_ts", "timestamp_seconds(1704067201 + id div 60) AS ts",
    )
    source, run = str(tmp_path / "in"), tmp_path / "run"
    expected = chunks.groupBy("transfer_id", "path").agg(F.sum("actual_size").alias("size")).localCheckpoint()
    before = shuffle_blocks(spark)
    stream = as_stream(spark, chunks, source, [f"chunk_no = {i}" for i in (9, 1, 0, 3, 2, 5, 4, 7, 6, 8)])
    got = drain(spark, stream_transfer_progress(stream, expected, late="1 hour"), str(run), partitions=2)
    assert sorted((r.chunks, r.bytes, r.size_ok) for r in got.collect()) == [(9, 45, True)] * 60
    assert len([f for f in (run / "checkpoint" / "commits").iterdir() if f.name.isdigit()]) <= 3
    deadline = time.time() + 20
    while shuffle_blocks(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_blocks(spark) - before


def test_a_reported_file_leaves_only_the_time_it_is_due():
    import pickle

    from agentlake.streaming.buckets import unpacked
    from agentlake.streaming.transfers import FileProcessor

    processor, held = FileProcessor(1000), {}
    rows = pd.DataFrame({"transfer_id": [1, 1], "path": ["a", "b"], "start_us": [0, 0], "ts_us": [5_000_000, 7_000_000], "chunks": [2, 1], "bytes": [9, 4], "end_no": [2.0, None]})
    assert list(processor.take(held, rows, None)) == [(1, "a", 0, 2, 9, 5.0)]
    assert held == {(1, "a", 0): [5001], (1, "b", 0): [8000, 1, 4, 7_000_000, None]}
    # What comes for it later only moves that time on.
    assert not list(processor.take(held, rows.assign(ts_us=9_000_000, end_no=None), None))
    assert held == {(1, "a", 0): [9001], (1, "b", 0): [10000, 2, 8, 9_000_000, None]}

    class Value:
        def update(self, value):
            self.value = value

    processor.entry, processor.due = Value(), Value()
    processor.handle = type("Timers", (), {"registerTimer": lambda self, at: None})()
    many = {(1, f"a/rather/long/path/of/file/{i}", 0): [5001] for i in range(500)}
    processor._store(None, many)
    many |= {(2, f"open/{i}", None): [9000, 1, i, 7_000_000, None] for i in range(9)} | {(None, None, 0): [8000, 0, 0, 1, 4]}
    processor._store(None, many)
    assert len(processor.entry.value[0]) < len(pickle.dumps(many, protocol=5)) / 5
    assert processor.thaw(unpacked(processor.entry.value[0])) == many


def test_files_of_a_stream_go_once_they_are_read(spark, tmp_path):
    from agentlake.plans import all_queries

    all_queries()
    from agentlake.plans.stream_queries import _in_parts

    source = str(tmp_path / "in")
    stream = _in_parts(spark.range(40).repartition(40), source, ["id % 2 = 1", "id % 2 = 0"])
    n_files = len(list((tmp_path / "in").glob("*.parquet")))
    assert drain(spark, stream, str(tmp_path / "run")).count() == 40
    assert len(list((tmp_path / "in").glob("*.parquet"))) < n_files


def test_sessions_share_entries_of_the_state(spark, responses, tmp_path, monkeypatch):
    from agentlake.streaming import buckets, sessions

    monkeypatch.setattr(buckets, "BUCKETS", 2)
    many = responses.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumn("session_id", F.expr("session_id + 10 * copy")).drop("copy")
    stream = as_stream(spark, many, str(tmp_path / "in"), ["seq % 3 = 2", "seq % 3 = 0"])
    got = drain(spark, stream_sessions(stream, position="seq"), str(tmp_path / "run"), partitions=2)
    assert {r.session_id for r in got.collect()} == {s + 10 * c for s in (5, 6) for c in range(20)}
    assert 0 < left_in(spark, str(tmp_path / "run"), "session") <= 2
    # More rows of a session wait than its bucket holds.
    monkeypatch.setattr(sessions, "MOST_WAITING", 5)
    usage = spark.range(400).selectExpr("id % 3 AS session_id", "id AS seq", "id div 3 AS position", "id % 11 AS tokens", "id % 97 = 0 AS fresh")
    stream = as_stream(spark, usage, str(tmp_path / "usage"), ["position > 60", "position % 2 = 1 AND position <= 60", "position % 2 = 0 AND position <= 60"])
    got = drain(spark, stream_cache_growth(stream, 60, "fresh"), str(tmp_path / "sums"), partitions=2)
    want = S.cumulative_tokens(usage, 60, reset="fresh").where("over_limit").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
