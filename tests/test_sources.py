"""File trees, result files, logs."""

import hashlib
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agentlake.operators import rules, scoreboards, transfers
from agentlake.plans import rule_queries
from agentlake.plans.tables import results
from agentlake.sources import records, workspaces


@pytest.fixture()
def tree(tmp_path):
    files = {
        "a.py": b"x = 1\r\n", "__init__.py": b"", "_exec_tmp.py": b"1", ".hidden": b"1", ".notes/n.json": b"{}",
        "sub/x.bin": b"\xff\xfe", "empty.txt": b"", "a.b": b"dot", "a/b.py": b"b", "deep/er/still/down.txt": "ü".encode(),
    }
    for name, content in files.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(tmp_path / "root" / "a.b", tmp_path / "root" / "link.b")
    os.symlink(tmp_path / "root" / "deep", tmp_path / "root" / "linked")
    return str(tmp_path / "root"), files


def test_scan_workspaces(spark, tree):
    root, _ = tree
    roots = spark.createDataFrame([("r", root), ("uri", f"file://{root}")], "run_id string, root string")
    rows = workspaces.scan_workspaces(roots).collect()
    for run in ("r", "uri"):
        assert {r.path: r.content for r in rows if r.run_id == run} == {
            "a.py": "x = 1\n", "__init__.py": "", ".notes/n.json": "{}", "sub/x.bin": "", "empty.txt": "", "a.b": "dot",
            "a/b.py": "b", "deep/er/still/down.txt": "ü", "link.b": "dot",
        }


def test_contents_come_in_small_batches_without_python_text(tmp_path):
    """A worker held 16 million characters and their copies, at up to four bytes a character."""
    texts = ["é\r\n🙂\rx" * (100_000 + i) for i in range(8)]
    for i, text in enumerate(texts):
        (tmp_path / str(i)).write_bytes(text.encode())
    (tmp_path / "8").write_bytes(b"ok" * 1000 + b"\xc3\r\n\xa9")
    names = [str(i) for i in range(9)]
    listed = pa.RecordBatch.from_pydict({"run_id": ["r"] * 9, "root": [str(tmp_path)] * 9, "path": names})
    got = list(workspaces._contents(iter([listed])))
    assert max(b.column("content").nbytes for b in got) < workspaces._BATCH_BYTES + 1_300_000
    content = {r["path"]: r["content"] for b in got for r in b.to_pylist()}
    assert content == {str(i): t.replace("\r\n", "\n").replace("\r", "\n") for i, t in enumerate(texts)} | {"8": ""}


def test_scan_manifest_and_order(spark, tree):
    root, files = tree
    roots = spark.createDataFrame([("r", root), ("one", f"{root}/a.b")], "run_id string, root string")
    found = workspaces.scan_manifest(roots)
    assert {r.path: r.size for r in found.where("run_id = 'r'").collect()} == {p: len(c) for p, c in files.items()}
    assert [(r.path, r.size) for r in found.where("run_id = 'one'").collect()] == [("a.b", 3)]
    ordered = transfers.traversal_order(found.where("run_id = 'r'").withColumnRenamed("run_id", "transfer_id"))
    numbered = {r.path: r.ord for r in found.where("run_id = 'r'").collect()}
    assert sorted(numbered.values()) == list(range(len(files)))
    paths = [r.path for r in ordered.collect()]
    assert [numbered[p] for p in paths] == list(range(len(paths)))
    assert paths == sorted(files, key=lambda p: p.split("/"))
    assert paths.index("a/b.py") < paths.index("a.b")


def test_result_files_of_both_writers(spark, tmp_path):
    one = [{"task": "b", "score": 10.0, "tools_used": 3, "checks": {"x": True}}, {"task": "a", "score": 1.0, "tools_used": 1}]
    (tmp_path / "list.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "single.json").write_text(json.dumps({"task": "c", "score": 5.0, "tools": 9}, indent=2))
    rows = records.read_results(spark, str(tmp_path)).orderBy("task").collect()
    assert [(r.task, r.score, r.tools) for r in rows] == [("a", 1.0, 1), ("b", 10.0, 3), ("c", 5.0, 9)]
    assert rows[1].checks == {"x": True}


def test_run_log_lines(spark):
    lines = [
        "[12:30:01] TASK: rest_api (fresh restart)", "--- Iteration 3/10 ---", "Model (120 tok, 4.5s): hello",
        '  Tool: write_file({"path": "a.py"})', "Score: 41.2/100", "  ✓ has_json", "  ✗ has_get", "  Result: fine",
    ]
    rows = records.parse_run_log(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.kind for r in rows] == ["other", "iteration", "model", "tool", "score", "check", "check", "other"]
    assert (rows[0].ts_text, rows[0].message) == ("12:30:01", "TASK: rest_api (fresh restart)")
    assert (rows[1].iteration, rows[2].tokens, rows[2].seconds) == (3, 120, 4.5)
    assert (rows[3].tool, rows[3].arguments, rows[4].score) == ("write_file", '{"path": "a.py"}', 41.2)
    assert (rows[5].check, rows[5].passed, rows[6].check, rows[6].passed) == ("has_json", True, "has_get", False)


def test_keyed_vectors(spark):
    wide = spark.createDataFrame([(1, [1.0], [2.0])], "id int, layer_3 array<double>, layer_12 array<double>")
    rows = records.read_keyed_vectors(records.wide_to_keyed(wide)).orderBy("layer_idx").collect()
    assert [(r.layer_idx, r.vec) for r in rows] == [(3, [1.0]), (12, [2.0])]


def test_report_file_order(spark, tmp_path):
    scored = scoreboards.with_score(
        spark.createDataFrame(
            [("m1", "t1", 1.0, 0.75, True, True, True, 3, 4, 50, 7.0), ("m2", "t2", 0.0, 0.0, False, False, False, 1, 0, 5, 2.5)],
            "model string, task string, file_score double, check_score double, tests_pass boolean, code_runs boolean, "
            "agent_success boolean, iterations bigint, tool_calls bigint, total_tokens bigint, total_time double",
        )
    )
    path = str(tmp_path / "report")
    records.write_report(scoreboards.report_lines(scored), path)
    assert scoreboards.report_lines(scored, ["m1", "m2"]).collect() == scoreboards.report_lines(scored).collect()
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    lines = "".join(open(os.path.join(path, p), encoding="utf-8").read() for p in parts).splitlines()
    assert lines == [
        "# Agent Harness Benchmark Report", "", "## Summary", "", "| Task | m1 | m2 |", "|------|-----:|-----:|",
        "| t1 | 91.2 | - |", "| **Average** | **91.2** | **0.0** |", "", "## Detail", "",
        "### m1", "", "**t1** — 91.2/100", "- Checks: 75% | Tests: PASS", "- Iterations: 3 | Tool calls: 4 | Tokens: 50 | Time: 7s", "",
        "### m2", "", "**t2** — 0.0/100", "- Checks: 0% | Tests: FAIL", "- Iterations: 1 | Tool calls: 0 | Tokens: 5 | Time: 2s", "",
    ]


def test_scores(spark):
    row = spark.createDataFrame([(1.0, 0.75, False, None)], "file_score double, check_score double, tests_pass boolean, code_runs boolean")
    assert scoreboards.with_score(row).first().score == 41.2


def test_file_map_parts_make_the_whole(spark):
    """Parts as coarse as their bytes allow: 5,000 files of one run, ten of another, and one file too large for any part."""
    files = spark.range(5012).selectExpr(
        "CASE WHEN id < 5000 THEN 'hot' WHEN id < 5010 THEN 'cold' ELSE 'big' END AS run_id", "concat('f', id) AS path", "IF(id = 5010, repeat('é', 5000), IF(id = 7, NULL, repeat('x', 30))) AS content"
    )
    got = rules.file_map(files, most=2000).collect()
    for run, paths in (("hot", range(5000)), ("cold", range(5000, 5010)), ("big", range(5010, 5012))):
        parts = {r.part: r.files for r in got if r.run_id == run}
        assert len(parts) == sum(r.run_id == run for r in got)
        assert sorted(p for held in parts.values() for p in held) == sorted(f"f{i}" for i in paths)
        assert {len(p) for p in parts} == {{"hot": 3, "cold": 0, "big": 1}[run]} or run == "hot"
        for part, held in parts.items():
            assert all(hashlib.md5(p.encode()).hexdigest().startswith(part) for p in held)
            assert len(held) == 1 or sum(len((c or "").encode()) for c in held.values()) <= 2000
    assert [dict(r.files) for r in rules.file_map(files.where("run_id = 'cold'")).collect()] == [{f"f{i}": "x" * 30 for i in range(5000, 5010)}]



def test_empty_task_scores_one(spark):
    runs = spark.createDataFrame([("r", "none")], "run_id string, task string")
    files = spark.createDataFrame([("r", "a", "b")], "run_id string, path string, content string")
    assert rules.file_score(runs, rules.expected_matches(files, {"t": ["a"]})).first().file_score == 1.0
    scored = rules.check_score(runs, rules.check_files(files, {"t": {"c": [[("cs", "b")]]}})).first()
    assert (scored.check_score, scored.check_results) == (1.0, {})


def test_both_terms_must_hold_in_one_file(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "init only"), ("r", "b.py", "MKDIR only"), ("s", "c.py", "INIT and mkdir"), ("u", "d.py", "Makedirs"), ("v", "e.py", "os.makedirs")],
        "run_id string, path string, content string",
    )
    got = {r.run_id: r.passed for r in rules.check_files(files).where("check = 'has_init'").collect()}
    assert got == {"r": False, "s": True, "u": False, "v": True}


def test_user_check(spark):
    files = spark.createDataFrame([("r", "a.py", "xx")], "run_id string, path string, content string")
    checks = {"t": {"long": lambda path, content: F.length(content) > 1}}
    assert rules.check_files(files, checks).first().passed


def test_round_tenths_equals_python(spark):
    import random

    from agentlake.functions.numbers import round_tenths

    rng = random.Random(1)
    values = [0.25, 0.35, 0.45, 41.25, 65.95, 0.05, 100.0, 0.0, 2.675, 99.95] + [rng.randint(0, 2000) / 20 for _ in range(300)]
    values += [rng.random() * 100 for _ in range(300)] + [sum([x / 10] * 3) / 3 for x in range(0, 1000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", round_tenths(F.col("x")).alias("r")).collect():
        assert row.r == round(row.x, 1), row.x


def test_reports_hold_every_source_of_the_table(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "src2", "en", 10), (2, "src10", "en", 20), (3, "src20", "en", 30), (4, "a.b", "en", 40)], "doc_id bigint, source string, lang string, n_chars bigint"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 5)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    board = scoreboards.leaderboard(scoreboards.with_score(results(spark, str(tmp_path))))
    assert {tuple(r.models) for r in board.select(F.map_keys("scores").alias("models")).collect()} == {("a.b", "src2", "src10", "src20")}
    rows = rule_queries.report_lines(spark, str(tmp_path)).where("section = 3 AND task = '' AND line_no = 0").orderBy("model").collect()
    assert [r.line for r in rows] == ["### a.b", "### src2", "### src10", "### src20"]
