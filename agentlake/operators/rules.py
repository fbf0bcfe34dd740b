"""Declarative checks of produced files.

``files(run_id, path, content)`` holds one row per file. A check passes for a run
when one single file satisfies the whole rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The checks of each task. A check is a list of alternatives; an
# alternative is a list of (target, text) terms that must all hold for one file.
# Targets: "lc" lower-cased content, "cs" content as written, "path" the path.
CHECKS = {
    "static_site_generator": {
        "has_frontmatter_parsing": [[("lc", "yaml"), ("lc", "safe_load")]],
        "has_markdown_conversion": [[("lc", "markdown"), ("lc", "html")]],
        "has_index_generation": [[("lc", "index"), ("lc", "sort")]],
        "has_watch_flag": [[("lc", "watch"), ("lc", "observer")]],
        "has_tests": [[("path", "test_")], [("lc", "unittest")], [("lc", "pytest")]],
        "has_requirements": [[("path", "requirements")]],
        "has_argparse": [[("lc", "argparse")]],
    },
    "rest_api": {
        "has_sqlite": [[("cs", "sqlite3")]],
        "has_http_server": [[("cs", "http.server")], [("cs", "HTTPServer")]],
        "has_get": [[("cs", "GET")]],
        "has_post": [[("cs", "POST")]],
        "has_put": [[("cs", "PUT")]],
        "has_delete": [[("cs", "DELETE")]],
        "has_tests": [[("path", "test_")]],
        "has_json": [[("lc", "json")]],
    },
    "data_pipeline": {
        "has_csv_reading": [[("lc", "csv")]],
        "has_json_output": [[("cs", "json.dump")], [("cs", "json.dumps")]],
        "has_yaml_config": [[("path", "config"), ("path", "yaml")]],
        "has_error_handling": [[("cs", "try"), ("cs", "except")]],
        "has_normalization": [[("lc", "normaliz")], [("lc", "clean")]],
        "has_tests": [[("path", "test_")]],
    },
    "cli_tool": {
        "has_argparse_subparsers": [[("cs", "add_subparsers")], [("cs", "subparsers")]],
        "has_init": [[("lc", "init"), ("lc", "mkdir")], [("cs", "makedirs")]],
        "has_add": [[("lc", "add"), ("cs", "def ")], [("lc", "add"), ("lc", "add_parser")], [("lc", "add"), ("lc", "argparse")]],
        "has_list": [[("lc", "def list")], [("cs", "'list'")]],
        "has_search": [[("lc", "search")]],
        "has_delete": [[("lc", "delete")], [("lc", "remove")]],
        "has_json_storage": [[("cs", "json.dump")]],
        "has_tests": [[("path", "test_")]],
    },
    "algorithm_no_tools": {
        "has_heapq": [[("cs", "heapq")]],
        "has_heuristic": [[("lc", "heuristic")], [("lc", "manhattan")]],
        "has_diagonal": [[("lc", "diagonal")], [("cs", "8")]],
        "has_path_return": [[("lc", "path"), ("cs", "return")]],
        "has_obstacle_handling": [[("lc", "obstacle")], [("lc", "wall")], [("lc", "blocked")]],
        "has_tests": [[("path", "test_")]],
        "has_no_path_case": [[("lc", "no path")], [("lc", "none")], [("lc", "no solution")]],
    },
}

# Files each task is expected to produce.
EXPECTED_FILES = {
    "static_site_generator": ["parser.py", "renderer.py", "cli.py", "test_parser.py", "requirements.txt"],
    "rest_api": ["server.py", "database.py", "test_api.py"],
    "data_pipeline": ["pipeline.py", "config.yaml", "test_pipeline.py"],
    "cli_tool": ["notes.py", "test_notes.py"],
    "algorithm_no_tools": ["astar.py", "test_astar.py"],
}

# Task to check to rule; a rule may also be a function of the path and content Columns.
Checks = Mapping[str, Mapping[str, object]]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def filter_workspace_files(files: DataFrame) -> DataFrame:
    """Without files named ``.*`` or ``_exec_tmp*``; dot-directories stay."""
    name = basename(F.col("path"))
    return files.where(~name.startswith(".") & ~name.startswith("_exec_tmp"))


def classify_files(files: DataFrame) -> DataFrame:
    """Flags ``is_test`` and ``is_main``; ``test_`` may be anywhere in the path."""
    python = F.col("path").endswith(".py")
    test = F.col("path").contains("test_")
    return files.withColumn("is_test", python & test).withColumn("is_main", python & ~test)


def first_main_file(files: DataFrame) -> DataFrame:
    """The first main file of each run by path."""
    return classify_files(files).where("is_main").groupBy("run_id").agg(F.min("path").alias("path"))


def rule_column(rule, path: Column, content: Column, lowered: Column) -> Column:
    """A rule as a boolean Column; a callable rule builds its own from (path, content)."""
    if callable(rule):
        return F.coalesce(rule(path, content), F.lit(False))
    targets = {"path": path, "cs": content, "lc": lowered}
    clauses = [reduce(lambda a, b: a & b, [targets[t].contains(text) for t, text in clause]) for clause in rule]
    return F.coalesce(reduce(lambda a, b: a | b, clauses), F.lit(False))


def check_files(files: DataFrame, checks: Checks = CHECKS) -> DataFrame:
    """``(run_id, task, check, passed)`` for every check of every task.

    All checks are evaluated in one pass over each file's content; only booleans are
    shuffled, already combined per task, so a run with most of the files costs no
    more than others.
    """
    lowered = files.withColumn("_lc", F.lower("content"))
    flags = [
        (task, check, F.bool_or(rule_column(rule, F.col("path"), F.col("content"), F.col("_lc"))))
        for task, rules in checks.items()
        for check, rule in rules.items()
    ]
    wide = lowered.groupBy("run_id").agg(*[flag.alias(f"c{i}") for i, (_, _, flag) in enumerate(flags)])
    rows = [
        F.struct(F.lit(task).alias("task"), F.lit(check).alias("check"), F.col(f"c{i}").alias("passed"))
        for i, (task, check, _) in enumerate(flags)
    ]
    return wide.select("run_id", F.inline(F.array(*rows)))


def expected_matches(files: DataFrame, expected: Mapping[str, Sequence[str]] = EXPECTED_FILES) -> DataFrame:
    """``(run_id, task, pattern, found)``: is the pattern part of any path of the run?

    The patterns are code, so each file tests them all in place and only one row of
    booleans per run and task is shuffled; no file meets another file's row.
    """
    wanted = [(task, pattern) for task, patterns in expected.items() for pattern in patterns]
    wide = files.groupBy("run_id").agg(
        *[F.bool_or(F.col("path").contains(pattern)).alias(f"p{i}") for i, (_, pattern) in enumerate(wanted)]
    )
    rows = [
        F.struct(F.lit(task).alias("task"), F.lit(pattern).alias("pattern"), F.col(f"p{i}").alias("found"))
        for i, (task, pattern) in enumerate(wanted)
    ]
    return wide.select("run_id", F.inline(F.array(*rows)))


def expected_found(files: DataFrame, expected=EXPECTED_FILES) -> DataFrame:
    return expected_matches(files, expected).where("found").drop("found")


def missing_expected(files: DataFrame, expected=EXPECTED_FILES) -> DataFrame:
    return expected_matches(files, expected).where("NOT found").drop("found")


def _fraction(good: str) -> Column:
    count = F.count(good)
    return F.when(count == 0, F.lit(1.0)).otherwise(F.count_if(F.col(good)) / count)


def file_score(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """``(run_id, task, file_score)``; 1.0 where nothing is expected.

    ``runs(run_id, task)`` lists the runs to score, ``matches`` is
    ``expected_matches``.
    """
    joined = runs.join(matches, ["run_id", "task"], "left")
    return joined.groupBy("run_id", "task").agg(_fraction("found").alias("file_score"))


def check_score(runs: DataFrame, checked: DataFrame) -> DataFrame:
    """``(run_id, task, check_score, check_results)``; 1.0 where there are no checks."""
    joined = runs.join(checked, ["run_id", "task"], "left")
    entries = F.collect_list(F.when(F.col("check").isNotNull(), F.struct("check", "passed")))
    return joined.groupBy("run_id", "task").agg(
        _fraction("passed").alias("check_score"), F.map_from_entries(entries).alias("check_results")
    )


#: Bytes of content that a row of a file map may hold, and the hexadecimal digits of the finest parts.
PART_BYTES, PART_DIGITS = 64 << 20, 6


def file_map(files: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """``(run_id, part, files MAP<path, content>)``, every run in parts of at most ``most`` bytes of content.

    A run's parts are named by the first digits of its paths' MD5; it takes as few digits, 0
    to ``PART_DIGITS``, as bring every part below ``most``. So a small run is one row with the
    empty name, and a large one is cut as far as it needs; the union of the parts is the
    whole workspace. Only a file that is larger by itself makes a larger row.
    """
    sized = files.select("run_id", F.md5("path").alias("digest"), F.octet_length("content").cast("bigint").alias("bytes"))
    level = sized.groupBy("run_id", F.substring("digest", 1, PART_DIGITS).alias("p")).agg(
        F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")
    )
    fits = None
    for digits in range(PART_DIGITS, -1, -1):
        if digits < PART_DIGITS:
            level = level.groupBy("run_id", F.substring("p", 1, digits).alias("p")).agg(F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"))
        # A part that is one file too large for any part does not ask for more digits.
        crowded = F.max((F.col("bytes") > most) & (F.col("bytes") - F.col("largest") > 0))
        one = level.groupBy("run_id").agg(crowded.alias("crowded")).select("run_id", F.when(~F.coalesce("crowded", F.lit(False)), digits).alias("digits"))
        fits = one if fits is None else fits.unionByName(one)
    # One row per run.
    chosen = fits.groupBy("run_id").agg(F.coalesce(F.min("digits"), F.lit(PART_DIGITS)).alias("_digits"))
    cut = files.join(chosen, "run_id").withColumn("part", F.expr("substring(md5(path), 1, _digits)"))
    return cut.groupBy("run_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("files"))
