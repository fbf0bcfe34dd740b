"""Queries over produced files, scores and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import text as T
from agentlake.operators import lookups, rules, scoreboards, vectors
from agentlake.plans.registry import query
from agentlake.plans.tables import FILES_SQL, MANIFEST_SQL, RESULTS_SQL, files, manifest, results, table

# Rules in the words of the documents, next to the shipped ones.
DOCUMENT_CHECKS = {
    "prose": {
        "has_license": [[("lc", "license")]],
        "has_the_and": [[("lc", "the"), ("lc", "and")]],
        "has_der_or_die": [[("cs", "der")], [("cs", "die")]],
        "is_french": [[("path", "fr/")]],
    },
}
DOCUMENT_FILES = {"prose": ["en/1", "de/", "zz/"], "nothing": []}
ALL_CHECKS = {**rules.CHECKS, **DOCUMENT_CHECKS}
ALL_FILES = {**rules.EXPECTED_FILES, **DOCUMENT_FILES}


def _term(target, text):
    column = {"path": "path", "cs": "content", "lc": "lower(content)"}[target]
    return f"contains({column}, '{text.replace(chr(39), chr(39) * 2)}')"


def _rule_sql(rule):
    return " OR ".join("(" + " AND ".join(_term(*term) for term in clause) + ")" for clause in rule)


CHECKED_SQL = "checked AS (" + " UNION ALL ".join(
    f"SELECT run_id, '{task}' AS task, '{check}' AS \"check\", bool_or({_rule_sql(rule)}) AS passed FROM files GROUP BY run_id"
    for task, group in ALL_CHECKS.items()
    for check, rule in group.items()
) + ")"
EXPECTED_SQL = "expected AS (" + " UNION ALL ".join(
    f"SELECT '{task}' AS task, '{pattern}' AS pattern" for task, patterns in ALL_FILES.items() for pattern in patterns
) + "), runs AS (SELECT DISTINCT run_id FROM files)"
TASKS_SQL = "tasks AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in [*ALL_CHECKS, "nothing"]) + "]) AS task)"


@query(f"WITH {MANIFEST_SQL} SELECT transfer_id, path FROM manifest WHERE path NOT LIKE '%\\_test\\_.py' ESCAPE '\\'")
def filter_workspace_files(spark, sf_dir):
    """Test files take the place of scratch files, dot-files that of binaries."""
    renamed = manifest(spark, sf_dir).withColumn(
        "_own", F.col("path")
    ).withColumn("path", F.expr("""CASE WHEN path LIKE '%.bin' THEN concat('.d/', path)
        WHEN endswith(path, '_test_.py') AND size % 2 = 0 THEN concat(path, '/.hidden')
        WHEN endswith(path, '_test_.py') THEN concat(path, '/_exec_tmp.py') ELSE path END"""))
    return rules.filter_workspace_files(renamed).select("transfer_id", F.col("_own").alias("path"))


@query(f"""WITH {MANIFEST_SQL} SELECT transfer_id, path, contains(path, 'test_') AND suffix(path, '.py') AS is_test,
  NOT contains(path, 'test_') AND suffix(path, '.py') AS is_main FROM manifest""")
def classify_files(spark, sf_dir):
    return rules.classify_files(manifest(spark, sf_dir)).select("transfer_id", "path", "is_test", "is_main")


@query(f"""WITH {MANIFEST_SQL} SELECT transfer_id AS run_id, min(path) AS path FROM manifest
WHERE NOT contains(path, 'test_') AND suffix(path, '.py') GROUP BY transfer_id""")
def first_main_file(spark, sf_dir):
    return rules.first_main_file(manifest(spark, sf_dir).withColumnRenamed("transfer_id", "run_id"))


@query("""SELECT page_id, c AS command, regexp_matches(c, '^(pip install|ls|tree|cat|wc|find|head)') AS allowed,
  CASE WHEN NOT regexp_matches(c, '^(pip install|ls|tree|cat|wc|find|head)') THEN
    'ERROR: Command not allowed. Allowed: [''pip install'', ''ls'', ''tree'', ''cat'', ''wc'', ''find'', ''head'']' END AS error
FROM (SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN 'cat ' WHEN 1 THEN 'rm ' WHEN 2 THEN 'catfoo ' ELSE '' END, url) AS c FROM pages)""")
def prefix_allowlist(spark, sf_dir):
    commands = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat(CASE page_id % 4 WHEN 0 THEN 'cat ' WHEN 1 THEN 'rm ' WHEN 2 THEN 'catfoo ' ELSE '' END, url) AS command"
    )
    padded = F.concat(F.lit(" \t"), F.col("command"), F.lit("\n"))
    checked = commands.withColumn("allowed", T.allowed_command(padded))
    return checked.withColumn("error", F.when(~F.col("allowed"), F.lit(T.command_rejection())))


@query(f"WITH {FILES_SQL}, {CHECKED_SQL} SELECT * FROM checked")
def check_rules(spark, sf_dir):
    return rules.check_files(files(spark, sf_dir), ALL_CHECKS)


@query(f"""WITH {FILES_SQL}, {EXPECTED_SQL}
SELECT run_id, task, pattern FROM runs, expected
WHERE EXISTS (SELECT 1 FROM files f WHERE f.run_id = runs.run_id AND contains(f.path, pattern))""")
def expected_file_match(spark, sf_dir):
    return rules.expected_found(files(spark, sf_dir), ALL_FILES)


@query(f"""WITH {FILES_SQL}, {EXPECTED_SQL}
SELECT run_id, task, pattern FROM runs, expected
WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.run_id = runs.run_id AND contains(f.path, pattern))""")
def missing_expected(spark, sf_dir):
    return rules.missing_expected(files(spark, sf_dir), ALL_FILES)


def _runs(frame, tasks):
    names = F.array(*[F.lit(t) for t in tasks])
    return frame.select("run_id").distinct().select("run_id", F.explode(names).alias("task"))


@query(f"""WITH {FILES_SQL}, {EXPECTED_SQL}, {TASKS_SQL}, hits AS (
  SELECT run_id, task, bool_or(contains(path, pattern)) AS found FROM files, expected GROUP BY run_id, task, pattern)
SELECT run_id, task, CASE WHEN count(found) = 0 THEN 1.0::DOUBLE ELSE round(count_if(found) / count(found)::DOUBLE, 6) END AS file_score
FROM runs CROSS JOIN tasks LEFT JOIN hits USING (run_id, task) GROUP BY run_id, task""")
def file_score(spark, sf_dir):
    produced = files(spark, sf_dir)
    scored = rules.file_score(_runs(produced, [*ALL_CHECKS, "nothing"]), rules.expected_matches(produced, ALL_FILES))
    return scored.withColumn("file_score", F.round("file_score", 6))


@query(f"""WITH {FILES_SQL}, {CHECKED_SQL}, {TASKS_SQL}, runs AS (SELECT DISTINCT run_id FROM files)
SELECT run_id, task, CASE WHEN count(passed) = 0 THEN 1.0::DOUBLE ELSE round(count_if(passed) / count(passed)::DOUBLE, 6) END AS check_score,
  coalesce(string_agg("check" || '=' || passed, ',' ORDER BY "check"), '') AS check_results
FROM runs CROSS JOIN tasks LEFT JOIN checked USING (run_id, task) GROUP BY run_id, task""")
def check_score(spark, sf_dir):
    produced = files(spark, sf_dir)
    scored = rules.check_score(_runs(produced, [*ALL_CHECKS, "nothing"]), rules.check_files(produced, ALL_CHECKS))
    listed = F.array_sort(F.transform(F.map_entries("check_results"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return scored.withColumn("check_score", F.round("check_score", 6)).withColumn("check_results", F.array_join(listed, ","))


#: Bytes of a part in the query below, so that runs of a small table have several.
_PART = 64 << 10


@query(f"""WITH {FILES_SQL}, sized AS (SELECT run_id, md5(path) AS d, content, octet_length(encode(content)) AS n FROM files),
levels AS (SELECT run_id, k, substr(d, 1, k) AS p, sum(n) AS total, max(n) AS largest FROM sized, (SELECT unnest(range(0, 7)) AS k) GROUP BY ALL),
fits AS (SELECT run_id, k, coalesce(bool_or(total > {_PART} AND total > largest), false) AS crowded FROM levels GROUP BY ALL),
chosen AS (SELECT run_id, coalesce(min(k) FILTER (WHERE NOT crowded), 6) AS k FROM fits GROUP BY run_id)
SELECT run_id, substr(d, 1, k) AS part, count(*) AS n_files, CAST(sum(length(content)) AS BIGINT) AS chars FROM sized JOIN chosen USING (run_id) GROUP BY ALL""")
def file_map(spark, sf_dir):
    mapped = rules.file_map(files(spark, sf_dir), _PART)
    total = F.aggregate(F.map_values("files"), F.lit(0).cast("bigint"), lambda acc, c: acc + F.length(c))
    return mapped.select("run_id", "part", F.size("files").cast("bigint").alias("n_files"), total.alias("chars"))


@query(f"WITH {RESULTS_SQL} SELECT model, task, score FROM scored")
def overall_score(spark, sf_dir):
    return scoreboards.with_score(results(spark, sf_dir)).select("model", "task", "score")


#: Models in the order of a board, and the tasks of the first.
BOARD_SQL = """models AS (SELECT model, row_number() OVER (ORDER BY length(model), model) AS place FROM scored WHERE model IS NOT NULL GROUP BY model),
  first AS (SELECT DISTINCT task FROM scored JOIN models USING (model) WHERE place = 1),
  cells AS (SELECT task, model, any_value(place) AS place, coalesce(CAST(max(score) AS VARCHAR), '-') AS score
    FROM first CROSS JOIN models LEFT JOIN scored USING (task, model) GROUP BY task, model)"""


def _mean(condition="true"):
    """Mean score in SQL, summed in tenths; NULL without scores."""
    return f"(sum(CAST(round_even(score * 10, 0) AS BIGINT)) FILTER (WHERE {condition}) / 10.0::DOUBLE / count(score) FILTER (WHERE {condition}))"


def _one_decimal(x):
    """One decimal decided on the exact binary value, as text."""
    k = f"round_even({x} * 20, 0)"
    short = f"(({k} - {x} * 16) - {x} * 4)"
    return f"""printf('%.1f', CASE WHEN {k} % 2 = 0 THEN {k} / 2 WHEN {short} > 0 THEN ({k} - 1) / 2 WHEN {short} < 0 THEN ({k} + 1) / 2
      WHEN (({k} - 1) / 2) % 2 = 0 THEN ({k} - 1) / 2 ELSE ({k} + 1) / 2 END / 10)"""



@query(f"WITH {RESULTS_SQL}, {BOARD_SQL} SELECT task, model, score FROM cells")
def leaderboard(spark, sf_dir):
    board = scoreboards.leaderboard(scoreboards.with_score(results(spark, sf_dir)))
    return board.select("task", F.explode("scores").alias("model", "score"))


@query(f"""WITH {RESULTS_SQL}
SELECT model, round(coalesce({_mean("task IN (SELECT task FROM scored WHERE model = 'src0')")}, 0), 6) AS average,
  count(CASE WHEN task IN (SELECT task FROM scored WHERE model = 'src0') THEN score END) AS tasks
FROM scored GROUP BY model""")
def model_average(spark, sf_dir):
    average = scoreboards.model_average(scoreboards.with_score(results(spark, sf_dir)), "src0")
    return average.withColumn("average", F.round("average", 6))


@query(f"""WITH {RESULTS_SQL}, grouped AS (
  SELECT model, grouping(task) AS is_average, CASE WHEN grouping(task) = 1 THEN 'AVERAGE' ELSE task END AS task, {_mean()} AS score,
    max(iterations) AS iterations, max(total_time) AS total_time, bool_or(tests_pass) AS tests_pass
  FROM scored GROUP BY GROUPING SETS ((model, task), (model)))
SELECT model, CAST(is_average AS INT) AS is_average, task,
  concat(rpad(task, 35, ' '), ' ', lpad({_one_decimal('score')}, 5, ' '), '/100',
    CASE WHEN is_average = 1 THEN '' ELSE concat(' ', lpad(iterations::VARCHAR, 6, ' '), ' ',
      CASE WHEN length(t) >= 5 THEN t ELSE lpad(t, 5, ' ') END, 's ', lpad(CASE WHEN tests_pass THEN '✓' ELSE '✗' END, 5, ' ')) END) AS line
FROM (SELECT *, CAST(CAST(round_even(total_time, 0) AS BIGINT) AS VARCHAR) AS t FROM grouped)""")
def run_summary(spark, sf_dir):
    summary = scoreboards.run_summary(scoreboards.with_score(results(spark, sf_dir)))
    return summary.withColumn("is_average", F.col("is_average").cast("int"))


@query(f"""WITH {RESULTS_SQL}, {BOARD_SQL},
means AS (SELECT place, coalesce({_mean("task IN (SELECT task FROM first)")}, 0) AS mean FROM models LEFT JOIN scored USING (model) GROUP BY place),
details AS (SELECT scored.*, place FROM scored JOIN models USING (model)), lines AS (
SELECT 0 AS section, 0 AS model, '' AS task, 0 AS line_no, '# Agent Harness Benchmark Report' AS line
UNION ALL SELECT 0, 0, '', 1, '' UNION ALL SELECT 0, 0, '', 2, '## Summary' UNION ALL SELECT 0, 0, '', 3, ''
UNION ALL SELECT 0, 0, '', 4, concat('| Task |', string_agg(concat(' ', model[:20], ' '), '|' ORDER BY place), '|') FROM models
UNION ALL SELECT 0, 0, '', 5, concat('|------|', string_agg('-----:', '|'), '|') FROM models
UNION ALL SELECT 1, 0, task, 0, concat('| ', task, ' |', string_agg(concat(' ', score, ' |'), '' ORDER BY place)) FROM cells GROUP BY task
UNION ALL SELECT 2, 0, '', 0, concat('| **Average** |', string_agg(concat(' **', {_one_decimal('mean')}, '** |'), '' ORDER BY place)) FROM means
UNION ALL SELECT 2, 0, '', 1, '' UNION ALL SELECT 2, 0, '', 2, '## Detail' UNION ALL SELECT 2, 0, '', 3, ''
UNION ALL SELECT 3, place, '', 0, concat('### ', model) FROM models UNION ALL SELECT 3, place, '', 1, '' FROM models
UNION ALL SELECT 3, place, task, 0, concat('**', task, '** — ', score, '/100') FROM details
UNION ALL SELECT 3, place, task, 1, concat('- Checks: ', CAST(round_even(check_score * 100, 0) AS BIGINT), '% | Tests: ', CASE WHEN tests_pass THEN 'PASS' ELSE 'FAIL' END) FROM details
UNION ALL SELECT 3, place, task, 2, concat('- Iterations: ', iterations, ' | Tool calls: ', tool_calls, ' | Tokens: ', total_tokens,
   ' | Time: ', CAST(round_even(total_time, 0) AS BIGINT), 's') FROM details
UNION ALL SELECT 3, place, task, 3, '' FROM details)
SELECT CAST(section AS INT) AS section, CAST(model AS INT) AS model, task, CAST(line_no AS INT) AS line_no, line FROM lines""")
def report_lines(spark, sf_dir):
    return scoreboards.report_lines(scoreboards.with_score(results(spark, sf_dir)))


@query(f"""WITH {RESULTS_SQL}
SELECT model, task, score, tool_calls AS tools, task = 'en' AS fresh FROM scored""")
def union_results(spark, sf_dir):
    scored = scoreboards.with_score(results(spark, sf_dir)).select("model", "task", "score", "tool_calls")
    kept = scored.where("task <> 'en'").withColumnRenamed("tool_calls", "tools_used")
    fresh = scored.where("task = 'en'").withColumnRenamed("tool_calls", "tools").withColumn("fresh", F.lit(True))
    union = scoreboards.union_results(kept, fresh)
    return union.withColumn("fresh", F.coalesce("fresh", F.lit(False)))


PHRASES = ["license", "copyright", "lorem"]


@query("""SELECT lang, CAST(count_if(f) AS BIGINT) AS flagged, count(*) AS responses, round(avg(CAST(f AS INT)), 6) AS rate
FROM (SELECT lang, contains(lower(text), 'license') OR contains(lower(text), 'copyright') OR contains(lower(text), 'lorem') AS f FROM documents) GROUP BY lang""")
def phrase_rate(spark, sf_dir):
    rates = vectors.phrase_rate(table(spark, sf_dir, "documents"), ["lang"], T.flag_phrases(F.col("text"), PHRASES))
    return rates.withColumn("rate", F.round("rate", 6))


@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def contained_in(spark, sf_dir):
    """Benchmark passages inside documents, without comparing every pair."""
    patterns = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lookups.contained_in(patterns, texts, "passage", "text", "item_id", "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('Lookup FAILED: ', text) ELSE text END AS text FROM documents
WHERE NOT contains(lower(CASE WHEN doc_id % 5 = 0 THEN concat('Lookup FAILED: ', text) ELSE text END), 'failed') AND length(text) > 0""")
def skip_failed_lookup(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 5 = 0 THEN concat('Lookup FAILED: ', text) ELSE text END AS text"
    )
    return lookups.skip_failed_lookup(answers)


@query("""WITH p AS (SELECT doc_id, CASE WHEN toxic = 1 THEN concat('Lookup FAILED: ', text) ELSE text END AS text
  FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
s AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
fp AS (SELECT * FROM p WHERE length(text) > 0 AND NOT contains(lower(text), 'failed')),
fs AS (SELECT doc_id, concat('[Context7]', chr(10), text) AS text FROM s WHERE length(text) > 0 AND NOT contains(lower(text), 'failed'))
SELECT doc_id, CASE WHEN fp.text IS NULL AND fs.text IS NULL THEN concat('No documentation found for ''', source, ''' - ''', lang, '''')
  ELSE concat_ws(chr(10) || chr(10), fp.text, fs.text) END AS answer
FROM documents LEFT JOIN fp USING (doc_id) LEFT JOIN fs USING (doc_id)""")
def lookup_docs(spark, sf_dir):
    """Documents as first source, whole conversations as second."""
    documents = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1")
    primary = documents.join(good, "doc_id").selectExpr(
        "doc_id", "CASE WHEN toxic = 1 THEN concat('Lookup FAILED: ', text) ELSE text END AS text"
    )
    secondary = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY turn)").alias("text")
    )
    requests = documents.selectExpr("doc_id", "source AS library", "lang AS topic")
    return lookups.lookup_docs(requests, primary, secondary, "doc_id").select("doc_id", "answer")
