"""Leaderboards and reports over ``results(model, task, ..., score)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.functions.numbers import SCORE_WEIGHTS, overall_score, round_tenths


def _padded(value: Column, width: int) -> Column:
    return F.when(F.length(value) >= width, value).otherwise(F.lpad(value, width, " "))


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", round_tenths(value))


def _mean_score(column: str = "score") -> Column:
    """Mean of scores with one decimal; summed in tenths, so no order of rows matters."""
    score = F.col(f"`{column}`")
    return F.sum(F.rint(score * 10).cast("bigint")) / F.lit(10.0) / F.count(score)


def with_score(results: DataFrame) -> DataFrame:
    present = {name: F.col(name) for name in SCORE_WEIGHTS if name in results.columns}
    return results.withColumn("score", overall_score(**present))


def union_results(*runs: DataFrame) -> DataFrame:
    """Results of both writers: ``tools_used`` and ``tools`` become ``tools``."""
    whole = runs[0]
    for other in runs[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    names = [c for c in ("tools_used", "tools") if c in whole.columns]
    if not names:
        return whole
    tools = F.coalesce(*[F.col(c) for c in names])
    return whole.withColumn("_tools", tools).drop(*names).withColumnRenamed("_tools", "tools")


def _tasks_of(scored: DataFrame, model: str) -> DataFrame:
    return scored.where(F.col("model") == model).select("task").distinct()


def model_names(scored: DataFrame, models: Sequence[str] | None = None) -> Column:
    """The models of a board in their order, as one array of names.

    Without ``models`` those of the table, shorter names first, then by name. A subquery
    finds them when the board runs, so its plan does not depend on how many there are.
    """
    if models is not None:
        return F.array(*[F.lit(m) for m in models]).cast("array<string>")
    distinct = scored.where("model IS NOT NULL").select("model").distinct()
    named = F.array_sort(F.collect_list(F.struct(F.length("model").alias("n"), F.col("model"))))
    return distinct.agg(named.alias("named")).select(F.col("named.model")).scalar()


def leaderboard(scored: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """``task, scores``: a map of every model's score text, ``-`` where it lacks the task.

    Only tasks of the first model appear. The map has the given models, or all of the
    table, in their order.
    """
    names = model_names(scored, models)
    return _score_grid(scored, names).select("task", F.map_from_arrays("names", _cells()).alias("scores"))


def _cells() -> Column:
    return F.transform("names", lambda m: F.coalesce(F.col("scores")[m].cast("string"), F.lit("-")))


def _score_grid(scored: DataFrame, names: Column) -> DataFrame:
    """``task, scores, names``: the scores by model, for the tasks the first model has, and the models."""
    best = scored.where("model IS NOT NULL AND score IS NOT NULL").groupBy("task", "model").agg(F.max("score").alias("score"))
    grid = best.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("model", "score"))).alias("scores"))
    # Subqueries cannot stand inside transform, so the names are a column first.
    return grid.withColumn("names", names).where(F.map_contains_key("scores", F.get("names", F.lit(0))))


def model_average(scored: DataFrame, first_model: str | None = None) -> DataFrame:
    """Mean score per model over its tasks, or over those the first model has too."""
    models = scored.select("model", "task", "score")
    if first_model is not None:
        shared = _tasks_of(scored, first_model).withColumn("_shared", F.lit(True))
        models = models.join(shared, "task", "left").withColumn("score", F.when(F.col("_shared"), F.col("score")))
    return models.groupBy("model").agg(
        F.coalesce(_mean_score(), F.lit(0.0)).alias("average"), F.count("score").alias("tasks")
    )


def run_summary(scored: DataFrame) -> DataFrame:
    """Fixed-width table lines per model: one per task, then the average.

    ``(model, is_average, task, line)`` from one pass with grouping sets.
    """
    grouped = scored.groupingSets(
        [[F.col("model"), F.col("task")], [F.col("model")]], F.col("model"), F.col("task")
    ).agg(
        F.grouping("task").alias("is_average"),
        _mean_score().alias("score"),
        F.max("iterations").alias("iterations"),
        F.max("total_time").alias("total_time"),
        F.bool_or("tests_pass").alias("tests_pass"),
    )
    name = F.when(F.col("is_average") == 1, F.lit("AVERAGE")).otherwise(F.col("task"))
    left = F.when(F.length(name) >= 35, name).otherwise(F.rpad(name, 35, " "))
    score = F.concat(_padded(_one_decimal(F.col("score")), 5), F.lit("/100"))
    detail = F.concat(
        F.lit(" "),
        _padded(F.col("iterations").cast("string"), 6),
        F.lit(" "),
        _padded(F.bround("total_time", 0).cast("bigint").cast("string"), 5),
        F.lit("s "),
        _padded(F.when(F.col("tests_pass"), "✓").otherwise("✗"), 5),
    )
    line = F.concat(left, F.lit(" "), score, F.when(F.col("is_average") == 1, F.lit("")).otherwise(detail))
    return grouped.select("model", "is_average", name.alias("task"), line.alias("line"))


def report_lines(scored: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """The comparison report as ordered rows ``(section, model, task, line_no, line)``.

    Of the given models, or of all of the table. Needs the evaluation columns next to
    ``score``. The order of lines is the order of the four key columns; ``section`` 0 is
    the heading, 1 the grid, 2 the averages and the next heading, 3 the details per model.
    The share of passed checks is labelled as such.
    """
    one = scored.sparkSession.range(1)
    names = model_names(scored, models)
    place = F.array_position(names, F.col("model"))
    shown = scored.where("model IS NOT NULL" if models is None else place > 0)

    def lines(frame, section, model, task, texts):
        rows = [F.struct(F.lit(i).alias("line_no"), t.alias("line")) for i, t in enumerate(texts)]
        return frame.select(
            F.lit(section).alias("section"), model.cast("int").alias("model"), task.alias("task"), F.inline(F.array(*rows))
        )

    one = one.select(names.alias("names"))
    heads = F.array_join(F.transform("names", lambda m: F.concat(F.lit(" "), F.left(m, F.lit(20)), F.lit(" "))), "|")
    rules = F.array_join(F.transform("names", lambda m: F.lit("-----:")), "|")
    heading = lines(
        one,
        0,
        F.lit(0),
        F.lit(""),
        [
            *[F.lit(text) for text in ("# Agent Harness Benchmark Report", "", "## Summary", "")],
            F.concat(F.lit("| Task |"), heads, F.lit("|")),
            F.concat(F.lit("|------|"), rules, F.lit("|")),
        ],
    )
    grid = _score_grid(scored, names)
    cells = F.array_join(F.transform(_cells(), lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), "")
    table = lines(grid, 1, F.lit(0), F.col("task"), [F.concat(F.lit("| "), F.col("task"), F.lit(" |"), cells)])

    of_models = grid.select(F.explode("scores").alias("model", "score")).groupBy("model").agg(_mean_score().alias("mean"))
    averages = of_models.agg(F.map_from_entries(F.collect_list(F.struct("model", "mean"))).alias("means")).withColumn("names", names)
    mean = F.transform("names", lambda m: F.coalesce(F.col("means")[m], F.lit(0.0)))
    cells = F.array_join(F.transform(mean, lambda x: F.concat(F.lit(" **"), _one_decimal(x), F.lit("** |"))), "")
    after = [F.lit(""), F.lit("## Detail"), F.lit("")]
    average = lines(averages, 2, F.lit(0), F.lit(""), [F.concat(F.lit("| **Average** |"), cells), *after])

    known = one.select(F.posexplode("names").alias("at", "model"))
    title = [F.concat(F.lit("### "), F.col("model")), F.lit("")]
    titles = lines(known, 3, F.col("at") + 1, F.lit(""), title)
    checks = F.bround(F.col("check_score") * 100, 0).cast("bigint").cast("string")
    detail = lines(
        shown,
        3,
        place,
        F.col("task"),
        [
            F.concat(F.lit("**"), F.col("task"), F.lit("** — "), F.col("score").cast("string"), F.lit("/100")),
            F.concat(
                F.lit("- Checks: "), checks, F.lit("% | Tests: "), F.when(F.col("tests_pass"), "PASS").otherwise("FAIL")
            ),
            F.concat(
                F.lit("- Iterations: "),
                F.col("iterations").cast("string"),
                F.lit(" | Tool calls: "),
                F.col("tool_calls").cast("string"),
                F.lit(" | Tokens: "),
                F.col("total_tokens").cast("string"),
                F.lit(" | Time: "),
                F.bround("total_time", 0).cast("bigint").cast("string"),
                F.lit("s"),
            ),
            F.lit(""),
        ],
    )
    return heading.unionByName(table).unionByName(average).unionByName(titles).unionByName(detail)
