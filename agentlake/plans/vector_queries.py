"""Queries over embeddings and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import vectors as V
from agentlake.operators import vectors
from agentlake.plans.registry import query
from agentlake.plans.tables import table


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def cells(df, vec):
    """Vectors as rounded cells, so the SQL twin can compare them."""
    rest = [c for c in df.columns if c != vec]
    out = df.select(*rest, F.posexplode(vec).alias("pos", "x"))
    return out.withColumn("pos", F.col("pos").cast("bigint")).withColumn("x", F.round("x", 6) + F.lit(0.0))


CELLS_SQL = """cells AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY ALL)"""


@query(f"WITH {CELLS_SQL} SELECT label, pos, round(m, 6) + 0.0::DOUBLE AS x FROM means")
def class_mean_vector(spark, sf_dir):
    return cells(vectors.class_mean_vector(embeddings(spark, sf_dir), ["label"], "vec"), "mean")


@query(f"""WITH {CELLS_SQL} SELECT vec_id, round(sum(x * m), 6) AS dot, round(sqrt(sum(x * x)), 6) AS norm
FROM cells JOIN means USING (label, pos) GROUP BY vec_id""")
def vec_dot_norm(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    joined = rows.join(vectors.class_mean_vector(rows, ["label"], "vec"), "label")
    return joined.select(
        "vec_id", F.round(V.dot(F.col("vec"), F.col("mean")), 6).alias("dot"), F.round(V.norm(F.col("vec")), 6).alias("norm")
    )


# Even vectors against odd ones within each label.
CONTRAST_SQL = f"""{CELLS_SQL}, gaps AS (
  SELECT label, pos, avg(CASE WHEN vec_id % 2 = 0 THEN x END) - avg(CASE WHEN vec_id % 2 = 1 THEN x END) AS d FROM cells GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(d * d)) AS norm FROM gaps GROUP BY label),
directions AS (SELECT label, pos, d / norm AS d, norm FROM gaps JOIN norms USING (label) WHERE norm > 0.01)"""


def directions(spark, sf_dir):
    return vectors.contrast_direction(embeddings(spark, sf_dir), ["label"], F.col("vec_id") % 2 == 0, "vec")


@query(f"WITH {CONTRAST_SQL} SELECT label, round(norm, 6) AS norm, pos, round(d, 6) + 0.0::DOUBLE AS x FROM directions WHERE label >= 2 AND label < 8")
def contrast_direction(spark, sf_dir):
    inner = vectors.inner_keys(directions(spark, sf_dir), "label", 10)
    return cells(inner.withColumn("norm", F.round("norm", 6)), "direction")


@query(f"""WITH {CONTRAST_SQL} SELECT label, round(norm, 6) AS norm FROM norms WHERE norm > 0.1""")
def min_norm(spark, sf_dir):
    long = vectors.min_norm_filter(directions(spark, sf_dir), 0.1)
    return long.select("label", F.round("norm", 6).alias("norm"))


@query(f"""WITH {CONTRAST_SQL}, p AS (SELECT vec_id, sum(x * d) AS projection FROM cells JOIN directions USING (label, pos) GROUP BY vec_id)
SELECT vec_id, label, round(projection, 6) AS projection, pos, round(x - projection * d, 6) + 0.0::DOUBLE AS x
FROM cells JOIN directions USING (label, pos) JOIN p USING (vec_id)""")
def reject_direction(spark, sf_dir):
    rejected = vectors.reject_direction(embeddings(spark, sf_dir), directions(spark, sf_dir), ["label"], "vec")
    return cells(rejected.drop("vec").withColumn("projection", F.round("projection", 6)), "rejected")


@query(f"WITH {CELLS_SQL} SELECT vec_id, pos, round(x * (label + 0.5::DOUBLE), 6) + 0.0::DOUBLE AS x FROM cells")
def scale_vector(spark, sf_dir):
    scaled = embeddings(spark, sf_dir).select("vec_id", V.scale(F.col("vec"), F.col("label") + F.lit(0.5)).alias("v"))
    return cells(scaled, "v")


RMS_SQL = f"""WITH {CELLS_SQL}, n AS (SELECT vec_id, 1 / sqrt(avg(x * x) + 1e-6::DOUBLE) AS f FROM cells GROUP BY vec_id)
SELECT vec_id, pos, round(x * f * (1 + pos / 64::DOUBLE), 6) + 0.0::DOUBLE AS x FROM cells JOIN n USING (vec_id)"""


def weights(size):
    """A gain per position, rising from 1."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lit(1.0) + i / F.lit(64.0))


@query(RMS_SQL)
def rms_normalize(spark, sf_dir):
    vec = F.col("vec")
    return cells(embeddings(spark, sf_dir).select("vec_id", V.rms_normalize(vec, weights(F.size(vec)), 1e-6).alias("v")), "v")


@query(RMS_SQL)
def rms_normalize_sharded(spark, sf_dir):
    whole = embeddings(spark, sf_dir).withColumn("weight", weights(F.size("vec")))
    shards = whole.select("vec_id", "vec", "weight", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shard")).selectExpr(
        "vec_id", "shard", "slice(vec, shard * 16 + 1, 16) AS part", "slice(weight, shard * 16 + 1, 16) AS weight"
    )
    out = cells(vectors.rms_normalize_sharded(shards, 1e-6).select("vec_id", "shard", "normalized"), "normalized")
    return out.select("vec_id", (F.col("shard") * 16 + F.col("pos")).alias("pos"), "x")


@query(f"WITH {CELLS_SQL} SELECT vec_id, pos, round(x * (1 + pos // 24 + label), 6) + 0.0::DOUBLE AS x FROM cells")
def block_scale(spark, sf_dir):
    """Blocks of 24, so the last one is ragged."""
    scales = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i + 1 + F.col("label")).cast("double"))
    scaled = embeddings(spark, sf_dir).select("vec_id", V.block_scale(F.col("vec"), scales, 24).alias("v"))
    return cells(scaled, "v")


TOPK_SQL = f"""WITH {CELLS_SQL}, e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM cells),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, pos) - 1 AS r FROM e)
SELECT vec_id, CAST(r AS BIGINT) AS rank, pos AS idx, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS weight FROM r WHERE r < 8"""


@query(TOPK_SQL)
def vector_topk(spark, sf_dir):
    best = vectors.vector_topk(embeddings(spark, sf_dir), "vec", 8)
    return best.select("vec_id", F.col("rank").cast("bigint").alias("rank"), F.col("idx").cast("bigint").alias("idx"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {CELLS_SQL}, s AS (SELECT *, 1 / (1 + exp(-x)) AS s FROM cells),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s + pos / 640::DOUBLE DESC, pos) - 1 AS r FROM s)
SELECT vec_id, CAST(r AS BIGINT) AS rank, pos AS idx, round(s / (sum(s) OVER (PARTITION BY vec_id) + 1e-20::DOUBLE), 6) AS weight FROM r WHERE r < 8""")
def vector_topk_sigmoid(spark, sf_dir):
    bias = F.transform(F.sequence(F.lit(0), F.size("vec") - 1), lambda i: i / F.lit(640.0))
    best = vectors.vector_topk(embeddings(spark, sf_dir), "vec", 8, mode="sigmoid", bias=bias)
    return best.select("vec_id", F.col("rank").cast("bigint").alias("rank"), F.col("idx").cast("bigint").alias("idx"), F.round("weight", 6).alias("weight"))


TRIALS_SQL = "trials AS (SELECT event_type AS study, user_id AS trial, avg(value) / 997 AS a, count(*) / CAST(200 AS DOUBLE) AS b FROM events GROUP BY ALL)"


def trials(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("study"), F.col("user_id").alias("trial")).agg(
        (F.avg("value") / 997).alias("a"), (F.count(F.lit(1)) / F.lit(200.0)).alias("b")
    )


@query(f"WITH {TRIALS_SQL} SELECT study, trial, round(0.7 * a + 0.3 * b, 6) AS score FROM trials")
def trial_score(spark, sf_dir):
    scored = vectors.trial_scores(trials(spark, sf_dir), {"a": 0.7, "b": 0.3})
    return scored.select("study", "trial", F.round("score", 6).alias("score"))


@query(f"""WITH {TRIALS_SQL}, s AS (SELECT *, round(0.7 * a + 0.3 * b, 6) AS score FROM trials)
SELECT study, trial, score, round(a, 6) AS a, b FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY score, trial) AS r FROM s) WHERE r = 1""")
def best_trial(spark, sf_dir):
    scored = vectors.trial_scores(trials(spark, sf_dir), {"a": 0.7, "b": 0.3}).withColumn("score", F.round("score", 6))
    return vectors.best_trial(scored).withColumn("a", F.round("a", 6))


@query(f"""WITH {TRIALS_SQL}, usable AS (SELECT study, round(a, 9) AS a, b FROM trials WHERE round(a, 9) < 0.06 AND b < 0.9),
marked AS (SELECT *, min(b) OVER (PARTITION BY study ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM usable),
front AS (SELECT study, a, b, coalesce(lead(a) OVER (PARTITION BY study ORDER BY a), 0.06) AS upto FROM marked WHERE best IS NULL OR b < best),
areas AS (SELECT study, count(*) AS front, sum((upto - a) * (0.9 - b)) AS area FROM front GROUP BY study)
SELECT study, count(*) AS trials, coalesce(any_value(front), 0) AS front, coalesce(round(any_value(area), 6), 0) AS area FROM trials LEFT JOIN areas USING (study) GROUP BY study""")
def trial_front(spark, sf_dir):
    """What the trials of a study dominate in two metrics, an objective no built-in aggregate gives."""
    tried = trials(spark, sf_dir).withColumn("a", F.round("a", 9))
    return vectors.dominated_area(tried, "a", "b", (0.06, 0.9)).withColumn("area", F.round("area", 6))


TRIAL_OBJECTIVE_SQL = f"""WITH {TRIALS_SQL}
SELECT study, count(*) AS trials, round(max(b) - min(a), 6) AS spread FROM trials GROUP BY study"""


@query(TRIAL_OBJECTIVE_SQL)
def custom_objective(spark, sf_dir):
    """A user's own objective over the trials of a study, as plain aggregate expressions."""
    return trials(spark, sf_dir).groupBy("study").agg(
        F.count(F.lit(1)).alias("trials"), F.round(F.max("b") - F.min("a"), 6).alias("spread")
    )
