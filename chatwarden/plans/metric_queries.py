"""Queries on prediction pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatwarden.operators import metrics as M
from chatwarden.operators.concordance import concordance as concordance_index
from chatwarden.plans.roles import (
    PREDICTIONS_SQL,
    SECOND_NUMBER_SQL,
    predictions,
    second_number,
    spread_split,
    spread_split_sql,
    table,
)

CUTOFF = 50.0


def _round_all(df, digits=6):
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else c for c in df.columns])


def baseline_mae(spark, sf_dir):
    pairs = predictions(spark, sf_dir).withColumn("split", spread_split("key"))
    train, val = (pairs.filter(F.col("split") == s) for s in ("train", "val"))
    return _round_all(M.mean_baseline(train, val))


BASELINE_MAE = f"""
    WITH p AS (SELECT value AS y, {spread_split_sql('event_id')} AS split FROM events),
    m AS (SELECT avg(y) AS mean_label FROM p WHERE split = 'train')
    SELECT round(any_value(mean_label), 6) AS mean_label,
           round(avg(abs(y - mean_label)), 6) AS baseline_mae, count(*) AS n_validation
    FROM p, m WHERE split = 'val'
"""


def regression_metrics(spark, sf_dir):
    return _round_all(M.regression_metrics(predictions(spark, sf_dir)))


REGRESSION_METRICS = f"""
    WITH p AS ({PREDICTIONS_SQL}),
    f AS (SELECT avg(y_true) AS mean, sum(y_true * y_pred) / sum(y_pred * y_pred) AS k FROM p),
    s AS (
        SELECT avg(pow(y_pred - y_true, 2)) AS mse, avg(abs(y_pred - y_true)) AS mae,
               pow(corr(y_true, y_pred), 2) AS r2, any_value(k) AS k,
               1 - sum(pow(y_true - k * y_pred, 2)) / sum(pow(y_true - mean, 2)) AS r02,
               1 - sum(pow(y_true - y_pred, 2)) / sum(pow(y_true - mean, 2)) AS score
        FROM p, f)
    SELECT round(mse, 6) AS mse, round(mae, 6) AS mae, round(r2, 6) AS pearson_r2,
           round(k, 6) AS slope, round(r02, 6) AS r0_squared,
           round(r2 * (1 - sqrt(abs(r2 * r2 - r02 * r02))), 6) AS rm_squared,
           round(score, 6) AS r2_score
    FROM s
"""


def _two_outputs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("y1"),
        second_number().alias("p1"),
        F.col("user_id").cast("double").alias("y2"),
        F.col("value").alias("p2"),
    )


_PAIRS = [("y1", "p1"), ("y2", "p2")]
_TWO_OUTPUTS_SQL = f"""
    SELECT event_id, value AS y1, {SECOND_NUMBER_SQL} AS p1,
           CAST(user_id AS DOUBLE) AS y2, value AS p2 FROM events
"""


def output_errors(spark, sf_dir):
    """Errors of a model with two outputs."""
    return _round_all(M.errors(_two_outputs(spark, sf_dir), _PAIRS))


OUTPUT_ERRORS = f"""
    SELECT round(avg(pow(p1 - y1, 2)) + avg(pow(p2 - y2, 2)), 6) AS mse,
           round(avg(abs(p1 - y1)), 6) AS mae, round(avg(abs(p2 - y2)), 6) AS mae_second
    FROM ({_TWO_OUTPUTS_SQL})
"""


def batch_metrics(spark, sf_dir):
    return _round_all(M.epoch_errors(_two_outputs(spark, sf_dir), "event_id", _PAIRS, 7))


BATCH_METRICS = f"""
    SELECT round(avg(mse), 6) AS mse, round(avg(mae), 6) AS mae, round(avg(mae2), 6) AS mae_second
    FROM (SELECT avg(pow(p1 - y1, 2)) + avg(pow(p2 - y2, 2)) AS mse, avg(abs(p1 - y1)) AS mae,
                 avg(abs(p2 - y2)) AS mae2
          FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 7 AS batch
                FROM ({_TWO_OUTPUTS_SQL}))
          GROUP BY batch HAVING count(*) = 7)
"""


def best_by_mae(spark, sf_dir):
    per_model = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("model_id"))
        .agg(F.avg(F.abs(second_number() - F.col("value"))).alias("mae"))
    )
    return _round_all(M.best_model(per_model, "model_id", "mae"))


BEST_BY_MAE = f"""
    SELECT arg_min(model_id, mae) AS model_id, round(min(mae), 6) AS mae
    FROM (SELECT event_type AS model_id, avg(abs({SECOND_NUMBER_SQL} - value)) AS mae
          FROM events GROUP BY event_type)
"""


def concordance(spark, sf_dir):
    found = concordance_index(predictions(spark, sf_dir))
    counts = {c: F.col(c).cast("double") for c in ("n_pairs", "wins", "ties")}
    return _round_all(found.withColumns(counts), 9)


CONCORDANCE = f"""
    WITH r AS (
        SELECT y_true AS y, row_number() OVER (ORDER BY y_pred DESC, key) AS rn
        FROM ({PREDICTIONS_SQL})),
    s AS (
        SELECT count(*) AS n, sum(CAST(a.y > b.y AS INTEGER)) AS wins,
               sum(CAST(a.y = b.y AS INTEGER)) AS ties
        FROM r a JOIN r b ON a.rn < b.rn)
    SELECT CAST(n AS DOUBLE) AS n_pairs, CAST(wins AS DOUBLE) AS wins,
           CAST(ties AS DOUBLE) AS ties,
           round((CAST(wins AS DOUBLE) + 0.5 * CAST(ties AS DOUBLE)) / n, 9) AS concordance
    FROM s
"""


def _pr_area_sql(source: str) -> str:
    return f"""
        WITH per_score AS (
            SELECT score, sum(label) AS p, count(*) AS n FROM ({source}) GROUP BY score),
        c AS (
            SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER () AS pos
            FROM per_score WINDOW w AS (ORDER BY score DESC)),
        pr AS (
            SELECT score, tp / seen AS precision,
                   CASE WHEN pos > 0 THEN tp / pos END AS recall FROM c)
        SELECT round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_area
        FROM (SELECT recall, precision, lag(recall, 1, 0) OVER o AS r0,
                     lag(precision, 1, 1) OVER o AS p0
              FROM pr WINDOW o AS (ORDER BY score DESC))
    """


def pr_area(spark, sf_dir):
    """Both numbers cut into 0/1 first."""
    pairs = M.binarized(predictions(spark, sf_dir), "y_true", "y_pred", CUTOFF)
    return _round_all(M.pr_area(pairs, "y_true", "y_pred"))


PR_AREA = _pr_area_sql(f"""
    SELECT CASE WHEN y_true < {CUTOFF} THEN 0 ELSE 1 END AS label,
           CASE WHEN y_pred < {CUTOFF} THEN 0 ELSE 1 END AS score
    FROM ({PREDICTIONS_SQL})
""")


def pr_area_scores(spark, sf_dir):
    """Given labels against a score with many values."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labelled = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return _round_all(M.pr_area(labelled, "quality", "n_chars"))


PR_AREA_SCORES = _pr_area_sql(
    "SELECT quality AS label, n_chars AS score FROM labels JOIN documents USING (doc_id)"
)

QUERIES = {
    "baseline_mae": (baseline_mae, BASELINE_MAE),
    "regression_metrics": (regression_metrics, REGRESSION_METRICS),
    "output_errors": (output_errors, OUTPUT_ERRORS),
    "batch_metrics": (batch_metrics, BATCH_METRICS),
    "best_by_mae": (best_by_mae, BEST_BY_MAE),
    "concordance": (concordance, CONCORDANCE),
    "pr_area": (pr_area, PR_AREA),
    "pr_area_scores": (pr_area_scores, PR_AREA_SCORES),
}
