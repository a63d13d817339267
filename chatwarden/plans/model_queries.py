"""Queries that embed, train, tune and score; trained results have no SQL form."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from chatwarden.functions.arrays import list_sum, risk_label
from chatwarden.operators import metrics, models, ridge
from chatwarden.plans.roles import spread_split, spread_split_sql, table
from chatwarden.session import spread

DIMS = 256


def chats(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chat")))


def labelled_chats(spark, sf_dir):
    """Documents with a label made from the two given marks."""
    marks = F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    labels = table(spark, sf_dir, "labels").select("doc_id", risk_label(marks).alias("label"))
    return chats(spark, sf_dir).join(labels, "doc_id").withColumn("split", spread_split("doc_id"))


def _part(rows, split):
    return rows.filter(F.col("split") == split)


def fitted(spark, sf_dir):
    train = _part(labelled_chats(spark, sf_dir), "train")
    return models.train_risk_model(train, dims=DIMS)


def embed_hash(spark, sf_dir):
    """Every document embedded; a vector has length 1, or 0 without any token."""
    embedded = models.embed_texts(chats(spark, sf_dir))
    x = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    return embedded.select(
        "doc_id", F.size("embedding").alias("dims"), F.round(F.sqrt(list_sum(x)), 4).alias("norm")
    )


EMBED_HASH = r"""
    SELECT doc_id, 768 AS dims,
           CASE WHEN regexp_matches(text, '[^\s]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
    FROM documents
"""


def _letter_shares():
    """A small encoder of the caller's kind: shares of some letters in a text."""
    import numpy as np

    letters = "aeioust"

    def encode(texts):
        counts = np.array([[t.count(c) for c in letters] for t in texts], dtype=float)
        return counts / np.maximum([[len(t)] for t in texts], 1)

    return encode


def embed_custom(spark, sf_dir):
    """An encoder given as a function, run over batches of texts in the tasks."""
    vectors = models.encode_texts(chats(spark, sf_dir), _letter_shares, "doc_id")
    share = [F.round(F.col("embedding")[i].cast("double"), 4).alias(f"x{i}") for i in range(7)]
    return vectors.select("doc_id", *share)


EMBED_CUSTOM = "SELECT doc_id, " + ", ".join(
    f"""round(CAST(CAST((length(text) - length(replace(text, '{c}', ''))) / length(text) AS FLOAT)
              AS DOUBLE), 4) AS x{i}"""
    for i, c in enumerate("aeioust")
) + " FROM documents"


def risk_model(spark, sf_dir):
    """Error of the trained model on the test part, beside the mean-label baseline."""
    rows = labelled_chats(spark, sf_dir)
    model = models.train_risk_model(_part(rows, "train"), dims=DIMS)
    test = _part(rows, "test")
    scored = models.score_texts(model, test, ["doc_id", "label"])
    found = metrics.errors(scored, [("label", "predicted_risk")]).select("mse", "mae")
    baseline = metrics.mean_baseline(_part(rows, "train"), test, "label")
    return found.withColumn("baseline_mae", baseline.select("baseline_mae").scalar())


def score(spark, sf_dir):
    """Predicted risk of every document."""
    return models.score_texts(fitted(spark, sf_dir), chats(spark, sf_dir), ["doc_id"])


def vector_model(spark, sf_dir):
    """A regressor on stored vectors: one feature, no penalty, so SQL can fit it too."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.array(F.col("n_chars") / 1000.0).alias("embedding")
    )
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("label")
    )
    plain = LinearRegression(regParam=0.0, solver="normal")
    model = models.train_on_embeddings(documents.join(labels, "doc_id"), plain)
    scored = models.score_embeddings(model, documents, ["doc_id"])
    return scored.withColumn("predicted_risk", F.round("predicted_risk", 6))


VECTOR_MODEL = """
    WITH d AS (SELECT doc_id, n_chars / 1000.0::DOUBLE AS x FROM documents),
    f AS (SELECT regr_slope(CAST(quality AS DOUBLE), x) AS b,
                 regr_intercept(CAST(quality AS DOUBLE), x) AS a
          FROM labels JOIN d USING (doc_id))
    SELECT doc_id, round(a + b * x, 6) AS predicted_risk FROM d, f
"""


def baseline_labels(spark, sf_dir):
    """The mean-label baseline on labelled chats, by split."""
    rows = labelled_chats(spark, sf_dir).drop("chat")
    found = metrics.mean_baseline(_part(rows, "train"), _part(rows, "test"), "label")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns[:2]], "n_validation")


BASELINE_LABELS = f"""
    WITH p AS (SELECT doc_id, (((quality + toxic) / 2.0::DOUBLE) + 1) / 8 AS label,
                      {spread_split_sql('doc_id')} AS split
               FROM labels JOIN documents USING (doc_id)),
    m AS (SELECT avg(label) AS mean_label FROM p WHERE split = 'train')
    SELECT round(any_value(mean_label), 6) AS mean_label,
           round(avg(abs(label - mean_label)), 6) AS baseline_mae, count(*) AS n_validation
    FROM p, m WHERE split = 'test'
"""


PENALTIES = (0.01, 0.1, 1.0)


def tune(spark, sf_dir):
    """Error of every penalty on the validation part, best first."""
    rows = models.embed_texts(labelled_chats(spark, sf_dir), dims=DIMS)
    _, tried = ridge.search(_part(rows, "train"), _part(rows, "val"), ["label"], PENALTIES)
    return tried.select("penalty", "mae").orderBy("mae")


def _marked_lengths(spark, sf_dir):
    """The two marks of a document as labels, its length as the only feature."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.array(F.col("n_chars") / 1000.0).alias("embedding")
    )
    marks = table(spark, sf_dir, "labels").select(
        "doc_id", *[F.col(c).cast("double").alias(c) for c in ("quality", "toxic")]
    )
    return documents.join(marks, "doc_id").withColumn("split", spread_split("doc_id"))


MARKED_LENGTHS_SQL = f"""
    SELECT doc_id, n_chars / 1000.0::DOUBLE AS x, CAST(quality AS DOUBLE) AS quality,
           CAST(toxic AS DOUBLE) AS toxic, {spread_split_sql('doc_id')} AS split
    FROM documents JOIN labels USING (doc_id)
"""


def tune_two_labels(spark, sf_dir):
    """The search on one feature and two labels, from sums that SQL can take too."""
    rows = _marked_lengths(spark, sf_dir)
    _, tried = ridge.search(_part(rows, "train"), _part(rows, "val"), ["quality", "toxic"], PENALTIES)
    return tried.select("penalty", "label", "n", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"))


TUNE_TWO_LABELS = f"""
    WITH d AS ({MARKED_LENGTHS_SQL}),
    r AS (SELECT x, split, unnest(['quality', 'toxic']) AS label, unnest([quality, toxic]) AS y FROM d),
    s AS (SELECT label, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS sxy, var_pop(x) AS sxx
          FROM r WHERE split = 'train' GROUP BY label),
    m AS (SELECT penalty, label, sxy / (sxx + penalty) AS w, my - mx * (sxy / (sxx + penalty)) AS b
          FROM s, (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in PENALTIES)}]) AS penalty))
    SELECT penalty, label, count(*) AS n, round(avg(abs(w * x + b - y)), 6) AS mae,
           round(avg((w * x + b - y) ** 2), 6) AS mse
    FROM r JOIN m USING (label) WHERE split = 'val' GROUP BY penalty, label
"""


def two_label_errors(spark, sf_dir):
    """A model of two outputs, its errors over both and per output on the test part."""
    rows = _marked_lengths(spark, sf_dir)
    model = ridge.fit(_part(rows, "train"), ["quality", "toxic"])
    test = ridge.predict(model, _part(rows, "test"), ["doc_id", "quality", "toxic"])
    found = metrics.errors(test, [("quality", "predicted_quality"), ("toxic", "predicted_toxic")])
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


TWO_LABEL_ERRORS = f"""
    WITH d AS ({MARKED_LENGTHS_SQL}),
    m AS (SELECT regr_slope(quality, x) AS wq, regr_intercept(quality, x) AS bq,
                 regr_slope(toxic, x) AS wt, regr_intercept(toxic, x) AS bt FROM d WHERE split = 'train')
    SELECT round(avg((wq * x + bq - quality) ** 2) + avg((wt * x + bt - toxic) ** 2), 6) AS mse,
           round(avg(abs(wq * x + bq - quality)), 6) AS mae,
           round(avg(abs(wt * x + bt - toxic)), 6) AS mae_second
    FROM d, m WHERE split = 'test'
"""

QUERIES = {
    "embed_hash": (embed_hash, EMBED_HASH),
    "embed_custom": (embed_custom, EMBED_CUSTOM),
    "risk_model": (risk_model, None),
    "vector_model": (vector_model, VECTOR_MODEL),
    "baseline_labels": (baseline_labels, BASELINE_LABELS),
    "score": (score, None),
    "tune": (tune, None),
    "tune_two_labels": (tune_two_labels, TUNE_TWO_LABELS),
    "two_label_errors": (two_label_errors, TWO_LABEL_ERRORS),
}
