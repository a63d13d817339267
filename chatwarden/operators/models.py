"""Text embeddings, the risk regressor, its search and scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chatwarden.functions.fixed_values import EMBEDDING_DIMS, TOKEN_PATTERN

Encoder = Callable[[Sequence[str]], np.ndarray]


def hashing_stages(text: str = "chat", dims: int = EMBEDDING_DIMS) -> list[Transformer]:
    """Built-in encoder, all in the JVM: hashed token counts scaled to length 1."""
    return [
        RegexTokenizer(
            inputCol=text, outputCol="tokens", pattern=TOKEN_PATTERN, gaps=False, toLowercase=False
        ),
        HashingTF(inputCol="tokens", outputCol="token_counts", numFeatures=dims),
        Normalizer(inputCol="token_counts", outputCol="features", p=2.0),
    ]


def embed_texts(texts: DataFrame, text: str = "chat", dims: int = EMBEDDING_DIMS) -> DataFrame:
    """Adds ``embedding`` with the built-in encoder; the whole text is read."""
    out = texts
    for stage in hashing_stages(text, dims):
        out = stage.transform(out)
    return out.withColumn("embedding", vector_to_array("features", dtype="float32")).drop(
        "tokens", "token_counts", "features"
    )


def encode_texts(
    texts: DataFrame,
    load_encoder: Callable[[], Encoder],
    key: str = "sample_id",
    text: str = "chat",
) -> DataFrame:
    """``key`` and ``embedding`` with an encoder of the caller's.

    The encoder is loaded once per task and is given a batch of texts at a
    time; it returns one vector per text.
    """
    schema = T.StructType(
        [texts.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def task(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or load_encoder()
            chats = [chat or "" for chat in batch.column(1).to_pylist()]
            vectors = np.asarray(encoder(chats), dtype=np.float32)
            width = vectors.shape[1] if vectors.ndim == 2 else 0
            offsets = np.arange(0, batch.num_rows + 1, dtype=np.int32) * width
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=schema.names)

    return texts.select(key, text).mapInArrow(task, schema)


def risk_pipeline(
    regressor: Estimator | None = None, text: str = "chat", dims: int = EMBEDDING_DIMS
) -> Pipeline:
    """Text to predicted risk; any regressor that reads ``features`` will do."""
    regressor = regressor or LinearRegression(regParam=0.1)
    return Pipeline(stages=[*hashing_stages(text, dims), regressor])


def train_risk_model(
    train: DataFrame, label: str = "label", regressor: Estimator | None = None, text: str = "chat",
    dims: int = EMBEDDING_DIMS,
) -> PipelineModel:
    regressor = regressor or LinearRegression(regParam=0.1)
    return risk_pipeline(regressor.copy({regressor.labelCol: label}), text, dims).fit(train)


def train_on_embeddings(
    train: DataFrame, regressor: Estimator, label: str = "label", vector: str = "embedding"
) -> Transformer:
    """Fits any regressor on stored vectors instead of texts."""
    features = train.select(_as_vector(vector).alias(regressor.getFeaturesCol()), label)
    return regressor.copy({regressor.labelCol: label}).fit(features)


def score_embeddings(
    model: Transformer, rows: DataFrame, keep: Sequence[str], vector: str = "embedding"
) -> DataFrame:
    """Predicted risk of stored vectors."""
    features = rows.select(*keep, _as_vector(vector).alias(model.getFeaturesCol()))
    return model.transform(features).select(*keep, F.col("prediction").alias("predicted_risk"))


def _as_vector(vector: str) -> Column:
    return array_to_vector(F.col(vector).cast("array<double>"))


def score_texts(model: Transformer, texts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predicted risk per text, for a table or a stream."""
    return model.transform(texts).select(*keep, F.col("prediction").alias("predicted_risk"))


def tune_risk_model(
    train: DataFrame,
    label: str = "label",
    regressor: Estimator | None = None,
    grid: Sequence[dict] | None = None,
    text: str = "chat",
    dims: int = EMBEDDING_DIMS,
    seed: int = 1,
    parallelism: int = 2,
) -> tuple[TrainValidationSplitModel, list[tuple[dict[str, float], float]]]:
    """Search for the lowest validation error (mean absolute error).

    ``grid`` has the parameter maps to try, as ``ParamGridBuilder`` builds them;
    by default penalties of a linear model. The features do not depend on them,
    so they are made once, outside the search. Returns the fitted search and
    (parameters, error) per point.
    """
    features = train
    for stage in hashing_stages(text, dims):
        features = stage.transform(features)
    features = features.select("features", label)
    if regressor is None:
        regressor = LinearRegression()
        grid = grid or ParamGridBuilder().addGrid(regressor.regParam, [0.01, 0.1, 1.0]).build()
    search = TrainValidationSplit(
        estimator=regressor.copy({regressor.labelCol: label}),
        estimatorParamMaps=list(grid or [{}]),
        evaluator=RegressionEvaluator(labelCol=label, metricName="mae"),
        trainRatio=0.8,
        seed=seed,
        parallelism=parallelism,
    ).fit(features)
    tried = [{p.name: v for p, v in point.items()} for point in search.getEstimatorParamMaps()]
    return search, list(zip(tried, search.validationMetrics))
