"""The work end to end, on a message log with the declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, functions as F

from chatwarden import schema
from chatwarden.functions import fixed_values as fixed
from chatwarden.functions.arrays import risk_label
from chatwarden.operators import models, vectors
from chatwarden.operators.cleaning import add_chat, clean_windows
from chatwarden.operators.concordance import concordance
from chatwarden.operators.metrics import errors, mean_baseline, regression_metrics
from chatwarden.operators.split import exact_split, hash_split
from chatwarden.operators.windows import sliding_windows
from chatwarden.session import materialize
from chatwarden.sources import stores

_OTHER_COLUMNS = tuple(
    c for c in schema.LOG_COLUMNS if c not in schema.SCORE_COLUMNS and c != schema.TEXT
)


def clean_message_windows(
    log: DataFrame,
    length: int = fixed.WINDOW_LENGTH,
    step: int = fixed.WINDOW_STEP,
    order: Sequence[str] = schema.ORDER_COLUMNS,
) -> DataFrame:
    """Message log to clean windows with a chat column and typed lists.

    A window with a missing value in any column of the log is dropped, as it is
    in its text form. A message carries one flag for that into its windows.
    """
    missing = F.lit(False)
    for name in schema.LOG_COLUMNS:
        missing = missing | F.col(name).isNull()
        if name in schema.SCORE_COLUMNS:
            missing = missing | F.isnan(name)
    columns = [schema.TEXT, *schema.SCORE_COLUMNS, "_missing"]
    flagged = log.withColumn("_missing", missing)
    windows = sliding_windows(flagged, schema.ALLIANCE, order, columns, length, step)
    return add_chat(windows.filter(~F.array_contains("_missing", True)).drop("_missing"))


def clean_text_windows(windows: DataFrame) -> DataFrame:
    """The same from windows whose lists are stored as text (``schema.TEXT_WINDOWS``)."""
    return clean_windows(windows, schema.TEXT, schema.SCORE_COLUMNS, _OTHER_COLUMNS)


def split_windows(windows: DataFrame, by_alliance: bool = False) -> DataFrame:
    """Adds ``split``: exact 80/10/10 by window, or whole alliances by hash.

    Windows overlap. By window, near copies land on both sides; by alliance
    they do not, and the sizes are only close to 80/10/10.
    """
    if by_alliance:
        return hash_split(windows, schema.ALLIANCE)
    return exact_split(windows, "sample_id")


def store_embeddings(windows: DataFrame, path: str, seq_length: int = fixed.WINDOW_LENGTH) -> None:
    """Embeds the chats of split windows and stores them by length and split."""
    embedded = models.embed_texts(windows.select("sample_id", "split", schema.CHAT))
    rows = embedded.drop(schema.CHAT).withColumn("seq_length", F.lit(seq_length))
    stores.write_embeddings(rows, path)


def cluster_report(
    windows: DataFrame,
    embeddings: DataFrame,
    clusters: int,
    k: int = fixed.NEAREST_PER_CLUSTER,
    profile: Sequence[str] = schema.PROFILE_COLUMNS,
) -> DataFrame:
    """Clusters the training rows and profiles the rows nearest to each center."""
    train = embeddings.filter(F.col("split") == "train")
    _, centers, _ = vectors.kmeans(train, clusters)
    picks = vectors.nearest_rows(embeddings, centers, k)
    return vectors.cluster_profile(picks, windows, profile, "sample_id")


def similar_report(
    windows: DataFrame,
    embeddings: DataFrame,
    k: int,
    profile: Sequence[str] = schema.PROFILE_COLUMNS,
) -> DataFrame:
    """Profiles the k riskiest windows and the ten windows most like them."""
    return vectors.riskiest_and_similar(windows, embeddings, schema.SEED_COLUMN, profile, k)


def with_label(windows: DataFrame, score: str = schema.LABEL_COLUMN) -> DataFrame:
    return windows.withColumn("label", risk_label(F.col(score)))


def evaluate(model: PipelineModel, rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: ``mse mae concordance rm_squared`` of the model on labelled rows."""
    scored = materialize(models.score_texts(model, rows, [key, "label"]), "scored")
    pair = ("label", "predicted_risk")
    found = errors(scored, [pair]).select("mse", "mae")
    ranked = concordance(scored, key, *pair).select("concordance").scalar()
    fitted = regression_metrics(scored, *pair).select("rm_squared").scalar()
    return found.withColumns({"concordance": ranked, "rm_squared": fitted})


def train_and_evaluate(
    windows: DataFrame, regressor: Estimator | None = None, dims: int = fixed.EMBEDDING_DIMS
) -> tuple[PipelineModel, DataFrame]:
    """Trains on the training part; errors on the other parts beside the baseline."""
    rows = with_label(windows)
    parts = {s: rows.filter(F.col("split") == s) for s in ("train", "val", "test")}
    model = models.train_risk_model(parts["train"], "label", regressor, dims=dims)
    reports = []
    for part in ("val", "test"):
        baseline = mean_baseline(parts["train"], parts[part], "label").select("baseline_mae")
        reports.append(
            evaluate(model, parts[part]).withColumns(
                {"split": F.lit(part), "baseline_mae": baseline.scalar()}
            )
        )
    return model, reports[0].unionByName(reports[1])
