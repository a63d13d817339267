"""Embeddings, the regressor, the pipelines and the streams."""

import datetime
import random

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F, types as T

from chatwarden import schema
from chatwarden.operators import metrics, models
from chatwarden.operators.moderation import sort_by_risk
from chatwarden.operators.windows import sliding_windows
from chatwarden.plans import flows
from chatwarden.sources import logs, stores
from chatwarden.streaming.scoring import append_stream, score_stream
from chatwarden.streaming.windows import stream_windows

WORDS = ["game", "attack", "trade", "hello", "win", "deck", "chest", "clan"]


def chat_table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(12)]
        rows.append((f"s{i:04}", " ".join(words), (words.count("attack") + 1) / 8))
    return spark.createDataFrame(rows, "sample_id STRING, chat STRING, label DOUBLE")


def test_hashed_embeddings(spark):
    df = spark.createDataFrame([("a", "Hello, hello Hello"), ("b", " "), ("c", "x")], "sample_id STRING, chat STRING")
    got = {r.sample_id: np.array(r.embedding) for r in models.embed_texts(df, dims=64).collect()}
    index = HashingTF(numFeatures=64).indexOf
    want = np.zeros(64)
    for token in ["Hello", ",", "hello", "Hello"]:
        want[index(token)] += 1
    assert np.allclose(got["a"], want / np.linalg.norm(want), atol=1e-6)
    assert not got["b"].any() and got["c"].sum() == 1


def test_encoder_of_the_caller_is_loaded_once_per_task(spark, tmp_path):
    marks = tmp_path / "loads"
    marks.mkdir()
    folder = str(marks)

    def load():
        import tempfile

        tempfile.mkstemp(dir=folder)
        return lambda texts: [[len(t), t.count("a")] for t in texts]

    df = chat_table(spark, 300).repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = models.encode_texts(df, load).join(df, "sample_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300 and all(r.embedding == [len(r.chat), r.chat.count("a")] for r in got)
    assert len(list(marks.iterdir())) == 2


def test_model_beats_the_mean(spark):
    train, val = chat_table(spark), chat_table(spark, 100, 2)
    base = metrics.mean_baseline(train, val, "label").first().baseline_mae
    for regressor in (None, GBTRegressor(maxIter=5, seed=1)):
        model = models.train_risk_model(train, regressor=regressor, dims=128)
        scored = models.score_texts(model, val, ["sample_id", "label"])
        assert metrics.errors(scored, [("label", "predicted_risk")]).first().mae < 0.8 * base


def test_tuning_takes_the_lowest_error(spark):
    linear = LinearRegression()
    grid = ParamGridBuilder().addGrid(linear.regParam, [0.001, 100.0]).build()
    search, tried = models.tune_risk_model(chat_table(spark), "label", linear, grid, dims=64)
    assert [point["regParam"] for point, _ in tried] == [0.001, 100.0]
    assert tried[0][1] < tried[1][1] and search.bestModel.getRegParam() == 0.001
    trees = GBTRegressor(maxIter=2, seed=1)
    assert len(models.tune_risk_model(chat_table(spark, 80), "label", trees, dims=16)[1]) == 1


def message_log(spark, alliances=12, messages=30):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(alliances * messages):
        words = [rng.choice(WORDS) for _ in range(4)]
        row = []
        for name in schema.LOG_COLUMNS:
            if name == schema.ALLIANCE:
                row.append(f"al{i % alliances}")
            elif name == schema.TEXT:
                row.append(" ".join(words) + " 😀")
            elif name in schema.SCORE_COLUMNS:
                row.append(float(words.count("attack")) + (0.5 if name == schema.SEED_COLUMN else 0))
            else:
                row.append("x")
        rows.append((*row, start + datetime.timedelta(seconds=i), i))
    rows[0] = tuple(None if n == schema.LABEL_COLUMN else v for n, v in zip(schema.MESSAGE_LOG.names, rows[0]))
    return spark.createDataFrame(rows, schema.MESSAGE_LOG)


def test_flows_from_log_to_reports(spark, tmp_path):
    csv = str(tmp_path / "log")
    logs.write_csv(message_log(spark), csv)
    log = logs.read_csv(spark, csv, schema.MESSAGE_LOG)
    windows = flows.clean_message_windows(log, length=5, step=1)
    # one window of the first alliance holds the missing score
    assert windows.count() == 12 * 26 - 1
    assert windows.filter(F.col("chat").contains("😀")).isEmpty()
    windows = flows.split_windows(windows)
    path = str(tmp_path / "windows")
    stores.write_splits(windows, path)
    windows = stores.read_split(spark, path)
    assert stores.read_split(spark, path, "test").count() == 32
    vectors = str(tmp_path / "vectors")
    flows.store_embeddings(windows, vectors, 5)
    embeddings = stores.read_embeddings(spark, vectors, 5)
    assert embeddings.count() == windows.count()
    report = flows.cluster_report(windows, embeddings, 4, 3).collect()
    assert len(report) == 4 and all(getattr(report[0], c) is not None for c in schema.PROFILE_COLUMNS)
    similar = {r.picks: r for r in flows.similar_report(windows, embeddings, 5).collect()}
    assert similar["riskiest"][schema.SEED_COLUMN] >= similar["similar"][schema.SEED_COLUMN]
    model, found = flows.train_and_evaluate(windows, dims=64)
    rows = {r.split: r for r in found.collect()}
    assert set(rows) == {"val", "test"}
    assert all(r.mae < r.baseline_mae and r.concordance > 0.7 for r in rows.values())
    by_alliance = flows.split_windows(windows.drop("split"), by_alliance=True)
    assert by_alliance.groupBy("alliance_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()


def test_exported_log_is_taken_in_the_order_of_its_lines(spark, tmp_path):
    log = message_log(spark, 3, 20)
    path = str(tmp_path / "export")
    logs.write_csv(log.orderBy("msg_id").select(*schema.LOG_COLUMNS), path)
    raw = logs.read_csv_in_file_order(spark, path, schema.RAW_LOG)
    columns = ["sample_id", "chat", schema.SEED_COLUMN]
    got = flows.clean_message_windows(raw, 4, 1, logs.FILE_ORDER).select(columns)
    want = flows.clean_message_windows(log, 4, 1).select(columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 3 * 17 - 1


def test_windows_stored_as_text(spark):
    good = {n: "['x']" for n in schema.LOG_COLUMNS}
    good.update({n: "[1.0]" for n in schema.SCORE_COLUMNS})
    header = {n: n for n in schema.LOG_COLUMNS}
    bad = {**good, schema.SEED_COLUMN: "[nan]"}
    rows = [tuple(r[n] for n in schema.LOG_COLUMNS) for r in (good, header, bad, good)]
    windows = flows.clean_text_windows(spark.createDataFrame(rows, schema.TEXT_WINDOWS))
    assert [r.chat for r in windows.collect()] == ["x", "x"]


def test_csv_keeps_texts_as_they_are(spark, tmp_path):
    texts = ['say "hi"', "line\nbreak", "cr\r\nlf", "back\\slash", " outer ", "NA", "null", "", None, "a,b", "'"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    path = str(tmp_path / "csv")
    logs.write_csv(df.repartition(3), path)
    back = [r.t for r in logs.read_csv(spark, path, df.schema).orderBy("i").collect()]
    assert back == [t or None for t in texts]
    windows = df.withColumn("n", F.lit(1))
    for _ in range(2):
        logs.append_windows(windows, str(tmp_path / "table"))
    assert logs.read_table(spark, str(tmp_path / "table")).count() == 22
    assert [r.i for r in logs.first_rows(df, "i", 3).collect()] == [0, 1, 2]


def test_model_stores(spark, tmp_path):
    from chatwarden.operators.vectors import kmeans

    df = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(20)], "sample_id INT, embedding ARRAY<DOUBLE>")
    assigned, centers, model = kmeans(df, 2)
    stores.save_kmeans(model, str(tmp_path / "model"))
    again = stores.load_kmeans(str(tmp_path / "model"))
    assert [list(c) for c in again.clusterCenters()] == [list(c) for c in model.clusterCenters()]
    stores.write_centers(centers, str(tmp_path / "centers"))
    assert stores.read_centers(spark, str(tmp_path / "centers")).orderBy("cluster_id").collect() == centers.collect()
    stores.write_assignments(assigned, str(tmp_path / "ids"))
    assert spark.read.parquet(str(tmp_path / "ids")).count() == 20


def arrivals(spark, folder, batches):
    """One file per micro-batch, in the order given."""
    for rows in batches:
        spark.createDataFrame(rows, "grp STRING, ts TIMESTAMP, id LONG, text STRING").coalesce(1).write.mode(
            "append"
        ).parquet(folder)


@pytest.mark.parametrize("length,step", [(3, 1), (4, 2), (2, 5), (1, 1)])
def test_stream_windows_are_the_full_batch_windows(spark, tmp_path, length, step):
    rng = random.Random(length)
    start = datetime.datetime(2024, 3, 1)
    rows = [
        (f"g{rng.randrange(4)}", start + datetime.timedelta(milliseconds=i // 2), i, None if i % 7 == 0 else f"m{i}")
        for i in range(120)
    ]
    rows[60] = (None, *rows[60][1:])
    batches = [rows[:40], rows[40:44], rows[44:]]
    for batch in batches:
        rng.shuffle(batch)
    late = ("g0", start, -1, "late")
    folder = str(tmp_path / "in")
    arrivals(spark, folder, [batches[0], batches[1] + [late], batches[2]])
    table = spark.read.parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = stream_windows(stream, "grp", ["ts", "id"], ["text", "ts"], length, step)
    out = str(tmp_path / "out")
    query = append_stream(got, out, str(tmp_path / "state"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    batch = sliding_windows(table.filter("id >= 0"), "grp", ["ts", "id"], ["text", "ts"], length, step)
    columns = ["grp", "window_start", "text", "ts"]
    want = batch.filter(F.col("n_messages") == length).select(columns).collect()
    rows = spark.read.parquet(out)
    assert sorted(map(repr, rows.select(columns).collect())) == sorted(map(repr, want))
    assert rows.agg(F.max("late_messages")).first()[0] == 1
    assert isinstance(rows.schema["ts"].dataType, T.ArrayType)


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    chats = chat_table(spark, 60)
    model = models.train_risk_model(chats, dims=64)
    folder = str(tmp_path / "in")
    for part in chats.randomSplit([0.5, 0.5], 1):
        part.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(chats.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    out = str(tmp_path / "out")
    append_stream(score_stream(model, stream, "sample_id"), out, str(tmp_path / "state")).awaitTermination()
    want = models.score_texts(model, chats, ["sample_id", "chat"])
    queue = sort_by_risk(spark.read.parquet(out)).collect()
    by_risk = want.orderBy(F.desc("predicted_risk"), "sample_id").collect()
    assert [tuple(r) for r in queue] == [(r[0], r[1], r[2]) for r in by_risk]
