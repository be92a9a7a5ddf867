import pytest

from sojourn import schema as S
from sojourn.operators import cohort, export
from sojourn.plans import jobs
from sojourn.sources import files, guard


def test_policy(monkeypatch):
    monkeypatch.delenv(guard.CLOSED.workspace_variable, raising=False)
    open_ = guard.Egress(made_up_rows=True)
    for target in ("/data/x", "hdfs://name/x", "file:///x"):
        guard.CLOSED.admit(target)
    for target in ("s3a://bucket/x", "gs://bucket/x", "odd://x"):
        open_.admit(target)
        with pytest.raises(guard.EgressRefused, match="made up"):
            guard.CLOSED.admit(target)
    monkeypatch.setenv(guard.CLOSED.workspace_variable, "project.dataset")
    guard.CLOSED.admit("/data/x")
    with pytest.raises(guard.EgressRefused, match="real data"):
        open_.admit("s3a://bucket/x")


def test_sinks_ask_the_guard(texts, tmp_path):
    with pytest.raises(guard.EgressRefused):
        files.write_sequence_text(texts((1, "a")), "s3a://bucket/x")
    assert not (tmp_path / "x").exists()


def test_split_events_csv(spark, events, tmp_path):
    rows = [(s, float(i), f"C{i}", 0.5 * i, s, "a, \"b\"") for s in range(10) for i in range(3)]
    rows.append((3, None, "GENzz1"))
    split = export.split_events(events(*rows))
    path = str(tmp_path / "events")
    for _ in range(2):  # a second run replaces the first
        files.write_split_events(split, path)
    sizes = {n: files.count_csv_rows(spark, f"{path}/split={n}") for n in ("train", "test")}
    assert sum(sizes.values()) == len(rows) and sizes["test"] >= 6
    back = files.read_events_csv(spark, [f"{path}/split=train", f"{path}/split=test"])
    assert sorted(map(repr, back.collect())) == sorted(map(repr, events(*rows).collect()))


def test_predictions_csv(spark, tmp_path):
    frame = spark.sql(
        """SELECT 'a "b", c' AS original_text, array('x "1"', 'y') AS generated_text,
        array(0, 1) AS pred_labels, 7L AS subject_id, 1 AS label_token, 0.5D AS probability,
        array(0.25D) AS probability_scores, 2 AS num_predictions, 3 AS max_new_tokens, 'm' AS model_name"""
    )
    files.write_predictions(frame, str(tmp_path / "p"))
    assert files.read_predictions(spark, str(tmp_path / "p")).first() == frame.first()


def test_dataset_splits(spark, texts, tmp_path):
    rows = texts(*[(i, f"t{i}") for i in range(20)])
    path = str(tmp_path / "d")
    files.write_dataset(export.split_events(rows), path)
    assert files.read_dataset(spark, path).count() == 4
    assert files.read_dataset(spark, path, "all").count() == 20
    assert files.read_dataset(spark, path, "all", sample_size=3).count() == 6
    with pytest.raises(ValueError, match=r"available: \['test', 'train'\]"):
        files.read_dataset(spark, path, "dev")
    plan = files.read_dataset(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "Exchange" not in plan
    files.write_dataset(rows.selectExpr("*", "'a b/c' AS split"), path + "_named")
    assert files.split_names(spark, path + "_named") == ["a b/c"]
    assert files.read_dataset(spark, path + "_named", "a b/c").count() == 20
    files.write_dataset(rows, path + "_unsplit", ())
    assert files.read_dataset(spark, path + "_unsplit").count() == 20


def test_jobs_end_to_end(spark, events, tmp_path):
    day = 86400.0
    rows = []
    for s in range(12):
        rows.append((s, -9000 * day, S.BIRTH_CODE))
        for i in range(8):
            rows.append((s, i * 20 * day, f"CDzz{i % 3}", None, s * 100 + i // 2, "Office Visit"))
    path = str(tmp_path / "job")
    jobs.curation_job(events(*rows), path, S.Thresholds(2, 5, 50))
    texts = files.read_sequence_csv(spark, f"{path}/sequences_csv")
    assert texts.count() == 12 and spark.read.text(f"{path}/sequences_text").count() == 12
    vocabulary = files.read_vocabulary(spark, f"{path}/vocabulary")
    assert vocabulary.where("token = 'CDzz2'").count() == 1
    train = files.read_dataset(spark, f"{path}/dataset", "train")
    assert train.count() == 5 * int(0.9 * 12)
    test = files.read_dataset(spark, f"{path}/dataset", "test")
    task_codes = spark.createDataFrame([("t", 2), ("u", 9)], S.TASK_CODES)
    jobs.evaluation_set_job(test, task_codes, f"{path}/eval", cohort.Task())
    back = spark.read.parquet(f"{path}/eval").where("task = 'u' AND label_time_range = 730")
    row = back.first()
    assert row["label_token"] == 0 and len(row["input_ids"]) == row["stopping_time"]
    scores = spark.createDataFrame([(3, [[1.0]]), (4, [[0.0]])], "subject_id bigint, prs array<array<double>>")
    with_scores = S.Augmentation(None, 1, 0, zero_prs_copy=True)
    jobs.curation_job(events(*rows), f"{path}2", S.Thresholds(2, 5, 50), settings=with_scores, prs=scores)
    made = spark.read.parquet(f"{path}2/dataset")
    split = {r["subject_id"]: r["split"] for r in made.collect()}
    assert made.where("prs IS NULL").count() == 10
    assert made.where("subject_id = 3").count() == (2 if split[3] == "train" else 1)
    with pytest.raises(ValueError, match="need the PRS rows"):
        jobs.curation_job(events(*rows), f"{path}3", S.Thresholds(2, 5, 50), settings=with_scores)
    with pytest.raises(ValueError, match="no sequences"):
        jobs.curation_job(events(*rows), path, S.Thresholds(50, 5, 50))


def test_task_codes_csv(spark, tmp_path):
    (tmp_path / "tasks.csv").write_text("task,concept_id\nAD,5\nAD,4\n")
    read = files.read_task_codes(spark, str(tmp_path / "tasks.csv"))
    assert cohort.task_targets(read).first()["targets"] == ["CDzz4", "CDzz5"]
