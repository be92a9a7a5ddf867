import pytest

from sojourn import schema as S
from sojourn.operators import quantiles, vocab
from sojourn.plans import jobs
from sojourn.sources import subjects

DAY = 86400.0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan()


@pytest.fixture
def store(spark, events, tmp_path):
    rows = [(s, DAY * 40 * i, f"C{i % 3}", float(i), None, None) for s in range(40) for i in range(6)]
    rows += [(7, None, "GEN1"), (None, 1.0, "C0"), (8, DAY * 999, "NEW")]
    seen = events(*rows)
    known = seen.where("code <> 'NEW'")
    path = f"file://{tmp_path}/store"
    breaks, words = quantiles.decile_breaks(known), vocab.vocabulary(known)
    subjects.write_subject_store(seen, breaks, words, path, "a", 8)
    return path, seen, breaks, words


def test_lookup_reads_one_bucket(spark, store):
    path, seen, *_ = store
    opened = subjects.open_subject_store(spark, path)
    assert opened.version == "a" and opened.events.count() == seen.where("subject_id >= 0").count()
    folders = {f.split("bucket=")[1].split("/")[0] for f in opened.events.inputFiles()}
    assert len(folders) > 1
    for subject in (0, 7, 8, 39):
        one = opened.events_of(subject)
        assert one.count() == seen.where(f"subject_id = {subject}").count()
        assert one.columns == seen.columns
        text = plan_of(one).toString()
        assert "PartitionFilters: [isnotnull(bucket" in text
        assert f"EqualTo(subject_id,{subject})" in text
        read = one.selectExpr("input_file_name() AS f").distinct().collect()
        assert len({r["f"].split("bucket=")[1].split("/")[0] for r in read}) == 1
    assert opened.events_of(12345).count() == 0


def test_versions(spark, store, events):
    path, seen, breaks, words = store
    with pytest.raises(ValueError, match="complete already"):
        subjects.write_subject_store(seen, breaks, words, path, "a", 8)
    for name in ("", "a/b", "x'y"):
        with pytest.raises(ValueError, match="no name"):
            subjects.write_subject_store(seen, breaks, words, path, name, 8)
    with pytest.raises(ValueError, match="no complete version 'b'"):
        subjects.open_subject_store(spark, path, "b")
    # What a run left that ended before its last step is not a version, and is overwritten.
    seen.limit(1).withColumn("bucket", seen["subject_id"]).write.parquet(f"{path}/version=b/events")
    assert subjects.open_subject_store(spark, path).version == "a"
    subjects.write_subject_store(events((1, 2.0, "C1")), breaks, words, path, "b", 3)
    newest = subjects.open_subject_store(spark, path)
    assert (newest.version, newest.n_buckets, newest.events.count()) == ("b", 3, 1)
    assert subjects.open_subject_store(spark, path, "a").n_buckets == 8


def test_single_subject_job(spark, store):
    opened = subjects.open_subject_store(spark, store[0])
    ids = {r["token"]: r["token_id"] for r in opened.words.collect()}
    whole = jobs.single_subject_job(opened, 8)
    row = whole["sequence"].first()
    tokens = row["text"].split(" ")
    assert (row["n_events"], row["n_tokens"]) == (7, len(tokens)) and "NEW" in tokens
    assert row["input_ids"] == [ids.get(t, ids[S.UNKNOWN]) for t in tokens]
    assert [tuple(r) for r in whole["unknown"].collect()] == [("NEW", 1)]
    short = jobs.single_subject_job(opened, 8, window=4)["sequence"].first()
    assert short["text"].split(" ") == tokens[-4:] and short["input_ids"] == row["input_ids"][-4:]
    assert short["n_tokens"] == len(tokens) and short["attention_mask"] == [1] * 4
    early = jobs.single_subject_job(opened, 7, cutoff=DAY * 40)
    got = early["sequence"].first()
    assert got["n_events"] == 2 and got["text"].startswith("GEN1 C0")
    none = jobs.single_subject_job(opened, 4711)
    assert none["sequence"].count() == 0 and none["unknown"].count() == 0
    with pytest.raises(ValueError, match="window"):
        jobs.single_subject_job(opened, 8, window=0)


def test_store_job_learns_from_kept_events(spark, events, tmp_path):
    rows = [(s, DAY * i, "C1", float(i)) for s in range(5) for i in range(3)] + [(1, 0.0, "RARE", 1.0)]
    path = f"file://{tmp_path}/made"
    limits = S.Thresholds(min_subjects_per_code=2, min_events_per_subject=1, max_events_per_subject=9)
    jobs.subject_store_job(events(*rows), path, "v-1", limits, 4)
    opened = subjects.open_subject_store(spark, path)
    assert opened.events.count() == len(rows)
    assert opened.words.where("token = 'RARE'").count() == 0 and opened.breaks.count() == 1
    assert jobs.single_subject_job(opened, 1)["unknown"].first()["token"] == "RARE"
