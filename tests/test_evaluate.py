import hashlib
import random
import statistics

import pytest

from sojourn.functions.seeded import poisson_cuts
from sojourn.operators import evaluate, prs
from sojourn.plans import jobs


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture
def scored(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), round(rng.random(), 2), int(rng.random() < 0.3)) for i in range(300)]
    rows += [(1000 + i, "c", 0.5, 1) for i in range(4)]
    return rows, spark.createDataFrame(rows, "subject_id bigint, g string, s double, y int")


@pytest.mark.parametrize("lane_rows", [10_000, 7])
def test_auc_against_pairs(scored, lane_rows):
    rows, df = scored
    got = evaluate.roc_auc(df, "s", "y", lane_rows=lane_rows).first()
    assert got["auc"] == pytest.approx(brute_auc([(s, y) for _, _, s, y in rows]))
    by = {r["g"]: r["auc"] for r in evaluate.roc_auc(df, "s", "y", ["g"], lane_rows).collect()}
    assert set(by) == {"a", "b"}
    for g in by:
        assert by[g] == pytest.approx(brute_auc([(s, y) for _, x, s, y in rows if x == g]))


@pytest.mark.parametrize("scores,want", [([1, 2, 3, 4], 1.0), ([4, 3, 2, 1], 0.0), ([5] * 4, 0.5)])
def test_auc_extremes(spark, scores, want):
    rows = [(float(s), y) for s, y in zip(scores, [0, 0, 1, 1])]
    df = spark.createDataFrame(rows, "s double, y int")
    assert evaluate.roc_auc(df, "s", "y").first()["auc"] == want
    assert evaluate.roc_auc(df.where("y = 1"), "s", "y").count() == 0


def test_bootstrap(scored):
    rows, df = scored
    options = {"score": "s", "label": "y", "seed": 3}
    row = evaluate.bootstrap_interval(df, 300, **options).first()
    auc = brute_auc([(s, y) for _, _, s, y in rows])
    assert row["n_valid"] == 300 and row["ci_low"] < auc < row["ci_high"]
    assert 0.05 < row["ci_high"] - row["ci_low"] < 0.25
    again = evaluate.bootstrap_interval(df, 300, **options).first()
    laned = evaluate.bootstrap_interval(df, 300, lane_rows=9, **options).first()
    assert again == row
    assert laned["ci_low"] == pytest.approx(row["ci_low"])


def test_single_class_replicates_are_replaced(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (2, 0.9, 1)], "subject_id bigint, s double, y int")
    row = evaluate.bootstrap_interval(df, 50, score="s", label="y").first()
    assert (row["n_valid"], row["ci_low"], row["ci_high"]) == (50, 1.0, 1.0)


def test_aggregates(spark):
    lists = [[0.1, 0.9, 0.2], [0.4, 0.1, 0.2, 0.9], [0.7], []]
    df = spark.createDataFrame([(v,) for v in lists], "v array<double>")
    for how, fn in [("mean", statistics.mean), ("max", max), ("median", statistics.median)]:
        got = [r[0] for r in df.selectExpr(evaluate.aggregated("v", how)).collect()]
        assert got[:3] == [pytest.approx(fn(v)) for v in lists[:3]] and got[3] is None
    with pytest.raises(ValueError):
        evaluate.aggregated("v", "sum")


def test_age_buckets(spark):
    ages = [0.0, 17.99, 18.0, 24.9, 25.0, 45.0, 64.99, 65.0, 120.0]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    got = [r[0] for r in df.selectExpr(evaluate.age_bucket("a")).collect()]
    assert got == ["<18", "<18", "18-25", "18-25", "25-35", "45-55", "55-65", "65+", "65+"]


@pytest.fixture
def predictions(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        years = rng.choice(["TIME_10Y_2", "TIME_10Y_7"])
        rows.append((i, f"A {years} B", [rng.random() for _ in range(3)], int(rng.random() < 0.5)))
    return spark.createDataFrame(
        rows, "subject_id bigint, original_text string, probability_scores array<double>, label_token int"
    )


@pytest.fixture
def scores(spark):
    rows = [(i, [[0.0, float(i % 3)]]) for i in range(120)]
    return spark.createDataFrame(rows, "subject_id bigint, prs array<array<double>>")


def test_evaluation_job(predictions, scores):
    out = jobs.evaluation_job(predictions, scores, "median", True, True, iterations=40)
    assert out["overall"].first()["n"] == 120
    assert [r["age_bucket"] for r in out["age"].collect()] == ["18-25", "65+"]
    assert {r["has_prs"]: r["n"] for r in out["prs"].collect()} == {False: 40, True: 80}
    with pytest.raises(ValueError):
        jobs.evaluation_job(predictions, by_prs=True)
    with pytest.raises(ValueError):
        evaluate.prepared(predictions, prs=scores.where("subject_id > 0"))


def test_prs_preparation(spark):
    df = spark.sql("SELECT array(array(-5000D, 500D), array(0D, 2000D)) AS prs")
    row = prs.prepared(df).first()
    assert row["features"] == [-1.0, 0.5, 0.0, 1.0] and row["has_prs"]
    zero = spark.sql("SELECT array(array(0D)) AS prs")
    assert not prs.prepared(zero).first()["has_prs"]


def test_missing_scores_and_single_class(spark, monkeypatch):
    rows = [(1, 0.1, 0), (2, 0.9, 1), (3, None, 1), (4, float("nan"), 0), (5, 0.5, None)]
    df = spark.createDataFrame(rows, "subject_id int, probability_agg double, label_token int")
    with pytest.raises(ValueError, match="only 2 of 5"):
        evaluate.report(df, iterations=5)
    assert evaluate.report(df, iterations=5, allow_missing=True).first()["n"] == 2
    drawn = []
    monkeypatch.setattr(evaluate, "replicate_aucs", lambda *a, **k: drawn.append(a))
    assert evaluate.report(df.where("label_token = 1 AND subject_id = 2")).collect() == []
    assert not drawn


def test_auc_refuses_missing_scores(spark):
    rows = [(0.1, 0), (0.9, 1), (None, 1), (float("nan"), 0), (0.5, None), (0.4, 3)]
    df = spark.createDataFrame(rows, "s double, y int")
    for odd in rows[2:]:
        with pytest.raises(ValueError, match="only 2 of 3"):
            evaluate.roc_auc(spark.createDataFrame([*rows[:2], odd], "s double, y int"), "s", "y")
    row = evaluate.roc_auc(df, "s", "y", allow_missing=True).first()
    assert (row["n_pos"], row["n_neg"], row["auc"]) == (1, 1, 1.0)


def brute_replicate(rows, b, seed):
    cuts, drawn = poisson_cuts(), []
    for i, score, label in rows:
        text = f"{seed}|{b}" if i is None else f"{seed}|{b}|{i}"
        h = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
        drawn += [(score, label)] * sum(h >= c for c in cuts)
    return brute_auc(drawn)


@pytest.mark.parametrize("lane_rows", [4096, 3])
def test_replicates_are_those_of_plain_draws(spark, lane_rows, monkeypatch):
    rng = random.Random(9)
    rows = [(i, rng.randrange(6) / 5, int(rng.random() < 0.4)) for i in range(90)]
    rows += [(i, 0.4, i % 2) for i in range(100, 140)] + [(None, 0.2, 1), (7, 0.2, 0)]
    df = spark.createDataFrame(rows, "k int, s double, y int")
    monkeypatch.setattr(evaluate, "DRAW_CELLS", 50)
    lanes = evaluate.score_lanes(df, "k", "s", "y", lane_rows=lane_rows)
    got = {r["b"]: r["auc"] for r in evaluate.replicate_aucs(lanes, (3, 40), (), 8).collect()}
    assert got == {b: pytest.approx(brute_replicate(rows, b, 8)) for b in range(3, 40)}


def test_totals_per_piece_are_exchanged_not_draws(spark):
    def exchanged(n, replicates):
        df = spark.range(n).selectExpr("id AS k", "id / 7 AS s", "cast(id % 2 as int) AS y")
        lanes = evaluate.score_lanes(df, "k", "s", "y", lane_rows=n)
        pieces = lanes.count()
        assert lanes.selectExpr("sum(size(rows))").first()[0] == n
        return evaluate._drawn(lanes, 0, replicates, (), 0).count(), pieces

    few, pieces = exchanged(400, 20)
    many, more_pieces = exchanged(4000, 20)
    assert few == pieces * 20 and many == more_pieces * 20 and more_pieces <= 2 * pieces


def test_prs_rows_must_match_by_subject(spark):
    rows = [(1, "AGE_3", [0.5], 0), (2, "AGE_3", [0.5], 1)]
    kind = "subject_id int, original_text string, probability_scores array<double>, label_token int"
    predictions = spark.createDataFrame(rows, kind)
    prs = spark.createDataFrame([(1, [0.0]), (3, [1.0])], "subject_id int, prs array<double>")
    with pytest.raises(ValueError, match="2 subjects"):
        evaluate.prepared(predictions, prs=prs)
