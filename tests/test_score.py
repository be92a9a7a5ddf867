import math
import random

import pytest

from sojourn.operators import score
from sojourn.operators.cohort import Task
from sojourn.plans import jobs
from sojourn.sources import files


@pytest.fixture
def steps(spark):
    def build(*rows):
        return spark.createDataFrame(
            [(s, q, i, t, p) for s, q, seq in rows for i, (t, p) in enumerate(seq)],
            "subject_id bigint, seq bigint, step bigint, token string, p double",
        )

    return build


def chain(ps):
    total, miss = 0.0, 1.0
    for p in ps:
        total += p * miss
        miss *= 1 - p
    return total


def test_first_hit_counts_up_to_the_passing_step(steps):
    rows = steps(
        (1, 0, [("A", 0.2), ("TIME_M_1", 0.3), ("TIME_D_1", 0.4), ("B", 0.5)]),
        (1, 1, [("A", 0.0)]),
        (2, 0, [("A", 0.1), ("B", 1.0), ("C", 0.2)]),
    )
    got = {(r[0], r[1]): r["score"] for r in score.first_hit_probability(rows, 30).collect()}
    assert got[1, 0] == pytest.approx(chain([0.2, 0.3, 0.4]))
    assert got[1, 1] == 0 and got[2, 0] == 1
    free = {(r[0], r[1]): r["score"] for r in score.first_hit_probability(rows, 30, False).collect()}
    assert free[1, 0] == pytest.approx(chain([0.2, 0.3, 0.4, 0.5]))


def test_target_mass(spark):
    df = spark.sql("SELECT array(1000.0D, 1001.0D, 999.0D) AS logits")
    got = df.selectExpr(score.target_mass("logits", [1, 2, 77])).first()[0]
    e = [math.exp(-1), 1.0, math.exp(-2)]
    assert got == pytest.approx((e[1] + e[2]) / sum(e))


def test_prediction_rows(spark, steps):
    rows = steps(
        (1, 1, [("A", 0.5)]),
        (1, 0, [("B", 0.25), ("</s>", 0.0), ("TIME_D_1", 0.0)]),
    )
    scored = score.scored_sequences(rows, ["A"], 30)
    subjects = spark.createDataFrame(
        [(1, "x", 1), (2, "y", 0)], "subject_id bigint, original_text string, label_token int"
    )
    made = score.prediction_rows(subjects, scored, 2, 3, "it's")
    got = {r["subject_id"]: r for r in made.collect()}
    assert got[1]["generated_text"] == ["B TIME_D_1", "A"] and got[1]["pred_labels"] == [0, 1]
    assert got[1]["probability"] == 0.5
    assert got[1]["probability_scores"] == [pytest.approx(0.25), pytest.approx(0.5)]
    assert got[2]["generated_text"] == [] and got[2]["probability"] is None
    assert got[2]["probability_scores"] == [] and got[2]["model_name"] == "it's"


def test_losses(spark):
    rows = spark.createDataFrame(
        [(1, 0, 5, 2.0), (1, 0, -100, 9.0), (1, 1, 5, 4.0), (2, 0, -100, 3.0), (3, 1, 7, 1.0)],
        "subject_id bigint, batch_id bigint, label bigint, loss double",
    )
    examples = {r[0]: r[1] for r in score.example_losses(rows).collect()}
    assert examples == {1: 3.0, 2: 0.0, 3: 1.0}
    assert {r[0]: r[1] for r in score.subject_losses(rows).collect()} == {1: 4.0, 2: 0.0, 3: 1.0}
    assert score.overall_loss(rows).first()["test_loss"] == (2.0 + 2.5) / 2


def test_validation_loss_skips_nan(spark):
    rows = spark.sql("SELECT explode(array(1.0D, double('NaN'), 3.0D)) AS loss")
    row = score.mean_validation_loss(rows).first()
    assert (row["avg_loss"], row["message"]) == (2.0, None)
    row = score.mean_validation_loss(rows.where("isnan(loss)")).first()
    assert row["avg_loss"] is None and "no numeric loss" in row["message"]


@pytest.fixture
def words(spark):
    names = ["A", "B", "TIME_D_1", "TIME_M_1", "TIME_Y_1", "AB", "<unk>", "<s>", "</s>", "<pad>"]
    return spark.createDataFrame([(t, i) for i, t in enumerate(names)], "token string, token_id bigint")


def told(names, p, targets, horizon, bound=True):
    """Label, score and text of one sequence, step by step."""
    days, miss, hit, label = 0, 1.0, 0.0, 0
    for name, mass in zip(names, p, strict=True):
        if days <= horizon or not bound:
            hit += miss * mass
            miss *= 1 - mass
        if days <= horizon and not name.startswith("TIME_") and any(t in name for t in targets):
            label = 1 if not name.startswith("<") else label
        days += {"TIME_D_1": 1, "TIME_M_1": 30, "TIME_Y_1": 365}.get(name, 0)
    return label, hit, " ".join(n for n in names if not n.startswith("<"))


@pytest.mark.parametrize("bound", [True, False])
def test_fold_equals_step_by_step(spark, words, bound):
    draw = random.Random(7)
    names = [r["token"] for r in words.orderBy("token_id").collect()]
    rows, want = [], {}
    for subject in range(12):
        for seq in range(3):
            ids = [draw.randrange(len(names)) for _ in range(draw.randrange(1, 9))]
            logits = [[draw.uniform(-3, 3) for _ in names] for _ in ids]
            mass = [math.exp(x[0]) / sum(map(math.exp, x)) for x in logits]
            want[subject, seq] = told([names[i] for i in ids], mass, ["A"], 30, bound)
            rows += [(subject, seq, n, i, x) for n, (i, x) in enumerate(zip(ids, logits, strict=True))]
    draw.shuffle(rows)
    steps = spark.createDataFrame(
        rows, "subject_id bigint, seq bigint, step bigint, token_id bigint, logits array<double>"
    )
    made = score.decoded_steps(steps, words, ["A"])
    got = {(r[0], r[1]): r for r in score.scored_sequences(made, ["A"], 30, bound).collect()}
    assert set(got) == set(want)
    for key, (label, hit, text) in want.items():
        assert (got[key]["pred_label"], got[key]["generated_text"]) == (label, text)
        assert got[key]["score"] == pytest.approx(hit, abs=1e-12)


def test_shared_logits_equal_own(spark, words):
    lists = spark.sql("SELECT * FROM VALUES (1L, array(1.0D, 0.5D, -2.0D)), (2L, array(0.0D, 3.0D, 1.0D)) "
                      "AS t(logits_id, logits)")
    drawn = spark.sql("SELECT id AS subject_id, 0L seq, 0L step, id % 3 AS token_id, "
                      "IF(id = 6, NULL, id % 2 + 1 + id div 7) AS logits_id FROM range(8)")
    own = score.decoded_steps(drawn.join(lists, "logits_id", "left"), words, ["A"])
    shared = score.decoded_steps(drawn, words, ["A"], lists)
    want = {r["subject_id"]: tuple(r) for r in own.collect()}
    assert len(want) == 8 and sum(r[4] is None for r in want.values()) == 2
    assert {r["subject_id"]: tuple(r) for r in shared.collect()} == want


def test_fold_edges(spark, words, steps):
    rows = steps(
        (1, 0, [("TIME_Y_1", None), ("A", 0.5)]),
        (2, 0, [("<pad>", 1.5), ("A", 0.5)]),
        (3, 0, [(None, 0.25)]),
        (4, 0, [("TIME_Y_1", 0.5), ("TIME_X_9", 0.5)]),
    )
    got = {r[0]: tuple(r)[2:] for r in score.scored_sequences(rows, ["A"], 30).collect()}
    assert got[1] == ("TIME_Y_1 A", 0, 0.0) and got[2] == ("A", 1, 1.0)
    assert got[3] == ("", 0, 0.25) and got[4] == ("TIME_Y_1 TIME_X_9", 0, 0.5)
    assert {r["pred_label"] for r in score.scored_sequences(rows, [], 30).collect()} == {0}
    assert score.scored_sequences(rows.limit(0), ["A"], 30).count() == 0
    with pytest.raises(Exception, match="unknown gap token"):
        score.scored_sequences(steps((1, 0, [("TIME_X_9", 0.5)])), ["A"], 30).collect()
    assert score.target_ids(words, ["A", "missing"]) == [0]
    ids = spark.sql("SELECT 1L subject_id, 0L seq, 0L step, 77L token_id, array(1.0D) logits")
    row = score.decoded_steps(ids, words, ["missing"]).first()
    assert (row["token"], row["p"]) == (None, 0.0)


def test_steps_move_once(spark, steps):
    """Between the steps and the rows per subject there is one exchange of steps."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = steps((1, 0, [("A", 0.5)]))
        plan = score.regrouped(score.scored_sequences(rows, ["A"], 30))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange ") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scoring_job(spark, words, tmp_path):
    evaluation = spark.sql(
        "SELECT * FROM VALUES (1L, 'x y A z', 3, 1), (2L, 'x', 1, 0) "
        "AS t(subject_id, text, stopping_time, label_token)"
    )
    steps = spark.sql(
        "SELECT 1L subject_id, 0L seq, n AS step, element_at(array(8L, 0L), int(n + 1)) AS token_id, "
        "array(0.0D, 0.0D) AS logits FROM (SELECT explode(sequence(0L, 1L)) AS n)"
    )
    losses = spark.sql("SELECT explode(array(1.0D, double('NaN'), 2.0D)) AS loss")
    path = f"file://{tmp_path}/predictions"
    task = Task(targets=("A",), horizon_days=30)
    mean = jobs.scoring_job(evaluation, steps, words, path, task, 1, 2, "m", losses).first()
    assert mean["avg_loss"] == 1.5
    got = {r["subject_id"]: r for r in files.read_predictions(spark, path).collect()}
    assert got[1]["original_text"] == "x y A" and got[1]["generated_text"] == ["A"]
    assert got[1]["pred_labels"] == [1] and got[1]["probability_scores"] == [0.75]
    assert got[2]["generated_text"] == [] and got[2]["probability"] is None
