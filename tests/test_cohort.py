import dataclasses
import hashlib
import random

import pytest

from sojourn import schema as S
from sojourn.functions import tokens as X
from sojourn.operators import cohort

BIRTH = S.BIRTH_CODE


def draw(n, *parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) % n


def label_of(tokens, start, targets, horizon, exact=False):
    days = 0
    for t in tokens[start:]:
        if t.startswith("TIME_"):
            days += S.GAP_DAYS[t]
            if days > horizon:
                return 0
        elif any(x == t if exact else x in t for x in targets):
            return 1
    return 0


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(2)
    pool = ["CDzz1", "CDzz12", "CDzz3", "VIEnd", "VIER", "TIME_D_3", "TIME_M_2", "TIME_Y_1", "Q.1"]
    out = {}
    for i in range(120):
        tokens = [rng.choice(pool) for _ in range(rng.randint(1, 50))]
        tokens.insert(rng.randint(0, min(4, len(tokens))), BIRTH)
        out[i] = tokens
    out[500] = ["a", BIRTH]
    out[501] = [BIRTH, "TIME_Y_1", "CDzz12"]
    return out


@pytest.fixture
def rows(texts, sample):
    return texts(*[(i, " ".join(t)) for i, t in sample.items()], (999, "no birth"))


def test_candidates(rows, sample):
    got = {r["subject_id"]: r for r in cohort.candidates(rows).collect()}
    assert set(got) == set(sample)
    for i, tokens in sample.items():
        birth = tokens.index(BIRTH)
        years = sum(S.GAP_DAYS.get(t, 0) for t in tokens[birth + 2 :]) / 365
        assert (got[i]["len"], got[i]["birth_token"]) == (len(tokens), birth)
        assert got[i]["time_ehr"] == pytest.approx(years)
    few = cohort.candidates(rows, min_years=1.0).collect()
    assert {r["subject_id"] for r in few} == {i for i in got if got[i]["time_ehr"] > 1.0}


def test_part_of_a_token_is_no_birth(texts):
    assert cohort.with_birth(texts((1, f"x{BIRTH} y"))).count() == 0


def test_first_target(rows, sample):
    task = cohort.Task(targets=("CDzz12", "CDzz3"))
    found = cohort.labelled(rows, task, stop_before_stopping_time=True)
    for r in found.collect():
        hits = [i for i, t in enumerate(sample[r["subject_id"]]) if t in task.targets]
        assert r["first_target"] == (hits[0] if hits else -1)
    assert "stopping_time" not in found.columns


@pytest.mark.parametrize("match", ["contains", "exact"])
@pytest.mark.parametrize("horizon", [0, 60, 63, 365, 730])
def test_labels_against_a_scan(rows, sample, match, horizon):
    label = cohort.horizon_label("tokens", "len div 3", "array('CDzz1', 'Q.1')", horizon, match, "gaps")
    got = cohort.with_birth(rows).selectExpr("subject_id", f"{label} AS y").collect()
    for r in got:
        tokens = sample[r["subject_id"]]
        want = label_of(tokens, len(tokens) // 3, ["CDzz1", "Q.1"], horizon, match == "exact")
        assert r["y"] == want


def test_target_text_is_not_a_pattern(texts):
    rows = cohort.with_birth(texts((1, f"{BIRTH} QX1")))
    label = cohort.horizon_label("tokens", 0, "array('Q.1')", 9)
    assert rows.selectExpr(label).first()[0] == 0
    none = cohort.horizon_label("tokens", 0, "cast(array() as array<string>)", 9)
    assert rows.selectExpr(none).first()[0] == 0


def test_horizon_is_inclusive_and_unknown_gaps_fail(texts):
    rows = cohort.with_birth(texts((1, f"{BIRTH} TIME_Y_1 A")))
    for horizon, want in [(365, 1), (364, 0)]:
        assert rows.selectExpr(cohort.horizon_label("tokens", 0, "array('A')", horizon)).first()[0] == want
    bad = cohort.with_birth(texts((1, f"{BIRTH} TIME_M_12 A")))
    with pytest.raises(Exception, match="unknown gap token"):
        bad.selectExpr(cohort.horizon_label("tokens", 0, "array('A')", 5)).collect()


def end_visit(tokens, subject, target, exclude, strict):
    if target >= 0:
        tokens = tokens[:target]
    elif not strict:
        tokens = tokens[:-1]
    ends = [i for i, t in enumerate(tokens) if t == "VIEnd"]
    if len(ends) <= 1 or not ends[:-exclude]:
        return -1
    usable = ends[:-exclude]
    return usable[draw(len(usable), 0, "end_visit", subject)] + 1


@pytest.mark.parametrize("exclude,strict", [(1, False), (1, True), (3, False)])
def test_stopping_rules(rows, sample, exclude, strict):
    task = cohort.Task(targets=("CDzz3",), exclude_visits=exclude, strict_no_target=strict)
    found = cohort.labelled(rows, task, stop_before_stopping_time=True)
    stops = [f"{cohort.stopping_point(n, task)} AS stop_{n}" for n in cohort.STOPS]
    for r in found.selectExpr("subject_id", *stops).collect():
        i, tokens = r["subject_id"], sample[r["subject_id"]]
        hit = tokens.index("CDzz3") if "CDzz3" in tokens else -1
        quarter = len(tokens) // 4
        gap = next((k for k, t in enumerate(tokens) if "TIME" in t), None)
        assert r["stop_first_target"] == (hit + 1 if hit >= 0 else -1)
        assert r["stop_random"] == quarter + draw(2 * quarter + 1, 0, "random", i)
        assert r["stop_demo_age"] == (-1 if gap is None else gap + 1)
        assert r["stop_end_visit"] == end_visit(tokens, i, hit, exclude, strict)
    with pytest.raises(ValueError):
        cohort.stopping_point("never", task)


def test_years_after(rows, sample):
    at = cohort.token_years_after("tokens", "birth_token", 3)
    for r in cohort.with_birth(rows).selectExpr("subject_id", "birth_token", f"{at} AS i").collect():
        days, total = [], 0
        for t in sample[r["subject_id"]]:
            total += S.GAP_DAYS.get(t, 0)
            days.append(total)
        after = range(r["birth_token"] + 1, len(days))
        want = next((i for i in after if days[i] >= days[after[0]] + 3 * 365), -1)
        assert r["i"] == want


def test_evaluation_set_cuts_ids_and_checks_the_tail(spark):
    rows = spark.createDataFrame(
        [(1, f"{BIRTH} VIER A VIEnd B VIEnd C T", list(range(8)), [1] * 8)],
        "subject_id bigint, text string, input_ids array<bigint>, attention_mask array<int>",
    )
    task = cohort.Task(targets=("T",), stop="end_visit")
    row = cohort.evaluation_set(rows, task, eos_id=99).first()
    assert (row["stopping_time"], row["label_token"]) == (4, 1)
    assert row["input_ids"] == [0, 1, 2, 3] and row["attention_mask"] == [1] * 4
    assert cohort.evaluation_set(rows, task, window=10, new_tokens=6).count() == 0
    same = rows.selectExpr("subject_id", "text", "array_repeat(7L, 8) AS input_ids")
    with pytest.raises(Exception, match="ends in end tokens"):
        cohort.evaluation_set(same, task, eos_id=7).collect()


def test_all_tasks_in_one_pass(spark, rows):
    codes = spark.createDataFrame([("x", 1), ("y", 3), ("y", 12)], "task string, concept_id bigint")
    many = cohort.evaluation_sets(rows, codes, cohort.Task()).select("task", "subject_id", "stopping_time", "label_token")
    one = {n: cohort.evaluation_set(rows, cohort.Task(targets=t)) for n, t in [("x", ("CDzz1",)), ("y", ("CDzz12", "CDzz3"))]}
    want = [(n, r["subject_id"], r["stopping_time"], r["label_token"]) for n, d in one.items() for r in d.collect()]
    assert want and sorted(map(tuple, many.collect())) == sorted(want)


@pytest.mark.parametrize("match", ["contains", "exact"])
@pytest.mark.parametrize("stop", sorted(cohort.STOPS))
def test_index_and_patterns_answer_alike(spark, rows, monkeypatch, match, stop):
    codes = spark.createDataFrame([("x", 1), ("y", 3), ("y", 12), ("it's", 999)], S.TASK_CODES)
    task = cohort.Task(match=match, stop=stop, horizon_days=200)
    by_index = cohort.evaluation_sets(rows, codes, task)
    given = cohort.evaluation_sets(rows, codes, task, tokens=cohort.tokens_of(rows))
    monkeypatch.setattr(cohort, "target_index", lambda *_: None)
    by_pattern = cohort.evaluation_sets(rows, codes, task)
    assert set(by_index.columns) == set(by_pattern.columns)
    order = sorted(by_pattern.columns)
    want = sorted(map(str, by_pattern.select(*order).collect()))
    assert want and sorted(map(str, by_index.select(*order).collect())) == want
    assert sorted(map(str, given.select(*order).collect())) == want


def test_index_has_a_limit_and_needs_no_tasks(spark, rows, monkeypatch):
    defined, tokens = {"x": ["CDzz1"]}, cohort.tokens_of(rows)
    index = cohort.target_index(defined, cohort.Task(), tokens)
    assert index["CDzz1"] == ([0], [0]) and index["CDzz12"] == ([], [0])
    monkeypatch.setattr(cohort, "INDEX_TOKENS", len(index) - 1)
    assert cohort.target_index(defined, cohort.Task(), tokens) is None
    none = spark.createDataFrame([], S.TASK_CODES)
    assert cohort.evaluation_sets(rows, none, cohort.Task()).count() == 0
    two = spark.createDataFrame([("x", 1), ("y", 3)], S.TASK_CODES)
    monkeypatch.setattr(cohort, "MAX_TARGETS", 1)
    with pytest.raises(ValueError, match="2 task codes"):
        cohort.evaluation_sets(rows, two, cohort.Task())


@pytest.mark.parametrize("match", ["contains", "exact"])
def test_known_targets_match_like_a_column_of_targets(rows, match):
    for targets in (("CDzz1", "Q.1"), ("it's", "a\\d", "[x"), ("TIME_1",), ()):
        column = X.text_array(targets) if targets else "cast(array() as array<string>)"
        args = ("tokens", "len div 3", column, 730, match, "gaps")
        given = cohort.horizon_label(*args, hit=lambda w, t=targets: cohort.has_target(w, t, match))
        both = cohort.with_birth(rows).selectExpr(f"{cohort.horizon_label(*args)} AS a", f"{given} AS b")
        assert both.where("a <=> b").count() == both.count() > 0


@pytest.mark.parametrize("match", ["contains", "exact"])
def test_follow_up_targets_label_every_task(spark, rows, match):
    codes = spark.createDataFrame([("x", 1), ("y", 12)], "task string, concept_id bigint")
    task = cohort.Task(followup_targets=("CDzz3",), match=match)
    many = cohort.evaluation_sets(rows, codes, task).select("task", "subject_id", "label_token")
    want = []
    for name, target in (("x", "CDzz1"), ("y", "CDzz12")):
        one = cohort.evaluation_set(rows, dataclasses.replace(task, targets=(target,)))
        want += [(name, r["subject_id"], r["label_token"]) for r in one.collect()]
    assert want and sorted(map(tuple, many.collect())) == sorted(want)


def test_task_checks():
    for wrong in ({"exclude_visits": 0}, {"match": "fuzzy"}):
        with pytest.raises(ValueError):
            cohort.Task(**wrong)


def test_costly_expressions_are_planned_once(rows):
    plan = cohort.evaluation_set(rows, cohort.Task(targets=("CDzz12",)))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("arrays_overlap") == 1
