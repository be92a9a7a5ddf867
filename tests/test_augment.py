import hashlib
import random

import pytest

from sojourn.operators import augment
from sojourn.schema import Augmentation


def spans_of(tokens):
    """Scan: a visit opens at a visit token and runs to the next end token, or to the end."""
    spans, start = [], None
    for i, t in enumerate(tokens):
        if start is None and t.startswith("VI") and t != "VIEnd":
            start = i
        elif start is not None and t == "VIEnd":
            spans.append((start, i))
            start = None
    return spans + ([(start, len(tokens) - 1)] if start is not None else [])


def random_text(rng):
    pool = ["VIER", "VIOP", "VIEnd", "VIEnd", "CDzz1", "TIME_D_1", "Other", "Q3"]
    return " ".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(12)
    return {i: random_text(rng) for i in range(150)} | {900: "VIER", 901: "CDzz1", 902: "VIEnd VIER"}


def test_spans_against_a_scan(texts, sample):
    rows = texts(*sample.items()).selectExpr("subject_id", "split(text, ' ') AS tokens")
    for r in augment.with_visit_spans(rows).collect():
        assert [tuple(s) for s in r["spans"]] == spans_of(r["tokens"])


def test_spans_are_made_once_however_they_are_read(texts, sample):
    rows = texts(*sample.items()).selectExpr("subject_id", "split(text, ' ') AS tokens")
    spans = augment.with_visit_spans(rows).selectExpr("subject_id", "inline(spans)")
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1 and plan.count("VIEnd") == 1
    want = [(i, *s) for i, text in sample.items() for s in spans_of(text.split(" "))]
    assert sorted(tuple(r) for r in spans.collect()) == sorted(want)


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def drop_loop(tokens, subject, copy, target, max_extra, seed):
    """Remove drawn visits one by one, with the draws that the library makes."""
    spans = spans_of(tokens)
    waiting = sorted(range(len(spans)), key=lambda i: digest(seed, "visit", subject, copy, i))
    extra = int(digest(seed, "extra", subject, copy)[:8], 16) % (max_extra + 2)
    length, taken, gone = len(tokens), 0, set()
    for i in waiting:
        fits = target is None or length <= target
        if fits and taken >= extra:
            break
        taken += fits
        a, b = spans[i]
        length -= b - a + 1
        gone |= set(range(a, b + 1))
    return " ".join(t for i, t in enumerate(tokens) if i not in gone)


@pytest.mark.parametrize("target", [8, 1000, None])
def test_visit_drop_against_a_loop(texts, sample, target):
    settings = Augmentation(target, copies=3, max_extra_visits=3)
    got = augment.visit_dropped_copies(texts(*sample.items()), settings, seed=5).collect()
    assert len(got) == 3 * len(sample)
    changed = 0
    for r in got:
        before = sample[r["subject_id"]]
        assert r["text"] == drop_loop(before.split(" "), r["subject_id"], r["copy"], target, 3, 5)
        changed += r["text"] != before
    assert changed > 100


def test_settings(texts):
    with pytest.raises(ValueError):
        Augmentation(None, copies=2, max_extra_visits=0)
    assert not Augmentation(None, copies=1, max_extra_visits=0).drops_visits


def test_only_training_rows_are_augmented(spark):
    rows = spark.createDataFrame(
        [(1, "VIER a VIEnd b", "train", [[0.0, 2.0]]), (2, "VIER c", "test", [[1.0]]), (3, "d", "train", [[0.0]])],
        "subject_id bigint, text string, split string, prs array<array<double>>",
    )
    settings = Augmentation(2048, 2, 3, zero_prs_copy=True)
    got = augment.augmented(rows, settings).collect()
    count = {}
    for r in got:
        count[r["subject_id"]] = count.get(r["subject_id"], 0) + 1
    assert count == {1: 4, 2: 1, 3: 2}
    assert {str(r["prs"]) for r in got if r["subject_id"] == 1 and r["zeroed"] == 1} == {"[[0.0, 0.0]]"}
    plain = augment.augmented(rows, Augmentation(None, 1, 0))
    assert plain.count() == 3


def test_ids_are_cut_like_the_text(spark, sample):
    rows = spark.createDataFrame(
        [(i, t, "train" if i % 3 else None, [[i, k] for k, _ in enumerate(t.split(" "))]) for i, t in sample.items()],
        "subject_id bigint, text string, split string, word_ids array<array<bigint>>",
    )
    got = augment.augmented(rows, Augmentation(8, copies=2, max_extra_visits=1), seed=3).collect()
    assert len(got) == sum(2 if i % 3 else 1 for i in sample)
    for r in got:
        before = sample[r["subject_id"]].split(" ")
        at = [k for _, k in r["word_ids"]]
        assert " ".join(before[k] for k in at) == r["text"] and at == sorted(at)
        want = drop_loop(before, r["subject_id"], r["copy"], 8, 1, 3) if r["split"] else " ".join(before)
        assert r["text"] == want


def test_row_split_sizes(texts):
    rows = augment.split_rows(texts(*[(i, "x") for i in range(25)]))
    assert rows.where("split = 'train'").count() == int(0.9 * 25)
