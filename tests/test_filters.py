import random

import pytest

from sojourn.operators import distribute, filters
from sojourn.schema import Thresholds


def brute(rows, limits):
    rows = list(rows)
    for _ in range(limits.rounds):
        seen = {}
        for r in rows:
            if r[2] is not None:
                seen.setdefault(r[2], set()).add(r[0])
        common = {c for c, s in seen.items() if len(s) >= limits.min_subjects_per_code}
        rows = [r for r in rows if r[2] in common]
        if limits.codes_only:
            return rows
        counts = {}
        for r in rows:
            counts[r[0]] = counts.get(r[0], 0) + 1
        low, high = limits.min_events_per_subject, limits.max_events_per_subject
        rows = [r for r in rows if low <= counts[r[0]] <= high]
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("codes_only", [False, True])
def test_rounds_against_loops(events, monkeypatch, broadcast, codes_only):
    if not broadcast:
        defaults = distribute.lookup_join.__defaults__
        monkeypatch.setattr(distribute.lookup_join, "__defaults__", (defaults[0], 0, defaults[2]))
    rng = random.Random(4)
    rows = [
        (rng.randint(1, 25), float(i), rng.choice([None, *[f"C{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(6)]]))
        for i in range(400)
    ]
    rows += [(99, float(i), "C1") for i in range(60)]
    limits = Thresholds(6, 8, 30, codes_only=codes_only)
    want = brute(rows, limits)
    assert 0 < len(want) < len(rows)
    got = filters.frequency_filter(events(*rows), limits)
    assert got.columns.sort() == events(*rows).columns.sort()
    assert sorted((r["subject_id"], r["time"], r["code"]) for r in got.collect()) == sorted(want)


def test_limits_are_inclusive(events):
    rows = events(*[(s, float(i), "A") for s in (1, 2, 3, 4) for i in range(s)])
    got = filters.subject_activity_filter(rows, 2, 3)
    assert {r["subject_id"] for r in got.collect()} == {2, 3}
    assert filters.rare_code_filter(rows, 4).count() == 10
    assert filters.rare_code_filter(rows, 5).count() == 0


def test_counting_keeps_no_pairs_where_events_are_read(events):
    rows = events(*[(s, float(i), f"C{i % 3}") for s in range(6) for i in range(s)], (1, 0.0, None))
    counts = filters.subject_code_counts(rows)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    # Every aggregation lies above the exchange, that is before it in the text.
    assert plan.rindex("HashAggregate") < plan.index("Exchange")
    assert {(r[0], r[1]): r[2] for r in counts.collect()} == {
        (s, f"C{k}"): n for s in range(6) for k in range(3) if (n := len(range(k, s, 3)))
    }


def test_activity_counts_hold_no_codes(events, monkeypatch):
    seen = []

    def watched(counts, low, high):
        seen.append(counts)
        return found(counts, low, high)

    found = filters.active_subjects
    monkeypatch.setattr(filters, "active_subjects", watched)
    rows = events(*[(s, float(i), f"C{i}") for s in (1, 2, 3) for i in range(s)], (1, 9.0, None))
    got = filters.subject_activity_filter(rows, 1, 2)
    assert sorted(r["subject_id"] for r in got.collect()) == [1, 1, 2, 2]
    assert seen[0].columns == ["subject_id", "n"]


@pytest.mark.parametrize("needed", [1, 3, 40, 2000])
def test_frequent_codes_equal_counts(events, needed):
    rows = [(s, 0.0, f"C{k}") for k in (1, 2, 3, 39, 40, 41, 90) for s in range(k)]
    rows += [(7, float(i), "repeated") for i in range(2500)] + [(None, 0.0, "C2"), (1, 0.0, None)]
    seen = {}
    for subject, _, code in rows:
        seen.setdefault(code, set()).add(subject)
    want = sorted(c for c, subjects in seen.items() if c and len(subjects) >= needed)
    assert sorted(r["code"] for r in filters.frequent_codes(events(*rows), needed).collect()) == want


def test_common_codes_need_no_pairs(events, monkeypatch):
    def refused(rows):
        raise AssertionError("pairs were counted")

    monkeypatch.setattr(filters, "subject_code_counts", refused)
    rows = [(s, float(i), f"C{i}") for s in range(200) for i in range(4)] + [(1, 9.0, "rare")]
    got = filters.frequency_filter(events(*rows), Thresholds(5, 2, 9))
    assert got.count() == 800 and "rare" not in {r["code"] for r in got.collect()}


@pytest.mark.parametrize("outside, how", [(2, "LeftAnti"), (20, "LeftSemi")])
def test_subjects_are_selected_by_the_shorter_list(events, monkeypatch, outside, how):
    rounds, found = [], filters.frequent_codes

    def watched(live, needed):
        rounds.append(live)
        return found(live, needed)

    monkeypatch.setattr(filters, "frequent_codes", watched)
    rows = [(s, float(i), f"C{i}") for s in range(10) for i in range(4)]
    rows += [(100 + s, 0.0, "C0") for s in range(outside)] + [(None, 0.0, "C1")]
    got = filters.frequency_filter(events(*rows), Thresholds(5, 2, 9, rounds=5))
    joins = got._jdf.queryExecution().optimizedPlan().toString()
    assert [k for k in ("LeftAnti", "LeftSemi") if f"Join {k}, (subject_id" in joins] == [how]
    assert sorted({r["subject_id"] for r in got.collect()}) == list(range(10)) and got.count() == 40
    # The second round finds the codes of the first, so the other three do not run.
    assert len(rounds) == 2
