import random

import pytest

from sojourn.functions import tokens as X
from sojourn.operators import curate
from sojourn.operators.quantiles import decile_breaks, with_decile_tokens

DAY = 86400.0


def text_of(df):
    return {r["subject_id"]: r["text"] for r in df.collect()}


def test_sequence_by_hand(events):
    rows = events(
        (7, None, "SEXzz1"),
        (7, None, "GENzz1"),
        (7, -3650 * DAY, "MEDSzzBIRTH"),
        (7, 0.0, "CDzz1", None, 5, "Emergency Room Visit"),
        (7, DAY, "PRzz1", None, 5, "Emergency Room Visit"),
        (7, 3 * DAY, "MSzz1", 4.5, 6, "Telehealth visit"),
        (7, 3 * DAY, "DRzz1", 1.0, 6, "Telehealth visit"),
        (7, 40 * DAY, "VSzz9"),
    )
    want = (
        "GENzz1 SEXzz1 MEDSzzBIRTH TIME_10Y_1 VIER CDzz1 TIME_D_1 PRzz1 VIEnd "
        "TIME_D_2 Other DRzz1 Q0 MSzz1 Q0 VIEnd TIME_M_1 VSzz9"
    )
    assert text_of(curate.sequences(rows)) == {7: want}
    assert text_of(curate.sequences(rows, max_tokens=5)) == {7: " ".join(want.split()[:5])}


def test_no_start_token_on_first_row_and_no_end_token_on_last(events):
    rows = events(
        (1, 0.0, "A", None, 3, "Office Visit"),
        (1, 1.0, "B", None, 4, "Office Visit"),
        (1, 2.0, "C", None, 3, "Office Visit"),
    )
    assert text_of(curate.sequences(rows)) == {1: "A VIEnd VIOP B VIEnd VIOP C"}


def test_visit_types(events):
    rows = events(
        (1, 0.0, "A"),
        (1, 1.0, "B", None, 1, None),
        (1, 2.0, "C", None, 2, "no such visit"),
        (1, 3.0, "D", None, 3, "Pharmacy"),
        (1, 4.0, "E", None, None, "Pharmacy"),
    )
    want = "A B VIEnd Other C VIEnd VIPharm D VIEnd VIPharm E"
    assert text_of(curate.sequences(rows)) == {1: want}


GAPS = {
    0: None, 1: "D_1", 6: "D_6", 7: "W_1", 29: "W_4", 30: "M_1", 359: "M_11", 360: "M_11",
    364: "M_11", 365: "Y_1", 3649: "Y_9", 3650: "10Y_1", 29199: "10Y_7", 29200: "10Y_8",
    40000: "10Y_8",
}
OPEN_GAPS = {0: "DUMMY", 6: "TIME_D_6", 360: "TIME_M_12", 40000: "TIME_10Y_10"}


def test_gap_tokens(spark):
    days = spark.createDataFrame([(d,) for d in GAPS], "d bigint")
    got = {r[0]: r[1] for r in days.selectExpr("d", X.gap_token("d")).collect()}
    assert got == {d: t and f"TIME_{t}" for d, t in GAPS.items()}
    free = {r[0]: r[1] for r in days.selectExpr("d", X.open_gap_token("d")).collect()}
    assert {d: free[d] for d in OPEN_GAPS} == OPEN_GAPS


def test_gap_needs_a_whole_day(events):
    rows = events((1, 0.0, "A"), (1, DAY - 1, "B"), (1, 2 * DAY - 1, "C"))
    assert text_of(curate.sequences(rows)) == {1: "A B TIME_D_1 C"}


def brute_breaks(values):
    values, out = sorted(values), []
    for k in range(1, 10):
        at = (len(values) - 1) * (k / 10)
        low = int(at)
        high = min(low + (at > low), len(values) - 1)
        a, b, part = values[low], values[high], at - low
        out.append(a if a == b or part == 0 else a * (1 - part) + b * part)
    return out


@pytest.mark.parametrize("lane_rows", [1_000_000, 3])
def test_deciles_against_sorting(events, lane_rows):
    rng = random.Random(3)
    data = {
        "one": [4.0],
        "two": [1.0, 2.0],
        "same": [5.0] * 9,
        "ten": [float(i) for i in range(10)],
        "ties": [float(rng.randint(0, 6)) for _ in range(60)],
        "many": [rng.random() for _ in range(101)],
    }
    rows = [(1, 0.0, c, v) for c, vs in data.items() for v in vs] + [(1, 0.0, "none", None)]
    frame = events(*rows)
    got = {r["code"]: r["breaks"] for r in decile_breaks(frame, lane_rows).collect()}
    assert set(got) == set(data)
    for code, vs in data.items():
        assert got[code] == pytest.approx(brute_breaks(vs), abs=1e-12)
    tokens = with_decile_tokens(frame, decile_breaks(frame, lane_rows)).collect()
    for r in tokens:
        if r["numeric_value"] is None:
            assert r["quantile_token"] is None
        else:
            below = sum(b < r["numeric_value"] for b in brute_breaks(data[r["code"]]))
            assert r["quantile_token"] == f"Q{below}"


def random_events(rng, subjects=6, n=240):
    types = ["Office Visit", "Hospital", "strange", None]
    rows = []
    for _ in range(n):
        # Subject 1 holds about a third of the rows, and a mass of equal ones.
        s = 1 if rng.random() < 0.35 else rng.randint(2, subjects)
        if s == 1 and rng.random() < 0.5:
            rows.append((1, 5 * DAY, "CDzz0", 1.0, 2, "Hospital"))
        else:
            v = rng.choice([None, rng.randint(1, 4)])
            rows.append(
                (
                    s,
                    rng.choice([None, DAY * rng.randint(0, 900)]),
                    f"CDzz{rng.randint(0, 5)}",
                    rng.choice([None, float(rng.randint(0, 9))]),
                    v,
                    rng.choice(types),
                )
            )
    return rows


def test_heavy_subject_in_lanes_equals_plain_windows(events):
    rows = events(*random_events(random.Random(8)))
    plain = curate.tokenised_events(rows)
    assert len(curate.ordered_frames(rows, heavy_rows=20)) == 2
    laned = curate.tokenised_events(rows, heavy_rows=20).select(*plain.columns)
    assert sorted(map(repr, laned.collect())) == sorted(map(repr, plain.collect()))
    whole = text_of(curate.sequences(rows, max_tokens=40))
    assert text_of(curate.sequences(rows, max_tokens=40, heavy_rows=20)) == whole


def test_parts_join_to_the_whole(events):
    rows = events(*random_events(random.Random(9)))
    whole = text_of(curate.sequences(rows, max_tokens=100_000))
    parts = curate.sequence_parts(rows, part_events=7, heavy_rows=20).collect()
    joined = {}
    for r in sorted(parts, key=lambda r: (r["subject_id"], r["part"])):
        joined.setdefault(r["subject_id"], []).append(r["text"])
    assert {s: " ".join(p) for s, p in joined.items()} == whole


def test_unbounded_sequences_need_a_length(events):
    with pytest.raises(ValueError):
        curate.sequences(events((1, 0.0, "A")), max_tokens=None)


def test_time_types(spark):
    stamps = spark.sql("SELECT timestamp'1970-01-02 00:00:00' AS time")
    assert curate.with_time_columns(stamps).first()["time"] == DAY
    whole = spark.sql("SELECT 5L AS time")
    row = curate.with_time_columns(whole).selectExpr("time", "timestamp", "datetime").first()
    assert (row["time"], row["timestamp"]) == (5.0, 5e6)
    with pytest.raises(ValueError):
        curate.with_time_columns(spark.sql("SELECT 'x' AS time"))
