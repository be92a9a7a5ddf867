import hashlib
import random

import pytest

from sojourn.operators import distribute as D
from sojourn.operators.export import seeded_sample, split_events


def test_heavy_keys_are_few(spark):
    counts = spark.createDataFrame([(1, 50), (2, 30), (3, 20)], "k bigint, n bigint")
    assert [r["k"] for r in D.heavy_keys(counts, min_rows=1, shares=3)] == [1]
    assert D.heavy_keys(counts, min_rows=51, shares=3) == []
    assert D.heavy_keys(counts.where("k > 9"), min_rows=1) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_without_broadcast(spark, monkeypatch, how):
    monkeypatch.setattr(D.heavy_keys, "__defaults__", (3, 4))
    rows = [(k, i) for i, k in enumerate([1] * 9 + [2, 3, None, 5])]
    big = spark.createDataFrame(rows, "k bigint, i bigint")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k bigint, v string")
    want = sorted(map(repr, D.lookup_join(big, small, "k", how).collect()))
    got = sorted(map(repr, D.lookup_join(big, small, "k", how, max_broadcast=0).collect()))
    assert got == want
    assert got == sorted(map(repr, big.join(small, "k", how).collect()))


def test_numbered_is_the_global_order(spark):
    words = [f"{random.Random(i).randint(0, 999)}x{i}" for i in range(50)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["row_id"] for r in D.numbered(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


@pytest.mark.parametrize("keep", [0, 1, 37, 100, 120])
def test_digest_cutoff_is_exact(spark, keep):
    ids = spark.range(100).withColumnRenamed("id", "k")
    cutoff = D.digest_cutoff(ids, "k", "s", keep)
    got = {r["k"] for r in ids.where(D.drawn_within(cutoff, "s", "k")).collect()}
    ranked = sorted(range(100), key=lambda i: hashlib.md5(f"s|{i}".encode()).hexdigest())
    assert got == set(ranked[:keep])


def test_split_and_sample_sizes(spark):
    rows = spark.range(57).withColumnRenamed("id", "subject_id")
    split = split_events(rows, test_fraction=0.2)
    assert split.where("split = 'train'").count() == int(0.8 * 57)
    assert seeded_sample(rows, 10).count() == 10
    assert seeded_sample(rows, 99).count() == 57


@pytest.mark.parametrize("lane_rows", [1000, 2])
def test_running_totals(spark, lane_rows):
    rng = random.Random(1)
    cells = {(g, v): rng.randint(1, 9) for g in "ab" for v in rng.sample(range(50), 12)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in cells.items()], "g string, v int, n int")
    laned = D.lanes_by_value(df, "v", ["g"], lane_rows)
    assert ("lane" in laned.columns) == (lane_rows == 2)
    for r in D.running_before(laned, "v", ["g"], "n").collect():
        group = {v: n for (g, v), n in cells.items() if g == r["g"]}
        assert r["before"] == sum(n for v, n in group.items() if v < r["v"])
        assert r["total"] == sum(group.values())


def test_numbering_spreads_sparse_ids(spark):
    """63-bit ids and ids that share their upper digits stand in lanes of bounded size."""
    ids = [int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(900)]
    ids += [7_000_000_000 + i for i in range(900)] + list(range(-50, 50))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5)
    got = D.numbered(df, "id", lane_rows=100)
    assert {r["id"]: r["row_id"] for r in got.collect()} == {v: n for n, v in enumerate(sorted(ids))}
    assert D.numbered(df.where("false"), "id").count() == 0


def test_lanes_are_of_bounded_size(spark, monkeypatch):
    sizes = []
    kept = D.stored

    def seen(df):
        out = kept(df)
        if "_lane" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("_lane").count().collect())
        return out

    monkeypatch.setattr(D, "stored", seen)
    df = spark.range(2000).selectExpr("(id * id * 7919) % 1000003 * 4000000000000 + id AS id")
    D.numbered(df, "id", lane_rows=100).count()
    assert len(sizes) >= 15 and max(sizes) <= 300
