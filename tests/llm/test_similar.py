"""Near-duplicates by five-word shingles against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from sojourn.llm import common, similar

VOCABULARY = [f"w{i}" for i in range(500)]


def variant(base, seed, changes):
    draw = np.random.default_rng(seed)
    words = list(base)
    for at in draw.integers(len(words), size=changes):
        words[at] = f"new{draw.integers(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(4)
    bases = [list(draw.choice(VOCABULARY, 200)) for _ in range(30)]
    rows = [(100 * i, " ".join(base)) for i, base in enumerate(bases)]
    rows += [(100 * i + 1, variant(base, i, 2)) for i, base in enumerate(bases[:20])]
    rows += [(10_000 + i, variant(bases[0], 50 + i, 1)) for i in range(150)]  # a crowded group
    rows += [(20_000, rows[3][1]), (300, rows[3][1].upper())]  # a copy; a repeated id
    rows += [(30_000, None), (30_001, ""), (30_002, " \n"), (30_003, "one two"), (30_004, "ONE two")]
    rows += [(None, rows[5][1]), (None, "some text of its own here"), (30_005, "a b c " * 4000)]
    return rows


def least_linked(rows):
    """Component per row by all pairs of fingerprints."""
    fps = np.array([similar.wide((text or "").encode()) for _, text in rows])
    own = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(similar._near(fps[:i], fps[i])).tolist():
            a, b = own[i], own[j]
            own = [min(a, b) if c in (a, b) else c for c in own]
    ids = {}
    for c, (i, _) in zip(own, rows, strict=True):
        ids[c] = min((k for k in (ids.get(c), i) if k is not None), default=None)
    return [ids[c] for c in own]


def test_similar_documents_share_a_group(spark, rows):
    common.ship(spark)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, f0 string")
    got = similar.near_duplicates(docs.select("doc_id", "text")).collect()
    want = least_linked(rows)
    key = lambda pair: str(pair)
    assert sorted(((r[0], r[1]) for r in got), key=key) == sorted(
        zip((i for i, _ in rows), want, strict=True), key=key
    )
    assert len({w for w in want if w is not None}) == 30 + 3  # bases; empty, two words, the long text
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({w for w in want if w is not None})
    assert ids.count(None) == 1  # the text that has no id in its group
    assert similar.one_of_each(docs.where("false")).count() == 0


def test_distance_follows_similarity():
    draw = np.random.default_rng(6)
    base = list(draw.choice(VOCABULARY, 400))
    for seed in range(10):  # 8 changed words leave a similarity of about 0.82
        a, b = " ".join(base).encode(), variant(base, seed, 8).encode()
        assert np.bitwise_count(similar.wide(a) ^ similar.wide(b)).sum() <= similar.MOST_BITS + 6
    other = " ".join(draw.choice(VOCABULARY, 400)).encode()
    assert np.bitwise_count(similar.wide(a) ^ similar.wide(other)).sum() > 90


def parted(spark, fps, size, tables=similar.TABLES):
    """Rows of the first tables, split into parts and sorted as a task gets them."""
    table = spark.createDataFrame(fps.to_pandas())
    dealt = pa.Table.from_batches(list(similar._dealt(fps.to_batches(), 0, tables)))
    rows = spark.createDataFrame(dealt.to_pandas())
    common.ship(spark)
    split = similar.by_part(rows, similar.place_counts(table, 0, tables), size)
    return split.toArrow().sort_by([("place", "ascending"), ("part", "ascending")]).combine_chunks()


@pytest.mark.parametrize("cell,size", [(64, 1 << 17), (2, 1 << 17), (2, 40)])
def test_crowded_cells_and_long_places(spark, monkeypatch, cell, size):
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(similar, "ROWS", size)
    draw = np.random.default_rng(2)
    fps = draw.integers(0, 2**63, (12, 4), dtype=np.uint64)
    fps = np.repeat(fps, 25, axis=0)
    for row in range(len(fps)):  # up to eight flipped bits
        for bit in draw.integers(256, size=8).tolist():
            fps[row, bit // 64] ^= np.uint64(1 << bit % 64)
    signed = fps.view(np.int64)
    batch = {"id": pa.array(np.arange(len(fps)))} | {
        w: pa.array(np.ascontiguousarray(signed[:, k])) for k, w in enumerate(similar.WORDS)
    }
    dealt = parted(spark, pa.table(batch), size)
    own = list(range(len(fps)))
    for found in similar._met(dealt.to_batches(max_chunksize=16)):
        for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True):
            assert a // 25 == b // 25
            a, b = own[a], own[b]
            if a != b:
                own = [min(a, b) if c in (a, b) else c for c in own]
    assert own == [25 * (i // 25) for i in range(len(fps))]


def test_parts_hold_every_pair_of_a_place(spark):
    rows = spark.range(100).selectExpr("int(id % 2) AS place", "id", "id AS f0", "id AS f1", "id AS f2", "id AS f3")
    counts = rows.groupBy("place").count().withColumnRenamed("count", "n")
    met = set()
    parts = {}
    for r in similar.by_part(rows, counts, 9).collect():
        parts.setdefault((r["place"], r["part"]), []).append(r["id"])
    for ids in parts.values():
        met.update((a, b) for a in ids for b in ids)
    assert met == {(a, b) for a in range(100) for b in range(100) if a % 2 == b % 2}
    assert max(map(len, parts.values())) <= 40


def jaccard(a, b):
    a, b = (similar.shingle_set(t.encode()) for t in (a, b))
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


@pytest.mark.parametrize("block", [256, 4])
def test_groups_are_those_of_all_pairs_of_shingle_sets(spark, monkeypatch, block):
    """Pairs about the limit, and one group whose blocks and leaders do not tell all."""
    monkeypatch.setattr(similar, "BLOCK", block)
    draw = np.random.default_rng(11)
    texts = []
    for seed in range(150):  # groups of two, similarity about 0.7 to 0.9
        base = list(draw.choice(VOCABULARY, 400))
        texts += [" ".join(base), variant(base, seed, int(draw.integers(4, 15)))]
    chain = list(draw.choice(VOCABULARY, 400))  # members are near their neighbours only
    for seed in range(25):
        texts.append(" ".join(chain))
        chain = variant(chain, 1000 + seed, 6).split()
    pairs = [(jaccard(texts[i], texts[i + 1])) for i in range(0, 300, 2)]
    assert sum(0.8 <= j < 0.84 for j in pairs) > 15 and sum(0.7 < j < 0.8 for j in pairs) > 15
    common.ship(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    own = list(range(len(texts)))
    for i in range(len(texts)):
        for j in [i - 1] if i < 300 and i % 2 else range(300, i):
            if own[i] != own[j] and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = own[i], own[j]
                own = [min(a, b) if c in (a, b) else c for c in own]
    assert [got[i] for i in range(len(texts))] == own


@pytest.mark.parametrize("cell,size", [(64, 1 << 17), (2, 1 << 17), (2, 40)])
def test_chains_around_distant_leaders(spark, monkeypatch, cell, size):
    """Neighbours whose leaders differ, all of one cell, and more of them than a block of rows."""
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(similar, "ROWS", size)
    used = set(np.concatenate([similar._table_bits()[0]]).tolist())
    free = [b for b in range(256) if b not in used]
    fps = [np.zeros(4, np.uint64)]
    for row in range(1, 5):  # each far from all but its neighbours
        fps.append(fps[-1].copy())
        for bit in free[(row - 1) * 50 : row * 50]:
            fps[-1][bit // 64] ^= np.uint64(1 << bit % 64)
    # The first and the fourth lead; the link of the second and third is not one of a leader.
    fps = np.array([fps[i] for i in (0, 3, 1, 2, 4)])
    near = [(i, j) for i in range(5) for j in range(i) if similar._near(fps[i], fps[j])]
    assert len(near) == 4
    lone = np.random.default_rng(3).integers(0, 2**63, (120, 4), dtype=np.uint64)
    for bit in used:  # the same segment, else far apart
        lone[:, bit // 64] &= ~np.uint64(1 << bit % 64)
    signed = np.concatenate([fps[:2], lone[:60], fps[2:4], lone[60:], fps[4:]]).view(np.int64)
    batch = {"id": pa.array(np.arange(len(signed)))} | {
        w: pa.array(np.ascontiguousarray(signed[:, k])) for k, w in enumerate(similar.WORDS)
    }
    dealt = parted(spark, pa.table(batch), size, 1)
    own = list(range(len(signed)))
    for found in similar._met(dealt.to_batches(max_chunksize=16)):
        for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True):
            a, b = own[a], own[b]
            own = [min(a, b) if c in (a, b) else c for c in own]
    chain = [0, 1, 62, 63, 124]
    assert own == [0 if i in chain else i for i in range(len(signed))]


def test_texts_that_only_share_an_id_all_stay(spark):
    common.ship(spark)
    draw = np.random.default_rng(8)
    one, other = (list(draw.choice(VOCABULARY, 200)) for _ in range(2))
    near = [variant(one, seed, 1) for seed in range(3)]
    rows = [(7, " ".join(one)), (7, " ".join(other)), (7, " ".join(other)), (9, " ".join(other))]
    rows += [(7, text) for text in near]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [tuple(r) for r in similar.one_of_each(docs).collect()]
    again = [tuple(r) for r in similar.one_of_each(docs.orderBy("text")).collect()]
    assert sorted(kept) == sorted(again) and len(kept) == 2
    assert (7, " ".join(other)) in kept and {i for i, _ in kept} == {7}
