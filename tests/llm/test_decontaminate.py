"""The positional index against plain searches in lists of words."""

import hashlib
import re

import numpy as np
import pytest

from sojourn.llm import common, decontaminate

DOCS = "doc_id bigint, text string, t int, pos string, doc int"
ITEMS = "item_id bigint, text string, win int, seq string"


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def prose(seed, n, many=12):
    draw = np.random.default_rng(seed)
    return " ".join(f"W{draw.integers(many)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    items = [(i, prose(i, 10 + 3 * i)) for i in range(8)]
    items += [(100, items[3][1]), (101, items[3][1].lower()), (100, items[3][1])]  # equal items, a repeated row
    items += [(9, "É"), (10, "only two"), (11, None), (12, ""), (13, "-- ,"), (None, prose(77, 12))]
    items += [(14, "a a a a a a a a a a"), (15, f"{prose(5, 9)} unknownword"), (16, "three of them")]
    docs = [(i, prose(500 + i, 80)) for i in range(15)]
    docs += [(20 + i, f"{prose(600 + i, 7)}; {items[i][1].replace(' ', ', ')}! {prose(700 + i, 5)}") for i in range(8)]
    docs += [(i, docs[20][1]) for i in (40, 41, 41)] + [(41, docs[21][1])]  # copies; two texts of one id
    docs += [(50, "x é É y"), (51, "Only\ttwo only two"), (52, None), (53, ""), (None, items[4][1])]
    docs += [(54, "a " * 25), (55, prose(77, 12)), (56, f"{prose(1, 6000)} {items[6][1]}"), (57, "them of three")]
    return docs, items


def brute(docs, items, width=10):
    want = []
    windows = []
    for item, text in items:
        words = words_of(text)
        n = min(width, len(words))
        windows += [(item, words[i : i + n]) for i in range(len(words) - n + 1)] if n else []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        places = {}
        for n in {len(w) for _, w in windows}:
            for i in range(len(words) - n + 1):
                places.setdefault(tuple(words[i : i + n]), []).append(i)
        for item, window in windows:
            for i in places.get(tuple(window), []):
                hit.update(range(i, i + len(window)))
                found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        want.append((doc, len(words), len(hit), len(ids), sha, bool(hit)))
    return sorted(want, key=repr)


def frames(spark, docs, items):
    common.ship(spark)
    return (
        spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOCS).repartition(3),
        spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS).repartition(2),
    )


def test_contaminated_words_are_those_of_a_plain_search(spark, tables):
    found = decontaminate.contaminated(*frames(spark, *tables))
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(*tables)


def test_other_widths_and_shuffled_lookups(spark, tables, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    found = decontaminate.contaminated(*frames(spark, *tables), width=4)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(*tables, width=4)


def test_empty_tables(spark, tables):
    docs, items = frames(spark, *tables)
    none = decontaminate.contaminated(docs, items.limit(0)).collect()
    assert len(none) == len(tables[0]) and not any(r["contaminated"] for r in none)
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_postings_are_sorted_by_term_in_every_file(spark, tables):
    docs, items = frames(spark, *tables)
    asked = decontaminate.numbered_items(items)
    postings = decontaminate.index(docs, decontaminate.vocabulary(asked))
    for path in postings.inputFiles():
        one = [r["t"] for r in spark.read.parquet(path).collect()]
        assert one == sorted(one)
    ends = postings.where("t = 0").collect()
    assert sorted(r["pos"] for r in ends) == sorted(len(words_of(t)) for _, t in tables[0])


def test_proximity(spark, tables):
    docs, _ = frames(spark, *tables)
    asked = [("a", ["them", "three"]), ("b", ["w1", "w2", "w3", "w4"]), ("c", ["w5", "unheard"]), ("d", ["w6", "w6"])]
    queries = spark.createDataFrame(asked, "query_id string, words array<string>")
    terms = decontaminate.vocabulary(queries)
    postings = decontaminate.index(docs, terms)
    rare = decontaminate.rarity(postings, terms)
    counts = {r["term"]: (r["tf"], r["t"]) for r in rare.collect()}
    within = 6
    found = decontaminate.proximity_matches(postings, rare, queries, within)
    want = set()
    for text in {t for _, t in tables[0]}:
        words = words_of(text)
        for name, query in asked:
            needed = set(query)
            pivot = min(needed, key=lambda w: counts[w])
            for at in (i for i, w in enumerate(words) if w == pivot):
                spans = [
                    (j - i + 1, i)
                    for i in range(max(0, at - within + 1), at + 1)
                    for j in range(at, min(len(words), i + within))
                    if needed <= set(words[i : j + 1]) and words[i] in needed and words[j] in needed
                ]
                if spans:
                    length, start = min(spans)
                    want.add((name, hashlib.md5((text or "").encode()).hexdigest(), start, length))
    assert {tuple(r) for r in found.collect()} == want
    assert {r[0] for r in want} == {"a", "b", "d"}


def test_no_python_in_the_plan(spark, tables):
    plan = decontaminate.contaminated(*frames(spark, *tables))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
