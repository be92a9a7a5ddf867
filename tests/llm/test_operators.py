"""Corpus operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from sojourn.llm import bpe, common, embeddings, lm, mixing, pii, queries, simhash, similar
from sojourn.llm import substring, topk, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, fp string"
WORDS = "the cat sat on a mat and saw one old dog run by that red barn at noon today".split()


def prose(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(f"{draw.choice(WORDS)}{draw.integers(30)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    shared = prose(1, 40)
    rows = [(i, prose(100 + i, 60)) for i in range(20)]
    rows += [(20, rows[3][1]), (21, rows[3][1]), (3, rows[3][1])]  # copies; a repeated row
    rows += [(30 + i, f"{prose(200 + i, 20)} {shared} {prose(300 + i, 5)}") for i in range(5)]
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, "one two"), (44, "Ünï 漢字 ½ 'll x"), (None, shared)]
    rows += [(50, "x" * 3000), (51, prose(9, 5000))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    common.ship(spark)
    rows = [(i, t, None, ["a", "b", None][k % 3], None, 7, "own") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_bpe_is_the_library_and_round_trips(docs, empty, texts):
    lines = open(queries.RANKS, "rb").read()
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.Vocabulary(lines).ids, special_tokens={},
    )

    def run(df):
        coded = bpe.encode(df.select("doc_id", "text"), queries.RANKS, queries.PATTERN)
        return bpe.digests(bpe.decode(coded, queries.RANKS))

    want = []
    for i, text in texts:
        ids = own.encode_ordinary(text or "")
        joined = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), joined, hashlib.sha256((text or "").encode()).hexdigest()))
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert by_id(run(docs), *columns) == sorted(want, key=repr)
    at_once = bpe.round_trip(docs, queries.RANKS, queries.PATTERN, keep=("doc_id", "source", "ids"))
    assert at_once.columns == ["doc_id", "source", "ids", *bpe.DIGESTS]
    assert by_id(at_once, *columns) == sorted(want, key=repr)
    assert run(empty).count() == 0


def test_long_pieces_merge_in_the_same_order():
    vocabulary = bpe.Vocabulary(open(queries.RANKS, "rb").read())
    for seed in range(5):
        draw = np.random.default_rng(seed)
        piece = bytes(draw.choice(list(b"etaoin"), 300).tolist())
        (matrix,) = bpe.merged([piece], vocabulary)
        assert matrix == bpe.queue_merged(piece, vocabulary).tobytes()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, rank string")


def test_top_k_is_exact(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=8).tolist(), 1, "x") for i in range(300)]
    rows += [(1000, rows[0][1], 1, "x"), (1000, rows[0][1], 1, "x")]  # a repeated query
    rows += [(7, (4 * np.array(rows[0][1])).tolist(), 1, "x")] * 2  # unequal vectors of one id, and a copy
    rows += [(2000 + i, rows[50][1], 1, "x") for i in range(9)]  # ties beyond the fifth
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _, _ in rows]
    rows += [(1001, None, 1, "x")]
    rows += [(1002, [1.0, None], 1, "x"), (1003, [math.nan] * 8, 1, "x"), (None, [0.0] * 8, 1, "x")]
    want = []
    for q in sorted({i for i, _ in whole if i % 50 == 0}):
        scores = [(-int(u @ v), i) for j, u in whole if j == q for i, v in whole if i != q]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    got = topk.search(vectors(spark, rows), "vec_id % 50 = 0")
    assert by_id(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.search(vectors(spark, []), "vec_id % 50 = 0").count() == 0
    huge = [(0, [3e38, 3e38], 1, "x"), (1, [3e38, 3e38], 1, "x")]
    assert topk.search(vectors(spark, huge), "vec_id = 0").first()["score"] == 2**63 - 1


def test_top_k_skips_what_cannot_reach(spark):
    draw = np.random.default_rng(9)
    rows = []
    for i in range(40):  # vectors in distant bundles
        center = draw.normal(size=6)
        center *= 10 / np.linalg.norm(center)  # of equal length, where distances tell most
        rows += [(100 * i + j, (center + 0.1 * draw.normal(size=6)).tolist(), 1, "x") for j in range(100)]
    whole = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) for _, v, _, _ in rows])
    ids = np.array([i for i, *_ in rows])
    table = vectors(spark, rows)
    got = topk.search(table, "vec_id % 50 = 0")
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        scores = whole @ whole[q]
        top = [j for j in np.lexsort((ids, -scores)) if j != q][:5]
        want += [(int(ids[q]), n + 1, int(ids[j]), int(scores[j])) for n, j in enumerate(top)]
    assert by_id(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    work = topk.search(table, "vec_id % 50 = 0", counted=True).first()
    assert work["pairs"] == 80 * 4000 and work["evaluated"] < work["pairs"] / 2


def test_embedding_links(spark):
    draw = np.random.default_rng(8)
    rows = []
    for i in range(40):
        center = draw.normal(size=16)
        rows += [(10 * i + j, (center + 0.08 * draw.normal(size=16)).tolist(), i % 3, "x") for j in range(4)]
    rows += [(900, rows[0][1], 0, "x"), (901, rows[0][1], 0, "x"), (902, rows[0][1], None, "x")]
    rows += [(903, [0.0] * 16, 0, "x"), (904, None, 0, "x"), (905, [math.inf] * 16, 0, "x")]
    sound = [(i, np.array(v, np.float32).astype(float), l) for i, v, l, _ in rows[:-4]]
    links = {i: [] for i, *_ in rows}
    for i, v, l in sound:
        for j, w, m in sound:
            if i != j and l == m and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].append(j)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        return min(seen)

    got = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors(spark, rows), block=3).collect()}
    found = sum(r["n_links"] for r in got.values())
    total = sum(map(len, links.values()))
    assert len(got) == len(rows) and 0.9 * total <= found <= total
    assert all(r["n_links"] <= len(links[i]) for i, r in got.items())
    if found == total:
        assert {i: r["component_id"] for i, r in got.items()} == {i: least(i) for i in links}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


def pairs_at(cosine, n, dim, seed):
    """``n`` pairs of vectors with that cosine, far from all others."""
    draw = np.random.default_rng(seed)
    a = draw.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.normal(size=(n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return np.concatenate([a, cosine * a + math.sqrt(1 - cosine**2) * b])


@pytest.mark.parametrize("bits", [13, 20])
def test_embedding_recall(spark, bits):
    """Isolated pairs just above the limit against all pairs, with as many bits as large tables get."""
    scheme, n = embeddings.Scheme(bits), 400
    v = pairs_at(0.932, n, 64, bits).astype(np.float32)
    rows = [(i, x.tolist(), 1, "x") for i, x in enumerate(v)]
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert links.sum() == 2 * n
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors(spark, rows), 1024, scheme).collect()}
    assert all(r["n_links"] <= links[i] for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * links.sum()
    assert all(r["component_id"] == i % n for i, r in got.items() if r["n_links"])


def test_embedding_scheme_grows():
    schemes = [embeddings.Scheme.of(n) for n in (0, 1, 4096, 10**6, 10**9)]
    assert [s.bits for s in schemes] == [13, 13, 13, 21, 31]
    for scheme in schemes:
        meet = (1 - math.acos(0.93) / math.pi) ** scheme.bits
        assert 1 - (1 - meet) ** scheme.tables >= embeddings.RECALL
    assert schemes[0].tables == 24


def test_toxicity_learns_and_holds_out(spark, empty):
    common.ship(spark)
    rows = [(i, prose(i, 30) + (" vile scum here" if i % 4 == 0 else ""), "en", "s", 1, 7, "o") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, None, 7, "o")], DOCS)
    marks = [(i, None, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [got[i]["held_out"] for i in range(400)] == [i in held for i in range(400)]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert 0 < got[900]["score"] < 1
    assert toxicity.scored(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.5}


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash_groups(spark, bucket):
    common.ship(spark)
    draw = np.random.default_rng(2)
    base = [int(x) for x in draw.integers(0, 2**63, 6)]
    values = base + [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in draw.integers(0, 63, (25, 2))]
    rows = [(i, v) for i, v in enumerate(values)] + [(1000, values[0]), (None, values[1]), (None, 12345)]
    got = {r["fp"]: r["component_id"] for r in simhash.groups(spark.createDataFrame(rows, "doc_id bigint, fp bigint"), bucket).collect()}
    parent = {v: v for _, v in rows}

    def root(v):
        return v if parent[v] == v else root(parent[v])

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    want = {v: min((i for i, w in rows if i is not None and root(w) == root(v)), default=None) for v in parent}
    assert got == want


def test_simhash_of_texts(docs, empty, texts):
    got = by_id(simhash.near_duplicates(docs), "doc_id", "fingerprint")
    assert got == sorted([(i, f"{slow_fingerprint(t):016x}") for i, t in texts], key=repr)
    kept = [r["doc_id"] for r in similar.one_of_each(docs).collect()]
    assert len(kept) == len(set(kept)) and 3 in kept and not {20, 21} & set(kept)
    assert simhash.near_duplicates(empty).count() == similar.one_of_each(empty).count() == 0


def test_substring_against_all_windows(docs, empty, texts):
    words = {(i, t): (t or "").encode().split() for i, t in texts}
    first = {}
    for (i, _), w in words.items():
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, t in texts:
        w = words[i, t]
        gone = {p for k in range(len(w) - 12) for p in range(k, k + 13) if i is not None and first[tuple(w[k : k + 13])] < i}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert by_id(substring.removed(docs), *columns) == sorted(want, key=repr)
    assert substring.removed(empty).count() == 0


RULES = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(pii.digits_of(s)) <= 19 and pii.luhn(pii.digits_of(s))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(pii.digits_of(s)) <= 15),
)


def rules(text):
    return [(k, *m.span()) for k, (p, ok) in enumerate(RULES) for m in re.finditer(p, text) if ok(m.group())]


def test_base_rules_on_odd_strings():
    for alphabet in ("a@. -_1b", "0123456789 .-+()", "12. ", "+1 ()."):
        draw = np.random.default_rng(len(alphabet))
        for _ in range(3000):
            text = "".join(draw.choice(list(alphabet), draw.integers(40)))
            assert pii.base_spans(text) == rules(text), text
    assert pii.base_spans("9" * 50_000 + "@" + "a." * 20_000) == [(0, 0, 90_000)]


def test_pii_adds_and_masks(spark, empty):
    common.ship(spark)
    rows = [(i, f"{prose(i, 8)} mail a{i}.b@host{i}.example.com or +1 (212) 555-{1000 + i} {prose(i + 500, 6)}", None, None, 1, 7, "o") for i in range(120)]
    rows += [(500, f"{prose(3, 8)} call (212) 555-7777 {prose(4, 6)}", None, None, 1, 7, "o"), (501, None, None, None, None, 7, "o"), (502, prose(5, 200), None, None, 1, 7, "o")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    for i, text, *_ in rows:
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in rules(text or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(got[i]["spans"].split(","))
    assert got[500]["spans"].startswith("phone:") and got[502]["spans"] == got[501]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.masked(docs, pii.fit(docs)).collect()}
    assert "[EMAIL]" in clean[0] and "@" not in clean[0] and "7777" not in clean[500] and clean[501] is None
    assert pii.personal_data(empty).count() == 0


def test_mixing_meets_targets(spark, docs, empty):
    rows = [(i, prose(i, 1 + i % 40), None, ["a", "b", "c", None, "d"][i % 5], 1, 7, "o") for i in range(2000)]
    rows += [(i, prose(i, 30), None, "small", 1, 7, "o") for i in range(5000, 5003)] + [(7000, None, None, "none", 1, 7, "o")]
    big = spark.createDataFrame(rows, DOCS)
    got = mixing.taken(big).toPandas().merge(big.select("doc_id", "source").toPandas(), on="doc_id")
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    assert abs(got.groupby("source", dropna=False).target.max().sum() - got["size"].sum()) < 1e-6
    for source, part in got.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.max()) <= part["size"].max(), source
    assert got[got.source == "small"].target.max() == 3 * 90
    again = mixing.taken(big).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    texts = mixing.mixed_texts(big)
    want = {r.doc_id: r.taken for r in got.itertuples()}
    words = {}
    for r in texts.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert texts.columns == big.columns and words == {i: n for i, n in want.items() if n}
    assert mixing.taken(docs).count() == docs.count() and mixing.taken(empty).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 70), ("b", 9), ("c", 1)], "s string, k bigint")
    rows = mixing.split(quotas, 7).collect()
    for source, k in (("a", 70), ("b", 9), ("c", 1)):
        cuts = sorted((r["lo"], r["hi"]) for r in rows if r["s"] == source)
        assert cuts[0][0] == 0 and cuts[-1][1] == k
        assert all(x[1] == y[0] for x, y in zip(cuts, cuts[1:]))
    sizes = [sum(r["hi"] - r["lo"] for r in rows if r["shard"] == s) for s in range(7)]
    assert sum(sizes) == 80 and max(sizes) - min(sizes) <= 2


@pytest.mark.parametrize("k, n, total", [(30, 20, 70), (5, 60, 64), (1, 1, 2), (0, 3, 9), (40, 40, 40), (900, 700, 1500)])
def test_draws_are_hypergeometric(spark, k, n, total):
    """A grid of uniform numbers meets each outcome as often as its probability says."""
    grid = 20_000
    share = mixing._left_share("k", "n", "total", "u")
    rows = spark.range(grid).selectExpr(
        f"(id + 0.5D) / {grid} AS u", f"{k}L AS k", f"{n}L AS n", f"{total}L AS total"
    )
    got = dict(rows.selectExpr(f"{share} AS x").groupBy("x").count().collect())
    ways = {x: math.comb(k, x) * math.comb(total - k, n - x) for x in range(max(0, n - total + k), min(n, k) + 1)}
    assert set(got) <= set(ways) and sum(got.values()) == grid
    for x, w in ways.items():
        assert abs(got.get(x, 0) - grid * w / math.comb(total, n)) <= 2, x


def test_large_quotas_split_whole(spark):
    quotas = spark.createDataFrame([("a", 300_000), ("b", 200_000), ("c", 7)], "s string, k bigint")
    rows = mixing.split(quotas, 4).collect()
    assert {s: sum(r["hi"] - r["lo"] for r in rows if r["s"] == s) for s in "abc"} == {"a": 300_000, "b": 200_000, "c": 7}
    parts = [r["hi"] - r["lo"] for r in rows if r["s"] == "a"]
    assert len(parts) == 4 and all(abs(p - 75_000) < 2000 for p in parts)


def filled(sizes, weights, most):
    """Reshare what lies above the caps until no target does."""
    targets, room = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in sizes if s not in targets]
        each = room / (sum(weights[s] for s in free) or 1)
        above = [s for s in free if each * weights[s] > most * sizes[s]]
        if not above:
            return targets | {s: each * weights[s] for s in free}
        for s in above:
            targets[s] = float(most * sizes[s])
            room -= targets[s]


def test_targets_against_resharing(spark):
    rng = random.Random(8)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 300, 2500]) for i in range(9)}
        rows = spark.createDataFrame([(f"1{s}", s, n) for s, n in sizes.items()], "s string, source string, size bigint")
        want = filled(sizes, {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}, 3)
        got = {r["s"][1:]: r["target"] for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(want)


def test_archives_round_trip(spark):
    common.ship(spark)
    long = "<p>" + "ä" * 2000
    rows = [(1, "http://a", "x", 9), (2, "http://b\r\nX: y", long, 9), (3, None, long, 9), (4, "u", None, 9)]
    rows += [(5, "u", "x", 9), (None, "u", "z", 9), (6, "u", "k\r\n\r\n" * 300, 9), (7, "u", "k\r\n\r\n" * 300, 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type int")
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        twin = {2: 3, 6: 7}.get(i)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if twin else "response", twin))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert by_id(warc.round_trip(pages), *columns) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_zip_reader_reads_what_others_write(tmp_path):
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", b"1" * 10)
        z.writestr("two", b"2" * 20, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = path.read_bytes()
    reader = warc.ZipReader(lambda at, n: data[at : at + n], len(data))
    at, size = reader.place("one")
    assert data[at : at + size] == b"1" * 10
    with pytest.raises(ValueError, match="stored"):
        reader.place("two")
    out = open(tmp_path / "b.zip", "wb")
    writer = warc.ZipWriter(out)
    writer.begin("x")
    writer.write(b"abc")
    writer.end()
    writer.close()
    out.close()
    assert zipfile.ZipFile(tmp_path / "b.zip").read("x") == b"abc"


def test_losses_leave_the_document_out(docs, empty, texts):
    good = docs.where("doc_id < 10").select("doc_id")
    got = {r["doc_id"]: r for r in lm.scored(docs, good).collect()}
    hashes = common.WordHashes()
    placed = [(i, *lm.places((t or "").encode(), hashes)) for i, t in texts]

    def cost(i, words, pairs, target):
        from collections import Counter

        seen = Counter()
        for j, w, p in placed:
            if not target or (j is not None and j < 10):
                seen.update(w.tolist() + p.tolist())
        if not target or (i is not None and i < 10):
            seen.subtract(words.tolist() + pairs.tolist())
        size = sum(n for place, n in seen.items() if place < 1 << lm.WORD_BITS)
        total = 0.0
        for v, w, p in zip(words[:-1].tolist(), words[1:].tolist(), pairs.tolist()):
            single = (seen[w] + lm.ADDED) / (size + lm.ADDED * (1 << lm.WORD_BITS))
            total -= math.log((seen[p] + lm.PRIOR * single) / (seen[v] + lm.PRIOR))
        return total / len(pairs)

    for i, words, pairs in placed:
        if i is None or i == 3:
            continue
        if not len(pairs):
            assert got[i]["score"] is None and got[i]["n_tokens"] == 0
        elif i in (0, 12, 30, 43):
            assert got[i]["target_loss"] == pytest.approx(cost(i, words, pairs, True))
            assert got[i]["background_loss"] == pytest.approx(cost(i, words, pairs, False))
    assert lm.scored(empty, good).count() == 0


def test_losses_tell_all_words_apart(spark):
    """Exact words and pairs, of more words than 2^18 places; several chunks count as one."""
    common.ship(spark)
    many = [(100 + i, " ".join(f"v{i}x{j}" for j in range(15_000))) for i in range(20)]
    rows = [(1, "blue cats sleep all day"), (2, "blue cats sleep at night"), (3, "Blue dogs run"), *many]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    good = spark.createDataFrame([(1,), (100,)], "doc_id bigint")
    got = {r["doc_id"]: r for r in lm.scored(docs, good).collect()}
    assert sorted(got) == sorted(i for i, _ in rows)
    vocabulary = len({w for _, t in rows for w in t.lower().split()} | {None})
    assert vocabulary > 1 << lm.WORD_BITS

    def cost(own, target):
        from collections import Counter

        seen = Counter()
        for i, text in rows:
            if i != own and (not target or i in (1, 100)):
                marked = [None, *text.lower().split()]
                seen.update(marked)
                seen.update(zip(marked, marked[1:], strict=False))
        size = sum(n for k, n in seen.items() if not isinstance(k, tuple))
        marked, total = [None, *dict(rows)[own].lower().split()], 0.0
        for v, w in zip(marked, marked[1:], strict=False):
            single = (seen[w] + lm.ADDED) / (size + lm.ADDED * vocabulary)
            total -= math.log((seen[v, w] + lm.PRIOR * single) / (seen[v] + lm.PRIOR))
        return total / (len(marked) - 1)

    for i in (1, 2, 3, 100, 110):
        assert got[i]["target_loss"] == pytest.approx(cost(i, True), rel=1e-12)
        assert got[i]["background_loss"] == pytest.approx(cost(i, False), rel=1e-12)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000)]
    rows = common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}
    assert {r["vertex"]: r["component"] for r in rows} == want


def test_stages_keep_the_columns(spark, docs, empty):
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["toxicity", "near_duplicates"]
    for frame in (empty,):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            assert stage(spark, frame, "").columns == docs.columns, name


@pytest.mark.parametrize("rows", [[], [(1, None), (2, None)], [(10**9, 1), (None, 0)]])
def test_no_document_is_toxic_without_usable_labels(spark, docs, tmp_path, rows):
    labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert by_id(kept, "doc_id", "text") == by_id(docs, "doc_id", "text")


def test_two_texts_of_one_id_are_both_looked_up(spark):
    """They share an anchor, not its windows; a later document elsewhere repeats the second."""
    common.ship(spark)
    hashes = common.WordHashes()
    for seed in range(2000):
        run, *sides = (prose(9000 + 10 * seed + k, n) for k, n in enumerate((5, 4, 4, 4, 4)))
        one, other = f"{sides[0]} {run} {sides[1]}", f"{sides[2]} {run} {sides[3]}"
        anchors = [substring.anchors_of(hashes.of(t.encode().split())) for t in (one, other)]
        if anchors[0][0] == anchors[1][0]:
            break
    assert len(anchors[0]) == 1 and anchors[0][0] == anchors[1][0]
    rows = [(1, one), (1, other), (9, f"{other} and more"), (10, f"so {one}")]
    parts = spark.sparkContext.parallelize(rows, 2)  # the early rows in one task, the late in another
    got = substring.removed(spark.createDataFrame(parts, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (9, 13), (10, 13)]


def test_warc_keeps_negative_and_missing_ids(spark):
    common.ship(spark)
    same = "x" * 1200
    rows = [(-1, "u", same), (-3, "u", same), (None, "u", same), (-7, None, "short"), (None, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = by_id(warc.round_trip(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    want = [(-1, 1200, "response", None), (-3, 1200, "revisit", -1), (None, 1200, "revisit", -1)]
    want += [(-7, 5, "response", None), (None, 0, "response", None)]
    assert got == sorted(want, key=repr)


def test_every_query_has_sql_or_a_brute_force_test():
    """Operators that SQL cannot express, and the test that holds them against something plainer."""
    tested = {
        "op1_bpe": test_bpe_is_the_library_and_round_trips,
        "op3_toxicity": test_toxicity_learns_and_holds_out,
        "op4_simhash": test_simhash_groups,
        "op6_pii": test_base_rules_on_odd_strings,
        "op7_embeddings": test_embedding_links,
        "op8_mixing": test_mixing_meets_targets,
        "op10_lm": test_losses_leave_the_document_out,
    }
    assert set(queries.QUERIES) == set(queries.STATEMENTS) | set(tested)
