"""The prefix trie against a dictionary of prefixes."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from sojourn.llm import common, prefixes

TABLE = "conv_id bigint, turn bigint, role string, text string, ids string, depth int, key string"
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations():
    draw = np.random.default_rng(3)
    rows = []
    for conv in range(120):
        for turn in range(draw.integers(1, 7)):
            rows.append((conv, turn, ["user", "model"][turn % 2], ["hi", "a b", "c\td e", ""][draw.integers(4)]))
    rows += [(c, t, "user", "the same words") for c in range(200, 320) for t in range(3)]  # a hot conversation
    rows += [(500, None, None, None), (500, 0, "user", "x"), (501, 5, None, "late"), (501, 2, "user", None)]
    rows += [(520, 1, "user", "twice"), (520, 1, "user", "twice")]  # a repeated row
    rows += [(601, 0, "user", "alone")]  # its family has no first conversation
    rows += [(-40, 0, "user", "hi"), (-41, 0, "user", "hi"), (None, 0, "user", "lost")]
    rows += [(700, t, "user", "long " * 5) for t in range(300)] + [(700, 300, "user", "z" * 200_000)]
    return rows


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        whole = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((conv, d == len(whole)))
    children = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(nodes, key=len, reverse=True):
        leaves = 0 if node in children else 1
        said = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        saved = (len(nodes[node]) - 1) * said
        for child in children.get(node, []):
            leaves, saved = leaves + sums[child][0], saved + sums[child][1]
        sums[node] = (leaves, saved)
    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        up = min(c for c, _ in nodes[node[:-1]]) if node else None
        out.append((min(c for c, _ in members), len(node), up, len(members), len(children.get(node, [])),
                    *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    common.ship(spark)
    return spark.createDataFrame([(*r, "own", 7, "k") for r in rows], TABLE).repartition(3)


def got(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return sorted((tuple(r[c] for c in [*columns, "ends_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("cells", [prefixes.CELLS, 40, 1])
@pytest.mark.parametrize("shards", [1, 7])
def test_trie_is_that_of_a_dictionary(spark, monkeypatch, cells, shards):
    """Also with blocks of a few rows and of one row, where nearly every node crosses borders."""
    rows = conversations()
    table = frame(spark, rows)
    monkeypatch.setattr(prefixes, "CELLS", cells)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        found = got(_with_cells(prefixes, table, cells))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == brute(rows)


def _with_cells(module, table, cells):
    """Workers import the module anew, so the bound goes with the function."""
    run = module._blocks

    def bounded(batches):
        from sojourn.llm import prefixes as own

        own.CELLS = cells
        yield from run(batches)

    module._blocks, kept = bounded, module._blocks
    try:
        return module.conversation_trie(table).checkpoint()
    finally:
        module._blocks = kept


def test_shuffled_lookups(spark, monkeypatch):
    rows = conversations()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert got(prefixes.conversation_trie(frame(spark, rows))) == brute(rows)


def test_turnless_and_empty(spark):
    common.ship(spark)
    none = frame(spark, [])
    assert prefixes.conversation_trie(none).count() == 0
    kinds = "conv_id bigint, turns array<struct<turn: bigint, a: bigint, b: bigint, words: bigint>>"
    turnless = spark.createDataFrame([(i, []) for i in range(12)], kinds)
    ends = hashlib.sha256(",".join(map(str, range(12))).encode()).hexdigest()
    assert got(prefixes.trie(turnless)) == [(0, 0, None, 12, 0, 1, 0, ends)]
    one = spark.createDataFrame([(3, []), (4, [(0, 1, 1, 2)])], kinds)
    three, four = (hashlib.sha256(x).hexdigest() for x in (b"3", b"4"))
    assert got(prefixes.trie(one)) == [(3, 0, None, 2, 1, 1, 0, three), (4, 1, 3, 1, 0, 1, 0, four)]
