"""The prefix trie of conversations, from padded matrices of turn ids.

A turn's id is a 128-bit digest of role and text, held as two whole numbers; a conversation is the
array of its turns' ids, about 24 bytes a turn, and no text is shuffled. Conversations are rebuilt with
a shared head, then range-partitioned and sorted by (ids, conv_id), so that every prefix is a run of
rows; equal conversations, however many, spread over shards by conv_id.

A shard goes through its rows in blocks of at most ``CELLS`` cells. A block is one padded matrix:
lexsort orders it, the masks of changed columns between neighbouring rows, OR-accumulated from the
left, mark where nodes start, and ``reduceat`` over these starts aggregates every depth. With the
common prefix of a row and the row before it, all node values are sums over rows: a row adds a child
to each node in which it opens one, saves the words of the turns it shares, and makes a leaf if the row after
it does not go on from it.

Nodes within a block are final. Those that the first or the last row of a block belongs to may go
on in other blocks: their sums are recombined by node, together with what the two border rows owe to
their neighbours in the adjoining blocks. The ids of a node's ending conversations are one text per
block, which are hashed in order, one after the other, so no list of them is ever held.

Rows without conv_id are left out; null role or text is empty. Rows of equal turn follow each other
in an order that depends on their role and text alone; repeated rows are repeated turns. An empty table has no
nodes, not even a root. One conversation's ids are one row, as a long text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.operators.distribute import lookup_join
from sojourn.session import materialise, stored

FAMILY = 20
HEADS = 4
WORDS = r"[^\\x20\\x09-\\x0D]+"
# Cells (rows x longest row) of a block's matrix; a longer conversation is a block of its own.
CELLS = 1 << 17
PAD = np.iinfo(np.int64).min

NODE = {
    "depth": pa.int64(),
    "conv_id": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(),
    "key": pa.string(),
    "parent_key": pa.string(),
    "ends": pa.string(),
    "block": pa.int64(),
}
BORDER = {
    "first_ids": pa.list_(pa.int64()),
    "last_ids": pa.list_(pa.int64()),
    "first_keys": pa.list_(pa.string()),
    "last_keys": pa.list_(pa.string()),
    "first_words": pa.list_(pa.int64()),
}
PART = pa.schema([*NODE.items(), *BORDER.items()])
PART_DDL = (
    "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, key string, parent_key string, "
    "ends string, block bigint, first_ids array<bigint>, last_ids array<bigint>, "
    "first_keys array<string>, last_keys array<string>, first_words array<bigint>"
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as ``(turn, a, b, words)``."""
    # A digest that equals the padding becomes its neighbour.
    rows = conversations.where("conv_id IS NOT NULL").selectExpr(
        "conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text"
    )
    ids = rows.selectExpr(
        "conv_id",
        f"struct(turn, greatest(xxhash64(role, text), {PAD + 1}L) AS a, "
        f"greatest(xxhash64(text, role), {PAD + 1}L) AS b, "
        f"cast(regexp_count(text, '{WORDS}') as bigint) AS words) AS t",
    )
    return ids.groupBy("conv_id").agg(F.expr("sort_array(collect_list(t)) AS turns"))


def with_shared_heads(own: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Each conversation with its first turns replaced by those of its family's first.

    The number of replaced turns is ``crc32`` of the decimal conv_id modulo ``heads``.
    """
    own = stored(own)
    first = own.where(f"conv_id % {family} = 0")
    first = first.selectExpr("conv_id AS base", f"slice(turns, 1, {heads - 1}) AS head")
    asked = own.selectExpr(
        "*",
        f"conv_id - conv_id % {family} AS base",
        f"cast(crc32(cast(cast(conv_id as string) as binary)) % {heads} as int) AS h",
    )
    met = lookup_join(asked, first, "base", "left", common.BROADCAST_ROWS)
    kept = "slice(turns, h + 1, size(turns))"
    return met.selectExpr("conv_id", f"concat(slice(coalesce(head, slice(turns, 1, 0)), 1, h), {kept}) AS turns")


def _chain(ids: np.ndarray) -> list[str]:
    """A key of every prefix of one conversation, from the root on."""
    key = hashlib.md5(b"")
    keys = [key.hexdigest()]
    for turn in ids.reshape(-1, 2):
        key.update(turn.tobytes())
        keys.append(key.hexdigest())
    return keys


def _ends(convs: np.ndarray) -> str:
    return ",".join(map(str, convs.tolist()))


def block_nodes(convs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, words: np.ndarray, block: int):
    """Columns of :data:`PART` for one block; the border row comes last.

    ``sizes`` are turns per row, ``ids`` two numbers a turn and ``words`` one, row after row.
    """
    n, wide = len(convs), int(sizes.max(initial=0))
    cell = np.arange(wide) < sizes[:, None]
    matrix = np.full((n, wide, 2), PAD, np.int64)
    matrix[cell] = ids.reshape(-1, 2)
    spoken = np.zeros((n, wide), np.int64)
    spoken[cell] = words
    matrix = matrix.reshape(n, 2 * wide)
    if n > 1:
        order = np.lexsort((convs, *matrix.T[::-1]))
        convs, sizes, matrix, spoken = convs[order], sizes[order], matrix[order], spoken[order]
    changed = (matrix[1:] != matrix[:-1]).reshape(n - 1, wide, 2).any(2)
    np.logical_or.accumulate(changed, axis=1, out=changed)
    common_ = np.zeros(n, np.int64)  # turns shared with the row before
    common_[1:] = np.minimum((~changed).sum(1), np.minimum(sizes[1:], sizes[:-1]))
    upto = np.zeros((n, wide + 1), np.int64)
    np.cumsum(spoken, axis=1, out=upto[:, 1:])
    rows = np.arange(n)
    shared = upto[rows, common_]
    leaf = np.zeros(n, np.int64)
    leaf[:-1] = common_[1:] < sizes[:-1]
    first_keys, last_keys = _chain(matrix[0, : 2 * sizes[0]]), _chain(matrix[-1, : 2 * sizes[-1]])

    out: dict[str, list] = {name: [] for name in PART.names}
    above = None
    for depth in range(wide + 1):
        starts = np.flatnonzero(common_ < depth) if depth else np.zeros(0, np.int64)
        if not len(starts) or starts[0]:
            starts = np.concatenate(([0], starts))
        stops = np.append(starts[1:], n)
        real = sizes[starts] >= depth
        opens = (common_ <= depth) & (sizes > depth)
        opens[0] = False
        saved = np.where(common_ >= depth, shared - upto[:, max(depth - 1, 0)], 0)
        saved[0] = 0
        least = np.minimum.reduceat(convs, starts)
        totals = [np.add.reduceat(x.astype(np.int64), starts) for x in (opens, leaf, saved, sizes == depth)]
        children, leaves, savings, ending = (t[real] for t in totals)
        starts, stops, least = starts[real], stops[real], least[real]
        edge = (starts == 0) | (stops == n)
        if above is None:
            parent_least, parent_keys = [None] * len(starts), [None] * len(starts)
        else:
            at = np.searchsorted(above[0], starts, "right") - 1
            parent_keys = [above[3][i] for i in at.tolist()]
            parent_least = [
                None if key else int(v) for key, v in zip(parent_keys, above[1][at], strict=True)
            ]
        keys = [
            None if not e else first_keys[depth] if s == 0 else last_keys[depth]
            for s, e in zip(starts.tolist(), edge.tolist(), strict=True)
        ]
        texts = [
            _ends(convs[s : s + k]) if k else None
            for s, k in zip(starts.tolist(), ending.tolist(), strict=True)
        ]
        out["depth"] += [depth] * len(starts)
        out["conv_id"] += least.tolist()
        out["parent_conv_id"] += parent_least
        out["n_convs"] += (stops - starts).tolist()
        out["n_children"] += children.tolist()
        out["n_leaves"] += leaves.tolist()
        out["saved_tokens"] += savings.tolist()
        out["key"] += keys
        out["parent_key"] += parent_keys
        out["ends"] += [t if k else None for t, k in zip(texts, keys, strict=True)]
        out["ends_sha256"] += [
            None if k else hashlib.sha256(t.encode()).hexdigest() if t else NO_ENDS
            for t, k in zip(texts, keys, strict=True)
        ]
        above = (starts, least, edge, keys)
    made = len(out["depth"])
    out["block"] = [block] * (made + 1)
    for name in NODE:
        if name != "block":
            out[name].append(None)
    border = (
        matrix[0, : 2 * sizes[0]], matrix[-1, : 2 * sizes[-1]], first_keys, last_keys, upto[0, : sizes[0] + 1],
    )
    for name, value in zip(BORDER, border, strict=True):
        out[name] = [None] * made + [value if isinstance(value, list) else value.tolist()]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard's sorted rows, block by block; blocks are numbered in the order of shards."""
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    longest = 1

    def made() -> pa.RecordBatch:
        convs = np.array([h[0] for h in held], np.int64)
        sizes = np.array([len(h[2]) for h in held], np.int64)
        ids, words = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        return pa.RecordBatch.from_pydict(block_nodes(convs, sizes, ids, words, number), PART)

    for batch in batches:
        columns = []
        for name in ("ids", "words"):
            lists = batch[name]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            columns.append((lists.flatten().to_numpy(zero_copy_only=False), ends))
        for i, conv in enumerate(batch["conv_id"].to_pylist()):
            ids, words = (v[e[i] : e[i + 1]] for v, e in columns)
            if held and (len(held) + 1) * max(longest, len(words)) > CELLS:
                yield made()
                number, held, longest = number + 1, [], 1
            held.append((conv, ids, words))
            longest = max(longest, len(words))
    if held:
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, sha`` of each node's ids, from pieces sorted by node and block."""
    key, digest = None, None
    out = pa.schema([("key", pa.string()), ("sha", pa.string())])

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": [key], "sha": [digest.hexdigest()]}, out)

    for batch in batches:
        for node, piece in zip(batch["key"], batch["ends"], strict=True):
            if node.as_py() != key:
                if digest:
                    yield row()
                key, digest = node.as_py(), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_py().encode())
    if digest:
        yield row()


def shared_turns(a: str, b: str) -> str:
    """Turns that two arrays of ids have in common at their start (SQL)."""
    least = f"least(size({a}), size({b}))"
    equal = f"zip_with(slice({a}, 1, {least}), slice({b}, 1, {least}), (x, y) -> x = y)"
    place = f"array_position({equal}, false)"
    return f"(IF({place} = 0, {least}, {place} - 1) div 2)"


def _border_sums(parts: DataFrame) -> DataFrame:
    """What the first and last rows of all blocks owe to their neighbours, per node."""
    borders = stored(parts.where("first_ids IS NOT NULL").select("block", *BORDER))
    # Only the blocks' numbers meet in one task.
    order = "OVER (ORDER BY block)"
    beside = materialise(
        borders.select("block").selectExpr(
            "block", f"lag(block) {order} AS before", f"lead(block) {order} AS after"
        )
    )
    lasts = borders.selectExpr("block AS before", "last_ids AS other")
    firsts = borders.selectExpr("block AS after", "first_ids AS other")
    met = borders.join(beside, "block")
    opened = met.join(lasts, "before", "left").selectExpr(
        "first_keys",
        "first_words",
        "size(first_ids) div 2 AS turns",
        f"IF(other IS NULL, 0, {shared_turns('first_ids', 'other')}) AS shared",
    )
    opened = opened.selectExpr("*", "posexplode(first_keys) AS (d, key)").selectExpr(
        "key",
        "IF(d >= shared AND d < turns, 1L, 0L) AS n_children",
        "0L AS n_leaves",
        "IF(d <= shared, first_words[shared] - first_words[greatest(d - 1, 0)], 0L) AS saved_tokens",
    )
    closed = met.join(firsts, "after", "left").selectExpr(
        "last_keys",
        "size(last_ids) div 2 AS turns",
        f"IF(other IS NULL, -1, {shared_turns('last_ids', 'other')}) AS shared",
    )
    closed = closed.where("shared < turns").selectExpr(
        "explode(last_keys) AS key", "0L AS n_children", "1L AS n_leaves", "0L AS saved_tokens"
    )
    return opened.unionByName(closed)


def trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of ``conv_id, turns`` (arrays of ``(…, a, b, words)``), one row each.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's; see the module for the rest.
    """
    rows = stored(
        rebuilt.selectExpr(
            "conv_id",
            "flatten(transform(turns, t -> array(t.a, t.b))) AS ids",
            "transform(turns, t -> t.words) AS words",
        )
    )
    ordered = rows.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    parts = stored(ordered.mapInArrow(common.tidied(_blocks), PART_DDL))
    sums = ["n_children", "n_leaves", "saved_tokens"]
    pieces = parts.where("key IS NOT NULL")
    own = pieces.selectExpr("key", "depth", "conv_id", "parent_key", "n_convs", *sums)
    nothing = [f"cast(NULL AS bigint) AS {c}" for c in ("depth", "conv_id", "n_convs")]
    owed = _border_sums(parts).selectExpr("key", *nothing, "cast(NULL AS string) AS parent_key", *sums)
    edges = own.unionByName(owed).groupBy("key").agg(
        F.expr("max(depth) AS depth"),
        F.expr("min(conv_id) AS conv_id"),
        F.expr("max(parent_key) AS parent_key"),
        F.expr("sum(n_convs) AS n_convs"),
        *[F.expr(f"sum({c}) AS {c}") for c in sums],
    )
    texts = pieces.where("ends IS NOT NULL").select("key", "block", "ends")
    texts = texts.repartition("key").sortWithinPartitions("key", "block")
    hashed = texts.mapInArrow(common.tidied(_hashed), "key string, sha string")
    edges = materialise(edges.join(hashed, "key", "left"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    columns += ["ends_sha256"]
    inner = parts.where("key IS NULL AND depth IS NOT NULL")
    settled = inner.where("parent_key IS NULL").select(*columns)
    parents = edges.selectExpr("key AS parent_key", "conv_id AS found")
    below = inner.where("parent_key IS NOT NULL").select("parent_key", *columns)
    below = below.unionByName(
        edges.selectExpr(
            "parent_key", *[c for c in columns if c not in ("parent_conv_id", "ends_sha256")],
            "cast(NULL AS bigint) AS parent_conv_id", f"coalesce(sha, '{NO_ENDS}') AS ends_sha256",
        ).where("parent_key IS NOT NULL")
    )
    joined = lookup_join(below, parents, "parent_key", "inner", common.BROADCAST_ROWS, computed=True)
    root = edges.where("parent_key IS NULL").selectExpr(
        *[c for c in columns if c not in ("parent_conv_id", "ends_sha256")],
        "cast(NULL AS bigint) AS parent_conv_id", f"coalesce(sha, '{NO_ENDS}') AS ends_sha256",
    )
    joined = joined.withColumn("parent_conv_id", F.col("found")).select(*columns)
    return settled.unionByName(joined).unionByName(root.select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations with shared heads."""
    return trie(with_shared_heads(turns(conversations)))
