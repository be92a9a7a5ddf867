"""Near-duplicates: a Jaccard similarity of 0.8 or more of the sets of five-word shingles.

Links are exact: each is found by counting the shingles that two sets have in common. What is
compared is found by SimHash and multi-index hashing. Texts at a similarity of 0.8 differ in about
15 % of their SimHash bits, so fingerprints here have 256 bits, in four words: bit i is set where
more than half of the distinct shingles set it, and of a tie the least shingle decides. Up to ``MOST_BITS`` differing bits make a candidate:
at 0.8 the mean is 38.8 with a deviation of 5.7, so a pair in 3,000 is beyond.

Each of ``TABLES`` index tables takes ``SEGMENT`` of the bits. Two fingerprints are compared whole
if their segments in any table differ by one bit at most: with 39 differing bits that holds with a
probability of 0.999, with 45 of 0.99, with 50 of 0.96, and above 0.8 there are fewer. Of a segment
with at most one differing bit one half is equal, so a fingerprint is sent to its two halves per
table, and the Hamming ball around the other half is enumerated where they meet.

Candidates are tied to components, and within a component every set is compared with every other,
so a pair also has the ways through its neighbours to be compared. Components are dealt into blocks
of about ``BLOCK`` sets that tasks compare completely; of a component with several blocks, first
each block for itself, then the first members of the groups found, then all pairs of blocks that do
not belong to one group already.

Equal sets are one row. Where many share a segment, pairs would grow with their square. Such a cell
elects leaders: the first member, then the first that is far from all leaders, and so on. Members are
compared with the leaders of this cell and those around it first, and then with all members that are
not in their tree yet, in bounded pieces. A place of more than ``ROWS`` rows is dealt into blocks, and
each block meets itself and every other one in a group of rows of its own.

Null text counts as empty; texts without words are copies of one another. A text of fewer than five
words is one shingle. Rows with a null id stay if their whole group has none. Documents with
clashing hashes of their sets would share a group; of 10^8 sets that is one case in 3,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.llm.simhash import shingle_hashes
from sojourn.operators.distribute import lookup_join
from sojourn.session import materialise, stored

SHINGLE_WORDS = 5
MOST_BITS = 58
TABLES = 40
FIRST_TABLES = 3
SEGMENT = 20
HALF = SEGMENT // 2
# Cells of up to this many fingerprints are compared pair by pair.
CELL = 64
# Rows that a task looks through at once, and of a block of a longer place.
ROWS = 1 << 16
SHINGLES = 1 << 14
# Sets, and shingles of all of them, that a task compares with one another.
BLOCK = 256
BLOCK_SHINGLES = 1 << 21
WORDS = ["f0", "f1", "f2", "f3"]
SALTS = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of the whole text, in order."""
    parts = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def set_id(hashes: np.ndarray) -> int:
    """A signed hash of a whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _bits_of(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(256, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        spread = common.mix64(hashes[at : at + SHINGLES, None] ^ SALTS)
        bits = np.unpackbits(spread.view(np.uint8).reshape(-1, 32), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    if len(hashes):  # the least shingle decides ties, else short texts would have few bits
        least = common.mix64(hashes[0] ^ SALTS).view(np.uint8)
        counts = 2 * counts + np.unpackbits(least, bitorder="little")
    return np.packbits(counts > len(hashes), bitorder="little").view(np.uint64)


def wide(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The 256-bit fingerprint of the whole text, as four uint64."""
    return _bits_of(shingle_set(text, width))


def wide_fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of ``docs`` but the text, the set's ``id`` and ``size``, and ``f0`` to ``f3``."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, found = [], [], []
            for text in common.texts_of(batch["text"]):
                hashes = shingle_set(text, width)
                ids.append(set_id(hashes))
                sizes.append(len(hashes))
                found.append(_bits_of(hashes))
            found = np.array(found, np.uint64).reshape(-1, 4).view(np.int64)
            columns = [batch[c] for c in kept]
            columns += [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(np.ascontiguousarray(found[:, i])) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "id", "size", *WORDS])

    more = dict.fromkeys(["id", "size", *WORDS], "bigint")
    return docs.mapInArrow(common.tidied(run), common.plus(docs.drop("text"), **more))


def _table_bits() -> list[np.ndarray]:
    """The bits of each table's segment: fixed draws, the same in every task."""
    return [np.random.default_rng(t).permutation(256)[:SEGMENT] for t in range(TABLES)]


def _words(batch: pa.RecordBatch) -> np.ndarray:
    """The fingerprints of a batch, one row of four uint64 each."""
    return np.stack([batch[w].to_numpy() for w in WORDS], axis=1).view(np.uint64)


def _dealt(
    batches: Iterator[pa.RecordBatch], first: int = 0, last: int = TABLES
) -> Iterator[pa.RecordBatch]:
    """Two rows per table and fingerprint: ``place`` names table and one half, ``rest`` is the other."""
    powers, tables = 1 << np.arange(HALF), _table_bits()
    for batch in batches:
        fps = np.ascontiguousarray(_words(batch))
        bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
        for t, chosen in enumerate(tables[first:last], first):
            halves = bits[:, chosen[:HALF]] @ powers, bits[:, chosen[HALF:]] @ powers
            for side in (0, 1):
                place = ((2 * t + side) << HALF) + halves[side]
                columns = [pa.array(place, pa.int32()), pa.array(halves[1 - side], pa.int16())]
                columns += [batch[c] for c in ("id", *WORDS)]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "rest", "id", *WORDS])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) <= MOST_BITS


def _leaders(fps: np.ndarray) -> list[int]:
    """Rows such that every row is near one of them and none of them are near each other."""
    chosen, free = [], np.ones(len(fps), bool)
    while free.any():
        chosen.append(int(np.argmax(free)))
        free &= ~_near(fps, fps[chosen[-1]])
    return chosen


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, …``, ``n[i]`` numbers of each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Meeting:
    """Rows of whole places, sorted into cells of equal segment; finds the links among them."""

    def __init__(self, place: np.ndarray, rest: np.ndarray, ids: np.ndarray, fps: np.ndarray):
        code = place.astype(np.int64) << HALF | rest
        order = np.argsort(code, kind="stable")
        self.code, self.place, self.ids, self.fps = code[order], place[order], ids[order], fps[order]
        self.rest = rest[order]
        self.cells, self.start, self.size = np.unique(
            self.code, return_index=True, return_counts=True
        )
        self.leaders: dict[int, list[int]] = {}
        # Trees of what is linked so far, over the distinct vertices of the rows.
        self.vertices, self.vertex = np.unique(self.ids, return_inverse=True)
        self.root = np.arange(len(self.vertices))

    def led(self, cell: int) -> list[int]:
        """The rows of a cell's leaders."""
        if cell not in self.leaders:
            at, n = self.start[cell], self.size[cell]
            self.leaders[cell] = [at + i for i in _leaders(self.fps[at : at + n])]
        return self.leaders[cell]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs between cells ``a`` and ``b``, some at a time; crowded cells by leaders first."""
        work = self.size[a] * self.size[b]
        small = work <= CELL * CELL
        bounds = np.cumsum(work[small]) // (ROWS * 4)
        for part in np.unique(bounds):
            x, y = a[small][bounds == part], b[small][bounds == part]
            left = _spread(self.start[x], self.size[x])
            n = np.repeat(self.size[y], self.size[x])
            yield np.repeat(left, n), _spread(np.repeat(self.start[y], self.size[x]), n)
        for x, y in zip(a[~small].tolist(), b[~small].tolist(), strict=True):
            for led, other in {(x, y), (y, x)}:
                rows = np.arange(self.start[other], self.start[other] + self.size[other])
                for leader in self.led(led):
                    yield np.full(len(rows), leader), rows
            yield from self._rest(x, y)

    def _rest(self, x: int, y: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs of two crowded cells that are not in one tree; trees grow in between."""
        left, right = (np.arange(self.start[c], self.start[c] + self.size[c]) for c in (x, y))
        for tree in np.unique(self.root[self.vertex[left]]).tolist():
            mine = left[self.root[self.vertex[left]] == tree]
            while len(mine):
                others = right[self.root[self.vertex[right]] != self.root[self.vertex[mine[0]]]]
                if not len(others):
                    break
                some, mine = np.split(mine, [max(1, ROWS * 4 // len(others))])
                for at in range(0, len(others), ROWS * 4):
                    piece = others[at : at + ROWS * 4]
                    yield np.repeat(some, len(piece)), np.tile(piece, len(some))

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Put the vertices ``a[i]`` and ``b[i]`` into one tree; roots are the least vertices."""
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up

    def links(self) -> pa.RecordBatch:
        """A spanning forest of all links among these rows; one edge per vertex at most."""
        # Equal segments meet in both halves of a table; one of the two is enough.
        first_side = np.flatnonzero((self.cells >> (2 * HALF)) % 2 == 0)
        several = first_side[self.size[first_side] > 1]
        meeting = [(several, several)]
        for bit in range(HALF):
            around = np.flatnonzero(self.cells >> bit & 1)
            wanted = self.cells[around] ^ (1 << bit)
            at = np.searchsorted(self.cells, wanted)
            hit = self.cells[at] == wanted  # the wanted number is smaller, so it is within
            meeting.append((around[hit], at[hit]))
        for a, b in meeting:
            for x, y in self._pairs(a, b):
                open_ = self.root[self.vertex[x]] != self.root[self.vertex[y]]
                x, y = x[open_], y[open_]
                near = _near(self.fps[x], self.fps[y])
                self._join(self.vertex[x[near]], self.vertex[y[near]])
        tied = np.flatnonzero(self.root != np.arange(len(self.root)))
        ends = self.vertices[tied], self.vertices[self.root[tied]]
        return pa.record_batch({"a": pa.array(ends[0]), "b": pa.array(ends[1])})


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by place and part; whole parts are looked through together."""
    held: list[tuple[np.ndarray, ...]] = []
    many = 0

    def together() -> tuple[np.ndarray, ...]:
        return tuple(map(np.concatenate, zip(*held, strict=True)))

    for batch in batches:
        names = ("place", "part", "rest", "id")
        held.append((*(batch[c].to_numpy() for c in names), _words(batch)))
        many += batch.num_rows
        if many < ROWS:
            continue
        rows = together()
        ends = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        if len(ends):  # the last part may go on
            place, _, *others = (c[: ends[-1]] for c in rows)
            yield _Meeting(place, *others).links()
            rows = tuple(c[ends[-1] :] for c in rows)
        held, many = [rows], len(rows[0])
    if many:
        place, _, *others = together()
        yield _Meeting(place, *others).links()


def place_counts(fps: DataFrame, first: int = 0, last: int = TABLES) -> DataFrame:
    """``place, n``: the fingerprints that each place of the tables gets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dealt in _dealt(batches, first, last):
            place, n = np.unique(dealt["place"].to_numpy(), return_counts=True)
            yield pa.record_batch({"place": pa.array(place), "n": pa.array(n.astype(np.int64))})

    rows = fps.mapInArrow(common.tidied(counted), "place int, n bigint")
    return rows.groupBy("place").agg(F.expr("sum(n) AS n"))


def by_part(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """``rows`` with a ``part`` of their place, of about ``2 * most`` rows at most.

    The rows of a longer place are dealt into blocks, and every two blocks, or one alone, are a part.
    """
    longer = materialise(counts.where(f"n > {most}").selectExpr("place", f"int(ceil(n / {most})) AS m"))
    if longer.isEmpty():
        return rows.selectExpr("*", "0L AS part")
    known = lookup_join(rows, longer, "place", "left", common.BROADCAST_ROWS, computed=True)
    dealt = known.selectExpr("*", "coalesce(pmod(xxhash64(id, f0, f1, f2, f3), m), 0L) AS block")
    pairs = "transform(sequence(0, coalesce(m, 1) - 1), j -> least(j, block) * coalesce(m, 1) + greatest(j, block))"
    return dealt.selectExpr(*rows.columns, f"explode({pairs}) AS part")


def links(fps: DataFrame, first: int = 0, last: int = TABLES) -> DataFrame:
    """Edges ``a, b`` that connect what is linked in some tables: rows ``id, f0, f1, f2, f3``.

    Fingerprints with the same ``id`` count as linked.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(batches, first, last)

    rows = fps.mapInArrow(
        common.tidied(dealt),
        "place int, rest smallint, id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint",
    )
    rows = by_part(rows, place_counts(fps, first, last), ROWS)
    rows = rows.repartition("place", "part").sortWithinPartitions("place", "part")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.forests(_met(batches))

    return rows.mapInArrow(common.tidied(met), "a bigint, b bigint")


def linked(fps: DataFrame) -> DataFrame:
    """``id, component`` of each of the distinct fingerprints ``id, f0, f1, f2, f3``.

    The first tables link most of a large group. The others then look at whole components, so that
    its members are not tied to one another once more in every table.
    """
    tied = common.components(links(fps, 0, FIRST_TABLES), reduced=True)
    joined = fps.join(tied, F.expr("id = vertex"), "left")
    early = stored(joined.selectExpr("id", "coalesce(component, id) AS early", *WORDS))
    rest = links(early.selectExpr("early AS id", *WORDS), FIRST_TABLES, TABLES)
    tied = common.components(rest, reduced=True)
    return early.join(tied, F.expr("early = vertex"), "left").selectExpr(
        "id", "coalesce(component, early) AS component"
    )


def _links_of(ids: list[int], early: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    """A spanning forest of the links between sets that have not one ``early`` group already."""
    sizes = np.array([len(x) for x in sets], np.int64)
    root = np.unique(early, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, value = np.unique(np.concatenate(sets), return_inverse=True)
    holders = owner[np.argsort(value, kind="stable")]
    n = np.bincount(value, minlength=len(values))
    start, own = np.cumsum(n) - n, np.split(value, np.cumsum(sizes)[:-1])
    ends = [], []
    for i in range(len(sets) - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        common_ = np.bincount(holders[_spread(start[own[i]], n[own[i]])], minlength=len(sets))
        # a similarity of 4/5: 5 both >= 4 (one + other - both)
        near = (9 * common_ >= 4 * (sizes[i] + sizes)) & (sizes > 0) & (root != root[i])
        for j in np.flatnonzero(near).tolist():
            if root[j] != root[i]:
                ends[0].append(ids[i])
                ends[1].append(ids[j])
                root[root == root[j]] = root[i]
    return pa.record_batch({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})


def _compared(texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Links ``a, b`` among the sets of each task: ``key, id, early, task`` of every member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, early, sets = None, [], [], []
        for batch in batches:
            rows = (batch[c].to_pylist() for c in ("task", "id", "early"))
            for task, own, group, text in zip(*rows, common.texts_of(batch["text"]), strict=True):
                if task != now:
                    if len(ids) > 1:
                        yield _links_of(ids, early, sets)
                    now, ids, early, sets = task, [], [], []
                if not ids or own != ids[-1]:  # rows that repeat id and text come once
                    ids.append(own)
                    early.append(group)
                    sets.append(shingle_set(text, width))
        if len(ids) > 1:
            yield _links_of(ids, early, sets)

    lists = members.groupBy("key").agg(
        F.expr("first(id) AS id"), F.expr("first(early) AS early"), F.expr("collect_list(task) AS tasks")
    )
    rows = lookup_join(texts, lists, "key", max_broadcast=common.BROADCAST_ROWS)
    rows = rows.selectExpr("explode(tasks) AS task", "id", "early", "text")
    rows = rows.repartition("task").sortWithinPartitions("task", "id")
    return rows.mapInArrow(common.tidied(run), "a bigint, b bigint")


def _regrouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``early`` brought up to date by links between ids."""
    names = links.selectExpr("a AS id", "b AS other")
    tied = names.join(members.select("id", "early"), "id").selectExpr("other AS id", "early AS a")
    tied = tied.join(members.selectExpr("id", "early AS b"), "id").select("a", "b")
    tied = common.components(tied).selectExpr("vertex AS early", "component AS to")
    rows = lookup_join(members, tied, "early", "left", common.BROADCAST_ROWS)
    return stored(rows.withColumn("early", F.expr("coalesce(to, early)")).select(*members.columns))


def _blocks(n: str, size: str) -> str:
    return f"greatest(1, int(ceil({n} / {BLOCK})), int(ceil({size} / {BLOCK_SHINGLES})))"


def similar_sets(texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``id, early``: the group that each member of a component of candidates is in.

    ``members`` has ``key`` (of a row of ``texts``), ``id``, ``size`` and ``component``. Two sets of
    one component are in one group if similar sets of the component connect them.
    """
    whole = members.groupBy("component").agg(F.expr("count(*) AS n"), F.expr("sum(size) AS total"))
    whole = whole.where("n > 1").selectExpr("component", f"{_blocks('n', 'total')} AS blocks")
    rows = lookup_join(members, whole, "component", max_broadcast=common.BROADCAST_ROWS)
    rows = stored(rows.selectExpr("*", "id AS early", "pmod(xxhash64(id, 7L), blocks) AS block"))
    task = "xxhash64(component, block) AS task"
    found = _compared(texts, rows.selectExpr("key", "id", "early", task), width)
    rows = _regrouped(rows, stored(found))
    done, large = rows.where("blocks = 1"), rows.where("blocks > 1")
    if large.isEmpty():
        return done.select("id", "early")
    # One member per group, as blocks of their own.
    firsts = large.where("id = early")
    many = firsts.groupBy("component").agg(F.expr("count(*) AS n"), F.expr("sum(size) AS total"))
    many = many.selectExpr("component", f"{_blocks('n', 'total')} AS parts")
    firsts = firsts.join(many, "component").selectExpr(
        "key", "id", "early", "xxhash64(component, pmod(xxhash64(id, 8L), parts)) AS task"
    )
    large = _regrouped(large, stored(_compared(texts, firsts, width)))
    # Every pair of blocks that are not both of one group; large groups have blocks of their own.
    groups = large.groupBy("component", "early").agg(F.expr("count(*) AS n"), F.expr("sum(size) AS total"))
    groups = groups.selectExpr("*", f"IF({_blocks('n * 2', 'total * 2')} > 1, early, NULL) AS owner")
    pools = groups.groupBy("component", "owner").agg(F.expr("sum(n) AS n"), F.expr("sum(total) AS total"))
    pools = pools.selectExpr("component", "owner", f"{_blocks('n', 'total')} AS parts")
    own = large.join(groups.select("component", "early", "owner"), ["component", "early"])
    own = own.alias("x").join(
        pools.alias("y"), F.expr("x.component = y.component AND x.owner <=> y.owner")
    ).selectExpr(
        "key", "id", "early", "x.component AS component", "x.owner AS owner",
        "xxhash64(coalesce(x.owner, 0L), isnull(x.owner), pmod(xxhash64(id, 9L), parts)) AS block",
    )
    own = stored(own)
    blocks = own.groupBy("component", "owner", "block").agg(F.expr("count(*) AS n"))
    pairs = blocks.alias("x").join(
        blocks.alias("y"),
        F.expr("x.component = y.component AND x.block <= y.block AND NOT coalesce(x.owner = y.owner, false)"),
    )
    pairs = pairs.selectExpr(
        "x.component AS component", "x.block AS one", "y.block AS other",
        "xxhash64(x.component, x.block, y.block) AS task",
    )
    pairs = pairs.selectExpr("component", "task", "explode(array_distinct(array(one, other))) AS block")
    tasks = own.join(pairs, ["component", "block"]).select("key", "id", "early", "task")
    large = _regrouped(large, stored(_compared(texts, tasks, width)))
    return done.unionByName(large).select("id", "early")


def grouped(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of ``docs`` but the text, ``component_id`` (the group's least id), ``component``.

    Groups that share a least id, as ids may repeat, differ in ``component``.
    """
    key = "xxhash64(doc_id, xxhash64(text)) AS key"
    rows = stored(wide_fingerprints(docs.selectExpr("*", key), width))
    kept = [c for c in docs.columns if c != "text"]
    first = [f"first({c}) AS {c}" for c in ("size", *WORDS)]
    fps = rows.groupBy("id").agg(*map(F.expr, ["min(doc_id) AS least", "min(key) AS key", *first]))
    fps = stored(fps)
    candidates = linked(fps.select("id", *WORDS))
    members = stored(fps.select("id", "key", "size").join(candidates, "id"))
    found = similar_sets(docs.selectExpr("text", key), members, width)
    named = fps.select("id", "least").join(found, "id", "left")
    named = stored(named.selectExpr("id", "least", "coalesce(early, id) AS component"))
    ids = named.groupBy("component").agg(F.expr("min(least) AS component_id"))
    groups = named.join(ids, "component").select("id", "component_id", "component")
    joined = lookup_join(rows, groups, "id", max_broadcast=common.BROADCAST_ROWS)
    return joined.select(*kept, "component_id", "component")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of ``docs`` but the text, and ``component_id``: the least id of the group."""
    return grouped(docs, width).drop("component")


def one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """All columns of one document of each group of near-duplicates: the one with the least id.

    Of rows of the group that repeat that id the one with the least hash of its text stays; an id that
    stands in several groups stays in each. Rows without id go if their group has an id, and stay if
    it has none. Of candidates one text per set moves to be compared; the others move only if the
    list of documents to drop is too long to broadcast.
    """
    own = common.fresh(docs, "mark")
    mark = "concat_ws(':', doc_id, xxhash64(text))"
    placed = stored(grouped(docs.selectExpr("doc_id", "text", f"{mark} AS mark"), width))
    first = placed.where("doc_id = component_id").groupBy("component")
    first = first.agg(F.expr("min(mark) AS stays"), F.expr("max(mark) AS last"))
    first = first.where("stays < last").select("component", "stays")
    others = lookup_join(placed, first, "component", max_broadcast=common.BROADCAST_ROWS)
    gone = placed.where("NOT doc_id <=> component_id").select("mark")
    gone = gone.unionByName(others.where("doc_id = component_id AND mark > stays").select("mark"))
    gone = gone.selectExpr(f"mark AS {own}").distinct()
    kept = lookup_join(docs.withColumn(own, F.expr(mark)), gone, own, "left_anti", common.BROADCAST_ROWS)
    marks = placed.where("doc_id IS NOT NULL").groupBy("mark").agg(F.expr("count(*) AS n"))
    repeated = marks.where("n > 1").selectExpr(f"mark AS {own}")
    return common.one_row_per(kept, own, repeated).select(*docs.columns)
