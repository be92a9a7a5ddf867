"""Near-duplicate vectors by random-hyperplane sign hashing.

Within a label, equal vectors become one class. Classes whose sign hash agrees in one of several
tables are compared by their exact cosine. A pair that meets in several tables counts in the first
only, which both sides' hashes tell, so links are counted without collecting pairs.

A table's bucket that is too large for one task is dealt into blocks of bounded size, and every two
blocks meet in a task of their own, so crowded buckets are compared in full. Tasks hand on counts
per class and, as edges, a spanning forest of their links.

Vectors that are null, zero or empty, hold null or non-finite components, or have no label link with
nothing. Vectors of different length never link. Rows without id are classed with their equals but
do not name a component.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.operators.distribute import lookup_join
from sojourn.session import stored

COSINE = 0.93
# The chance that a pair at the limit meets in some table; pairs above it meet more often.
RECALL = 0.993
# Classes that a bucket holds by chance. Hashes are whole numbers of 13 to 31 bits.
LOAD = 0.5
BITS = (13, 31)
SEED = 20
# Classes of one bucket that one task compares with another such block.
BLOCK = 1024


def classes(vectors: DataFrame) -> DataFrame:
    """``class, label, v, least, size``: distinct sound vectors within a label."""
    sound = "label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, "
    sound += "x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    sound += " AND exists(embedding, x -> x != 0)"
    key = "sha2(concat_ws(',', transform(embedding, x -> string(double(x) + 0))), 256)"
    rows = vectors.selectExpr("vec_id", "label", "embedding", f"{sound} AS sound")
    rows = rows.selectExpr(
        "vec_id",
        "label",
        "IF(sound, embedding, NULL) AS v",
        f"IF(sound, {key}, NULL) AS key",
    )
    return rows


@dataclass(frozen=True)
class Scheme:
    """Bits of a hash, and in how many tables vectors meet."""

    bits: int

    @classmethod
    def of(cls, n: int) -> Scheme:
        """For ``n`` classes in the largest label."""
        least, most = BITS
        return cls(min(max(math.ceil(math.log2(max(n, 1) / LOAD)), least), most))

    @property
    def tables(self) -> int:
        meet = (1 - math.acos(COSINE) / math.pi) ** self.bits
        return math.ceil(math.log(1 - RECALL) / math.log(1 - meet))

    def planes(self, dim: int) -> np.ndarray:
        """Normals of all tables' hyperplanes; the same on every machine."""
        draw = np.random.default_rng([SEED, dim])
        return draw.standard_normal((dim, self.tables * self.bits))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(False).astype(float).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _hashed(scheme: Scheme) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Adds one whole-number hash per table, as bytes of int32 and as a list."""
    bits, tables = scheme.bits, scheme.tables

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = 1 << np.arange(bits, dtype=np.int64)
        hashes = np.zeros((batch.num_rows, tables), np.int32)
        dims = np.array(batch["dim"].to_pylist(), int)
        for dim in set(dims.tolist()):
            planes = scheme.planes(dim)
            at = np.flatnonzero(dims == dim)
            units = _units(batch["v"].take(pa.array(at)), dim)
            # One row at a time, so that equal vectors hash alike in any batch.
            signs = np.array([u @ planes >= 0 for u in units]).reshape(-1, tables, bits)
            hashes[at] = signs @ weights
        return pa.RecordBatch.from_arrays(
            [
                batch["class"],
                pa.array([row.tobytes() for row in hashes], pa.binary()),
                pa.array(hashes.tolist(), pa.list_(pa.int32())),
            ],
            names=["class", "h", "buckets"],
        )

    return add


class Found:
    """Links of one task: neighbours counted per class, and edges."""

    def __init__(self, tables: int):
        self.tables = tables
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(self, rows: pa.Table) -> None:
        """Two blocks of a bucket, or one with itself where there is one side only."""
        rows = rows.combine_chunks()
        t, dim, n = rows["t"][0].as_py(), rows["dim"][0].as_py(), rows.num_rows
        ids, sizes = rows["class"].to_numpy(), rows["size"].to_numpy()
        u = _units(rows["v"].combine_chunks(), dim)
        h = np.frombuffer(b"".join(rows["h"].to_pylist()), np.int32).reshape(n, self.tables)[:, :t]
        side, own = rows["side"].to_numpy().astype(bool), rows["own"][0].as_py()
        right = np.arange(n) if own else np.flatnonzero(side)
        for part in np.array_split(np.flatnonzero(~side), -(-n // 256)):
            near = u[part] @ u[right].T >= COSINE - 1e-9
            if own:
                near &= part[:, None] < right
            i, j = np.nonzero(near)
            i, j = part[i], right[j]
            exact = (u[i] * u[j]).sum(axis=1) >= COSINE
            i, j = i[exact], j[exact]
            first = ~(h[i] == h[j]).any(axis=1)
            i, j = i[first], j[first]
            if len(i):
                self.edges.append((ids[i], ids[j]))
                self.counts += [(ids[i], sizes[j]), (ids[j], sizes[i])]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row ``a, b`` per edge of a spanning forest, a row ``a, n`` per class with links."""
        if not self.edges:
            return
        a, b = (np.concatenate(x) for x in zip(*self.edges, strict=True))
        edges = pa.record_batch({"a": pa.array(a), "b": pa.array(b)})
        forest = next(common.forests(iter([edges])))
        where, size = (np.concatenate(x) for x in zip(*self.counts, strict=True))
        ids, at = np.unique(where, return_inverse=True)
        totals = np.zeros(len(ids), np.int64)
        np.add.at(totals, at, size)
        none = pa.nulls(forest.num_rows, pa.int64())
        yield pa.record_batch({"a": forest["a"], "b": forest["b"], "n": none})
        none = pa.nulls(len(ids), pa.int64())
        yield pa.record_batch({"a": pa.array(ids), "b": none, "n": pa.array(totals)})
        self.edges, self.counts = [], []


def _linked(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by ``meet``; those of one value are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, key = Found(scheme.tables), [], None
        for batch in batches:
            keys = batch["meet"].to_pylist()
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if keys[start] != key:
                    if held:
                        found.compare(pa.Table.from_batches(held))
                    held, key = [], keys[start]
                held.append(batch.slice(start, end - start))
            if sum(len(a) for a, _ in found.edges) > 1 << 20:
                yield from found.batches()
        if held:
            found.compare(pa.Table.from_batches(held))
        yield from found.batches()

    return run


def near_duplicates(
    vectors: DataFrame, block: int = BLOCK, scheme: Scheme | None = None
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row; ``kept`` marks the least id of a group.

    ``scheme`` is chosen by the size of the largest label if not given.
    """
    rows = stored(classes(vectors))
    found = rows.where("key IS NOT NULL").groupBy("label", "key").agg(
        F.expr("min(vec_id) AS least"), F.expr("count(*) AS size"), F.expr("min(v) AS v")
    )
    found = stored(found.withColumn("class", F.expr("monotonically_increasing_id()")))
    sound = found.selectExpr("class", "string(label) AS label", "size", "v", "size(v) AS dim")
    if scheme is None:
        sizes = found.groupBy("label").agg(F.expr("count(*) AS n"))
        scheme = Scheme.of(sizes.selectExpr("coalesce(max(n), 0L) AS n").first()["n"])
    hashed = stored(
        common.per_batch(
            sound.select("class", "dim", "v"), _hashed(scheme), "class bigint, h binary, buckets array<int>"
        )
    )
    keys = ["label", "dim", "t", "bucket"]
    placed = hashed.join(sound.select("class", "label", "dim"), "class").selectExpr(
        "class", "label", "dim", "posexplode(buckets) AS (t, bucket)"
    )
    placed = stored(placed)
    loads = placed.groupBy(*keys).agg(F.expr("count(*) AS load")).where("load > 1")
    # A block is the left side with itself and later blocks, and the right side with earlier ones.
    meetings = placed.join(loads, keys).selectExpr(
        "*",
        f"ceil(load / {block}) AS blocks",
        f"pmod(xxhash64(class), ceil(load / {block})) AS mine",
    ).selectExpr(
        "class",
        "t",
        "concat_ws(':', label, dim, t, bucket) AS place",
        "explode(sequence(0L, blocks - 1)) AS other",
        "mine",
    ).selectExpr(
        "class",
        "struct(t, other = mine AS own, int(other < mine) AS side, concat_ws(':', place, least(mine, other), "
        "greatest(mine, other)) AS meet) AS m",
    )
    meetings = meetings.groupBy("class").agg(F.expr("collect_list(m) AS ms"))
    met = sound.join(hashed.select("class", "h"), "class").join(meetings, "class").selectExpr(
        "class", "size", "dim", "v", "h", "inline(ms)"
    )
    met = met.repartition("meet").sortWithinPartitions("meet")
    met = stored(met.mapInArrow(common.tidied(_linked(scheme)), "a bigint, b bigint, n bigint"))
    linked = met.where("n IS NOT NULL").groupBy("a").agg(F.expr("sum(n) AS links"))
    tied = common.components(met.where("b IS NOT NULL").select("a", "b"))
    named = (
        found.select("label", "key", "class", "least", "size")
        .join(linked, F.expr("class = a"), "left")
        .join(tied, F.expr("class = vertex"), "left")
        .selectExpr(
            "class", "label", "key", "least", "coalesce(links, 0L) + size - 1 AS n_links",
            "coalesce(component, class) AS component",
        )
    )
    named = stored(named)
    least = named.groupBy("component").agg(F.expr("min(least) AS component_id"))
    named = named.join(least, "component").selectExpr(
        "concat(label, ':', key) AS class_key", "n_links", "component_id"
    )
    keyed = rows.selectExpr("vec_id", "concat(label, ':', key) AS class_key")
    joined = lookup_join(
        keyed.where("class_key IS NOT NULL"), named, "class_key", max_broadcast=common.BROADCAST_ROWS
    ).select("vec_id", "n_links", "component_id")
    alone = keyed.where("class_key IS NULL").selectExpr(
        "vec_id", "0L AS n_links", "vec_id AS component_id"
    )
    return joined.unionByName(alone).selectExpr(
        "*", "coalesce(vec_id = component_id, false) AS kept"
    )
