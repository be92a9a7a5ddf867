"""What several corpus operators share: tables, word hashes, Arrow maps, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sojourn.operators.distribute import lookup_join
from sojourn.session import materialise, stored

# Lookup sides are broadcast up to this many counted rows of a few numbers each.
BROADCAST_ROWS = 200_000
# Rows that a worker gets at once, and their bytes; a longer row comes alone.
ARROW_ROWS = 1000
ARROW_BYTES = 2 << 20
# A worker's cache of word hashes is emptied at this size.
CACHE_WORDS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and keep Arrow batches small.

    Texts differ much in length, so batches are bounded by rows and by bytes, in the JVM as well as
    in the workers.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    if any(os.path.basename(path) == f"{name}.zip" for path in context.listFiles):
        return
    base = os.path.join(tempfile.mkdtemp(prefix=f"{name}-code-"), name)
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), name))


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lowered(word: str) -> str:
    """A word with A-Z lower-cased (SQL); ``lower`` alone would change other letters as well."""
    ascii_only = f"octet_length({word}) = char_length({word})"
    return f"IF({ascii_only}, lower({word}), translate({word}, '{UPPER}', '{LOWER}'))"


class WordHashes(dict):
    """XXH64 of byte words, remembered up to a bound."""

    def __init__(self, seed: int = 0, most: int = CACHE_WORDS):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(a: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return a ^ (a >> np.uint64(33))


def plus(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with further columns."""
    more = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
    return StructType([*df.schema.fields, *more.fields])


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, or a single longer text."""
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0)
    start = total = 0
    for i, size in enumerate(sizes.to_pylist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def per_batch(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``function`` over Arrow batches; it sees one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return df.mapInArrow(tidied(run), schema)


def tidied(function: Callable) -> Callable:
    """``function`` for ``mapInArrow``, with its memory given back when the task ends.

    Workers live on for later tasks; what they had grown to would stay with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def held_out(doc_id: str = "doc_id") -> str:
    """SQL: the row belongs to the quarter of rows that no model learns from."""
    return f"coalesce(crc32(cast(cast({doc_id} as string) as binary)) % 4 = 2, false)"


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch of edges, every edge pointing to its tree's least vertex."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            top = v
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(v, v)) != top:
                parent[v], v = top, up
            return top

        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        ends = list(parent)
        yield pa.record_batch(
            {"a": pa.array(ends, pa.int64()), "b": pa.array([root(v) for v in ends], pa.int64())}
        )


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``a > b``.

    Large: every larger neighbour of a vertex is tied to the least vertex around it. Small: the
    vertex and its smaller neighbours are. Least neighbours are pre-aggregated and joined back as
    a lookup, so a vertex with a third of all edges stays spread out.
    """
    if large:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.expr("least(a, min(b)) AS m"))
        tied = lookup_join(both, least, "a", max_broadcast=BROADCAST_ROWS)
        tied = tied.where("b > a").selectExpr("b AS a", "m AS b")
    else:
        least = edges.groupBy("a").agg(F.expr("min(b) AS m"))
        tied = lookup_join(edges, least, "a", max_broadcast=BROADCAST_ROWS)
        tied = tied.selectExpr("inline(array(struct(a, m AS b), struct(b AS a, m AS b)))")
    return tied.where("a > b").distinct()


def components(edges: DataFrame, reduced: bool = False) -> DataFrame:
    """``vertex, component`` (the least vertex reachable) of every vertex of ``edges(a, b)``.

    ``reduced`` edges come as :func:`forests` already, from the map that made them.

    Alternating star contraction; each round is written out, and the rounds end when nothing
    changes, after about log(n)^2 rounds at worst. Loops are ignored; no edges give no rows.
    """
    edges = edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a > b")
    if not reduced:
        edges = edges.mapInArrow(tidied(forests), "a bigint, b bigint")
    edges = stored(edges.distinct())
    before = None
    while True:
        edges = stored(_stars(_stars(edges, large=True), large=False))
        state = edges.selectExpr("count(*) AS n", "sum(cast(xxhash64(a, b) as decimal(38,0))) AS s")
        now = tuple(state.first())
        if now == before:
            break
        before = now
    tops = edges.selectExpr("b AS vertex", "b AS component").distinct()
    return edges.selectExpr("a AS vertex", "b AS component").unionByName(tops)


def one_row_per(df: DataFrame, key: str, repeated: DataFrame) -> DataFrame:
    """One row of each of the ``repeated`` keys; only their rows are shuffled. Null keys all stay."""
    repeated = materialise(repeated)
    if repeated.isEmpty():
        return df
    single = lookup_join(df, repeated, key, "left_anti", BROADCAST_ROWS, computed=True)
    several = lookup_join(df, repeated, key, "left_semi", BROADCAST_ROWS, computed=True)
    return single.unionByName(several.dropDuplicates([key]))
