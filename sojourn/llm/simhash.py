"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 64 bits: a bit is set where more than half of its shingle hashes set
it. Fingerprints link when few bits differ. For two differing bits, either the high half differs by
at most one bit or the low half is equal, so it is enough to

* enumerate the Hamming ball of radius one around the high half, fetch the table rows with that
  high half, and verify the whole distance;
* fetch the rows with an equal low half, and verify.

Copies never meet: equal fingerprints are one table row. Where a half is shared by so many
fingerprints that pairs would grow with their square, links come from masked keys instead: two
fingerprints with the same key differ in the masked bits only, so tying every one to the least of
its key gives the same components with a bounded number of rows each.

Null text counts as empty; a text without words has fingerprint zero, linked like any other. Rows
with a null id get the component of their group, which is null if the whole group has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.operators.distribute import lookup_join
from sojourn.session import stored

SHINGLE_WORDS = 3
SEED = 42
# Up to this many fingerprints on one side of a bucket are compared pair by pair.
BUCKET = 64
# Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, some at a time; nothing if there are no words."""
    words = text.lower().split()  # of bytes: only A-Z change, and the six ASCII spaces split
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        spans = zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8")


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of the whole text, in bounded memory beside its words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of ``docs`` but the text, and ``fp``: the fingerprint as a signed long."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in common.texts_of(batch["text"])]
            signed = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            columns = [*(batch[c] for c in kept), signed]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "fp"])

    return docs.mapInArrow(common.tidied(run), common.plus(docs.drop("text"), fp="bigint"))


def _same_half(fps: DataFrame, half: str, other: str, bucket: int) -> list[DataFrame]:
    """Links between fingerprints with equal ``half`` and one or two differing bits in ``other``."""
    sizes = fps.groupBy(half).agg(F.expr("count(*) AS size")).where("size > 1")
    shared = fps.join(sizes, half)
    small = shared.where(f"size <= {bucket}")
    left, right = small.alias("l"), small.alias("r")
    near = f"l.{half} = r.{half} AND l.fp < r.fp AND bit_count(l.fp ^ r.fp) <= 2"
    pairs = left.join(right, F.expr(near)).selectExpr("l.fp AS a", "r.fp AS b")
    masks = "flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> "
    masks += f"{other} & ~(shiftleft(1L, i) | shiftleft(1L, j)) | shiftleft(i * 32L + j, 32))))"
    keyed = shared.where(f"size > {bucket}").selectExpr("fp", half, f"explode({masks}) AS mask")
    return [pairs, _ties(keyed, [half, "mask"])]


def _ties(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Every fingerprint tied to the least and, through it, to all others of its key."""
    least = keyed.groupBy(*keys).agg(F.expr("min(fp) AS b"), F.expr("count(*) AS n"))
    return keyed.join(least.where("n > 1"), keys).where("fp > b").selectExpr("fp AS a", "b")


def _ball(fps: DataFrame, bucket: int) -> list[DataFrame]:
    """Links between fingerprints that differ in one bit of the high and one of the low half.

    The one of the two whose bit is set probes with that bit cleared, so a pair meets once.
    """
    set_bits = "filter(sequence(0, 31), i -> (hi & shiftleft(1L, i)) != 0)"
    probes = fps.selectExpr("fp", "lo", "hi", f"explode({set_bits}) AS i").selectExpr(
        "fp", "lo", "i", "hi & ~shiftleft(1L, i) AS at"
    )
    # Only probes that hit a table row matter; sizes of both sides come with them.
    sizes = fps.groupBy("hi").agg(F.expr("count(*) AS rows"))
    hits = stored(probes.join(sizes, F.expr("at = hi")).drop("hi"))
    load = hits.groupBy("at").agg(F.expr("count(*) AS probes"))
    hits = hits.join(load, "at")
    crowded = f"(rows > {bucket} AND probes > {bucket})"
    near = "p.at = t.hi AND bit_count(p.lo ^ t.lo) = 1"
    pairs = hits.where(f"NOT {crowded}").alias("p").join(fps.alias("t"), F.expr(near))
    pairs = pairs.selectExpr("p.fp AS a", "t.fp AS b")
    crowd = hits.where(crowded)
    places = crowd.selectExpr("at", "i").distinct()
    both = crowd.select("fp", "lo", "at", "i").unionByName(
        fps.join(places, F.expr("hi = at")).select("fp", "lo", "at", "i")
    )
    masks = "transform(sequence(0, 31), j -> lo & ~shiftleft(1L, j) | shiftleft(cast(j as bigint), 32))"
    keyed = both.selectExpr("fp", "at", "i", f"explode({masks}) AS mask")
    return [pairs, _ties(keyed, ["at", "i", "mask"])]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` that connect distinct ``fp`` at two or fewer differing bits.

    Between fingerprints of a crowded bucket the edges are a spanning part of all links.
    """
    halves = fps.selectExpr(
        "fp", "shiftrightunsigned(fp, 32) AS hi", "fp & 4294967295L AS lo"
    )
    found = [
        *_same_half(halves, "hi", "lo", bucket),
        *_same_half(halves, "lo", "hi", bucket),
        *_ball(halves, bucket),
    ]
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def groups(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``fp, component_id`` for rows ``doc_id, fp``: the least id of all linked fingerprints."""
    fps = stored(rows.groupBy("fp").agg(F.expr("min(doc_id) AS least")))
    tied = common.components(links(fps.select("fp"), bucket))
    named = fps.join(tied, F.expr("fp = vertex"), "left").selectExpr(
        "fp", "least", "coalesce(component, fp) AS component"
    )
    named = stored(named)
    least = named.groupBy("component").agg(F.expr("min(least) AS component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document; copies are rows, never pairs."""
    rows = stored(fingerprints(docs.select("doc_id", "text"), width))
    joined = lookup_join(rows, groups(rows), "fp", max_broadcast=common.BROADCAST_ROWS)
    return joined.selectExpr(
        "doc_id", "lpad(lower(hex(fp)), 16, '0') AS fingerprint", "component_id"
    )
