"""Exact top-k by inner product with a pivot table.

Vectors become whole numbers, ``floor(256 * x)``. One more coordinate lifts all of them onto a sphere
(the queries keep 0 there), where the largest inner product is the least distance. Every vector's
distances to fixed pivots are computed once, as its row of the pivot table. For a query and a
candidate, the largest difference of the two rows bounds their distance from below, hence the score
from above.

Candidates are range-partitioned by nearest pivot and distance to it into blocks, and a block's rows,
in that order, into rings; the intervals of a ring's or block's pivot distances bound all of its rows at
once. A query first visits the block it stands in itself, which gives it a k-th best score. It is then
sent only to the other blocks whose bound reaches that score. Within a block, rings are evaluated in the
order of their bounds, each for the queries whose k-th score its bound still reaches, so results are
exact. Candidates are stored once and copied only per ``QUERY_BLOCK`` queries.

Vectors that are null or hold null or non-finite components take no part, nor do rows without id.
Every row is a candidate, also several of one id; a query's own id is none. Query rows of one id
share one list. Only vectors of equal length are compared. Scores beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.session import stored

PIVOTS = 24
# Queries and candidates that a task holds.
QUERY_BLOCK = 1 << 15
CANDIDATE_BLOCK = 1 << 15
LEAST_BLOCKS = 12
# Candidates of a ring, which are evaluated between two looks at the bound.
STEP = 256
LONG_ENDS = (-(2**63), 2**63 - 1)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, v`` with ``v = floor(256 * x)`` as doubles, for every row that takes part."""
    sound = "embedding IS NOT NULL AND vec_id IS NOT NULL AND forall(embedding, "
    sound += "x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    # A double of 2^53 or more is a whole number already.
    whole = "transform(transform(embedding, x -> 256D * double(x)), "
    whole += "y -> IF(abs(y) < 9e15D, double(floor(y)), y))"
    rows = vectors.where(sound).selectExpr("vec_id", "embedding")
    return rows.selectExpr("vec_id", "size(embedding) AS dim", f"{whole} AS v")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(False).reshape(-1, dim)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products; of Python integers where a double would not hold them."""
    top = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * queries.shape[1]
    if top < 2**53:
        return queries @ candidates.T
    exact = [[int(x) for x in row] for row in candidates]
    rows = [[int(x) for x in row] for row in queries]
    low, high = LONG_ENDS
    found = [
        [min(high, max(low, sum(map(int.__mul__, a, b)))) for b in exact] for a in rows
    ]
    return np.array(found, object).reshape(len(queries), len(candidates))


def _distances(lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (lifted**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * lifted @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _bounds(scale: np.ndarray, rows_q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest score each query can have with any candidate within the pivot intervals.

    ``scale`` is a query's squared length and the squared radius together; one row of ``low`` and
    ``high`` per group of candidates.
    """
    lower = np.zeros((len(rows_q), len(low)))
    for p in range(rows_q.shape[1]):
        mine = rows_q[:, p, None]
        np.maximum(lower, low[:, p] - mine, out=lower)
        np.maximum(lower, mine - high[:, p], out=lower)
    return (scale[:, None] - lower**2) / 2 + 1e-6 * (scale[:, None] + 1)  # room for rounding


def block_top(queries, query_ids, rows_q, floors, cands, cand_ids, rows_c, radius2: float, k: int):
    """Best ``k`` of one candidate block for each query: (query, candidate, score) lists, and the
    number of pairs that were evaluated.

    ``rows_q`` and ``rows_c`` are rows of the pivot table, ``radius2`` the squared radius. ``floors``
    are scores that a query has ``k`` candidates for already.
    """
    near = rows_c.argmin(1)
    order = np.lexsort((cand_ids, rows_c.min(1), near))
    cands, cand_ids, rows_c = cands[order], cand_ids[order], rows_c[order]
    starts = np.arange(0, len(cands), STEP)
    low, high = (f.reduceat(rows_c, starts) for f in (np.minimum, np.maximum))
    upper = _bounds((queries**2).sum(1) + radius2, rows_q, low, high)
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    least = floors.astype(float)
    evaluated = 0
    for ring in np.argsort(-upper.max(0), kind="stable").tolist():
        active = np.flatnonzero(upper[:, ring] >= least)
        if not len(active):
            continue
        some = slice(starts[ring], starts[ring] + STEP)
        found, ids = _scores(queries[active], cands[some]), cand_ids[some]
        evaluated += found.size
        wanted = (found >= least[active, None]) & (query_ids[active, None] != ids)
        for row in np.flatnonzero(wanted.any(1)).tolist():
            q, hits = active[row], np.flatnonzero(wanted[row])
            new = [(-int(found[row, j]), int(ids[j])) for j in hits.tolist()]
            best[q] = sorted(best[q] + new)[:k]
            if len(best[q]) == k:
                least[q] = max(least[q], float(-best[q][-1][0]))
    out = ([], [], [])
    for q, rows in enumerate(best):
        out[0].extend([int(query_ids[q])] * len(rows))
        out[1].extend(i for _, i in rows)
        out[2].extend(-s for s, _ in rows)
    return out, evaluated


def search(vectors: DataFrame, queries: str, k: int = 5, counted: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of all other rows for each row that
    satisfies ``queries`` (SQL), ties to the smaller id.

    ``counted`` gives ``pairs, evaluated`` instead: how many scores there are and were computed.
    """
    whole = stored(whole_vectors(vectors))
    size = whole.selectExpr(
        "count(*) AS n",
        f"count_if({queries}) AS q",
        "max(aggregate(v, 0D, (s, x) -> s + double(x) * double(x))) AS radius2",
    ).first()
    if not size["q"]:
        return whole.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0L AS score").limit(0)
    chunks = -(-size["q"] // QUERY_BLOCK)
    blocks = max(LEAST_BLOCKS, -(-size["n"] // CANDIDATE_BLOCK))
    radius2 = float(size["radius2"])
    # Pivots are a few rows in a seeded random order, with their own lift.
    seen = whole.selectExpr("dim", "v", "xxhash64(vec_id, 7) AS draw")
    picked = seen.orderBy("draw", "v").limit(PIVOTS).collect()
    pivots = [(r["dim"], np.array([float(x) for x in r["v"]])) for r in picked]

    def lifted(v: np.ndarray, is_query: bool) -> np.ndarray:
        rest = np.zeros(len(v)) if is_query else np.sqrt(np.maximum(radius2 - (v**2).sum(1), 0))
        return np.column_stack((v, rest))

    def distances(v: np.ndarray, is_query: bool) -> np.ndarray:
        mine = [p for dim, p in pivots if dim == v.shape[1]] or [np.zeros(v.shape[1])]
        return _distances(lifted(v, is_query), lifted(np.array(mine), False))

    def tabled(df: DataFrame, is_query: bool) -> DataFrame:
        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            dims = np.array(batch["dim"].to_pylist(), int)
            rows_of: list = [None] * batch.num_rows
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                v = batch["v"].take(pa.array(at)).flatten().to_numpy(False).reshape(len(at), dim)
                for i, d in zip(at.tolist(), distances(v, is_query), strict=True):
                    rows_of[i] = d
            made = pa.array(rows_of, pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "d"])

        return common.per_batch(df, rows, common.plus(df, d="array<double>"))

    placed = tabled(whole, False).selectExpr(
        "*", "cast(array_position(d, array_min(d)) as int) AS near", "array_min(d) AS far"
    )
    ranged = placed.repartitionByRange(blocks, "dim", "near", "far", "vec_id")
    cands = stored(ranged.drop("near", "far").withColumn("c", F.spark_partition_id()))
    spans = cands.selectExpr("dim", "c", "posexplode(d) AS (p, x)").groupBy("dim", "c", "p")
    spans = spans.agg(F.expr("min(x) AS low"), F.expr("max(x) AS high")).groupBy("dim", "c")
    spans = spans.agg(F.expr("sort_array(collect_list(struct(p, low, high))) AS s"))
    # One row of a few hundred bytes per block of candidates.
    table: dict[int, list] = {}
    for r in spans.orderBy("dim", "c").collect():
        ends = np.array([(e["low"], e["high"]) for e in r["s"]])
        table.setdefault(r["dim"], []).append((r["c"], ends))
    chunk = f"cast(pmod(xxhash64(vec_id, 3), {chunks}) as int) AS q"
    asked = stored(tabled(cands.where(queries).select("vec_id", "dim", "v", "c"), True).selectExpr("*", chunk))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found, evaluated = ([], [], []), 0
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            parts = []
            for side in (left, right):
                parts += [
                    _matrix(side["v"], dim) if dim else np.zeros((side.num_rows, 0)),
                    side["vec_id"].to_numpy(),
                    _matrix(side["d"], len(side["d"][0].as_py())),
                ]
                if side is left:
                    parts.append(side["floor"].to_numpy())
            found, evaluated = block_top(*parts, radius2, k)
        columns = [*found, [None] * len(found[0])]
        if counted:
            columns = [[*c, v] for c, v in zip(columns, (None, None, None, evaluated), strict=True)]
        names = ["query_id", "vec_id", "score", "evaluated"]
        return pa.table([pa.array(f, pa.int64()) for f in columns], names=names)

    keys = ["dim", "c", "q"]
    copies = cands.selectExpr("*", f"explode(sequence(0, {chunks - 1})) AS q").groupBy(*keys)

    def visited(rows: DataFrame) -> DataFrame:
        met = rows.select("vec_id", "v", "d", "floor", *keys).groupBy(*keys).cogroup(copies)
        return met.applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint, evaluated bigint")

    order = "PARTITION BY query_id ORDER BY score DESC, vec_id"

    def ranked(found: DataFrame) -> DataFrame:
        rows = found.selectExpr("*", f"cast(row_number() OVER ({order}) as int) AS rank")
        return rows.where(f"rank <= {k}")

    lowest = "double('-infinity')"
    own = asked.selectExpr("*", f"{lowest} AS floor")
    first = stored(visited(own))
    full = ranked(first.where("query_id IS NOT NULL")).groupBy("query_id")
    full = full.agg(F.expr(f"IF(count(*) = {k}, double(min(score)), NULL) AS reached"))
    # Compared as doubles, so a floor must not be rounded up.
    floor = f"coalesce(reached - abs(reached) * 1e-15D, {lowest}) AS floor"
    known = asked.join(full.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    known = known.selectExpr("vec_id", "dim", "v", "c", "d", "q", floor)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, dim in enumerate(batch["dim"].to_pylist()):
                v, d = (np.array(batch[c][i].as_py(), float) for c in ("v", "d"))
                others = [e for e in table[dim] if e[0] != batch["c"][i].as_py()]
                if not others:
                    continue
                low, high = (np.array([e[1][:, j] for e in others]) for j in (0, 1))
                upper = _bounds(np.array([(v**2).sum() + radius2]), d[None], low, high)[0]
                reach = np.flatnonzero(upper >= batch["floor"][i].as_py())
                row = batch.take(pa.array(np.full(len(reach), i)))
                c = pa.array([others[j][0] for j in reach], pa.int32())
                yield row.set_column(row.schema.get_field_index("c"), "c", c)

    more = visited(known.mapInArrow(common.tidied(sent), known.schema))
    if counted:
        total = first.unionByName(more).agg(F.expr("sum(evaluated) AS evaluated"))
        return total.selectExpr(f"{size['q']}L * {size['n']}L AS pairs", "evaluated")
    kept = ranked(first.unionByName(more).where("query_id IS NOT NULL"))
    return kept.select("query_id", "rank", "vec_id", "score")
