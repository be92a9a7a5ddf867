"""Joins, ranks and running totals that stay spread out when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sojourn.functions.seeded import digest
from sojourn.session import materialise, stored

# A side is broadcast only when counted at or below this many rows. Lookup rows here are at most
# a key and nine doubles, so this stays within some 150 MB.
BROADCAST_ROWS = 1_000_000
# A key is heavy from this many rows on, if it also holds 1/shares of all rows.
HEAVY_ROWS = 1_000_000
# Rows, of any width, that one task numbers.
NUMBER_ROWS = 50_000
# Rows that one window task may order.
LANE_ROWS = 1_000_000


def shares_of(df: DataFrame) -> int:
    return max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(
    counts: DataFrame, min_rows: int = HEAVY_ROWS, shares: int | None = None
) -> list[Row]:
    """Rows of ``counts(key…, n)`` that hold at least ``1/shares`` of the total.

    At most ``shares`` rows can qualify whatever the data size, so the answer fits the driver. One
    small job settles the usual case of no such key.
    """
    size = counts.selectExpr("sum(n) AS total", "max(n) AS top").first()
    if (size["top"] or 0) < min_rows:
        return []
    shares = shares or shares_of(counts)
    return counts.where(f"n >= {min_rows} AND n * {shares} >= {size['total']}").collect()


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "inner",
    max_broadcast: int = BROADCAST_ROWS,
    computed: bool = False,
) -> DataFrame:
    """Join a large side to a lookup side that has one row per ``key``.

    The lookup is computed once (unless it is ``computed`` already) and counted. Up to
    ``max_broadcast`` rows it is broadcast and the large side does not move. Beyond that the rows of
    heavy keys, at most ``shares`` keys, are joined by broadcast and only the rest is shuffled.
    Rows without a key find nothing and never meet in a task.
    """
    if not computed:
        small = materialise(small)
    if small.count() <= max_broadcast:
        return big.join(F.broadcast(small), key, how)
    keyed = big.where(f"{key} IS NOT NULL")
    counts = keyed.groupBy(key).agg(F.expr("count(*) AS n"))
    heavy = [row[key] for row in heavy_keys(counts)]
    if heavy:
        in_heavy = F.col(key).isin(heavy)
        hot = keyed.where(in_heavy).join(F.broadcast(small.where(in_heavy)), key, how)
        out = hot.unionByName(keyed.where(~in_heavy).join(small, key, how))
    else:
        out = keyed.join(small, key, how)
    if how in ("left", "left_anti"):
        out = out.unionByName(big.where(f"{key} IS NULL"), allowMissingColumns=True)
    return out


def numbered(
    df: DataFrame, order: str, name: str = "row_id", lane_rows: int = NUMBER_ROWS
) -> DataFrame:
    """0-based global position by ``order``, an SQL expression that should tell rows apart.

    Range partitioning samples the order and cuts it into lanes of about ``lane_rows`` rows, whatever
    the values are; rows are ordered inside their lane and shifted by the number of rows in earlier
    lanes. Only the lanes' counts meet in one task. The rows are written out before, as sampling reads
    them once more, and after, as the borders must not change.
    """
    rows = stored(df)
    lanes = max(1, -(-rows.count() // lane_rows))
    ranged = rows.repartitionByRange(lanes, F.expr(order)) if lanes > 1 else rows.coalesce(1)
    laned = stored(ranged.withColumn("_lane", F.spark_partition_id()))
    offsets = (
        laned.groupBy("_lane")
        .agg(F.expr("count(*) AS _n"))
        .selectExpr("_lane", "sum(_n) OVER (ORDER BY _lane) - _n AS _before")
    )
    rank = f"row_number() OVER (PARTITION BY _lane ORDER BY {order})"
    ranked = laned.withColumn("_rank", F.expr(rank))
    joined = lookup_join(ranked, offsets, "_lane")
    return joined.selectExpr(*df.columns, f"_before + _rank - 1 AS {name}")


def digest_cutoff(ids: DataFrame, key: str, seed, keep: int) -> str | None:
    """The digest of the ``keep``-th id in seeded random order.

    ``digest(seed, id) <= cutoff`` then selects exactly ``keep`` of the distinct ids, row by row,
    so membership needs no join. Only the counts of 65,536 digest prefixes meet in one task.
    """
    if keep <= 0:
        return None
    drawn = materialise(ids.selectExpr(f"{digest(seed, key)} AS d"))
    running = (
        drawn.groupBy(F.expr("substr(d, 1, 4) AS p"))
        .agg(F.expr("count(*) AS n"))
        .selectExpr("p", "n", "sum(n) OVER (ORDER BY p) AS upto")
    )
    hit = running.where(f"upto >= {keep}").orderBy("p").first()
    if hit is None:
        return "g"
    nth = keep - (hit["upto"] - hit["n"])
    ranked = drawn.where(f"substr(d, 1, 4) = '{hit['p']}'").selectExpr(
        "d", "row_number() OVER (ORDER BY d) AS r"
    )
    return ranked.where(f"r = {nth}").first()["d"]


def drawn_within(cutoff: str | None, seed, key: str) -> str:
    """Row-level membership test (SQL) that belongs to :func:`digest_cutoff`."""
    if cutoff is None:
        return "false"
    return f"coalesce({digest(seed, key)} <= '{cutoff}', false)"


def range_lanes(df: DataFrame, order: Sequence, n: int, lane_rows: int) -> DataFrame:
    """Add ``lane``: contiguous pieces of about ``lane_rows`` rows of the order given.

    Spark's range partitioning draws the borders; writing the rows out fixes the assignment.
    """
    pieces = max(1, -(-n // lane_rows))
    return materialise(
        df.repartitionByRange(pieces, *order).withColumn("lane", F.spark_partition_id())
    )


def lanes_by_value(
    cells: DataFrame, value: str, groups: Sequence[str] = (), lane_rows: int = LANE_ROWS
) -> DataFrame:
    """Add a ``lane`` that grows with ``value`` where some group is too large for one task.

    ``cells`` has one row per group and value, and should be materialised. Usually the largest
    group fits and ``cells`` comes back as it is.
    """
    counts = cells.groupBy(*groups).agg(F.expr("count(*) AS n"))
    size = counts.selectExpr("max(n) AS largest", "sum(n) AS n").first()
    if (size["largest"] or 0) <= lane_rows:
        return cells
    return range_lanes(cells, [*groups, value], size["n"], lane_rows)


def running_before(
    cells: DataFrame, value: str, groups: Sequence[str], count: str
) -> DataFrame:
    """Add ``before``, the sum of ``count`` over smaller values of the same group, and ``total``.

    With a ``lane`` column, windows run over (group, lane) and are shifted by the totals of the
    earlier lanes.
    """
    by_group = f"PARTITION BY {', '.join(groups)}" if groups else ""
    if "lane" not in cells.columns:
        return cells.selectExpr(
            "*",
            f"sum({count}) OVER ({by_group} ORDER BY {value}) - {count} AS before",
            f"sum({count}) OVER ({by_group}) AS total",
        )
    keys = [*groups, "lane"]
    offsets = (
        cells.groupBy(*keys)
        .agg(F.expr(f"sum({count}) AS _n"))
        .selectExpr(
            *keys,
            f"sum(_n) OVER ({by_group} ORDER BY lane) - _n AS _offset",
            f"sum(_n) OVER ({by_group}) AS total",
        )
    )
    run = f"sum({count}) OVER (PARTITION BY {', '.join(keys)} ORDER BY {value}) - {count}"
    return (
        cells.withColumn("_run", F.expr(run))
        .join(offsets, keys)
        .withColumn("before", F.expr("_run + _offset"))
        .drop("_run", "_offset")
    )
