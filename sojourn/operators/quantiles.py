"""Exact deciles of numeric values per code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.distribute import LANE_ROWS, lanes_by_value, lookup_join, running_before
from sojourn.session import materialise

INNER_DECILES = [k / 10 for k in range(1, 10)]


def decile_breaks(events: DataFrame, lane_rows: int = LANE_ROWS) -> DataFrame:
    """``code, breaks``: the nine inner deciles of the non-null values, linearly interpolated.

    Works on (code, value) counts, combined before the shuffle, so a code that holds much of the
    data costs its distinct values only, and these are ordered in lanes of bounded size. A break
    at fractional rank r needs the values at ranks floor(r) and ceil(r); both are found by
    comparing with the running count.
    """
    cells = materialise(
        events.where("numeric_value IS NOT NULL AND code IS NOT NULL")
        .groupBy("code", F.expr("numeric_value AS value"))
        .agg(F.expr("count(*) AS n"))
    )
    laned = lanes_by_value(cells, "value", ["code"], lane_rows)
    ranked = running_before(laned, "value", ["code"], "n")
    picks = []
    for k, p in enumerate(INNER_DECILES, start=1):
        at = f"cast(total - 1 as double) * {p}D"
        for name, rank in [("low", f"floor({at})"), ("high", f"ceil({at})")]:
            picks.append(f"max(IF(before <= {rank} AND {rank} < before + n, value, NULL)) AS {name}{k}")
        picks.append(f"max({at} - floor({at})) AS part{k}")
    found = ranked.groupBy("code").agg(*[F.expr(p) for p in picks])
    breaks = ", ".join(
        f"IF(low{k} = high{k} OR part{k} = 0, low{k}, low{k} * (1 - part{k}) + high{k} * part{k})"
        for k in range(1, 10)
    )
    return found.selectExpr("code", f"array({breaks}) AS breaks")


def decile_token(value: str, breaks: str) -> str:
    """``Q0``…``Q9``: the number of breaks strictly below the value; null for a null value."""
    below = " + ".join(f"cast({breaks}[{i}] < {value} as int)" for i in range(9))
    return f"IF({value} IS NULL OR {breaks} IS NULL, NULL, concat('Q', cast({below} as string)))"


def with_decile_tokens(events: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    if breaks is None:
        breaks = decile_breaks(events)
    token = F.expr(decile_token("numeric_value", "breaks"))
    joined = lookup_join(events, breaks, "code", "left")
    return joined.withColumn("quantile_token", token).drop("breaks")
