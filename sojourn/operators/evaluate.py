"""Evaluation of predictions: AUC, bootstrap intervals and strata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn import schema as S
from sojourn.functions.seeded import poisson_cuts
from sojourn.functions.tokens import cases, text
from sojourn.operators.cohort import years_of
from sojourn.operators.distribute import LANE_ROWS, lanes_by_value, range_lanes, running_before
from sojourn.operators.prs import any_nonzero
from sojourn.session import materialise, stored

# Rounds of further replicates, each doubling those tried, before a short group is an error.
REDRAW_ROUNDS = 6
# Rows of a lane that one task draws replicates for at a time.
DRAW_ROWS = 4096
PIECES_PER_TASK = 6
# Weights that a task holds at a time.
DRAW_CELLS = 1 << 18


def aggregated(scores: str, how: str = "mean") -> str:
    """Mean, max or median of a list of probabilities (SQL); null for an empty list."""
    if how == "max":
        return f"array_max({scores})"
    if how == "mean":
        total = f"aggregate({scores}, 0.0D, (a, x) -> a + x)"
        return f"{total} / nullif(size({scores}), 0)"
    if how == "median":
        low = f"get(sort_array({scores}), (size({scores}) - 1) div 2)"
        high = f"get(sort_array({scores}), size({scores}) div 2)"
        return f"IF(size({scores}) > 0, ({low} + {high}) / 2, NULL)"
    raise ValueError(f"unknown aggregation: {how}")


def age_bucket(age: str) -> str:
    return cases(
        (f"{age} >= 0" if below is None else f"{age} >= 0 AND {age} < {below}", text(label))
        for below, label in S.AGE_BUCKETS
    )


def prepared(predictions: DataFrame, how: str = "mean", prs: DataFrame | None = None) -> DataFrame:
    """Predictions with aggregated probability, age and age bucket, and PRS presence if given.

    ``prs`` must hold exactly one row for every prediction's subject, and no others.
    """
    out = predictions.selectExpr(
        "*",
        f"{aggregated('probability_scores', how)} AS probability_agg",
        years_of("split(original_text, ' ')") + " AS age",
    ).withColumn("age_bucket", F.expr(age_bucket("age")))
    if prs is None:
        return out
    asked = predictions.select("subject_id").distinct().selectExpr("subject_id", "1 AS asked")
    given = prs.groupBy("subject_id").agg(F.expr("count(*) AS given"))
    odd = asked.join(given, "subject_id", "full").where("asked IS NULL OR given IS NULL OR given > 1")
    n = odd.count()
    if n:
        raise ValueError(f"{n} subjects lack a prediction or a single PRS row")
    return out.join(prs_presence(prs), "subject_id")


def prs_presence(prs: DataFrame) -> DataFrame:
    return prs.selectExpr("subject_id", f"{any_nonzero('prs')} AS has_prs")


def score_cells(df: DataFrame, score: str, label: str, groups: Sequence[str]) -> DataFrame:
    """``groups, score, neg, pos, odd``: class counts per distinct score, and rows without a score
    (null or NaN) or with a label other than 0 and 1."""
    scored = df.selectExpr(*groups, f"{score} AS score", f"{label} AS _label")
    odd = "NOT coalesce(NOT isnan(score) AND _label IN (0, 1), false)"
    sound = "score IS NOT NULL AND NOT isnan(score)"
    return scored.groupBy(*groups, "score").agg(
        F.expr(f"count_if(_label = 0 AND {sound}) AS neg"),
        F.expr(f"count_if(_label = 1 AND {sound}) AS pos"),
        F.expr(f"count_if(score IS NULL OR {odd}) AS odd"),
    )


def pair_auc(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """AUC per group from score cells; groups with one class are left out.

    Twice the number of rightly ordered pairs, ties half, is Σ pos·(2·negatives below + neg): a
    whole number, so the result does not depend on the order of summation.
    """
    ranked = running_before(cells, "score", groups, "neg")
    twice = "cast(pos as decimal(19,0)) * cast(2 * before + neg as decimal(19,0))"
    sums = ranked.groupBy(*groups).agg(
        F.expr(f"cast(sum({twice}) as double) AS u"),
        F.expr("sum(pos) AS n_pos"),
        F.expr("sum(neg) AS n_neg"),
    )
    auc = "u / (2.0D * cast(n_pos as double) * cast(n_neg as double)) AS auc"
    return sums.where("n_pos > 0 AND n_neg > 0").selectExpr(*groups, "n_pos", "n_neg", auc)


def roc_auc(
    df: DataFrame,
    score: str = "probability_agg",
    label: str = "label_token",
    groups: Sequence[str] = (),
    lane_rows: int = LANE_ROWS,
    allow_missing: bool = False,
) -> DataFrame:
    """``groups, n_pos, n_neg, auc``. Exact, with ties; many scores are ordered lane by lane.

    Scores that are null or NaN and labels other than 0 and 1 are an error, unless
    ``allow_missing``: then such rows are left out. They are counted with the cells, in one pass.
    """
    cells = materialise(score_cells(df, score, label, groups))
    sound = cells.where("neg + pos > 0").drop("odd")
    if not allow_missing:
        size = cells.selectExpr("sum(odd) AS odd", "sum(neg + pos) AS n").first()
        if size["odd"]:
            raise ValueError(
                f"only {size['n']} of {size['n'] + size['odd']} rows have score and label"
            )
    return pair_auc(lanes_by_value(sound, "score", groups, lane_rows), groups)


def score_lanes(
    df: DataFrame,
    key: str = "subject_id",
    score: str = "probability_agg",
    label: str = "label_token",
    groups: Sequence[str] = (),
    lane_rows: int = DRAW_ROWS,
) -> DataFrame:
    """``groups, at, inner, rows``: pieces of the sample in score order, for :func:`replicate_aucs`.

    The rows are range-partitioned by score and key, so a mass of equal scores spreads out as well,
    and each lane becomes three pieces: the rows of its lowest score, those between (``inner``), and
    those of its highest. Lowest and highest scores may go on in other lanes. ``rows`` are
    ``(opens, label, suffix)`` in order; ``opens`` marks the first of a score, ``suffix`` is the
    end of the text that the row's draws are digests of.
    """
    whole = df.where(f"{score} IS NOT NULL").selectExpr(
        *groups,
        f"{score} AS _score",
        f"{label} AS _label",
        f"concat_ws('', IF({key} IS NULL, NULL, '|'), cast({key} as string)) AS _suffix",
    )
    whole = materialise(whole)
    # Even a small sample is drawn on every core.
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = whole.count()
    lanes = range_lanes(whole, [*groups, "_score", "_suffix"], n, max(1, min(lane_rows, n // (4 * cores))))
    lists = lanes.groupBy(*groups, "lane").agg(
        F.expr("sort_array(collect_list(struct(_score, _label, _suffix))) AS rows"),
        F.expr("min(_score) AS low"),
        F.expr("max(_score) AS high"),
    )
    flagged = "transform(rows, (e, i) -> struct(e._score AS score, i = 0 OR e._score <> "
    flagged += "rows[greatest(i - 1, 0)]._score AS opens, e._label AS label, e._suffix AS suffix))"
    pieces = {
        ("low", "false"): "e.score = low",
        ("low", "true"): "e.score > low AND e.score < high",
        ("high", "false"): "e.score = high AND high > low",
    }
    cut = ", ".join(
        f"struct({at} AS at, {inner} AS inner, filter(flagged, e -> {test}) AS rows)"
        for (at, inner), test in pieces.items()
    )
    marked = lists.selectExpr(*groups, "low", "high", f"{flagged} AS flagged")
    return stored(marked.selectExpr(*groups, f"inline(array({cut}))").where("size(rows) > 0"))


def _drawn(pieces: DataFrame, first: int, last: int, groups: Sequence[str], seed) -> DataFrame:
    """``groups, b, at, inner, neg, pos, twice``: the totals of each piece in each replicate.

    A task holds the weights of one piece in some replicates as a matrix; the negatives seen so far
    are prefix sums along its rows.
    """
    kept, cuts = [*groups, "at", "inner"], poisson_cuts()
    fields = [pieces.schema[c] for c in kept]
    more = T.StructType.fromDDL("b int, neg bigint, pos bigint, twice bigint")
    cells = DRAW_CELLS

    def totals(rows: pa.StructArray, replicates: range) -> list[np.ndarray]:
        label = rows.field("label").to_numpy(zero_copy_only=False)
        opens = rows.field("opens").to_numpy(zero_copy_only=False)
        suffixes = [s.encode() for s in rows.field("suffix").to_pylist()]
        starts = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
        digests = (
            hashlib.md5(prefix + suffix).digest()[:4]
            for prefix in (f"{seed}|{b}".encode() for b in replicates)
            for suffix in suffixes
        )
        drawn = np.frombuffer(b"".join(digests), ">u4").reshape(len(replicates), len(label))
        weights = np.searchsorted(cuts, drawn, side="right")
        pos = weights * (label == 1)
        seen = np.zeros((len(replicates), len(label) + 1), np.int64)
        np.cumsum(weights * (label == 0), axis=1, out=seen[:, 1:])
        twice = (pos * (seen[:, starts] + seen[:, 1:])).sum(1)
        return [seen[:, -1], pos.sum(1), twice]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch["rows"].slice(i, 1).flatten()
                step = max(1, cells // len(rows))
                for at in range(first, last, step):
                    replicates = range(at, min(at + step, last))
                    same = pa.array(np.full(len(replicates), i))
                    own = [batch[c].take(same) for c in kept]
                    found = [pa.array(v, pa.int64()) for v in totals(rows, replicates)]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(replicates, pa.int32()), *found], names=[*kept, *more.names]
                    )

    return pieces.select(*kept, "rows").mapInArrow(run, T.StructType([*fields, *more.fields]))


def replicate_aucs(
    lanes: DataFrame, replicates: tuple[int, int], groups: Sequence[str] = (), seed=0
) -> DataFrame:
    """``groups, b, auc`` of Poisson bootstrap replicates ``first ≤ b < last`` of :func:`score_lanes`.

    Each row enters each replicate Poisson(1) times, drawn from its key, so replicates need no
    common order of rows. A piece of a lane hands on three totals per replicate: its negatives, its
    positives, and twice its own rightly ordered pairs. Only these are exchanged; no draw leaves its
    task, so what is shuffled does not grow with rows times replicates.
    """
    # A piece is little to read and long to draw from: spread them by number, not by bytes.
    cores = lanes.sparkSession.sparkContext.defaultParallelism
    spread = lanes.repartition(max(cores, lanes.count() // PIECES_PER_TASK))
    each = _drawn(spread, *replicates, groups, seed)
    # One exchange serves the sums of scores in several lanes and the order of all pieces.
    met = each.repartition(*groups, "b").groupBy(*groups, "b", "at", "inner").agg(
        F.expr("sum(neg) AS neg"), F.expr("sum(pos) AS pos"), F.expr("sum(twice) AS twice")
    )
    order = f"PARTITION BY {', '.join([*groups, 'b'])} ORDER BY at, inner"
    placed = met.selectExpr("*", f"sum(neg) OVER ({order}) - neg AS before")
    wide = "cast({} as decimal(19,0))"
    own = f"IF(inner, {wide.format('twice')}, {wide.format('pos')} * {wide.format('neg')})"
    pairs = f"{own} + {wide.format('pos')} * {wide.format('2 * before')}"
    sums = placed.groupBy(*groups, "b").agg(
        F.expr(f"cast(sum({pairs}) as double) AS u"),
        F.expr("sum(pos) AS n_pos"),
        F.expr("sum(neg) AS n_neg"),
    )
    auc = "u / (2.0D * cast(n_pos as double) * cast(n_neg as double)) AS auc"
    return sums.where("n_pos > 0 AND n_neg > 0").selectExpr(*groups, "b", auc)


def _short_groups(
    wanted: DataFrame, aucs: DataFrame, groups: Sequence[str], iterations: int
) -> DataFrame:
    """Groups (at most as many as there are strata) with fewer than ``iterations`` AUCs."""
    counts = aucs.groupBy(*groups).agg(F.expr("count(*) AS _n"))
    if not groups:
        return counts.where(f"_n < {iterations}")
    joined = wanted.join(counts, [*groups], "left")
    return materialise(joined.where(f"coalesce(_n, 0) < {iterations}").select(*groups))


def bootstrap_interval(
    df: DataFrame,
    iterations: int = 1000,
    confidence: float = 0.95,
    groups: Sequence[str] = (),
    seed=0,
    **options,
) -> DataFrame:
    """``groups, n_valid, ci_low, ci_high``: percentile interval over the bootstrap AUCs.

    A replicate with a single class has no AUC; further replicates of that group take its place.
    Groups must hold both classes. One that stays short of ``iterations`` is an error.
    """
    wanted = materialise(df.selectExpr(*groups, "1 AS _one").distinct())
    lanes = score_lanes(df, groups=groups, **options)
    aucs = materialise(replicate_aucs(lanes, (0, iterations), groups, seed))
    upto = iterations
    for _ in range(REDRAW_ROUNDS):
        short = _short_groups(wanted, aucs, groups, iterations)
        if short.isEmpty():
            break
        some = lanes.join(F.broadcast(short), [*groups], "left_semi") if groups else lanes
        more = replicate_aucs(some, (upto, 2 * upto), groups, seed)
        aucs = materialise(aucs.union(more))
        upto *= 2
    if not _short_groups(wanted, aucs, groups, iterations).isEmpty():
        raise ValueError(f"a group has both classes in fewer than {iterations} of {upto} replicates")
    by_group = f"PARTITION BY {', '.join(groups)}" if groups else ""
    first = aucs.selectExpr("*", f"row_number() OVER ({by_group} ORDER BY b) AS r")
    alpha = (1.0 - confidence) / 2.0
    return (
        first.where(f"r <= {iterations}")
        .groupBy(*groups)
        .agg(
            F.expr("count(*) AS n_valid"),
            F.expr(f"percentile(auc, {alpha}D) AS ci_low"),
            F.expr(f"percentile(auc, {1.0 - alpha}D) AS ci_high"),
        )
    )


def report(
    df: DataFrame,
    strata: str | None = None,
    iterations: int = 1000,
    score: str = "probability_agg",
    label: str = "label_token",
    key: str = "subject_id",
    seed=0,
    allow_missing: bool = False,
) -> DataFrame:
    """``[stratum,] n, auc, ci_low, ci_high, n_valid``, overall or per stratum with both classes.

    Scores that are null or NaN and labels other than 0 and 1 are an error, unless
    ``allow_missing``: then such rows are left out and ``n`` counts the others.
    """
    groups = [strata] if strata else []
    if strata:
        df = df.where(f"{strata} IS NOT NULL")
    df = materialise(df.selectExpr(*groups, key, score, label))
    points = roc_auc(df, score, label, groups, allow_missing=allow_missing)
    points = materialise(points.withColumn("n", F.expr("n_pos + n_neg")))
    df = df.where(f"coalesce(NOT isnan({score}) AND {label} IN (0, 1), false)")
    if points.isEmpty():  # one class only: nothing to draw
        none = "cast(NULL AS double)"
        return points.selectExpr(
            *groups, "n", "auc", f"{none} AS ci_low", f"{none} AS ci_high", "0L AS n_valid"
        )
    if groups:
        df = df.join(F.broadcast(points.select(*groups)), groups, "left_semi")
    spans = bootstrap_interval(
        df, iterations, groups=groups, key=key, score=score, label=label, seed=seed
    )
    if groups:
        joined = points.join(spans, groups)
    else:
        one = F.lit(1)
        joined = points.withColumn("one", one).join(spans.withColumn("one", one), "one")
    return joined.select(*groups, "n", "auc", "ci_low", "ci_high", "n_valid")
