"""Events to token sequences.

All per-subject steps share one window, so a run needs one shuffle by subject. Subjects that pass
the activity filter are bounded. Without that filter one subject may hold a large part of the
data; the rows of such subjects are cut into order-preserving lanes and the neighbours across a
lane border are filled in from the lanes' first and last rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn import schema as S
from sojourn.functions import tokens as X
from sojourn.operators.distribute import HEAVY_ROWS, heavy_keys, range_lanes
from sojourn.operators.filters import frequency_filter
from sojourn.operators.quantiles import decile_breaks, with_decile_tokens
from sojourn.operators.vocab import event_encoder, vocabulary
from sojourn.session import materialise, stored

# Events per text row where a subject is not bounded by the activity filter.
PART_EVENTS = 10_000


# Spark sorts nulls first when ascending.
ORDER = ", ".join(S.EVENT_ORDER)
VISIT_KEY = "coalesce(cast(visit_id as bigint), 0)"


def with_time_columns(events: DataFrame) -> DataFrame:
    """``time`` as double seconds, from numbers or timestamps, plus µs and datetime columns."""
    kind = events.schema["time"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        seconds = "unix_micros(cast(time as timestamp)) / 1e6D"
    elif isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)):
        seconds = "cast(time as double)"
    else:
        raise ValueError(f"unsupported type of time: {kind.simpleString()}")
    return events.withColumn("time", F.expr(seconds)).selectExpr(
        "*", "time * 1e6D AS timestamp", "timestamp_seconds(time) AS datetime"
    )


def _ordered(events: DataFrame) -> DataFrame:
    """Neighbours and 1-based position over whole subjects."""
    w = f"(PARTITION BY subject_id ORDER BY {ORDER})"
    return events.selectExpr(
        "*",
        f"lag(time) OVER {w} AS prev_time",
        f"lag({VISIT_KEY}) OVER {w} AS prev_visit",
        f"lead({VISIT_KEY}) OVER {w} AS next_visit",
        f"cast(row_number() OVER {w} as bigint) AS pos",
    )


def _ordered_in_lanes(events: DataFrame, n: int, lane_rows: int) -> DataFrame:
    """The same columns for heavy subjects, lane by lane.

    A row number joins the order, so that even a mass of equal events spreads over lanes. It is
    written out before the rows are shuffled by it, so a lost task cannot renumber them. Across a
    lane border the neighbours come from the lanes' first and last rows.
    """
    rows = materialise(events.withColumn("uid", F.monotonically_increasing_id()))
    laned = range_lanes(rows, ["subject_id", *S.EVENT_ORDER, "uid"], n, lane_rows)
    edge = f"struct({ORDER}, uid, {VISIT_KEY} AS visit)"
    edges = laned.groupBy("subject_id", "lane").agg(
        F.expr(f"min({edge}) AS first"), F.expr(f"max({edge}) AS last"), F.expr("count(*) AS n")
    )
    across = "(PARTITION BY subject_id ORDER BY lane)"
    edges = edges.selectExpr(
        "subject_id",
        "lane",
        f"lag(last) OVER {across} AS before",
        f"lead(first) OVER {across} AS after",
        f"sum(n) OVER {across} - n AS offset",
    )
    w = f"(PARTITION BY subject_id, lane ORDER BY {ORDER}, uid)"
    # One edge per lane and subject in it: no more than lanes and heavy subjects together.
    within = laned.join(F.broadcast(edges), ["subject_id", "lane"]).selectExpr(
        "*",
        f"lag(time) OVER {w} AS lag_time",
        f"lag({VISIT_KEY}) OVER {w} AS lag_visit",
        f"lead({VISIT_KEY}) OVER {w} AS lead_visit",
        f"row_number() OVER {w} AS row",
    )
    return within.selectExpr(
        *events.columns,
        "IF(lag_visit IS NULL, before.time, lag_time) AS prev_time",
        "coalesce(lag_visit, before.visit) AS prev_visit",
        "coalesce(lead_visit, after.visit) AS next_visit",
        "offset + row AS pos",
    )


def ordered_frames(
    events: DataFrame, bounded: bool = False, heavy_rows: int = HEAVY_ROWS
) -> list[DataFrame]:
    """Events with neighbours and position: one frame, or two when there are heavy subjects."""
    if bounded:
        return [_ordered(events)]
    counts = events.groupBy("subject_id").agg(F.expr("count(*) AS n"))
    heavy = heavy_keys(counts, min_rows=heavy_rows)
    if not heavy:
        return [_ordered(events)]
    ids = [row["subject_id"] for row in heavy]
    is_heavy = F.coalesce(F.col("subject_id").isin(ids), F.lit(False))
    n = sum(row["n"] for row in heavy)
    return [
        _ordered(events.where(~is_heavy)),
        _ordered_in_lanes(events.where(is_heavy), n, heavy_rows),
    ]


def with_event_tokens(ordered: DataFrame) -> DataFrame:
    """Gap, visit-start and visit-end tokens and the event's own text."""
    columns = [c for c in ordered.columns if c not in ("prev_time", "prev_visit", "next_visit")]
    starts = f"{VISIT_KEY} - prev_visit <> 0"
    ends = f"next_visit - {VISIT_KEY} <> 0 AND visit_id IS NOT NULL"
    gaps = ordered.selectExpr(
        *columns,
        "coalesce(floor((time - prev_time) / 86400), 0) AS day_gap",
        f"IF({starts}, {X.visit_group('visit_type')}, NULL) AS visit_token",
        f"IF({ends}, '{S.VISIT_END}', NULL) AS visit_end_token",
    )
    parts = "time_token, visit_token, code, quantile_token, visit_end_token"
    return gaps.withColumn("time_token", F.expr(X.gap_token("day_gap"))).withColumn(
        "event_text", F.expr(f"trim(concat_ws(' ', {parts}))")
    )


def event_token_frames(
    events: DataFrame,
    breaks: DataFrame | None = None,
    bounded: bool = False,
    heavy_rows: int = HEAVY_ROWS,
) -> list[DataFrame]:
    tokened = with_decile_tokens(events, breaks)
    return [with_event_tokens(f) for f in ordered_frames(tokened, bounded, heavy_rows)]


def tokenised_events(
    events: DataFrame,
    breaks: DataFrame | None = None,
    bounded: bool = False,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Events with their derived token columns and their position within the subject."""
    frames = event_token_frames(with_time_columns(events), breaks, bounded, heavy_rows)
    return reduce(DataFrame.unionByName, frames)


def head(text: str, max_tokens: int) -> str:
    """The first ``max_tokens`` tokens of a text (SQL)."""
    return f"substring_index({text}, ' ', {max_tokens})"


def _joined(frame: DataFrame, *keys: str) -> DataFrame:
    """Texts of events in order, and the ids of their words if the events have them.

    They come from a generator: a filter on a text would else be pushed below and join it again.
    """
    fields = [c for c in ("event_text", "word_ids") if c in frame.columns]
    listed = f"sort_array(collect_list(struct(pos, {', '.join(fields)}))) AS _listed"
    made = ["array_join(transform(_listed, e -> e.event_text), ' ') AS text"]
    if "word_ids" in fields:
        made.append("flatten(transform(_listed, e -> e.word_ids)) AS word_ids")
    return frame.groupBy(*keys).agg(F.expr(listed)).selectExpr(*keys, X.once(*made))


def sequences(
    events: DataFrame,
    breaks: DataFrame | None = None,
    max_tokens: int | None = S.WINDOW_TOKENS,
    bounded: bool = False,
    heavy_rows: int = HEAVY_ROWS,
    encoder: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One text row per subject: its events' texts in order.

    An ``encoder`` of events adds ``word_ids``, the ids per token of the text.

    Every event yields a token, so the first ``max_tokens`` events are all that a head of that
    many tokens can need; the rest is dropped before texts are collected. ``max_tokens=None`` is
    for subjects bounded by the activity filter; use :func:`sequence_parts` for others.
    """
    if max_tokens is None and not bounded:
        raise ValueError("unbounded subjects need max_tokens, or use sequence_parts")
    out = []
    for frame in event_token_frames(events, breaks, bounded, heavy_rows):
        if max_tokens is not None:
            frame = frame.where(f"pos <= {max_tokens}")
        joined = _joined(encoder(frame) if encoder else frame, "subject_id")
        if max_tokens is not None:
            heads = [f"{head('text', max_tokens)} AS text"]
            if encoder:
                heads.append(f"slice(word_ids, 1, {max_tokens}) AS word_ids")
            joined = joined.selectExpr("subject_id", X.once(*heads))
        out.append(joined)
    return reduce(DataFrame.unionByName, out)


def sequence_parts(
    events: DataFrame,
    breaks: DataFrame | None = None,
    part_events: int = PART_EVENTS,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Whole sequences of any length as ``subject_id, part, text``.

    Part 0 is the whole text of a subject with up to ``part_events`` events; longer subjects
    continue in parts 1, 2, …, to be joined by a space.
    """
    part = F.expr(f"cast((pos - 1) div {part_events} as int)")
    out = [
        _joined(frame.withColumn("part", part), "subject_id", "part")
        for frame in event_token_frames(events, breaks, False, heavy_rows)
    ]
    return reduce(DataFrame.unionByName, out)


def curated(
    events: DataFrame,
    limits: S.Thresholds | None = S.Thresholds(),
    max_tokens: int | None = S.WINDOW_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Filter, tokenise and assemble: the kept events and one sequence per subject.

    ``limits=None`` skips the filters. Kept events are computed once; the deciles and the
    sequences both read them.
    """
    kept, bounded = _kept(events, limits)
    return kept, sequences(kept, decile_breaks(kept), max_tokens, bounded)


def curated_ids(
    events: DataFrame,
    limits: S.Thresholds | None = S.Thresholds(),
    max_tokens: int | None = S.WINDOW_TOKENS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`curated`, with the ids of the vocabulary of the kept events beside the texts.

    Returns kept events, ``subject_id, text, word_ids`` and the vocabulary. ``word_ids`` has one list
    per token of the text, so that both can be cut alike; flattened, it is the encoded text.
    """
    kept, bounded = _kept(events, limits)
    words = materialise(vocabulary(kept))
    encoder = event_encoder(kept, words)
    rows = sequences(kept, decile_breaks(kept), max_tokens, bounded, encoder=encoder)
    return kept, rows, words


def _kept(events: DataFrame, limits: S.Thresholds | None) -> tuple[DataFrame, bool]:
    if limits is None:
        return events, False
    return stored(frequency_filter(events, limits)), not limits.codes_only
