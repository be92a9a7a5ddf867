"""Row split and training-data variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn import schema as S
from sojourn.functions import tokens as X
from sojourn.functions.seeded import digest, draw_below
from sojourn.operators import prs as P
from sojourn.operators.export import split_events


def split_rows(
    rows: DataFrame, seed=S.ROW_SPLIT_SEED, subjects: DataFrame | None = None
) -> DataFrame:
    """90/10 train/test split of rows that hold one subject each.

    ``subjects``, if given, is the rows' list of subjects; the rows are then not computed for it.
    """
    if subjects is None:
        subjects = rows.select("subject_id")
    return split_events(rows, subjects, S.ROW_TEST_FRACTION, seed)


def with_visit_spans(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add ``spans``: the ``(first, last)`` token positions of the visits, in order.

    A visit opens at a visit token when none is open and closes at the next end token, or with the
    sequence. Among the visit marks alone, an opening is thus one whose predecessor is an end, and
    the end that closes it is the next one whose predecessor is not: the n-th of both belong together.
    """
    mark = f"IF(startswith(t, 'VI'), struct(i AS at, t = '{S.VISIT_END}' AS closes), NULL)"
    opening = "NOT m.closes AND (i = 0 OR get(marks, i - 1).closes)"
    closing = "m.closes AND i > 0 AND NOT get(marks, i - 1).closes"
    # The generators keep filters on spans, which readers of their rows imply, from repeating all this.
    return (
        rows.selectExpr(
            "*",
            X.once(
                f"array_compact(transform({tokens}, (t, i) -> {mark})) AS marks",
                f"size({tokens}) - 1 AS end",
            ),
        )
        .selectExpr(
            *rows.columns,
            "end",
            f"filter(marks, (m, i) -> {opening}) AS openings",
            f"filter(marks, (m, i) -> {closing}) AS closings",
        )
        .selectExpr(
            *rows.columns,
            X.once(
                "transform(openings, (m, i) -> struct(m.at AS first, "
                "coalesce(get(closings, i).at, end) AS last)) AS spans"
            ),
        )
    )


def drop_count(sizes: str, length: str, target: int | None, extra: str) -> str:
    """How many visits go (SQL), given their sizes in drawing order.

    A visit goes while the text is longer than the target; once it is not, as long as fewer than
    ``extra`` visits have gone since. Both limits only tighten, so what goes is a leading part.
    """
    over = f"{length} - s.gone > {length if target is None else target}"
    goes = f"({over} OR s.fits < {extra})"
    step = (
        f"named_struct('gone', s.gone + IF({goes}, z, 0), "
        f"'fits', s.fits + IF({over}, 0, 1), 'n', s.n + IF({goes}, 1, 0))"
    )
    start = "named_struct('gone', 0, 'fits', 0, 'n', 0)"
    return f"aggregate({sizes}, {start}, (s, z) -> {step}, s -> s.n)"


def without_spans(tokens: str, spans: str) -> str:
    """Tokens outside of sorted, non-overlapping spans (SQL): the pieces between them."""
    begin = f"IF(i = 0, 0, element_at({spans}, i).last + 1)"
    stop = f"IF(i = size({spans}), size({tokens}), get({spans}, i).first)"
    piece = f"slice({tokens}, {begin} + 1, {stop} - {begin})"
    return f"flatten(transform(sequence(0, size({spans})), i -> {piece}))"


def visit_dropped_copies(
    rows: DataFrame, settings: S.Augmentation = S.Augmentation(), seed=0, which: str = "true"
) -> DataFrame:
    """``copies`` variants of each row, numbered by ``copy``, with random visits removed.

    Time tokens between visits stay. ``word_ids``, if there, are cut at the same places as the text;
    other columns repeat. Rows for which ``which`` (SQL) does not hold pass once and whole, so that a
    dataset of both kinds is a single pass.
    """
    drawn = digest(f"{seed}|visit", "subject_id", "copy", "i")
    extra = draw_below(settings.max_extra_visits + 2, f"{seed}|extra", "subject_id", "copy")
    spanned = with_visit_spans(
        rows.selectExpr("*", f"coalesce({which}, false) AS varied", "split(text, ' ') AS tokens")
    )
    copies = f"IF(varied, sequence(0, {settings.copies - 1}), array(0))"
    counted = (
        spanned.selectExpr("*", f"explode({copies}) AS copy")
        .selectExpr(
            "*",
            f"IF(varied, {extra}, 0) AS extra",
            "IF(varied, sort_array(transform(spans, (s, i) -> "
            f"struct({drawn} AS d, s.first AS first, s.last AS last))), array()) AS drawn",
        )
        .selectExpr("*", "transform(drawn, s -> s.last - s.first + 1) AS sizes")
    )
    n = drop_count("sizes", "size(tokens)", settings.target_tokens, "extra")
    dropped = f"sort_array(transform(slice(drawn, 1, {n}), s -> struct(s.first, s.last)))"
    made = {"text": f"array_join({without_spans('tokens', 'dropped')}, ' ') AS text"}
    if "word_ids" in rows.columns:
        made["word_ids"] = f"{without_spans('word_ids', 'dropped')} AS word_ids"
    others = [c for c in rows.columns if c not in made]
    whole = [c for c in made if c != "text"]
    # The generator keeps the drop list from being derived once per column that it cuts.
    return counted.selectExpr(
        *others, "copy", "tokens", *whole, X.once(f"{dropped} AS dropped")
    ).selectExpr(*others, "copy", *made.values())


def with_zero_prs_copies(rows: DataFrame, which: str = "true") -> DataFrame:
    """Each row, and for a row with any nonzero score a copy with all scores zero.

    Rows for which ``which`` (SQL) does not hold pass once.
    """
    copied = f"({which}) AND {P.any_nonzero('prs')}"
    variants = f"IF({copied}, array(prs, {P.zeros_like('prs')}), array(prs))"
    others = [c for c in rows.columns if c != "prs"]
    return rows.selectExpr(*others, f"posexplode({variants}) AS (zeroed, prs)")


def augmented(rows: DataFrame, settings: S.Augmentation = S.Augmentation(), seed=0) -> DataFrame:
    """Variants of the training rows; other rows pass unchanged as copy 0. The rows are read once."""
    train = "split = 'train'"
    if settings.drops_visits:
        out = visit_dropped_copies(rows, settings, seed, train)
    else:
        out = rows.withColumn("copy", F.lit(0))
    return with_zero_prs_copies(out, train) if settings.zero_prs_copy else out
