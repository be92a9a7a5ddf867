"""Preparation of the nested score matrices (``prs``) of a subject. Expressions are SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sojourn import schema as S


def scaled(prs: str, clip: float = S.PRS_CLIP) -> str:
    """Every element clipped to ``±clip`` and divided by ``clip``."""
    one = f"greatest(least(x, {clip}D), -{clip}D) / {clip}D"
    return f"transform({prs}, r -> transform(r, x -> {one}))"


def any_nonzero(prs: str) -> str:
    return f"exists(flatten({prs}), x -> x <> 0)"


def zeros_like(prs: str) -> str:
    return f"transform({prs}, r -> transform(r, x -> 0.0D))"


def prepared(df: DataFrame, clip: float = S.PRS_CLIP) -> DataFrame:
    """Add the flat scaled vector and whether any of it is nonzero."""
    made = df.selectExpr("*", f"{scaled('prs', clip)} AS _scaled")
    return made.selectExpr(
        *df.columns, "flatten(_scaled) AS features", f"{any_nonzero('_scaled')} AS has_prs"
    )
