"""Seeded draws as SQL expressions.

Every draw is a function of a seed and the row's own keys, so a recomputed task draws the same
values, and any SQL engine with ``md5`` can repeat them. Keys are SQL expressions; so is the
result, for use in ``selectExpr`` or ``F.expr``.
"""

from __future__ import annotations

import math

HASH_SPAN = 2**32


def digest(seed, *keys: str) -> str:
    """32 hex digits of ``seed|key|key…``; its text order is a seeded random order."""
    parts = ", ".join([f"'{seed}'"] + [f"cast({k} as string)" for k in keys])
    return f"md5(concat_ws('|', {parts}))"


def hash32(seed, *keys: str) -> str:
    """Uniform BIGINT in [0, 2^32)."""
    return f"cast(conv(substr({digest(seed, *keys)}, 1, 8), 16, 10) as bigint)"


def draw_below(n: str | int, seed, *keys: str) -> str:
    """Uniform BIGINT in [0, n)."""
    return f"pmod({hash32(seed, *keys)}, cast({n} as bigint))"


def poisson_cuts(top: int = 12) -> list[int]:
    """Cut points, on the hash32 scale, of the Poisson(1) distribution function."""
    cuts, total = [], 0.0
    for k in range(top):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(math.floor(total * HASH_SPAN))
    return cuts


def poisson_of(hashed: str) -> str:
    """Poisson(1) value of a hash32: the number of cut points at or below it."""
    cuts = poisson_cuts()
    cases = " ".join(f"WHEN {hashed} < {cut} THEN {k}" for k, cut in enumerate(cuts))
    return f"cast(CASE {cases} ELSE {len(cuts)} END as bigint)"
