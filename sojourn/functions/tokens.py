"""SQL expressions for single tokens and for token arrays.

Arguments and results are SQL text, for ``selectExpr`` or ``F.expr``.
"""

from __future__ import annotations

from collections.abc import Iterable

from sojourn import schema as S


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Iterable[str]) -> str:
    return "array(" + ", ".join(text(v) for v in values) + ")"


def cases(pairs: Iterable[tuple[str, str]], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in pairs)
    return f"CASE {whens} ELSE {otherwise} END"


def gap_token(days: str) -> str:
    """Token of a day gap, capped at the largest token of each unit; null below one day."""
    return cases(
        (
            f"{days} >= {size}",
            f"concat('TIME_{unit}_', cast(least({days} div {size}, {top}) as string))",
        )
        for unit, size, top in reversed(S.GAP_UNITS)
    )


def open_gap_token(days: str) -> str:
    """Gap token without caps: always the largest unit that fits, ``DUMMY`` below one day."""
    return cases(
        (
            (f"{days} >= {size}", f"concat('TIME_{unit}_', cast({days} div {size} as string))")
            for unit, size, _ in reversed(S.GAP_UNITS)
        ),
        text(S.NO_GAP),
    )


def gap_days(token: str) -> str:
    """Days of a known gap token, null for every other token."""
    entries = ", ".join(f"{text(t)}, {d}" for t, d in S.GAP_DAYS.items())
    return f"IF(startswith({token}, 'TIME_'), map({entries})[{token}], NULL)"


def gaps(tokens: str) -> str:
    """``(pos, days)`` of every ``TIME_`` token in order; days are null for an unlisted one."""
    entry = f"struct(i AS pos, {gap_days('t')} AS days)"
    return f"array_compact(transform({tokens}, (t, i) -> IF(startswith(t, 'TIME_'), {entry}, NULL)))"


def visit_group(visit_type: str) -> str:
    """Group of a visit name; ``Other`` for an unlisted name, null for a null name."""
    pairs = [(f"{visit_type} IS NULL", "NULL")]
    for group, names in S.VISIT_GROUPS.items():
        pairs.append((f"{visit_type} IN ({', '.join(text(n) for n in names)})", text(group)))
    return cases(pairs, text(S.UNMAPPED_VISIT))


def code_category(token: str) -> str:
    return cases((f"startswith({token}, '{p}')", text(n)) for p, n in S.CODE_CATEGORIES.items())


def visit_label(token: str) -> str:
    return cases((f"{token} = '{g}'", text(n)) for g, n in S.VISIT_LABELS.items())


def first_position(tokens: str, hit: str) -> str:
    """0-based position of the first token ``t`` for which ``hit`` holds, -1 if none."""
    return f"coalesce(array_min({all_positions(tokens, hit)}), -1)"


def all_positions(tokens: str, hit: str) -> str:
    """Ascending 0-based positions of the tokens ``t`` for which ``hit`` holds."""
    return f"array_compact(transform({tokens}, (t, i) -> IF({hit}, i, NULL)))"


def days_from(gaps_: str, start: str | int = 0) -> str:
    """Sum of the known gap days at or after position ``start``."""
    tail = f"filter({gaps_}, g -> g.pos >= {start})"
    return f"aggregate({tail}, 0, (total, g) -> total + coalesce(g.days, 0))"


def once(*named: str) -> str:
    """Generator of one row with the given ``expression AS name`` columns.

    A filter on a plain column is pushed below the projection that makes it, with a copy of the
    expression per mention. A generator's output stops that, so costly expressions run once.
    """
    fields = ", ".join(f"'{n.rsplit(' AS ', 1)[1]}', {n.rsplit(' AS ', 1)[0]}" for n in named)
    return f"inline(array(named_struct({fields})))"
