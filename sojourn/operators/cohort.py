"""Evaluation cohorts: stopping points and horizon labels.

Everything is a function of a subject's own token array, so no step shuffles. Expressions are SQL
text over the columns ``tokens`` and ``subject_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn import schema as S
from sojourn.functions import tokens as X
from sojourn.functions.seeded import draw_below


@dataclass(frozen=True)
class Task:
    """A prediction task: which codes to foresee, from where and how far ahead."""

    targets: tuple[str, ...] = ("VIER",)
    horizon_days: int = 730
    stop: str = "end_visit"
    followup_targets: tuple[str, ...] = ()
    exclude_visits: int = 1
    min_years: float | None = None
    # Off: a subject without target loses its last token before visit ends are looked up.
    strict_no_target: bool = False
    # "contains" also counts codes that merely contain a target's text.
    match: str = "contains"
    seed: int = 0

    def __post_init__(self):
        if self.exclude_visits < 1:
            raise ValueError(f"at least one visit must be excluded, not {self.exclude_visits}")
        if self.match not in ("contains", "exact"):
            raise ValueError(f"unknown match: {self.match}")


# Task codes that may become part of a plan, and tokens of an index over them.
MAX_TARGETS = 10_000
INDEX_TOKENS = 10_000

# Columns that label building works with; evaluation sets do not keep them.
HELPERS = ("tokens", "gaps", "visit_ends")


def task_targets(task_codes: DataFrame) -> DataFrame:
    """``task, targets`` from ``task, concept_id``: a sorted list of condition codes per task."""
    code = f"concat('{S.CONDITION}', cast(concept_id as string))"
    return task_codes.groupBy("task").agg(F.expr(f"sort_array(collect_set({code})) AS targets"))


def with_birth(rows: DataFrame) -> DataFrame:
    """Rows with a birth token, with ``tokens``, ``len``, ``birth_token`` and landmarks.

    Landmarks are ``gaps``, the positions and days of the gap tokens, and ``visit_ends``, the
    positions of the visit ends. Later steps read these short lists instead of all tokens.
    """
    birth = f"cast(array_position(tokens, '{S.BIRTH_CODE}') - 1 as int)"
    ends = X.all_positions("tokens", f"t = '{S.VISIT_END}'")
    landmarks = X.once(
        "size(tokens) AS len",
        f"{birth} AS birth_token",
        f"{X.gaps('tokens')} AS gaps",
        f"{ends} AS visit_ends",
    )
    return (
        rows.where(f"contains(text, '{S.BIRTH_CODE}')")
        .selectExpr("*", "split(text, ' ') AS tokens")
        .selectExpr("*", landmarks)
        .where("birth_token >= 0")
    )


def years_of(tokens: str) -> str:
    """Years covered by all gap tokens."""
    return f"{X.days_from(X.gaps(tokens))} / 365"


def candidates(rows: DataFrame, min_years: float | None = None) -> DataFrame:
    """Birth rows with ``time_ehr``, the years covered from two tokens after birth on.

    That skips the gap from birth to the first event. ``min_years`` keeps longer records only.
    """
    years = f"{X.days_from('gaps', 'birth_token + 2')} / 365 AS time_ehr"
    out = with_birth(rows).selectExpr("*", years)
    return out if min_years is None else out.where(f"time_ehr > {min_years}")


def cumulative_ages(rows: DataFrame) -> DataFrame:
    """``subject_id, pos, token, age_years``: the age reached at each token."""
    days = f"sum(coalesce({X.gap_days('token')}, 0)) OVER (PARTITION BY subject_id ORDER BY pos)"
    exploded = rows.selectExpr("subject_id", "posexplode(tokens) AS (pos, token)")
    return exploded.selectExpr("subject_id", "pos", "token", f"{days} / 365 AS age_years")


def token_years_after(tokens: str, birth: str, years: int = 3) -> str:
    """First position, from the token after birth on, whose age is ``years`` above the age there.

    -1 if the sequence ends earlier. Ages are compared in whole days.
    """
    days = f"s.days + coalesce({X.gap_days('t')}, 0)"
    base = f"IF(s.i = {birth} + 1, {days}, s.base)"
    hit = f"s.at < 0 AND s.i > {birth} AND {days} >= {base} + {years * 365}"
    step = (
        f"named_struct('days', {days}, 'base', {base}, 'i', s.i + 1, 'at', IF({hit}, s.i, s.at))"
    )
    start = "named_struct('days', 0, 'base', 0, 'i', 0, 'at', -1)"
    return f"aggregate({tokens}, {start}, (s, t) -> {step}, s -> s.at)"


def first_target(tokens: str, targets: str) -> str:
    """Position of the first token equal to a target, -1 if none."""
    found = f"filter(transform({targets}, x -> array_position({tokens}, x)), p -> p > 0)"
    return f"IF(arrays_overlap({tokens}, {targets}), cast(array_min({found}) - 1 as int), -1)"


# ---- Stopping points: number of leading tokens that form the input, -1 for none ----


def stop_first_target(task: Task, target_at: str) -> str:
    return f"IF({target_at} >= 0, {target_at} + 1, -1)"


def stop_random(task: Task, target_at: str) -> str:
    """Uniform between a quarter and three quarters of the length."""
    low = "size(tokens) div 4"
    return f"cast({low} + {draw_below(f'{low} * 2 + 1', f'{task.seed}|random', 'subject_id')} as int)"


def stop_demo_age(task: Task, target_at: str) -> str:
    at = X.first_position("tokens", "contains(t, 'TIME')")
    return f"{at} + IF({at} >= 0, 1, 0)"


def stop_end_visit(task: Task, target_at: str) -> str:
    """After a random end of visit before the first target, the last ones excluded."""
    none = "len" if task.strict_no_target else "len - 1"
    ends = f"filter(visit_ends, e -> e < IF({target_at} >= 0, {target_at}, {none}))"
    n = f"size(e) - {task.exclude_visits}"
    drawn = draw_below(f"greatest({n}, 1)", f"{task.seed}|end_visit", "subject_id")
    pick = f"IF(size(e) > 1 AND {n} > 0, get(e, cast({drawn} as int)) + 1, -1)"
    return f"get(transform(array({ends}), e -> {pick}), 0)"


STOPS: dict[str, Callable[[Task, str], str]] = {
    "first_target": stop_first_target,
    "random": stop_random,
    "demo_age": stop_demo_age,
    "end_visit": stop_end_visit,
}


def stopping_point(name: str, task: Task, target_at: str = "first_target") -> str:
    if name not in STOPS:
        raise ValueError(f"unknown stopping rule: {name}")
    return STOPS[name](task, target_at)


def horizon_end(gaps: str, start: str, length: str, horizon_days: int) -> str:
    """Position of the gap token that passes the horizon, counted from ``start``; else length.

    An unlisted ``TIME_`` token on the way is an error.
    """
    bad = "cast(raise_error('unknown gap token') as int)"
    days = f"s.days + coalesce(g.days, {bad})"
    step = f"named_struct('days', {days}, 'at', IF({days} > {horizon_days}, g.pos, -1))"
    return (
        f"aggregate(filter({gaps}, g -> g.pos >= {start}), named_struct('days', 0, 'at', -1), "
        f"(s, g) -> IF(s.at >= 0, s, {step}), s -> IF(s.at >= 0, s.at, {length}))"
    )


def target_pattern(targets: str, match: str) -> str:
    """Regular expression for a text with a target token: one containing or being a target."""
    quoted = f"array_join(transform({targets}, x -> concat('\\\\Q', x, '\\\\E')), '|')"
    if match == "exact":
        return f"concat('(?:^| )(?!TIME_)(?:', {quoted}, ')(?: |$)')"
    return f"concat('(?:^| )(?!TIME_)[^ ]*(?:', {quoted}, ')')"


def has_target(window: str, targets: Iterable[str], match: str) -> str:
    """Whether the text has one of the given targets; the expression is compiled once per task."""
    quoted = "|".join(f"\\Q{target}\\E" for target in targets)
    if not quoted:
        return "false"
    if match == "exact":
        return f"rlike({window}, {X.text(f'(?:^| )(?!TIME_)(?:{quoted})(?: |$)')})"
    return f"rlike({window}, {X.text(f'(?:^| )(?!TIME_)[^ ]*(?:{quoted})')})"


def horizon_label(
    tokens: str,
    start: str | int,
    targets: str,
    horizon_days: int,
    match: str = "contains",
    gaps: str | None = None,
    hit: Callable[[str], str] | None = None,
) -> str:
    """1 if a target comes at or after ``start`` before the gaps exceed the horizon, else 0.

    ``gaps`` names a column with the tokens' gaps, if there is one. The tokens up to the horizon
    are matched as one text, by ``hit`` if targets are known beforehand: a pattern that is made of a
    column is compiled for every row.
    """
    start = f"cast({start} as int)"
    end = horizon_end(gaps or X.gaps(tokens), start, f"size({tokens})", horizon_days)
    window = f"array_join(slice({tokens}, {start} + 1, greatest({end} - {start}, 0)), ' ')"
    if hit:
        return f"IF({hit(window)}, 1, 0)"
    return f"IF(size({targets}) > 0 AND rlike({window}, {target_pattern(targets, match)}), 1, 0)"


def all_eos_tail(ids: str, eos_id: int) -> str:
    """Whether the last five ids are all the end token; true also for no ids at all."""
    return f"forall(slice({ids}, greatest(size({ids}) - 4, 1), 5), x -> x = {eos_id})"


def checked_tail(ids: str, eos_id: int) -> str:
    """The ids, or an error for a row that ends in end tokens only."""
    wrong = "raise_error('a truncated sequence ends in end tokens')"
    return f"IF({all_eos_tail(ids, eos_id)}, cast({wrong} as array<bigint>), {ids})"


def labelled(
    rows: DataFrame,
    task: Task,
    stop_before_stopping_time: bool = False,
    eos_id: int | None = None,
) -> DataFrame:
    """Candidates with first target, stopping point and label; encoded columns cut at the stop."""
    found = candidates(rows, task.min_years)
    targets = X.text_array(task.targets)
    later = task.followup_targets or task.targets

    def hit(window: str) -> str:
        return has_target(window, later, task.match)

    return _labelled(found, task, targets, hit, stop_before_stopping_time, eos_id)


def _labelled(
    found: DataFrame,
    task: Task,
    targets: str,
    hit: Callable[[str], str],
    stop_early: bool,
    eos_id: int | None,
) -> DataFrame:
    found_at = X.once(f"{first_target('tokens', targets)} AS first_target")
    out = found.selectExpr("*", found_at)
    if stop_early:
        return out
    stop = stopping_point(task.stop, task)
    label = horizon_label(
        "tokens", "stopping_time", targets, task.horizon_days, task.match, "gaps", hit
    )
    out = out.selectExpr("*", X.once(f"{stop} AS stopping_time"))
    out = out.where("stopping_time > 0 AND stopping_time < len")
    return cut_at_stop(out.selectExpr("*", f"{label} AS label_token"), eos_id)


def cut_at_stop(rows: DataFrame, eos_id: int | None) -> DataFrame:
    """Encoded columns, if there are any, cut to the stopping time."""
    for column in ("input_ids", "attention_mask"):
        if column in rows.columns:
            rows = rows.withColumn(column, F.expr(f"slice({column}, 1, stopping_time)"))
    if eos_id is not None and "input_ids" in rows.columns:
        rows = rows.withColumn("input_ids", F.expr(checked_tail("input_ids", eos_id)))
    return rows


def fits_window(df: DataFrame, window: int = S.WINDOW_TOKENS, new: int = S.NEW_TOKENS) -> DataFrame:
    return df.where(f"stopping_time < {window - new}")


def evaluation_set(
    rows: DataFrame,
    task: Task,
    eos_id: int | None = None,
    window: int = S.WINDOW_TOKENS,
    new_tokens: int = S.NEW_TOKENS,
) -> DataFrame:
    """One task's evaluation rows."""
    return fits_window(labelled(rows, task, eos_id=eos_id), window, new_tokens).drop(*HELPERS)


def collected_tasks(task_codes: DataFrame) -> dict[str, list[str]]:
    """Targets per task, at most ``MAX_TARGETS`` of them: they become part of the plan."""
    n = task_codes.distinct().count()
    if n > MAX_TARGETS:
        raise ValueError(f"{n} task codes, of at most {MAX_TARGETS} that definitions may have")
    return {r["task"]: r["targets"] for r in task_targets(task_codes).orderBy("task").collect()}


def tokens_of(rows: DataFrame) -> DataFrame:
    """The distinct tokens of texts; equal ones of a task are merged before they move."""
    return rows.selectExpr("explode(array_distinct(split(text, ' '))) AS token").distinct()


def target_index(
    defined: dict[str, list[str]], task: Task, tokens: DataFrame
) -> dict[str, tuple[list[int], list[int]]] | None:
    """Per token the numbers of the tasks that it is a target of, and of those that it counts for.

    A token counts for a task if it contains (or is) one of its later targets. That is decided once
    per distinct token, not in every text. None if more than ``INDEX_TOKENS`` tokens would count.
    """
    later = {name: list(task.followup_targets) or targets for name, targets in defined.items()}
    every = sorted({t for targets in later.values() for t in targets})
    counting = {t: {t} for t in every}
    if task.match == "contains" and every:
        found = tokens.select("token").distinct().selectExpr(
            "token", f"filter({X.text_array(every)}, x -> contains(token, x)) AS found"
        )
        rows = found.where("size(found) > 0").limit(INDEX_TOKENS + 1).collect()
        if len(rows) > INDEX_TOKENS:
            return None
        counting = {r["token"]: set(r["found"]) for r in rows}
    firsts = {t for targets in defined.values() for t in targets}
    index = {}
    for token in sorted(firsts | set(counting)):
        near = set() if token.startswith("TIME_") else counting.get(token, set())
        index[token] = (
            [n for n, targets in enumerate(defined.values()) if token in targets],
            [n for n, targets in enumerate(later.values()) if near.intersection(targets)],
        )
    return index


def _answered(
    found: DataFrame,
    names: list[str],
    index: dict[str, tuple[list[int], list[int]]],
    task: Task,
) -> DataFrame:
    """Rows and tasks with a stopping time; one scan of a text finds the hits of all tasks.

    Stops of all tasks are a short list per row. Only what has one becomes a row, so texts are not
    copied for tasks that leave them out.
    """

    def numbers(values: list[int]) -> str:
        return f"cast(array({', '.join(map(str, values))}) as array<int>)"

    entries = ", ".join(
        f"{X.text(t)}, struct({numbers(first)} AS first, {numbers(near)} AS near)"
        for t, (first, near) in index.items()
    )
    known = f"t IN ({', '.join(X.text(t) for t in index)})"
    hit = f"struct(i AS at, try_element_at(map({entries}), t) AS tasks)"
    hits = f"array_compact(transform(tokens, (t, i) -> IF({known}, {hit}, NULL))) AS hits"
    mine = "transform(filter(hits, h -> array_contains(h.tasks.first, n)), h -> h.at)"
    tasks = ", ".join(f"struct({X.text(name)} AS task, {n} AS n)" for n, name in enumerate(names))
    firsts = (
        f"transform(array({tasks}), k -> transform(array(k.n), n -> "
        f"struct(k.task AS task, n AS task_number, int(coalesce(array_min({mine}), -1)) AS first_target))[0])"
    )
    stop = stopping_point(task.stop, task, "a.first_target")
    stops = (
        f"transform({firsts}, a -> struct(a.task, a.task_number, a.first_target, "
        f"int({stop}) AS stopping_time))"
    )
    valid = f"filter({stops}, a -> a.stopping_time > 0 AND a.stopping_time < len)"
    out = found.selectExpr("*", X.once(hits)).selectExpr("*", f"inline({valid})")
    end = horizon_end("gaps", "stopping_time", "len", task.horizon_days)
    within = (
        "exists(hits, h -> h.at >= stopping_time AND h.at < e "
        "AND array_contains(h.tasks.near, task_number))"
    )
    label = f"IF(transform(array({end}), e -> {within})[0], 1, 0) AS label_token"
    return out.selectExpr("*", label).drop("hits", "task_number")


def evaluation_sets(
    rows: DataFrame,
    task_codes: DataFrame,
    task: Task,
    eos_id: int | None = None,
    window: int = S.WINDOW_TOKENS,
    new_tokens: int = S.NEW_TOKENS,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """Evaluation rows of every task in ``task_codes`` in one pass, with a ``task`` column.

    ``tokens`` has a column ``token`` with all tokens that can occur, such as a vocabulary of codes
    without spaces; without it, the distinct tokens of the rows are taken. Beyond ``INDEX_TOKENS``
    tokens that count for some task, texts are matched by patterns, task by task.
    """
    defined = collected_tasks(task_codes)
    found = candidates(rows, task.min_years)
    index = target_index(defined, task, tokens_of(rows) if tokens is None else tokens)
    if defined and index is not None:
        out = cut_at_stop(_answered(found, list(defined), index, task), eos_id)
    else:
        out = _matched(found, defined, task, eos_id)
    return fits_window(out, window, new_tokens).drop(*HELPERS)


def _matched(
    found: DataFrame, defined: dict[str, list[str]], task: Task, eos_id: int | None
) -> DataFrame:
    """The same rows by patterns, for definitions that a great part of all tokens counts for."""
    entries = ", ".join(
        f"named_struct('task', {X.text(name)}, 'targets', {X.text_array(targets)})"
        for name, targets in defined.items()
    )
    if not defined:
        entries = "cast(NULL as struct<task: string, targets: array<string>>)"
        found = found.where("false")

    def hit(window: str) -> str:
        if task.followup_targets or not defined:
            return has_target(window, task.followup_targets, task.match)
        tests = [
            (f"task = {X.text(name)}", has_target("w", targets, task.match))
            for name, targets in defined.items()
        ]
        return f"transform(array({window}), w -> {X.cases(tests, 'false')})[0]"

    flat = found.selectExpr("*", f"inline(array({entries}))")
    return _labelled(flat, task, "targets", hit, False, eos_id).drop("targets")
