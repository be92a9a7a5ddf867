"""Frequency filters on codes and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.distribute import lookup_join, shares_of
from sojourn.schema import Thresholds
from sojourn.session import materialise, stored


def subject_code_counts(events: DataFrame) -> DataFrame:
    """``subject_id, code, n``: all the filters need.

    Pairs seldom repeat within a task that reads events, so combining them there would keep almost
    every row of the task in memory. The two columns are dealt out first and counted afterwards, in
    at least 200 tasks, whatever the rows compress to.
    """
    pairs = events.where("code IS NOT NULL").select("subject_id", "code")
    dealt = pairs.repartition(shares_of(events), "subject_id", "code")
    return dealt.groupBy("subject_id", "code").agg(F.expr("count(*) AS n"))


def common_codes(pairs: DataFrame, min_subjects: int) -> DataFrame:
    """Codes seen in at least ``min_subjects`` subjects; ``pairs`` rows are distinct pairs."""
    counts = pairs.groupBy("code").agg(F.expr("count(*) AS subject_count"))
    return counts.where(f"subject_count >= {min_subjects}")


def active_subjects(counts: DataFrame, low: int, high: int) -> DataFrame:
    """Subjects whose number of coded events, the sum of ``n``, lies in ``[low, high]``."""
    counts = counts.groupBy("subject_id").agg(F.expr("sum(n) AS event_count"))
    return counts.where(f"event_count BETWEEN {low} AND {high}")


def rare_code_filter(events: DataFrame, min_subjects: int) -> DataFrame:
    codes = common_codes(subject_code_counts(events), min_subjects)
    return lookup_join(events, codes.select("code"), "code", "left_semi")


def subject_activity_filter(events: DataFrame, low: int, high: int) -> DataFrame:
    # Codes play no part here, so a task keeps one count per subject instead of one per pair.
    coded = events.where("code IS NOT NULL").groupBy("subject_id").agg(F.expr("count(*) AS n"))
    subjects = active_subjects(coded, low, high)
    return lookup_join(events, subjects.select("subject_id"), "subject_id", "left_semi")


def frequent_codes(events: DataFrame, min_subjects: int) -> DataFrame:
    """``code``: codes seen in at least ``min_subjects`` subjects, without the pairs of most of them.

    Subjects are dealt to slots by a hash, so a code has at least as many subjects as it fills slots.
    One pass, combined where events are read, finds the slots and events of each code: enough slots
    make it common, too few events make it rare. Only the events of the codes between are counted by
    pair. Thresholds beyond the slots leave every code there.
    """
    words = min(max(-(-4 * min_subjects // 64), 1), 16)
    filled = " + ".join(
        f"bit_count(bit_or(IF(slot div 64 = {w}, shiftleft(1L, cast(slot % 64 as int)), 0L)))"
        for w in range(words)
    )
    coded = events.where("code IS NOT NULL")
    dealt = coded.selectExpr("code", f"pmod(xxhash64(subject_id), {64 * words}L) AS slot")
    told = materialise(
        dealt.groupBy("code").agg(F.expr("count(*) AS n"), F.expr(f"{filled} AS filled"))
    )
    sure = told.where(f"filled >= {min_subjects}").select("code")
    unsure = told.where(f"filled < {min_subjects} AND n >= {min_subjects}").select("code")
    if unsure.isEmpty():
        return sure
    pairs = subject_code_counts(lookup_join(coded, unsure, "code", "left_semi", computed=True))
    return sure.union(common_codes(pairs, min_subjects).select("code"))


def frequency_filter(events: DataFrame, limits: Thresholds) -> DataFrame:
    """Alternating rounds of the code and the subject filter.

    Events are stored once; the rounds read two columns of them. A round only ever removes codes and
    subjects, so the events that survive are those of the last round's codes and subjects, and a
    round that finds the codes of the round before changes nothing any more. Subjects are selected by
    the shorter of two lists, those that stay and those that go. The event rows do not move as long as
    these lists can be broadcast.
    """
    if limits.codes_only:
        return rare_code_filter(events, limits.min_subjects_per_code)
    inside = f"n BETWEEN {limits.min_events_per_subject} AND {limits.max_events_per_subject}"
    events = stored(events)
    lists: list[tuple[DataFrame, str, str]] = []
    live, known = events.select("subject_id", "code"), None
    for _ in range(limits.rounds):
        codes = materialise(frequent_codes(live, limits.min_subjects_per_code))
        n_codes = codes.count()
        if n_codes == known:
            break
        known, of_codes = n_codes, (codes, "code", "left_semi")
        live = _selected(events.select("subject_id", "code"), [of_codes, *lists])
        counts = live.groupBy("subject_id").agg(F.expr("count(*) AS n"))
        told = stored(counts.selectExpr("subject_id", f"{inside} AS stays"))
        size = told.selectExpr("count_if(stays) AS stay", "count_if(NOT stays) AS go").first()
        if size["go"] < size["stay"]:
            gone = told.where("NOT stays AND subject_id IS NOT NULL").select("subject_id")
            lists = [*lists, (gone, "subject_id", "left_anti")]
        else:
            lists = [(told.where("stays").select("subject_id"), "subject_id", "left_semi")]
        live = _selected(events.select("subject_id", "code"), [of_codes, *lists])
    return _selected(events, [of_codes, *lists])


def _selected(events: DataFrame, lists: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Events that pass all lists of keys; a list of subjects leaves out events without one."""
    for keys, key, how in lists:
        if key == "subject_id":
            events = events.where("subject_id IS NOT NULL")
        events = lookup_join(events, keys, key, how, computed=True)
    return events
