"""Removal of passages that earlier documents already have, by seed and extend.

Seeds: of every window of 13 words the least hash of its five-word runs is its anchor. Equal windows
have equal anchors, so documents that share a window meet on it; an anchor of one document only
seeds nothing, and most are. Extension: from each anchor that documents share, all windows around it
that it stands for are tried, to the left and to the right, against the same windows of other
documents; consecutive hits join to maximal repeats of at least 13 words.

Documents meet through the least id that has an anchor or window, never pair by pair. Each task
settles among its own documents first and sends on the texts of one id per anchor and per window,
so a passage that a third of all documents hold is a row per task. A copy of a whole earlier text is
found by the text's hash and sends no windows.

Null text has no words. Texts under 13 words lose nothing. Rows without id lose nothing and cause no
removal. Rows with the same id do not remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.operators.distribute import lookup_join
from sojourn.session import stored

WINDOW = 13
SEED_WORDS = 5
# Numbers in a broadcast list of repeats.
BROADCAST_NUMBERS = 2_000_000
# Bytes of text that a task looks at together.
TEXT_BYTES = 1 << 23
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def runs_of(h: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of every run of ``size`` word hashes."""
    n = len(h) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(size):
            total = total * factor + h[j : j + n]
    return common.mix64(total)


def anchors_of(h: np.ndarray, window: int = WINDOW, seed: int = SEED_WORDS) -> np.ndarray:
    """For every window the least hash of its seeds."""
    least, width, wanted = runs_of(h, seed, FIRST), 1, window - seed + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[: len(least) - step], least[step:]) if len(least) > step else least[:0]
        width += step
    return least


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _least_by(docs: np.ndarray, ids: np.ndarray, *keys: np.ndarray):
    """Order by keys, then id, and for every row so ordered whether its id is its key's least."""
    order = np.lexsort((ids[docs], *keys))
    change = np.zeros(len(order), bool)
    change[:1] = True
    for key in keys:
        k = key[order]
        change[1:] |= k[1:] != k[:-1]
    group = np.cumsum(change) - 1
    sorted_ids = ids[docs][order]
    least = sorted_ids[change][group] if len(order) else sorted_ids
    return order, change, group, sorted_ids, least


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per anchor and text of its least id here, and per document its anchors known as shared."""
    hashes = common.WordHashes()
    for batch in batches:
        for part in common.slices(batch, "text", TEXT_BYTES):
            ids = part["doc_id"].to_numpy(False)
            marks = part["mark"].to_numpy(False)
            found = [
                np.unique(anchors_of(hashes.of(t.split()))) for t in common.texts_of(part["text"])
            ]
            # Rows in the order of id and mark, so that those of one id stand by their marks.
            rank = np.lexsort((marks, ids))
            ids, marks, found = ids[rank], marks[rank], [found[i] for i in rank]
            docs = np.repeat(np.arange(len(ids)), [len(f) for f in found])
            anchors = np.concatenate(found) if found else np.empty(0, np.uint64)
            if not len(anchors):
                continue
            order, change, group, by_id, least = _least_by(docs, ids, anchors)
            shared = np.zeros(group[-1] + 1, bool)
            shared[group[by_id != least]] = True
            own = marks[docs[order]]
            first = change.copy()
            first[1:] |= (by_id[1:] == least[1:]) & (own[1:] != own[:-1])
            send = order[first]
            yield pa.record_batch(
                {
                    "anchor": pa.array(_signed(anchors[send])),
                    "doc_id": pa.array(ids[docs[send]]),
                    "mark": pa.array(marks[docs[send]]),
                    "known": pa.nulls(len(send), pa.list_(pa.int64())),
                }
            )
            held = order[shared[group]]
            by_doc = held[np.argsort(docs[held], kind="stable")]
            owners, starts = np.unique(docs[by_doc], return_index=True)
            lists = np.split(_signed(anchors[by_doc]), starts[1:]) if len(owners) else []
            yield pa.record_batch(
                {
                    "anchor": pa.array(_signed(common.mix64(owners.astype(np.uint64)))),
                    "doc_id": pa.array(ids[owners]),
                    "mark": pa.array(marks[owners]),
                    "known": pa.array(lists, pa.list_(pa.int64())),
                }
            )


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of shared anchors: rows for the least document here, hits of the others at once."""
    hashes = common.WordHashes()
    for batch in batches:
        for part in common.slices(batch, "text", TEXT_BYTES):
            ids, marks = part["doc_id"].to_numpy(False), part["mark"].to_numpy(False)
            at, first, second, sizes = [], [], [], []
            for text, shared in zip(common.texts_of(part["text"]), part["shared"], strict=True):
                h = hashes.of(text.split())
                seeds = np.sort(shared.values.to_numpy(False).view(np.uint64))
                anchors = anchors_of(h)
                spot = np.minimum(np.searchsorted(seeds, anchors), len(seeds) - 1)
                tried = np.flatnonzero(seeds[spot] == anchors)
                at.append(tried)
                first.append(runs_of(h, WINDOW, FIRST)[tried])
                second.append(runs_of(h ^ (h >> np.uint64(17)), WINDOW, SECOND)[tried])
                sizes.append(len(tried))
            at, first = np.concatenate(at), np.concatenate(first)
            second = np.concatenate(second)
            if not len(at):
                continue
            docs = np.repeat(np.arange(len(ids)), sizes)
            order, _, _, by_id, least = _least_by(docs, ids, first, second)
            hit = by_id != least
            send = order[~hit]
            yield pa.record_batch(
                {
                    "w1": pa.array(_signed(first[send])),
                    "w2": pa.array(_signed(second[send]).astype(np.int32)),
                    "doc_id": pa.array(ids[docs[send]]),
                    "mark": pa.array(marks[docs[send]]),
                    "at": pa.array(at[send].astype(np.int32)),
                    "known": pa.nulls(len(send), pa.list_(pa.int32())),
                }
            )
            hits = order[hit]
            by_doc = hits[np.argsort(docs[hits], kind="stable")]
            owners, starts = np.unique(docs[by_doc], return_index=True)
            lists = np.split(at[by_doc].astype(np.int32), starts[1:]) if len(owners) else []
            yield pa.record_batch(
                {
                    "w1": pa.array(_signed(common.mix64(owners.astype(np.uint64)))),
                    "w2": pa.nulls(len(owners), pa.int32()),
                    "doc_id": pa.array(ids[owners]),
                    "mark": pa.array(marks[owners]),
                    "at": pa.nulls(len(owners), pa.int32()),
                    "known": pa.array(lists, pa.list_(pa.int32())),
                }
            )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit windows of a document to the word spans of its maximal repeats."""
    for batch in batches:
        spans = []
        for value in batch["hits"]:
            at = np.unique(value.values.to_numpy(False))
            cut = np.flatnonzero(np.diff(at) > WINDOW)
            starts = at[np.concatenate(([0], cut + 1))]
            ends = at[np.concatenate((cut, [len(at) - 1]))] + WINDOW
            spans.append(np.column_stack((starts, ends)).ravel().astype(np.int32))
        column = pa.array(spans, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["mark"], column], names=["doc_id", "mark", "spans"]
        )


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, spans``: per document its repeated words as start, end, start, end, …

    ``mark`` is ``hash(text)``, which tells rows with one id apart. Spans that touch or overlap are
    one. A copy of an earlier text has the span 0, -1: all of it.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr(
        "doc_id", "hash(text) AS mark", "text"
    )
    texts = rows.selectExpr("doc_id", "mark", "xxhash64(text) AS t1", "md5(text) AS t2")
    texts = stored(texts)
    least = texts.groupBy("t1", "t2").agg(F.expr("min(doc_id) AS least"), F.expr("max(doc_id) AS m"))
    least = least.where("least < m").selectExpr("t2", "least")
    copies = lookup_join(texts, least, "t2", max_broadcast=common.BROADCAST_ROWS)
    copies = stored(copies.where("doc_id > least").select("doc_id", "mark").distinct())

    sent = rows.mapInArrow(common.tidied(_anchored), "anchor bigint, doc_id bigint, mark int, known array<bigint>")
    sent = sent.selectExpr(
        "*", "min(doc_id) OVER (PARTITION BY anchor) AS low",
        "max(doc_id) OVER (PARTITION BY anchor) AS high",
    )
    shared = sent.where("known IS NOT NULL OR low < high").groupBy("doc_id", "mark").agg(
        F.expr("concat(flatten(collect_list(known)), collect_list(IF(known IS NULL, anchor, NULL))) AS shared")
    )
    shared = shared.join(copies, ["doc_id", "mark"], "left_anti")
    # Most documents share some anchor, so the texts go to the lists, at any size.
    seeded = rows.join(stored(shared).hint("merge"), ["doc_id", "mark"])
    tried = seeded.select("doc_id", "mark", "text", "shared").mapInArrow(
        common.tidied(_windowed), "w1 bigint, w2 int, doc_id bigint, mark int, at int, known array<int>"
    )
    tried = tried.selectExpr(
        "doc_id", "mark", "at", "known", "min(doc_id) OVER (PARTITION BY w1, w2) AS low"
    )
    hits = tried.where("known IS NOT NULL OR low < doc_id").groupBy("doc_id", "mark").agg(
        F.expr("concat(flatten(collect_list(known)), collect_list(at)) AS hits")
    )
    spans = hits.mapInArrow(common.tidied(_joined), "doc_id bigint, mark int, spans array<int>")
    return spans.unionByName(copies.selectExpr("doc_id", "mark", "array(0, -1) AS spans"))


def _beside(rows: DataFrame, lists: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """Texts with the list of their document, broadcast as long as its numbers are few."""
    size = lists.selectExpr(f"coalesce(sum(size({name}) + 2), 0L) AS n").first()["n"]
    if size <= BROADCAST_NUMBERS:
        lists = F.broadcast(lists)
    return rows.join(lists, ["doc_id", "mark"], how)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(common.texts_of(batch["text"]), batch["spans"], strict=True):
            words = text.split()
            n_words.append(len(words))
            if spans.is_valid:
                flat = spans.values.to_pylist()
                pairs = list(zip(flat[::2], flat[1::2], strict=True))
                if (0, -1) in pairs:
                    pairs = [(0, len(words))] if len(words) >= WINDOW else []
                rest, end = [], 0
                for start, stop in pairs:
                    rest += words[end:start]
                    end = stop
                words = rest + words[end:]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.record_batch(
            {
                "doc_id": batch["doc_id"],
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                "kept": pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
            }
        )


def removed(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every document."""
    rows = docs.selectExpr("doc_id", "hash(text) AS mark", "text")
    spans = stored(repeats(docs)) if found is None else found
    return _beside(rows, spans, "spans", "left").select("doc_id", "text", "spans").mapInArrow(
        common.tidied(_kept), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    )
