"""Cross-entropy difference between a target and a background language model.

Both are interpolated word bigram models over one vocabulary, with one count for every word and pair
that occurs, told apart by 63-bit hashes. The target model counts the documents of good labelled quality, the background model all
documents; every token of every text is counted. A token costs minus the logarithm of its
probability in a model, and a document's score is the mean over its tokens of target cost minus
background cost: the lower, the more it reads like the target.

    p(w) = (n(w) + a) / (N + a V)        p(w | v) = (n(v w) + m p(w)) / (n(v) + m)

V is the number of distinct words, or 2^18 where there are fewer: room for those not seen.

The counts grow with the texts, so none are collected or broadcast. Texts are dealt into chunks of
some ``CHUNK_BYTES`` by a hash of id and text. A chunk sends its distinct keys and counts on in order,
packed by ranges of keys; a range adds up what all chunks sent and answers each with the sums of its
keys, in the same order. A frequent word is an entry per chunk. Rows that repeat id and text share a
chunk.

A document is scored by the counts of the others: what it added to a model is taken off first, else
a target document would recognise itself. A start mark precedes each text.

Words are maximal runs without ASCII white space, A-Z lower-cased. Null text counts as empty. A text
without words has no costs (null). Rows without id are counted as background and scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.operators.distribute import lookup_join
from sojourn.session import stored

# The least size of the vocabulary, as a power of two.
WORD_BITS = 18
ADDED, PRIOR = 0.1, 50.0
START = np.uint64(0x5851F42D4C957F2D)
CHUNK_BYTES = 1 << 24
# Ranges of keys for each chunk: packed counts of some 100 KB.
RANGES = 16
ONE = np.uint64(1)


def places(text: bytes, hashes: common.WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the start mark and all words (negative), and of each word's pair with the one before."""
    h = hashes.of(text.lower().split())
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked = np.concatenate(([START], h))
    pair = common.mix64(marked[:-1] * np.uint64(3) + (h ^ np.uint64(11)))
    words = ~(common.mix64(marked) >> ONE).astype(np.int64)
    return words, (pair >> ONE).astype(np.int64)


def flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, text, chosen``: whether the document's id is one of the target's."""
    ids = target.where("doc_id IS NOT NULL").select("doc_id").distinct()
    ids = ids.selectExpr("doc_id", "1 AS chosen")
    rows = lookup_join(docs.select("doc_id", "text"), ids, "doc_id", "left", common.BROADCAST_ROWS)
    return rows.selectExpr("doc_id", "text", "chosen IS NOT NULL AS chosen")


class Chunk:
    """The texts of a chunk as keys, and what each key counts in it."""

    def __init__(self):
        self.ids, self.chosen, self.sizes, self.found = [], [], [], []

    def add(self, batch: pa.RecordBatch, hashes: common.WordHashes) -> None:
        self.ids += batch["doc_id"].to_pylist()
        self.chosen += batch["chosen"].to_pylist()
        for text in common.texts_of(batch["text"]):
            words, pairs = places(text, hashes)
            self.sizes.append(len(pairs))
            self.found += [words, pairs]

    def counted(self, inverse: bool = False) -> tuple[np.ndarray, ...]:
        """Keys in order, their background and target counts, and for every occurrence its key's row."""
        every = np.concatenate(self.found) if self.found else np.empty(0, np.int64)
        each = np.array([len(f) for f in self.found], np.int64)
        good = np.repeat(np.repeat(np.array(self.chosen, bool), 2), each)
        if inverse:
            keys, at, n = np.unique(every, return_inverse=True, return_counts=True)
            return keys, n, np.bincount(at[good], minlength=len(keys)), at
        keys, n = np.unique(every, return_counts=True)
        some, times = np.unique(every[good], return_counts=True)
        target = np.zeros(len(keys), np.int64)
        target[np.searchsorted(keys, some)] = times
        return keys, n, target


def packed(*columns: np.ndarray) -> bytes:
    """Columns of int64, byte by byte of equal weight, compressed."""
    values = np.stack([c.astype(np.int64) for c in columns])
    planes = values.view(np.uint8).reshape(len(columns), -1, 8).swapaxes(1, 2)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, columns: int, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, columns * n * 8, "zstd", asbytes=True), np.uint8)
    planes = raw.reshape(columns, 8, n).swapaxes(1, 2)
    return np.ascontiguousarray(planes).view(np.int64).reshape(columns, n)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches sorted by ``key`` that have one value of it."""
    for batch in batches:
        numbers = batch[key].to_numpy()
        borders = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(borders, borders[1:], strict=False):
            if a < b:
                yield int(numbers[a]), batch.slice(a, b - a)


def _sent(chunk: Chunk, number: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """The chunk's counts, a row per range of keys."""
    keys, *seen = chunk.counted()
    if not len(keys):
        return
    spots = ((keys >> np.int64(32)) + (1 << 31)) * ranges >> np.int64(32)
    some, starts = np.unique(spots, return_index=True)
    for k, a, b in zip(some.tolist(), starts, [*starts[1:], len(keys)], strict=True):
        steps = np.diff(keys[a:b], prepend=np.int64(0))
        blob = packed(steps, *(c[a:b] for c in seen))
        yield pa.record_batch(
            {
                "part": pa.array([k], pa.int64()),
                "chunk": pa.array([number], pa.int64()),
                "n": pa.array([b - a], pa.int64()),
                "blob": pa.array([blob], pa.binary()),
            }
        )


def _summed(part: int, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Answers to all chunks that sent counts of a range; the first has the totals of its words."""
    sizes = [n for _, n, _ in rows]
    steps, *seen = np.concatenate([unpacked(blob, 3, n) for _, n, blob in rows], axis=1)
    ends = np.cumsum(sizes)
    keys = np.concatenate([np.cumsum(steps[e - n : e]) for e, n in zip(ends, sizes, strict=True)])
    keys, at = np.unique(keys, return_inverse=True)
    sums = [np.bincount(at, c, len(keys)).astype(np.int64) for c in seen]
    words = keys < 0
    totals = [int(words.sum()), *(int(c[words].sum()) for c in sums)]
    for e, (chunk, n, _) in zip(ends, rows, strict=True):
        own = at[e - n : e]
        columns = {"chunk": chunk, "part": part, "n": n}
        columns |= dict(zip(("words", "b", "t"), totals, strict=True))
        columns = {c: pa.array([v], pa.int64()) for c, v in columns.items()}
        yield pa.record_batch(columns | {"blob": pa.array([packed(*(c[own] for c in sums))], pa.binary())})
        totals = [0, 0, 0]


class Model:
    """One of the two models: counts by row of a chunk's keys, of all words, and distinct words."""

    def __init__(self, seen: np.ndarray, size: int, vocabulary: int):
        self.seen, self.size = seen.astype(float), float(size)
        self.vocabulary = max(1 << WORD_BITS, vocabulary)

    def costs(self, words: np.ndarray, pairs: np.ndarray, own: bool) -> np.ndarray:
        """Cost of each word of a text; ``own`` if the text was counted in this model."""
        word, pair, size = self.seen[words], self.seen[pairs], self.size
        if own:
            word, pair = word - occurrences(words), pair - occurrences(pairs)
            size -= len(words)
        single = (word[1:] + ADDED) / (size + ADDED * self.vocabulary)
        return -np.log((pair + PRIOR * single) / (word[:-1] + PRIOR))


def occurrences(places: np.ndarray) -> np.ndarray:
    """For each element, how many are equal to it."""
    _, at, n = np.unique(places, return_inverse=True, return_counts=True)
    return n[at]


def _losses(
    chunk: Chunk, answers: dict[int, tuple[int, bytes]], totals: tuple[int, int, int]
) -> pa.RecordBatch:
    """Scores of a chunk's texts; ``answers`` have the sums of its keys by range."""
    keys, _, _, at = chunk.counted(inverse=True)
    sums = [unpacked(answers[k][1], 2, answers[k][0]) for k in sorted(answers)]
    background, target = np.concatenate([np.empty((2, 0), np.int64), *sums], axis=1)
    if len(background) != len(keys):
        raise RuntimeError(f"{len(keys)} words and pairs, but {len(background)} answers")
    vocabulary, *sizes = totals
    models = [Model(seen, n, vocabulary) for seen, n in zip((background, target), sizes, strict=True)]
    losses, start = [], 0
    for size, good in zip(chunk.sizes, chunk.chosen, strict=True):
        if not size:
            losses.append((None, None, None))
            continue
        words, pairs = at[start : start + size + 1], at[start + size + 1 : start + 2 * size + 1]
        start += 2 * size + 1
        background = models[0].costs(words, pairs, True)
        wanted = models[1].costs(words, pairs, good)
        losses.append((wanted.mean(), background.mean(), (wanted - background).mean()))
    columns = [pa.array(x, pa.float64()) for x in zip(*losses, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.ids, pa.int64()), pa.array(chunk.sizes, pa.int64()), *columns],
        names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
    )


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every document."""
    size = docs.selectExpr("coalesce(sum(octet_length(text)), 0L) AS n").first()["n"]
    chunks = int(size) // CHUNK_BYTES + 1
    ranges = RANGES * chunks
    number = f"pmod(xxhash64(doc_id, xxhash64(text)), {chunks}L) AS chunk"
    texts = flagged(docs, target).selectExpr(number, "doc_id", "text", "chosen")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, chunk = common.WordHashes(), None, Chunk()
        for own, part in _runs(batches, "chunk"):
            if own != now:
                yield from _sent(chunk, now, ranges)
                now, chunk = own, Chunk()
            chunk.add(part, hashes)
        yield from _sent(chunk, now, ranges)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for own, part in _runs(batches, "part"):
            if own != now:
                if rows:
                    yield from _summed(now, rows)
                now, rows = own, []
            rows += zip(*(part[c].to_pylist() for c in ("chunk", "n", "blob")), strict=True)
        if rows:
            yield from _summed(now, rows)

    sent = texts.repartition("chunk").sortWithinPartitions("chunk")
    sent = sent.mapInArrow(common.tidied(send), "part bigint, chunk bigint, n bigint, blob binary")
    sent = sent.repartition("part").sortWithinPartitions("part")
    answers = stored(
        sent.mapInArrow(
            common.tidied(add),
            "chunk bigint, part bigint, n bigint, words bigint, b bigint, t bigint, blob binary",
        )
    )
    sums = [f"coalesce(sum({c}), 0L)" for c in ("words", "b", "t")]
    totals = tuple(answers.selectExpr(*sums).first())
    rows = texts.selectExpr("*", "0L AS part", "0L AS n", "CAST(NULL AS binary) AS blob")
    answers = answers.selectExpr(
        "chunk", "CAST(NULL AS bigint) AS doc_id", "CAST(NULL AS string) AS text",
        "CAST(NULL AS boolean) AS chosen", "part", "n", "blob",
    )
    rows = rows.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, chunk, answers = common.WordHashes(), None, Chunk(), {}
        for own, part in _runs(batches, "chunk"):
            if own != now:
                if chunk.ids:
                    yield _losses(chunk, answers, totals)
                now, chunk, answers = own, Chunk(), {}
            is_text = part["chosen"].is_valid()
            chunk.add(part.filter(is_text), hashes)
            found = part.filter(pc.invert(is_text))
            for k, n, blob in zip(*(found[c].to_pylist() for c in ("part", "n", "blob")), strict=True):
                answers[k] = n, blob
        if chunk.ids:
            yield _losses(chunk, answers, totals)

    return rows.mapInArrow(
        common.tidied(run),
        "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double",
    )
