"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are its words, word pairs, and pairs with one or two words between, each hashed
to one of 2^20 places and counted once. The model is fitted online, with a learning rate for each
coordinate and an L1 penalty that leaves few weights; these are broadcast, at most 2^20 numbers.

It learns from at most ``limit`` labelled rows (a seeded sample of the labels) outside the held-out
quarter. Null text counts as empty; an empty text gets the score of the bias alone. Null labels and
labels without document teach nothing; without any label all scores are 0.5. A document labelled
twice counts with its higher label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.operators.distribute import lookup_join
from sojourn.session import materialise

BITS = 20
# Labelled documents that the model is fitted on.
LIMIT = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.1
# Toxic rows are rare; their steps are longer by this factor.
RARE = 2.0
THRESHOLD = 0.3
BIAS = 0
WORD = re.compile(r"[^\W_]+")
# Words of one text that are hashed at once.
CHUNK = 1 << 18


def features(text: bytes, hashes: common.WordHashes) -> Iterator[np.ndarray]:
    """Places of the features, some words at a time; chunks overlap by the longest gap."""
    words = WORD.findall(text.decode().lower())
    for at in range(0, max(len(words), 1), CHUNK):
        h = hashes.of(words[at : at + CHUNK + 3])
        own = min(CHUNK, len(words) - at)
        parts = [common.mix64(h[:own])]
        for gap in (1, 2, 3):
            a, b = h[:-gap][:own], h[gap:][:own]
            n = min(len(a), len(b))
            parts.append(common.mix64(a[:n] * np.uint64(2 * gap + 1) + (b[:n] ^ np.uint64(gap))))
        yield (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = common.WordHashes()
    for batch in batches:
        for part in common.slices(batch, "text"):
            found = [
                np.unique(np.concatenate([[BIAS], *features(t, hashes)])).astype(np.int32)
                for t in common.texts_of(part["text"])
            ]
            places = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part["draw"], part["label"], places], names=["draw", "label", "places"]
            )


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive in the order to learn from; only the model is held."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i) -> np.ndarray:
        zi = z[i]
        shrunk = zi - np.sign(zi) * L1
        return np.where(np.abs(zi) <= L1, 0, -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for batch in batches:
        for label, places in zip(batch["label"].to_pylist(), batch["places"], strict=True):
            i = places.values.to_numpy(False)
            w = weights(i)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum())))) - label
            g *= RARE if label else 1.0
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(slice(None))
    some = np.flatnonzero(w)
    yield pa.record_batch({"place": pa.array(some.astype(np.int32)), "weight": pa.array(w[some])})


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``place, weight``: the weights that are not zero."""
    known = labels.where(f"toxic IN (0, 1) AND doc_id IS NOT NULL AND NOT {common.held_out()}")
    known = known.groupBy("doc_id").agg(F.expr("max(toxic) AS label"))
    known = known.selectExpr("doc_id", "int(label) AS label", "xxhash64(doc_id, 3L) AS draw")
    sample = materialise(known.orderBy("draw", "doc_id").limit(limit))
    rows = docs.select("doc_id", "text")
    rows = lookup_join(rows, sample, "doc_id", max_broadcast=limit, computed=True)
    rows = rows.select("draw", "label", "text").mapInArrow(
        common.tidied(_featured), "draw bigint, label int, places array<int>"
    )
    rounds = rows.selectExpr("*", f"explode(sequence(1, {EPOCHS})) AS epoch").repartition(1)
    rounds = rounds.sortWithinPartitions("epoch", "draw", "label").drop("draw", "epoch")
    return rounds.mapInArrow(common.tidied(_fitted), "place int, weight double")


def score(docs: DataFrame, model: DataFrame, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text."""
    found = model.toArrow()  # at most 2^20 rows
    table = found["place"].to_numpy(), found["weight"].to_numpy().astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[shared.value[0]] = shared.value[1]
        hashes = common.WordHashes()
        for batch in batches:
            found = []
            for text in common.texts_of(batch["text"]):
                heavy = [i[dense[i] != 0] for i in features(text, hashes)]
                once = np.unique(np.concatenate([[BIAS], *heavy]).astype(np.int64))
                total = math.fsum(dense[once].tolist())
                found.append(1 / (1 + math.exp(-max(-700.0, min(700.0, total)))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())],
                names=[*batch.schema.names, name],
            )

    return docs.mapInArrow(common.tidied(run), common.plus(docs, **{name: "double"}))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.selectExpr(
        "doc_id",
        f"{common.held_out()} AS held_out",
        "score",
        f"int(score >= {THRESHOLD}D) AS predicted",
    )
