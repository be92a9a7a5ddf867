"""Byte-level BPE encoding and decoding over padded numpy matrices.

A text is cut by the tokenizer's pattern. Each distinct piece is encoded once per task and then
remembered, up to a bound. Pieces that are no token by themselves are put, bucketed by length, into
matrices with one piece per row, padded behind its end. In every round each row merges its leftmost
pair of least rank; ranks come from a hashed pair table, finished rows leave the matrix.

Null text is encoded like an empty one: no ids. Ids decode to the exact bytes of the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sojourn.llm import common

NO_RANK = np.int32(2**31 - 1)
# Cells of one matrix; pieces beyond LONG bytes merge by a queue, in the same order.
CELLS = 1 << 20
LONG = 512
# Distinct pieces a task remembers; pieces of one text that are looked at together.
CACHE = 100_000
CACHE_BYTES = 16 << 20  # of pieces and their ids
PIECES = 1 << 17
# Texts whose pieces are held at once.
TEXT_BYTES = 1 << 21
SPACES = r"\t-\r \x85\xa0  -     　"


class Vocabulary:
    """Token bytes by id and the hashed table of mergeable pairs."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes = [b""] * (max(self.ids.values(), default=-1) + 1)
        for token, rank in self.ids.items():
            self.bytes[rank] = token
        self.single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary needs all 256 bytes")
        left, right, rank = [], [], []
        for token, merged in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(merged)
        keys = self._key(np.array(left, np.int64), np.array(right, np.int64))
        self._fill(keys, np.array(rank, np.int32))

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.width)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probing, filled and read in vector steps."""
        self.width = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.width, -1, np.int64)
        self.ranks = np.full(1 << self.width, NO_RANK, np.int32)
        self.probes, slots = 0, self._slot(keys)
        while len(keys):
            self.probes += 1
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]  # of several for one slot the last one stays
            done = self.keys[slots] == keys
            self.ranks[slots[done]] = ranks[done]
            keys, ranks = keys[~done], ranks[~done]
            slots = (slots[~done] + np.uint64(1)) & np.uint64((1 << self.width) - 1)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging ``a`` and ``b``; NO_RANK where they do not merge or one is padding."""
        keys = self._key(a, b).ravel()
        keys[(a.ravel() < 0) | (b.ravel() < 0)] = -2
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.ranks[slots], NO_RANK)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + np.uint64(1)) & np.uint64((1 << self.width) - 1)
            here = self.keys[slots[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
        return found.reshape(a.shape)


def merged(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each piece, as the bytes of int32, merged in matrices of pieces of similar length."""
    out: list[bytes] = [b""] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    padded = 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    buckets = np.where(lengths <= 16, lengths, padded)
    for bucket in np.unique(buckets).tolist():
        chosen = np.flatnonzero(buckets == bucket)
        if bucket > LONG:
            for i in chosen.tolist():
                out[i] = queue_merged(pieces[i], vocabulary).tobytes()
            continue
        step = max(1, CELLS // max(1, bucket))
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step].tolist()
            found = _matrix([pieces[i] for i in part], bucket, vocabulary)
            for i, ids in zip(part, found, strict=True):
                out[i] = ids
    return out


def _matrix(rows: list[bytes], width: int, vocabulary: Vocabulary) -> list[bytes]:
    """One round after the other over a matrix with a piece per row, -1 behind its end."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    tokens = np.full((len(rows), width), -1, np.int32)
    tokens[np.arange(width) < sizes[:, None]] = vocabulary.single[
        np.frombuffer(b"".join(rows), np.uint8)
    ]
    result: list[bytes] = [b""] * len(rows)
    live = np.arange(len(rows))
    ranks = vocabulary.rank_of(tokens[:, :-1], tokens[:, 1:])
    while len(live):
        if ranks.shape[1]:
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(live)), at]
        else:
            best = np.full(len(live), NO_RANK)
        ended = best == NO_RANK
        if ended.any():  # compaction: finished rows leave
            rest, stride = tokens[ended], 4 * tokens.shape[1]
            held, flat = 4 * (rest >= 0).sum(axis=1), rest.tobytes()
            for k, (n, size) in enumerate(zip(live[ended].tolist(), held.tolist(), strict=True)):
                result[n] = flat[k * stride : k * stride + size]
            go = ~ended
            live, tokens, ranks = live[go], tokens[go], ranks[go]
            at, best = at[go], best[go]
            if not len(live):
                break
        row, last = np.arange(len(live)), tokens.shape[1] - 1
        # The merged token takes the place of its left part; all behind moves up by one.
        source = np.arange(last) + (np.arange(last) > at[:, None])
        tokens[row, at] = best
        tokens = np.take_along_axis(tokens, source, axis=1)
        if last == 1:
            ranks = np.empty((len(live), 0), np.int32)
            continue
        ranks = np.take_along_axis(ranks, source[:, : last - 1], axis=1)
        right = at < last - 1
        ranks[row[right], at[right]] = vocabulary.rank_of(
            tokens[row[right], at[right]], tokens[row[right], at[right] + 1]
        )
        left = at > 0
        ranks[row[left], at[left] - 1] = vocabulary.rank_of(
            tokens[row[left], at[left] - 1], tokens[row[left], at[left]]
        )
    return result


def queue_merged(piece: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """The same merges for one long piece, leftmost least rank first, in n log n steps."""
    tokens = vocabulary.single[np.frombuffer(piece, np.uint8)].tolist()
    n = len(tokens)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    first = vocabulary.rank_of(np.array(tokens[:-1]), np.array(tokens[1:])).tolist()
    queue = [(rank, i) for i, rank in enumerate(first) if rank != NO_RANK]
    heapq.heapify(queue)
    table = vocabulary.bytes
    current = first + [NO_RANK]

    def rank(i: int) -> int:
        if after[i] >= n:
            return NO_RANK
        return vocabulary.ids.get(table[tokens[i]] + table[tokens[after[i]]], NO_RANK)

    while queue:
        best, i = heapq.heappop(queue)
        if current[i] != best:
            continue
        gone = after[i]
        tokens[i], after[i] = best, after[gone]
        tokens[gone], current[gone] = -1, NO_RANK
        if after[i] < n:
            before[after[i]] = i
        for j in (i, before[i]):
            if j >= 0:
                current[j] = rank(j)
                if current[j] != NO_RANK:
                    heapq.heappush(queue, (current[j], j))
    return np.array([t for t in tokens if t >= 0], np.int32)


def with_sets(pattern: str, sets: dict[str, str]) -> str:
    """``pattern`` with the shorthands of ``sets`` written out, inside and outside brackets."""

    def spelled(found: re.Match) -> str:
        part = found.group()
        if part == r"\S":
            return f"[^{sets[chr(92) + 's']}]"
        if not part.startswith("["):
            return f"[{sets[part]}]" if part in sets else part
        for short, members in sets.items():
            part = part.replace(short, members)
        return part

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", spelled, pattern)


def latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern over Latin-1 bytes, whose letters, digits and spaces are listed."""
    letters = [chr(c) for c in range(256)]
    sets = {
        short: "".join(c for c in letters if regex.fullmatch(short, c))
        for short in (r"\p{L}", r"\p{N}")
    }
    return re.compile(with_sets(pattern, sets | {r"\s": "\t-\r \x85\xa0"}).encode("latin-1"))


class Encoder:
    """Texts to ids, with the pieces met before at hand.

    Pieces are kept as text, or as Latin-1 bytes where the whole text is Latin-1: cutting is much
    faster there and gives the same pieces.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.known, self.held = vocabulary, {}, 0
        self.one = [np.int32(i).tobytes() for i in range(len(vocabulary.bytes))]
        # White space as Unicode's property has it, as tokenizers do.
        self.pattern = regex.compile(with_sets(pattern, {r"\s": SPACES}))
        self.latin = latin_pattern(pattern)

    def _cut(self, text: str) -> list[str] | list[bytes]:
        try:
            return self.latin.findall(text.encode("latin-1"))
        except UnicodeEncodeError:
            return self.pattern.findall(text)

    def _learn(self, pieces: set) -> None:
        new = list(pieces.difference(self.known))
        if len(self.known) + len(new) > CACHE or self.held > CACHE_BYTES:
            self.known.clear()
            new, self.held = list(pieces), 0
        self.held += 3 * sum(map(len, new))
        ids, open_, open_bytes = self.vocabulary.ids, [], []
        for piece in new:
            raw = piece.encode() if isinstance(piece, str) else piece
            if not raw.isascii() and raw is piece:
                raw = piece.decode("latin-1").encode()
            whole = ids.get(raw)
            if whole is None:
                open_.append(piece)
                open_bytes.append(raw)
            else:
                self.known[piece] = self.one[whole]
        self.known.update(zip(open_, merged(open_bytes, self.vocabulary), strict=True))

    def _ids(self, pieces: list) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text of any length, some pieces at a time."""
        parts, pieces = [], (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(pieces, PIECES)):
            self._learn(set(some))
            parts.append(self._ids(some))
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of several texts, whose new pieces share their matrices."""
        if len(texts) == 1:
            return [self.encode(texts[0])]
        cut = list(map(self._cut, texts))
        self._learn(set(chain.from_iterable(cut)))
        return list(map(self._ids, cut))


def with_column(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _shared(df: DataFrame, ranks_path: str):
    """The rank file, whose size does not depend on the data, as a broadcast."""
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _encoding(shared, pattern: str, text: str, name: str) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value), pattern)
        for batch in batches:
            for part in common.slices(batch, text, TEXT_BYTES):
                ids = encoder.encode_all([t.decode() for t in common.texts_of(part[text])])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield with_column(part, pa.ListArray.from_arrays(ends, values), name)

    return run


def _decoding(shared, ids: str, name: str) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = Vocabulary(shared.value).bytes.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [b"".join(map(token, v.tolist())) for v in id_arrays(part[ids])]
                yield with_column(part, pa.array(found, pa.binary()), name)

    return run


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", name: str = "ids"
) -> DataFrame:
    """All columns of ``docs`` and the ids of ``text``, each match of ``pattern`` by itself."""
    run = _encoding(_shared(docs, ranks_path), pattern, text, name)
    return docs.mapInArrow(common.tidied(run), common.plus(docs, **{name: "array<int>"}))


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the bytes that ``ids`` stand for; null ids give none."""
    run = _decoding(_shared(docs, ranks_path), ids, name)
    return docs.mapInArrow(common.tidied(run), common.plus(docs, **{name: "binary"}))


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")
DIGEST_KINDS = dict(zip(DIGESTS, ("bigint", "string", "string"), strict=True))


def id_arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Ids of each row; null rows have none."""
    values, offsets = column.values, column.offsets.to_pylist()
    for i, valid in enumerate(column.is_valid().to_pylist()):
        yield values[offsets[i] : offsets[i + 1]].to_numpy(False) if valid else np.empty(0, int)


def _digesting(ids: str, decoded: str, keep: tuple[str, ...]) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal: list[bytes] = []
        for batch in batches:
            sizes, hashes = [], []
            for value in id_arrays(batch[ids]):
                if len(value) and value.max() >= len(decimal):
                    decimal = [b"%d" % i for i in range(int(value.max()) + 1)]
                sizes.append(len(value))
                joined = b" ".join(map(decimal.__getitem__, value.tolist()))
                hashes.append(hashlib.sha256(joined).hexdigest())
            whole = [hashlib.sha256(t).hexdigest() for t in common.texts_of(batch[decoded])]
            made = [pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(whole)]
            yield pa.record_batch([batch[c] for c in keep] + made, names=[*keep, *DIGESTS])

    return run


def digests(
    coded: DataFrame, ids: str = "ids", decoded: str = "decoded", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns to ``keep``, ``n_tokens``, and SHA-256 of the decimal ids and of the decoded bytes."""
    run = _digesting(ids, decoded, keep)
    schema = common.plus(coded.select(*keep), **DIGEST_KINDS)
    return coded.select(*dict.fromkeys((*keep, ids, decoded))).mapInArrow(common.tidied(run), schema)


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """:func:`digests` of :func:`decode` of :func:`encode`, in one worker per task.

    ``keep`` may name ``ids``. Each step in a map of its own would hold a worker of its own.
    """
    shared = _shared(docs, ranks_path)
    kept = [c for c in keep if c != "ids"]
    steps = [
        _encoding(shared, pattern, text, "ids"),
        _decoding(shared, "ids", "decoded"),
        _digesting("ids", "decoded", keep),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    rows = docs.select(*dict.fromkeys((*kept, text)))
    kinds = {c: "array<int>" if c == "ids" else docs.schema[c].dataType.simpleString() for c in keep}
    schema = StructType.fromDDL(", ".join(f"`{c}` {kind}" for c, kind in (kinds | DIGEST_KINDS).items()))
    return rows.mapInArrow(common.tidied(run), schema)
