"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base kinds - email, ip, card, phone - are found by fixed rules in every whole text. A semi-Markov
CRF adds spans that the rules miss, such as spelled-out addresses or numbers without a plus sign.
It scores whole candidate segments of up to seven tokens by features of the span (its shape, digits,
digit groups, checks, and neighbours) and one dynamic program chooses boundaries and kinds together.
It looks at stretches around tokens that could begin or end such a span.

The CRF is fitted by gradient steps on the likelihood of at most ``limit`` stretches, a seeded
sample over all documents. What the rules found there is the truth, and rewritten copies (spelled
out, regrouped) stand for what they miss. An added span never overlaps a base span.

Offsets count code points, ends are exclusive. Null text counts as empty. Without any stretch to
learn from, nothing is added.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sojourn.llm import common

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
TOKENS = 7  # of one segment at most
FEATURE_BITS = 14
LIMIT = 600
EPOCHS = 5
RATE = 0.3
# How much better than plain text a segment must be, in log odds.
MARGIN = 3.0
CONTEXT = 4  # tokens on either side of a stretch

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


# ---- base rules ----------------------------------------------------------------------------------


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign back over the local part and on over the domain: linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        else:
            free = at + 1 if start < at else free
        at = text.find("@", max(at + 1, free if domain else at + 1))
    return found


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def small_parts(address: str) -> bool:
    parts = [p.lstrip("0") for p in address.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def digits_of(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if small_parts(m.group()):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append((3, *m.span()))
    return found


# ---- stretches and their segments ----------------------------------------------------------------

WORD = re.compile(r"\S+")
AT_SIGN = re.compile(r"@|[\[(]at[\])]|(?<=\s)at(?=\s+\S+\s+dot\s)", re.I)
DIGITS = re.compile(r"[0-9](?:[^0-9\n]{0,4}[0-9]){6,}")
OPENERS, CLOSERS = "\"'<[{,;:", "\"'>]},;:.!?"


def stretches(text: str) -> list[tuple[int, int]]:
    """Character ranges, on token borders, around at signs and runs of seven or more digits."""
    spots = [m.span() for m in DIGITS.finditer(text)]
    if "@" in text or "at" in text:
        spots += [m.span() for m in AT_SIGN.finditer(text)]
    spots.sort()
    ranges: list[list[int]] = []
    for start, end in spots:
        left, right = start, end
        for _ in range(CONTEXT + 1):
            while left > 0 and text[left - 1].isspace():
                left -= 1
            while left > 0 and not text[left - 1].isspace():
                left -= 1
            while right < len(text) and text[right].isspace():
                right += 1
            while right < len(text) and not text[right].isspace():
                right += 1
        if ranges and left <= ranges[-1][1]:
            ranges[-1][1] = max(right, ranges[-1][1])
        else:
            ranges.append([left, right])
    return [(a, b) for a, b in ranges]


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text)]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in OPENERS:
        start += 1
    while end > start and (text[end - 1] in CLOSERS or text[end - 1] == ")" and "(" not in text[start:end]):
        end -= 1
    return start, end


SHAPES = ((re.compile(r"[0-9]+"), "0"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\s+"), " "))


def shape(span: str) -> str:
    for pattern, sign in SHAPES:
        span = pattern.sub(sign, span)
    return span[:28]


def features(text: str, tokens: list[tuple[int, int]], i: int, n: int) -> list[int]:
    """Hashed features of the segment of ``n`` tokens from the ``i``-th; as many for each."""
    start, end = trimmed(text, tokens[i][0], tokens[i + n - 1][1])
    span = text[start:end]
    digits = digits_of(span)
    groups = "-".join(str(min(len(g), 20)) for g in re.findall(r"[0-9]+", span)[:8])
    lower = span.lower()
    before = shape(text[slice(*tokens[i - 1])]) if i else "^"
    after = shape(text[slice(*tokens[i + n])]) if i + n < len(tokens) else "$"
    told = (
        f"shape {shape(span)}",
        f"digits {min(len(digits), 20)}",
        f"groups {groups}",
        f"tokens {n}",
        f"at {min(span.count('@'), 2)}",
        f"spelled {' at ' in lower or '[at]' in lower or '(at)' in lower} {'dot' in lower}",
        f"dots {min(span.count('.'), 4)} {len(digits) > 0}",
        f"ip {bool(IP.fullmatch(span)) and small_parts(span)}",
        f"card {13 <= len(digits) <= 19 and luhn(digits)}",
        f"plus {span[:1] == '+'} {min(len(digits), 16) // 3}",
        f"only {bool(re.fullmatch(r'[0-9 ().+-]+', span))} {min(len(digits), 20)}",
        f"around {before[:6]} {after[:6]} {n}",
        "bias",
    )
    return [zlib.crc32(t.encode()) >> (32 - FEATURE_BITS) for t in told]


class SemiMarkov:
    """Weights of segment features by kind, and of kinds in a row."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        kinds = OTHER + 1
        self.weights = np.zeros((kinds, 1 << FEATURE_BITS)) if weights is None else weights
        self.steps = np.zeros((kinds, kinds)) if steps is None else steps
        self.seen, self.stepped = np.ones_like(self.weights), np.ones_like(self.steps)

    def scored(self, text: str, tokens: list[tuple[int, int]]):
        """Features and scores of all segments by start and number of tokens."""
        spots, rows = {}, []
        for i in range(len(tokens)):
            for n in range(1, min(TOKENS, len(tokens) - i) + 1):
                spots[i, n] = len(rows)
                rows.append(features(text, tokens, i, n))
        index = np.array(rows)
        scores = self.weights[:, index].sum(axis=2).T
        for (_, n), row in spots.items():
            if n > 1:
                scores[row, OTHER] = -np.inf  # plain text goes token by token
        return spots, index, scores

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """``kind, first token, tokens`` of the best segmentation that beat plain text by far."""
        spots, _, scores = self.scored(text, tokens)
        n = len(tokens)
        value = np.full((n + 1, OTHER + 1), -np.inf)
        value[0, OTHER] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for end in range(1, n + 1):
            for size in range(1, min(TOKENS, end) + 1):
                into = value[end - size][:, None] + self.steps
                from_kind = into.argmax(axis=0)
                total = into.max(axis=0) + scores[spots[end - size, size]]
                for kind in np.flatnonzero(total > value[end]).tolist():
                    value[end, kind] = total[kind]
                    back[end, kind] = (size, int(from_kind[kind]))
        path, end, kind = [], n, int(value[n].argmax())
        while end:
            size, last = back[end, kind]
            if kind != OTHER:
                plain = sum(scores[spots[end - size + k, 1], OTHER] for k in range(size))
                if scores[spots[end - size, size], kind] - plain >= MARGIN:
                    path.append((kind, end - size, size))
            end, kind = end - size, last
        return path[::-1]

    def learn(self, text: str, tokens: list[tuple[int, int]], truth: list[tuple[int, int, int]]):
        """One step up the likelihood of ``truth`` (kind, first token, tokens), plain text between."""
        spots, index, scores = self.scored(text, tokens)
        n, kinds = len(tokens), OTHER + 1
        ahead = np.full((n + 1, kinds), -np.inf)
        ahead[0, OTHER] = 0
        entered = np.full((n, kinds), -np.inf)
        for end in range(n):
            entered[end] = np.logaddexp.reduce(ahead[end][:, None] + self.steps, axis=0)
            for size in range(1, min(TOKENS, n - end) + 1):
                ahead[end + size] = np.logaddexp(
                    ahead[end + size], entered[end] + scores[spots[end, size]]
                )
        rest = np.full((n + 1, kinds), -np.inf)
        rest[n] = 0
        leaving = np.full((n, kinds), -np.inf)  # all that can follow when a kind starts here
        for start in range(n - 1, -1, -1):
            for size in range(1, min(TOKENS, n - start) + 1):
                leaving[start] = np.logaddexp(
                    leaving[start], scores[spots[start, size]] + rest[start + size]
                )
            rest[start] = np.logaddexp.reduce(self.steps + leaving[start][None, :], axis=1)
        whole = np.logaddexp.reduce(ahead[n])
        expected = np.zeros((len(index), kinds))
        for (start, size), row in spots.items():
            expected[row] = np.exp(entered[start] + scores[row] + rest[start + size] - whole)
        step_by = np.zeros((kinds, kinds))
        for start in range(n):
            step_by += np.exp(ahead[start][:, None] + self.steps + leaving[start][None, :] - whole)
        last, at = OTHER, 0
        for kind, first, size in [*truth, (None, n, 0)]:
            while at < first:
                expected[spots[at, 1], OTHER] -= 1
                step_by[last, OTHER] -= 1
                last, at = OTHER, at + 1
            if kind is not None:
                expected[spots[first, size], kind] -= 1
                step_by[last, kind] -= 1
                last, at = kind, first + size
        slope = np.zeros_like(self.weights)
        used = np.abs(expected).max(axis=1) > 1e-4
        for kind in range(kinds):
            np.add.at(slope[kind], index[used].ravel(), np.repeat(expected[used, kind], index.shape[1]))
        columns = np.unique(index[used])
        slope = slope[:, columns]
        self.seen[:, columns] += slope**2
        self.weights[:, columns] -= RATE * slope / np.sqrt(self.seen[:, columns])
        self.stepped += step_by**2
        self.steps -= RATE * step_by / np.sqrt(self.stepped)


def as_segments(text: str, tokens, spans) -> list[tuple[int, int, int]] | None:
    """Spans as kind, first token, tokens; None if tokens cannot tell them apart."""
    found, free = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        inside = [k for k, (a, b) in enumerate(tokens) if a < end and b > start]
        if not inside or inside[0] < free or len(inside) > TOKENS:
            return None
        found.append((kind, inside[0], len(inside)))
        free = inside[-1] + 1
    return found


def rewritten(text: str, spans: list[tuple[int, int, int]], turn: int):
    """The stretch with its spans in a form that the rules miss, and the spans' new places."""
    out, moved, at = "", [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        span = text[start:end]
        if kind == 0:
            user, _, host = span.partition("@")
            forms = ((" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."))
            sign, dot = forms[turn % 4]
            span = user + sign + host.replace(".", dot)
        elif kind == 3:
            groups = re.findall(r"[0-9]+", span)
            own = groups[1:] if len(groups) > 3 else groups
            joiner = ("-", ".", " ", "-")[turn % 4]
            span = joiner.join(own)
            if turn % 4 == 3 and len(own) > 2:
                span = f"({own[0]}) " + "-".join(own[1:])
        elif kind == 2 and turn % 2:
            digits = digits_of(span)
            span = ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
        out += text[at:start]
        moved.append((kind, len(out), len(out) + len(span)))
        out += span
        at = end
    return out + text[at:], moved


# ---- Spark jobs ----------------------------------------------------------------------------------


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in common.texts_of(batch["text"]):
            text = text.decode()
            for start, end in stretches(text):
                if end - start <= 400:
                    found.append(text[start:end])
        draws = [zlib.crc32(s.encode()) for s in found]
        yield pa.record_batch({"stretch": pa.array(found, pa.string()), "draw": pa.array(draws, pa.int64())})


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample is bounded by its parameter, so one task holds it."""
    known = [s for batch in batches for s in batch["stretch"].to_pylist()]
    model, cases = SemiMarkov(), []
    for turn, text in enumerate(known):
        spans = base_spans(text)
        forms = [(text, spans)] + ([rewritten(text, spans, turn)] if spans else [])
        for form, places in forms:
            tokens = tokens_of(form)
            truth = as_segments(form, tokens, places)
            if tokens and truth is not None:
                cases.append((form, tokens, truth))
    for _ in range(EPOCHS):
        for case in cases:
            model.learn(*case)
    kind, place = np.nonzero(model.weights)
    rows, columns = np.indices(model.steps.shape)
    yield pa.record_batch(
        {
            "kind": pa.array(np.concatenate((kind, rows.ravel())).astype(np.int32)),
            "place": pa.array(np.concatenate((place, -1 - columns.ravel())).astype(np.int32)),
            "weight": pa.array(np.concatenate((model.weights[kind, place], model.steps.ravel()))),
        }
    )


def fit(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``kind, place, weight``: feature weights; steps between kinds have negative places."""
    sample = docs.select("text").mapInArrow(common.tidied(_sampled), "stretch string, draw bigint")
    sample = sample.distinct().orderBy("draw", "stretch").limit(limit)
    sample = sample.repartition(1).sortWithinPartitions("draw", "stretch")
    return sample.mapInArrow(common.tidied(_fitted), "kind int, place int, weight double")


def loaded(weights: pa.Table) -> SemiMarkov:
    model = SemiMarkov()
    kind, place, weight = (weights[n].to_numpy() for n in ("kind", "place", "weight"))
    step = place < 0
    model.weights[kind[~step], place[~step]] = weight[~step]
    model.steps[kind[step], -1 - place[step]] = weight[step]
    return model


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov):
    """What the CRF finds beside the base spans."""
    found = []
    for start, end in stretches(text):
        part = text[start:end]
        tokens = tokens_of(part)
        for kind, first, size in model.best(part, tokens):
            a, b = trimmed(part, tokens[first][0], tokens[first + size - 1][1])
            a, b = a + start, b + start
            if a < b and not any(a < y and x < b for _, x, y in base):
                found.append((kind, a, b))
    return found


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find(docs: DataFrame, model: DataFrame, base: str = "base", added: str = "added") -> DataFrame:
    """All columns of ``docs``, the base spans and the spans that the CRF adds, by kind and start."""
    table = model.toArrow()  # at most 5 * 2^14 rows and 25 steps
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def listed(spans) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = loaded(shared.value)
        for batch in batches:
            first, more = [], []
            for text in common.texts_of(batch["text"]):
                text = text.decode()
                spans = base_spans(text)
                first.append(listed(spans))
                more.append(listed(added_spans(text, spans, crf)))
            columns = [pa.array(x, pa.list_(SPAN)) for x in (first, more)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, base, added]
            )

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.mapInArrow(common.tidied(run), common.plus(docs, **{base: kind, added: kind}))


def masked(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap become one."""
    shared = docs.sparkSession.sparkContext.broadcast(model.toArrow())
    own, at = docs.columns, docs.columns.index("text")

    def clean(text: str | None, crf: SemiMarkov) -> str | None:
        base = base_spans(text or "")
        spans = sorted(base + added_spans(text or "", base, crf), key=lambda s: (s[1], -s[2]))
        out, free = [], 0
        for kind, start, end in spans:
            if start >= free:
                out += [text[free:start], f"[{KINDS[kind].upper()}]"]
            free = max(free, end)
        return "".join([*out, text[free:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = loaded(shared.value)
        for batch in batches:
            columns = list(batch.columns)
            texts = [clean(t.as_py(), crf) for t in batch["text"]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=own)

    return docs.mapInArrow(common.tidied(run), docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    ranked = "transform(concat(base, added), s -> struct(array_position(array('email', 'ip', 'card', "
    ranked += "'phone'), s.kind) AS turn, s.start AS start, s.end AS end, s.kind AS kind))"
    counts = [f"bigint(size(filter(base, s -> s.kind = '{k}'))) AS n_{k}" for k in KINDS]
    return found.selectExpr(
        "doc_id",
        *counts,
        f"sha2({joined.format('base')}, 256) AS base_sha256",
        f"{joined.format(f'array_sort({ranked})')} AS spans",
    )


def personal_data(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    return digests(find(rows, fit(rows)).drop("text"))
