"""Vocabulary, encoding and decoding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn import schema as S
from sojourn.functions.seeded import digest
from sojourn.functions.tokens import text, text_array
from sojourn.operators.distribute import lookup_join, numbered
from sojourn.session import materialise, stored

# Runs of word characters, or runs of other visible characters.
PIECES = r"(?U)\\w+|[^\\w\\s]+"
SPECIALS = [S.UNKNOWN, S.BOS, S.EOS, S.PAD]
# Tokens of a vocabulary that may become part of a plan.
LISTED_TOKENS = 10_000
IS_SPECIAL = f"token IN ({', '.join(repr(t) for t in SPECIALS)})"


def distinct_codes(events: DataFrame) -> DataFrame:
    return events.where("code <> ''").select("code").distinct()


def ordered_fixed_tokens() -> list[str]:
    """The three blocks in front of the codes: gaps, deciles, visit groups, each sorted."""
    blocks = [[*S.GAP_DAYS, S.NO_GAP], S.DECILE_TOKENS, list(S.VISIT_GROUPS)]
    return [token for block in blocks for token in sorted(block)]


def numbered_list(spark: SparkSession, tokens: list[str]) -> DataFrame:
    return spark.sql(
        f"SELECT token, cast(pos as bigint) AS token_id FROM "
        f"(SELECT posexplode({text_array(tokens)}) AS (pos, token))"
    )


def with_special_tokens(words: DataFrame) -> DataFrame:
    """Add the four special tokens behind the ids of a plain vocabulary."""
    behind = words.agg(F.expr("count(*) AS n")).selectExpr(
        "n", f"posexplode({text_array(SPECIALS)}) AS (pos, token)"
    )
    return words.select("token", "token_id").union(behind.selectExpr("token", "n + pos"))


def vocabulary(events: DataFrame, specials: bool = True) -> DataFrame:
    """``token, token_id``: fixed tokens, then the sorted codes, then the special tokens."""
    fixed = ordered_fixed_tokens()
    codes = numbered(distinct_codes(events), "code")
    words = numbered_list(events.sparkSession, fixed).union(
        codes.selectExpr("code", f"row_id + {len(fixed)}")
    )
    return with_special_tokens(words) if specials else words


def special_ids(vocab: DataFrame) -> dict[str, int]:
    return {r["token"]: r["token_id"] for r in vocab.where(IS_SPECIAL).collect()}


def pieces_of(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys, pos, token``: the pieces of a text.

    The outer generator keeps Spark from running the split a second time, in a filter for rows
    without pieces; those are filtered here instead.
    """
    pieces = f"regexp_extract_all({text}, '{PIECES}', 0)"
    exploded = rows.selectExpr(*keys, f"posexplode_outer({pieces}) AS (pos, token)")
    return exploded.where("token IS NOT NULL")


def listed_ids(known: DataFrame, keys: Sequence[str], unknown: int) -> DataFrame:
    """``keys, ids``: the ids of looked-up pieces in order, ``unknown`` for those without one."""
    named = f"struct(pos, coalesce(token_id, {unknown}L) AS id)"
    return known.groupBy(*keys).agg(
        F.expr(f"transform(sort_array(collect_list({named})), e -> e.id) AS ids")
    )


def code_words(events: DataFrame, vocab: DataFrame, unknown: int) -> DataFrame:
    """``code, word_map``: one row per distinct code, from its words to the ids of their pieces.

    A code is one word, unless it holds spaces. A word without pieces has no entry.
    """
    words = distinct_codes(events).selectExpr(
        "code", "explode(array_distinct(split(code, ' '))) AS word"
    )
    pieces = pieces_of(words, ["code", "word"], "word")
    known = lookup_join(pieces, vocab.select("token", "token_id"), "token", "left")
    entries = "map_from_entries(collect_list(struct(word, ids))) AS word_map"
    return listed_ids(known, ["code", "word"], unknown).groupBy("code").agg(F.expr(entries))


def fixed_words(vocab: DataFrame, unknown: int) -> str:
    """Map (SQL) from the tokens that curation writes around codes to their ids.

    Their number is fixed by the schema, and each is a single piece.
    """
    fixed = [*ordered_fixed_tokens(), S.UNMAPPED_VISIT]
    rows = vocab.where(f"array_contains({text_array(fixed)}, token)").collect()
    ids = {r["token"]: r["token_id"] for r in rows}
    entries = (f"{text(t)}, array({ids.get(t, unknown)}L)" for t in fixed)
    return f"map({', '.join(entries)})"


def event_encoder(events: DataFrame, vocab: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds ``word_ids`` to frames of these events: per word of ``event_text`` its pieces' ids.

    Pieces never reach across spaces, so the ids of a sequence are those of its words one after the
    other. The text of an event consists of fixed tokens and its code; the pieces of a code are looked
    up once per distinct code, and events join that list, by broadcast up to the counted limit. No
    single token is ever shuffled.
    """
    unknown = special_ids(vocab)[S.UNKNOWN]
    dictionary = materialise(code_words(events, vocab, unknown))
    fixed = fixed_words(vocab, unknown)
    found = f"coalesce(try_element_at(word_map, w), try_element_at({fixed}, w), array())"
    ids = f"transform(split(event_text, ' '), w -> {found}) AS word_ids"

    def add(frame: DataFrame) -> DataFrame:
        joined = lookup_join(frame, dictionary, "code", "left", computed=True)
        return joined.selectExpr(*frame.columns, ids)

    return add


def finished(
    rows: DataFrame,
    ids: str,
    specials: dict[str, int],
    add_eos: bool = False,
    pad_to: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``columns`` (all) with ``input_ids`` and ``attention_mask`` made of the array ``ids`` (SQL).

    ``add_eos`` appends the end token. ``pad_to`` cuts to that length on the right and pads on the
    left.
    """
    end = f"array({specials[S.EOS]}L)" if add_eos else "array()"
    out = rows.withColumn("_ids", F.expr(f"concat(coalesce({ids}, array()), {end})"))
    if pad_to is None:
        made = ["_ids AS input_ids", "array_repeat(1, size(_ids)) AS attention_mask"]
    else:
        pad, missing = specials[S.PAD], f"greatest({pad_to} - size(_ids), 0)"
        made = [
            f"concat(array_repeat({pad}L, {missing}), slice(_ids, 1, {pad_to})) AS input_ids",
            f"concat(array_repeat(0, {missing}), array_repeat(1, {pad_to} - {missing})) "
            "AS attention_mask",
        ]
    return out.selectExpr(*(columns or rows.columns), *made)


def encode(
    rows: DataFrame,
    vocab: DataFrame,
    keys: tuple[str, ...] = ("subject_id",),
    text: str = "text",
    add_eos: bool = False,
    pad_to: int | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask`` to any texts, as :func:`finished` makes them.

    For texts whose events are at hand, :func:`event_encoder` needs no token rows. ``keys`` identify
    a row. Only keys and single tokens are exploded for the lookup, not
    the texts; the rows, read for both, are stored first. ``keep_text=False`` drops the text and
    the keys.
    """
    ids = special_ids(vocab)
    rows = stored(rows)
    exploded = pieces_of(rows, keys, text)
    known = lookup_join(exploded, vocab.select("token", "token_id"), "token", "left")
    encoded = listed_ids(known, keys, ids[S.UNKNOWN]).withColumnRenamed("ids", "_found")
    out = rows.join(encoded, list(keys), "left")
    out = finished(out, "_found", ids, add_eos, pad_to, rows.columns)
    return out if keep_text else out.drop(text, *keys)


def token_list(vocab: DataFrame) -> str | None:
    """Array (SQL) of the tokens by id, null for special ones; None if ids have gaps or are many."""
    found = vocab.select("token", "token_id").limit(LISTED_TOKENS + 1).collect()
    tokens = {r["token_id"]: r["token"] for r in found}
    if len(found) > LISTED_TOKENS or set(tokens) != set(range(len(found))):
        return None
    hidden = (None, *SPECIALS)
    shown = (tokens[i] for i in range(len(found)))
    return f"array({', '.join('NULL' if t in hidden else text(t) for t in shown)})"


def decode(
    rows: DataFrame, vocab: DataFrame, keys: tuple[str, ...] = ("subject_id",), ids: str = "input_ids"
) -> DataFrame:
    """``keys, text``: token texts in order without special tokens.

    ``keys`` identify a row; rows without ids are left out. With up to ``LISTED_TOKENS`` tokens,
    numbered without gaps, ids are replaced where they lie, so that no token becomes a row. Other
    vocabularies are joined to the exploded ids.
    """
    listed = token_list(vocab)
    if listed is not None:
        shown = f"transform({ids}, x -> get({listed}, try_cast(x as int)))"
        return rows.where(f"size({ids}) > 0").selectExpr(*keys, f"array_join({shown}, ' ') AS text")
    exploded = rows.selectExpr(*keys, f"posexplode({ids}) AS (pos, token_id)")
    named = lookup_join(exploded, vocab.select("token", "token_id"), "token_id", "left")
    listed = f"sort_array(collect_list(IF({IS_SPECIAL}, NULL, struct(pos, token))))"
    return named.groupBy(*keys).agg(
        F.expr(f"array_join(transform({listed}, e -> e.token), ' ') AS text")
    )


def unknown_tokens(
    rows: DataFrame, vocab: DataFrame, key: str = "subject_id", text: str = "text"
) -> DataFrame:
    """``key, token, n``: tokens of each text that the vocabulary lacks."""
    counted = pieces_of(rows, [key], text).groupBy(key, "token").agg(F.expr("count(*) AS n"))
    known = vocab.where(f"token <> '{S.UNKNOWN}'").select("token")
    return lookup_join(counted, known, "token", "left_anti")


def last_tokens(ids: str, n: int = S.WINDOW_TOKENS) -> str:
    """The last ``n`` ids (SQL)."""
    return f"slice({ids}, greatest(size({ids}) - {n} + 1, 1), {n})"


def training_examples(
    rows: DataFrame, seq_len: int = 1024, shuffle_seed=None, key: str = "subject_id"
) -> DataFrame:
    """``row_id, input_ids`` cut to ``seq_len``, numbered in key order or in seeded order."""
    if shuffle_seed is None:
        ordered = numbered(rows, key)
    else:
        drawn = rows.withColumn("_d", F.expr(digest(shuffle_seed, key)))
        ordered = numbered(drawn, "_d")
    return ordered.selectExpr("row_id", f"slice(input_ids, 1, {seq_len}) AS input_ids")


def _in_batches(rows: DataFrame, batch_size: int) -> DataFrame:
    """Add ``batch_id`` and how many ids the row lacks to the longest of its batch."""
    longest = "max(size(input_ids)) OVER (PARTITION BY batch_id)"
    return rows.withColumn("batch_id", F.expr(f"row_id div {batch_size}")).withColumn(
        "missing", F.expr(f"{longest} - size(input_ids)")
    )


def shifted_batches(examples: DataFrame, batch_size: int, pad_id: int) -> DataFrame:
    """Right-padded batches whose labels are the next token; -100 where there is none."""
    tail = "slice(input_ids, 2, greatest(size(input_ids), 1))"
    return _in_batches(examples, batch_size).selectExpr(
        "batch_id",
        "row_id",
        f"concat(input_ids, array_repeat({pad_id}L, missing)) AS input_ids",
        f"concat({tail}, array_repeat({S.IGNORED_LABEL}L, missing + 1)) AS labels",
    )


def causal_batches(
    rows: DataFrame,
    batch_size: int,
    pad_id: int,
    side: str = "left",
    kept: tuple[str, ...] = ("subject_id",),
) -> DataFrame:
    """Batches padded on ``side`` with labels equal to the ids, -100 on every pad id.

    ``rows`` has ``row_id``; the ``kept`` columns pass through.
    """
    if side not in ("left", "right"):
        raise ValueError(f"unknown padding side: {side}")

    def padded(values: str, fill: str) -> str:
        pads = f"array_repeat({fill}, missing)"
        return f"concat({pads}, {values})" if side == "left" else f"concat({values}, {pads})"

    return (
        _in_batches(rows, batch_size)
        .selectExpr(
            "batch_id",
            "row_id",
            *kept,
            f"{padded('array_repeat(1, size(input_ids))', '0')} AS attention_mask",
            f"{padded('input_ids', f'{pad_id}L')} AS input_ids",
        )
        .withColumn(
            "labels",
            F.expr(f"transform(input_ids, x -> IF(x = {pad_id}, {S.IGNORED_LABEL}L, x))"),
        )
    )
