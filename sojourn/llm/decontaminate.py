"""Benchmark decontamination with a positional inverted index, DataFrame operations only.

Index. Every training text is read once. Each of its words that the test set knows becomes a posting
``(t, doc, pos)``: term, digest of the text, position. Postings are written where their text was
read and sorted by term there, so every file is an inverted index of its own texts, the postings of
a frequent word lie spread over all files, and a lookup reads the pages of its terms. Term 0 is
the end of a text; its position is the number of words.

Exact phrases. The terms of a phrase are ordered by their number of postings. Each posting of the
rarest one, moved back by the term's offset, is a candidate start. Candidates meet the postings of
the second rarest term under its offset; of those left, all other terms are looked up in the
texts that still have a candidate. Every join is on (term, text, position), a key of one posting, so
neither a hot word nor a hot text gathers in a task.

Proximity. Around each posting of a query's rarest term, the postings of its other terms within reach
are gathered, and the shortest stretch that holds all of them is kept if it is short enough.

Words are maximal runs of digits, ASCII letters and all characters beyond ASCII, with A-Z
lower-cased. Texts are told apart by their MD5, so copies are looked up once and rows that repeat
an id keep a result each. Null is empty; an empty text has no words. Test rows without words
are never found; a test row without id is found but not counted. An empty test set or
an empty table of texts gives no matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.operators.distribute import lookup_join
from sojourn.session import materialise, stored

WINDOW = 10
# What stands between words, before lower-casing.
BETWEEN = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
# Bytes of test words up to which they are broadcast, if they are also few enough.
BROADCAST_BYTES = 64 << 20


def split_words(text: str) -> str:
    """The words of a text, not yet lower-cased (SQL)."""
    return f"array_remove(split(coalesce({text}, ''), '{BETWEEN}'), '')"


def tokens(rows: DataFrame, *kept: str, text: str = "text") -> DataFrame:
    """``kept, pos, term``: the words of each text in order, and an empty term at its end."""
    found = f"array_append({split_words(text)}, '')"
    exploded = rows.selectExpr(*kept, f"posexplode_outer({found}) AS (pos, term)")
    return exploded.selectExpr(*kept, "pos", f"{common.lowered('term')} AS term")


def numbered_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``seq, item_id, words``: the distinct word sequences of a test set, numbered, with the id of
    each row that has them. Stored, since the numbers must not change."""
    found = f"transform({split_words(text)}, w -> {common.lowered('w')})"
    words = items.selectExpr(f"{item_id} AS item_id", f"{found} AS words")
    words = stored(words.where("size(words) > 0"))
    seqs = words.select("words").distinct().withColumn("seq", F.monotonically_increasing_id())
    return stored(words.join(stored(seqs), "words").select("seq", "item_id", "words"))


def vocabulary(asked: DataFrame) -> DataFrame:
    """``term, t``: the distinct words of test items, numbered from 1, and the end of a text, 0."""
    terms = asked.selectExpr("explode(array_distinct(words)) AS term").distinct()
    numbers = terms.selectExpr("term", "monotonically_increasing_id() + 1 AS t")
    end = asked.sparkSession.sql("SELECT '' AS term, 0L AS t")
    return stored(numbers.unionByName(end))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings ``t, doc, pos, doc_id`` of the given terms; ``doc_id`` only at term 0."""
    rows = docs.selectExpr("doc_id", "text", "md5(coalesce(text, '')) AS doc")
    size = terms.selectExpr("sum(octet_length(term)) AS n").first()["n"]
    most = common.BROADCAST_ROWS if size <= BROADCAST_BYTES else 0
    known = lookup_join(tokens(rows, "doc_id", "doc"), terms, "term", "inner", most, computed=True)
    made = known.selectExpr("t", "doc", "pos", "IF(t = 0, doc_id, NULL) AS doc_id")
    return stored(made.sortWithinPartitions("t"))


def rarity(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, t, tf``: how often each term stands in the texts, 0 if never."""
    counts = postings.groupBy("t").agg(F.expr("count(*) AS tf"))
    return materialise(terms.join(counts, "t", "left").selectExpr("term", "t", "coalesce(tf, 0L) AS tf"))


def _lookup_words(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """``rows`` with ``words`` replaced by ``terms``, an array of ``(o, t, tf)`` in order."""
    one = rows.selectExpr("*", "posexplode(words) AS (o, term)").drop("words")
    keys = [c for c in rows.columns if c != "words"]
    named = lookup_join(one, rare, "term", "inner", common.BROADCAST_ROWS, computed=True)
    listed = "sort_array(collect_list(struct(o, t, tf))) AS terms"
    return named.groupBy(*keys).agg(F.expr(listed))


def windows(asked: DataFrame, rare: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of test items, and ``win, item_id``.

    A window is ``win, size, t1, o1, t2, o2, rest``: the offsets of its rarest and second rarest term
    and ``(o, t)`` of all others. A window with a word that no text has is left out. Shorter items
    are a window as a whole.
    """
    seqs = asked.select("seq", "words").dropDuplicates(["seq"])
    starts = f"sequence(1, greatest(size(words) - {width} + 1, 1))"
    cut = seqs.selectExpr("seq", f"explode(transform({starts}, s -> slice(words, s, {width}))) AS words")
    cut = cut.distinct()
    distinct = cut.select("words").distinct().withColumn("win", F.monotonically_increasing_id())
    distinct = stored(distinct)
    members = cut.join(distinct, "words").select("win", "seq")
    members = stored(members.join(asked.select("seq", "item_id"), "seq").select("win", "item_id"))
    ranked = _lookup_words(distinct, rare).selectExpr(
        "win",
        "size(terms) AS size",
        "array_sort(transform(terms, e -> struct(e.tf, e.o, e.t))) AS r",
    )
    found = ranked.where("r[0].tf > 0").selectExpr(
        "win",
        "size",
        "r[0].t AS t1",
        "r[0].o AS o1",
        "get(r, 1).t AS t2",
        "get(r, 1).o AS o2",
        "transform(slice(r, 3, greatest(size(r), 1)), e -> struct(e.o, e.t)) AS rest",
    )
    return stored(found), members.distinct()


def _at(postings: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The distinct ``t, doc, pos`` whose ``key`` is one of ``wanted``."""
    some = lookup_join(
        postings.where("t > 0").select("t", "doc", "pos"), wanted, key, "left_semi", common.BROADCAST_ROWS
    )
    return some.distinct()


def phrase_matches(postings: DataFrame, wins: DataFrame) -> DataFrame:
    """``doc, start, win, size``: every place in a text where a window stands word for word. Stored."""
    first = _at(postings, wins.selectExpr("t1 AS t").distinct(), "t")
    asked = wins.selectExpr("t1 AS t", "win", "size", "o1", "t2", "o2")
    starts = lookup_join(first, asked, "t", "inner", common.BROADCAST_ROWS, computed=True)
    starts = starts.selectExpr("doc", "pos - o1 AS start", "win", "size", "t2 AS t", "pos - o1 + o2 AS pos")
    starts = starts.where("start >= 0")
    second = _at(postings, wins.selectExpr("t2 AS t").where("t IS NOT NULL").distinct(), "t")
    kept = ["doc", "start", "win", "size"]
    both = starts.where("t IS NOT NULL").join(second, ["t", "doc", "pos"]).select(*kept)
    left = stored(both.unionByName(starts.where("t IS NULL").select(*kept)))
    whole = left.where("size <= 2")
    rest = wins.where("size > 2").select("win", "rest")
    others = lookup_join(left.where("size > 2"), rest, "win", "inner", common.BROADCAST_ROWS, computed=True)
    others = others.selectExpr(*kept, "inline(rest) AS (o, t)").selectExpr(*kept, "t", "start + o AS pos")
    there = _at(postings, left.where("size > 2").select("doc").distinct(), "doc")
    counted = others.join(there, ["t", "doc", "pos"]).groupBy(*kept).agg(F.expr("count(*) AS n"))
    return stored(whole.unionByName(counted.where("n = size - 2").drop("n")))


def proximity_matches(
    postings: DataFrame, rare: DataFrame, queries: DataFrame, within: int = 20
) -> DataFrame:
    """``query_id, doc, start, length``: stretches of at most ``within`` words that hold all distinct
    words of a query, in any order; for each place of its rarest word the shortest, then the first.

    ``queries`` has ``query_id, words``. A query with a word that no text has, or without words, is
    never found. The gathered postings of a place are at most ``2 * within - 1`` positions.
    """
    asked = queries.selectExpr("query_id", "array_distinct(words) AS words")
    numbered = stored(_lookup_words(asked, rare).where("forall(terms, e -> e.tf > 0)"))
    numbered = numbered.selectExpr(
        "query_id",
        "size(terms) AS k",
        "array_min(transform(terms, e -> struct(e.tf, e.t))).t AS pivot",
        "transform(terms, e -> e.t) AS all",
    )
    numbered = materialise(numbered)
    first = _at(postings, numbered.selectExpr("pivot AS t").distinct(), "t").withColumnRenamed("pos", "at")
    pivots = numbered.selectExpr("pivot AS t", "query_id", "k", "all")
    anchors = lookup_join(first, pivots, "t", "inner", common.BROADCAST_ROWS, computed=True)
    # Positions meet in blocks of ``within`` words: an anchor looks into its own and both next to it.
    block = f"explode(array(at div {within} - 1, at div {within}, at div {within} + 1)) AS block"
    wanted = anchors.selectExpr("query_id", "doc", "at", "k", "explode(all) AS t", "all")
    wanted = wanted.select("query_id", "doc", "at", "k", "t").selectExpr("*", block)
    terms = numbered.selectExpr("explode(all) AS t").distinct()
    others = _at(postings, terms, "t").selectExpr("t", "doc", "pos", f"pos div {within} AS block")
    near = wanted.join(others, ["t", "doc", "block"]).where(f"abs(pos - at) < {within}")
    gathered = near.groupBy("query_id", "doc", "at", "k").agg(
        F.expr("array_sort(collect_list(struct(pos, t))) AS found")
    )
    # From each first position, the nearest last position that completes the terms.
    reach = "transform({side}, y -> y.t)"
    upto = "filter(found, y -> y.pos >= x.pos AND y.pos <= z.pos)"
    ends = (
        "filter(found, z -> z.pos >= x.pos AND x.pos <= at AND z.pos >= at AND "
        f"size(array_distinct({reach.format(side=upto)})) = k)"
    )
    spans = f"transform(found, x -> struct(array_min({ends}).pos - x.pos + 1 AS length, x.pos AS start))"
    best = gathered.selectExpr(
        "query_id", "doc", f"array_min(filter({spans}, s -> s.length IS NOT NULL)) AS s"
    )
    found = best.where(f"s.length <= {within}")
    return found.selectExpr("query_id", "doc", "s.start", "s.length").distinct()


def contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row per text row.

    ``n_hit`` counts the words inside any window of a test item, ``n_items`` the items that have
    such a window in the text.
    """
    asked = numbered_items(items)
    terms = vocabulary(asked)
    postings = index(docs, terms)
    wins, members = windows(asked, rarity(postings, terms), width)
    found = phrase_matches(postings, wins)
    places = found.selectExpr("doc", "explode(sequence(start, start + size - 1)) AS pos").distinct()
    hits = places.groupBy("doc").agg(F.expr("count(*) AS n_hit"))
    of_doc = found.select("doc", "win").distinct().join(members, "win")
    ids = "array_sort(collect_set(cast(item_id as string)))"
    named = of_doc.groupBy("doc").agg(F.expr(f"{ids} AS ids"))
    named = named.selectExpr("doc", "cast(size(ids) as bigint) AS n_items", "sha2(array_join(ids, ','), 256) AS sha")
    each = hits.join(named, "doc")
    ends = postings.where("t = 0").selectExpr("doc_id", "doc", "cast(pos as bigint) AS n_words")
    return lookup_join(ends, each, "doc", "left", common.BROADCAST_ROWS).selectExpr(
        "doc_id",
        "n_words",
        "coalesce(n_hit, 0L) AS n_hit",
        "coalesce(n_items, 0L) AS n_items",
        "coalesce(sha, sha2('', 256)) AS items_sha256",
        "n_hit IS NOT NULL AS contaminated",
    )
