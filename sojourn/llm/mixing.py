"""Mixing sources to target weights, with DataFrame operations only.

Targets. Each source wants its share of all words; no target exceeds ``most`` times the source, and
what is cut off goes to the others by weight until none is above.

Draws. A source's documents stand in a seeded random order, cut into blocks. The mix takes whole
passes over the source and, of one more pass, the documents of the order up to the target, to the
nearest document. A pass takes each document once, so none comes more than ``most`` times.

Splitting tree. The output has shards of equally many blocks. From the root, which holds every
source's quota of blocks, each node deals its quotas to a left and a right half of its shards by one
multivariate-hypergeometric draw, source after source, so quotas stay exact at every level. The
quotas of the leaves cut each source's permuted blocks into disjoint stretches. Within a shard, the
documents are shuffled locally by a seeded key.

Null text has size 0, null is a source of its own, and empty sources have target 0. Documents are
told apart by position, so repeated ids are documents of their own; rows without id are mixed too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.operators.distribute import lookup_join
from sojourn.session import materialise, stored

MOST = 3
SHARDS = 16  # at least; more when a shard would get more than SHARD_BLOCKS blocks
SHARD_BLOCKS = 64
BLOCK_DOCS = 1000
SEED = 11
DRAW = f"xxhash64({SEED}L, doc_id, text)"
# A block of a source as one key.
RANKED = "concat(rank, ':', s)"
WORDS = r"[^\\x20\\x09-\\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, s, size, draw``: the draw orders a source's documents at random; ``s`` is
    the source as a key that is never null."""
    return docs.selectExpr(
        "doc_id",
        "source",
        "IF(source IS NULL, '0', concat('1', source)) AS s",
        f"coalesce(cast(regexp_count(text, '{WORDS}') as bigint), 0L) AS size",
        f"{DRAW} AS draw",
    )


def targets(rows: DataFrame, most: int = MOST) -> DataFrame:
    """``s, weight, source_size, docs, target``: one row per source.

    Sources fill up in the order of size by weight: once the smallest of them do not reach their cap
    at the common level, none after them does. Only the sources' totals meet in one task.
    """
    totals = rows.groupBy("s").agg(
        F.expr("min(source) AS source"),
        F.expr("sum(size) AS source_size"),
        F.expr("count(*) AS docs"),
    )
    weighed = totals.selectExpr(
        "*",
        "double(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) AS weight",
        "double(sum(source_size) OVER ()) AS total",
    )
    order = "OVER (ORDER BY source_size / weight, source IS NULL, source "
    before = order + "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    onward = order + "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    level = weighed.selectExpr(
        "*",
        f"(total - {most} * coalesce(double(sum(source_size) {before}), 0D)) / "
        f"sum(weight) {onward} AS level",
        "row_number() OVER (ORDER BY source_size / weight, source IS NULL, source) AS turn",
    )
    # The level of the first source that stays under its cap holds for all after it.
    open_ = f"{most} * source_size > level * weight"
    return level.selectExpr(
        "*", f"(min(IF({open_}, struct(turn, level), NULL)) OVER ()).level AS common"
    ).selectExpr(
        "s",
        "weight",
        "source_size",
        "docs",
        f"IF(common IS NULL, double({most} * source_size), "
        f"least(double({most} * source_size), common * weight)) AS target",
    )


def drawn(docs: DataFrame, most: int = MOST, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Every document with its block and how often the mix takes it.

    ``doc_id, source, size, draw, block, blocks, source_size, target, full, extra``: ``full`` whole
    passes, and ``extra`` is 1 for the documents that the last pass takes as well. Blocks are equal
    slices of the range of the draw. Only the block that the target falls into is looked at
    document by document.
    """
    rows = stored(sized(docs))
    goals = targets(rows, most).selectExpr(
        "s",
        "source_size",
        "target",
        f"greatest(1L, bigint(ceil(docs / {block_docs}))) AS blocks",
        "IF(source_size = 0, 0L, bigint(floor(target / source_size + 1e-12))) AS full",
    )
    goals = materialise(
        goals.selectExpr("*", "greatest(0D, target - double(full * source_size)) AS rest")
    )
    slot = "bigint(floor((draw / 18446744073709551616D + 0.5D) * blocks))"
    placed = lookup_join(rows, goals, "s", computed=True).selectExpr(
        "*", f"least(blocks - 1, {slot}) AS block"
    )
    loads = placed.groupBy("s", "block").agg(
        F.expr("sum(size) AS words"), F.expr("min(rest) AS rest")
    )
    upto = "sum(words) OVER (PARTITION BY s ORDER BY block)"
    loads = loads.selectExpr("s", "block AS b", "words", "rest", f"{upto} - words AS before")
    cut = loads.where("before + words > rest AND before < rest")
    cut = materialise(cut.selectExpr("s", "b", "rest - before AS room"))  # one block per source
    in_cut = lookup_join(placed, cut, "s", computed=True).where("block = b").selectExpr(
        "s", "draw", "doc_id", "size", "room",
        "sum(size) OVER (PARTITION BY s ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto",
    )
    # The document that crosses the target is taken if that comes nearer.
    edge = in_cut.where("upto - size / 2 <= room").groupBy("s").agg(
        F.expr("max(struct(draw, doc_id, size)) AS last")
    )
    edge = materialise(cut.drop("room").join(edge, "s", "left"))
    return lookup_join(placed, edge, "s", "left", computed=True).selectExpr(
        *[c for c in placed.columns if c != "rest"],
        "CASE WHEN rest <= 0 THEN 0 WHEN b IS NULL OR block < b THEN 1 WHEN block > b THEN 0 "
        "ELSE int(coalesce(struct(draw, doc_id, size) <= last, false)) END AS extra",
    )


# One hypergeometric draw by inversion, outward from the likeliest outcome, whose weight is set to 1:
# first upward, then downward, each weight following from its neighbour by a ratio. Folds keep a
# running weight and no list. Outcomes further than 20 roots of the smaller count away have, by
# Hoeffding's bound, less than exp(-800) of the mass, which no double holds beside 1.
def _left_share(k: str, n: str, total: str, uniform: str) -> str:
    """SQL for the number among ``n`` blocks drawn from ``total`` that belong to a source of ``k``."""
    # Every lambda names what the next one reads, so that nothing is spelled out twice.
    mode = f"greatest({{low}}, least({{high}}, bigint(floor(double({n} + 1) * ({k} + 1) / ({total} + 2)))))"
    reach = f"bigint(20 * sqrt(double(least({n}, {k}))) + 1)"
    ends = f"struct(greatest(0L, {n} - ({total} - {k})) AS low, least({n}, {k}) AS high)"
    middle = f"struct(b.low AS low, b.high AS high, {mode.format(low='b.low', high='b.high')} AS mid)"
    near = f"struct(greatest(m.low, m.mid - {reach}) AS low, least(m.high, m.mid + {reach}) AS high, m.mid AS mid)"
    up = f"(double({k} - x + 1) * ({n} - x + 1)) / (double(x) * ({total} - {k} - {n} + x))"
    down = f"(double(x + 1) * ({total} - {k} - {n} + x + 1)) / (double({k} - x) * ({n} - x))"
    above = "IF(r.mid < r.high, sequence(r.mid + 1, r.high), cast(array() as array<bigint>))"
    below = "IF(r.mid > r.low, sequence(r.mid - 1, r.low, -1L), cast(array() as array<bigint>))"

    def mass(steps: str, ratio: str) -> str:
        step = f"struct(a.w * {ratio} AS w, a.total + a.w * {ratio} AS total)"
        return f"aggregate({steps}, struct(1D AS w, 0D AS total), (a, x) -> {step}, a -> a.total)"

    def walk(steps: str, ratio: str, left: str) -> str:
        # ``left`` is what of the uniform number lies beyond the outcomes so far.
        step = (
            f"IF(a.at IS NOT NULL, a, struct(a.w * {ratio} AS w, a.left - a.w * {ratio} AS left, "
            f"IF(a.left < a.w * {ratio}, x, NULL) AS at))"
        )
        start = f"struct(1D AS w, {left} AS left, cast(NULL as bigint) AS at)"
        return f"aggregate({steps}, {start}, (a, x) -> {step}, a -> a.at)"

    masses = f"struct({mass(above, up)} AS above, {mass(below, down)} AS below)"
    drawn = f"({uniform}) * (1 + w.above + w.below)"
    # Rounding may leave a rest behind the last outcome; the likeliest one takes it.
    picked = (
        f"CASE WHEN d < 1 THEN r.mid WHEN d - 1 < w.above THEN coalesce({walk(above, up, 'd - 1')}, r.mid) "
        f"ELSE coalesce({walk(below, down, 'd - 1 - w.above')}, r.mid) END"
    )
    out = f"transform(array({drawn}), d -> {picked})[0]"
    for value, name in ((masses, "w"), (near, "r"), (middle, "m"), (ends, "b")):
        out = f"transform(array({value}), {name} -> {out})[0]"
    return out


def _halved(nodes: DataFrame, level: int) -> DataFrame:
    """Both children of every node ``first, shards, quotas``."""
    half = "bigint(shards div 2)"
    fold = f"""aggregate(quotas,
      struct({half} * total div shards AS n, total AS total, cast(array() as array<bigint>) AS left),
      (s, q) -> transform(array({_left_share('q.k', 's.n', 's.total', 'q.u')}), x ->
        struct(s.n - x AS n, s.total - q.k AS total, array_append(s.left, x) AS left))[0],
      s -> s.left)"""
    uniform = f"(pmod(xxhash64({SEED}L, {level}, first, q.s), 1000003) + 0.5D) / 1000003"
    with_draws = nodes.where("shards > 1").selectExpr(
        "first", "shards", "total",
        f"transform(quotas, q -> struct(q.s AS s, q.k AS k, {uniform} AS u)) AS quotas",
    ).selectExpr("*", f"{fold} AS lefts")
    side = "zip_with(quotas, lefts, (q, x) -> struct(q.s AS s, {take} AS k))"
    left = with_draws.selectExpr(
        "first", f"{half} AS shards", f"{half} * total div shards AS total",
        f"{side.format(take='x')} AS quotas",
    )
    right = with_draws.selectExpr(
        f"first + {half} AS first", f"shards - {half} AS shards",
        f"total - {half} * total div shards AS total", f"{side.format(take='q.k - x')} AS quotas",
    )
    return left.unionByName(right).unionByName(nodes.where("shards = 1"))


def split(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``shard, s, lo, hi``: which of each source's blocks, by rank, go to which shard.

    ``quotas`` has ``s, k``: a source and its number of blocks. A node holds one number per source;
    the tree is written out level by level.
    """
    nodes = quotas.where("k > 0").selectExpr("s", "bigint(k) AS k").agg(
        F.expr("array_sort(collect_list(struct(s, k))) AS quotas"), F.expr("coalesce(sum(k), 0L) AS total")
    )
    nodes = nodes.selectExpr("0L AS first", f"bigint({shards}) AS shards", "total", "quotas")
    level, width = 0, shards
    while width > 1:
        nodes = materialise(_halved(nodes, level))
        level, width = level + 1, -(-width // 2)
    leaves = nodes.selectExpr("first AS shard", "inline(quotas)")
    upto = "sum(k) OVER (PARTITION BY s ORDER BY shard)"
    return leaves.selectExpr("shard", "s", f"{upto} - k AS lo", f"{upto} AS hi").where("lo < hi")


def mixed(docs: DataFrame, most: int = MOST, shards: int | None = None) -> DataFrame:
    """One row per take: the document's key columns, ``pass``, ``shard`` and ``place``, the seeded
    key that orders a shard. Documents that the mix does not take have one row with a null shard."""
    rows = stored(drawn(docs, most))
    quotas = rows.groupBy("s").agg(
        F.expr("min(full) * min(blocks) + coalesce(max(IF(extra = 1, block + 1, NULL)), 0L) AS k")
    )
    quotas = materialise(quotas)
    blocks = quotas.selectExpr("bigint(coalesce(sum(k), 0)) AS n").first()["n"]
    ranges = split(quotas, shards or max(SHARDS, -(-blocks // SHARD_BLOCKS)))
    # One row per block taken, a thousandth of the documents; a document finds its shard by its block.
    dealt = materialise(
        ranges.selectExpr("s", "shard", "explode(sequence(lo, hi - 1)) AS rank").selectExpr(
            f"{RANKED} AS ranked", "shard"
        )
    )
    takes = rows.selectExpr(
        "*", "explode_outer(IF(full + extra = 0, NULL, sequence(0L, full + extra - 1))) AS pass"
    ).selectExpr("*", "pass * blocks + block AS rank")
    takes = takes.selectExpr("*", f"IF(pass IS NULL, NULL, {RANKED}) AS ranked")
    return lookup_join(takes, dealt, "ranked", "left", computed=True).selectExpr(
        "doc_id", "source", "s", "size", "draw", "source_size", "target", "pass", "shard",
        f"IF(pass IS NULL, NULL, xxhash64({SEED}L, draw, pass)) AS place",
    )


def mixed_texts(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mix itself: all columns of ``docs``, a row per take, shard by shard in seeded order.

    The texts move twice: to their takes, and to their shard.
    """
    draw, takes, mine = (common.fresh(docs, n) for n in ("mix_draw", "mix_takes", "mix_id"))
    plan = mixed(docs, most).groupBy("doc_id", "draw").agg(
        F.expr("count(*) FILTER (WHERE pass IS NULL OR pass = 0) AS rows"),
        F.expr("collect_list(IF(shard IS NULL, NULL, struct(shard, place))) AS all"),
    )
    # Rows that agree in id and text share a plan row; it gives them all the same takes.
    plan = plan.where("size(all) > 0").selectExpr(
        f"doc_id AS {mine}",
        f"draw AS {draw}",
        f"array_sort(slice(array_sort(all), 1, int(ceil(size(all) / rows)))) AS {takes}",
    )
    both = docs.withColumn(draw, F.expr(DRAW)).join(plan, draw).where(f"doc_id <=> {mine}")
    rows = both.selectExpr(*[f"`{c}`" for c in docs.columns], f"inline({takes})")
    rows = rows.toDF(*docs.columns, takes, mine)
    return rows.repartition(takes).sortWithinPartitions(takes, mine).select(*docs.columns)


def taken(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document: words taken, repeats counted."""
    rows = mixed(docs)
    per = rows.groupBy("doc_id", "s", "size", "draw", "source_size", "target").agg(
        F.expr("count(shard) AS takes"), F.expr("count(*) FILTER (WHERE pass IS NULL OR pass = 0) AS rows")
    )
    # Rows that agree in all of these are repeats of one document; each gets its equal part.
    return per.selectExpr("*", "explode(sequence(1L, rows)) AS one").selectExpr(
        "doc_id", "size", "source_size", "target", "size * takes div rows AS taken"
    )
