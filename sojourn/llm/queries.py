"""One query per corpus operator, and its DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sojourn.llm import bpe, common, decontaminate, embeddings, lm, mixing, pii, simhash
from sojourn.llm import prefixes, spelling, substring, topk, toxicity, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, RANKS, PATTERN)


@_query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(common.table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    return toxicity.scored(common.table(spark, sf_dir, "documents"), labels)


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


@_query
def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(common.table(spark, sf_dir, "documents")).drop("kept")


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(common.table(spark, sf_dir, "documents"))


@_query
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(common.table(spark, sf_dir, "embeddings"))


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(common.table(spark, sf_dir, "documents"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


@_query
def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = common.table(spark, sf_dir, "labels").where("quality = 1")
    return lm.scored(common.table(spark, sf_dir, "documents"), good)


@_query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, items)


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(common.table(spark, sf_dir, "conversations"))


@_query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(common.table(spark, sf_dir, "documents"))


STATEMENTS: dict[str, str] = {
    "op2_top_k": """
        WITH sound AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM sound q JOIN sound c ON c.vec_id <> q.vec_id
          WHERE q.vec_id % 50 = 0
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
          FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op5_substring": r"""
        WITH split AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
          FROM documents
        ), starts AS (
          SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split
          WHERE len(words) >= 13
        ), windows AS (
          SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM starts
        ), hits AS (
          SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) < doc_id AS hit FROM windows
        ), covered AS (
          SELECT doc_id, list(DISTINCT p) AS gone
          FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hits WHERE hit) GROUP BY doc_id
        ), one AS (
          SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM split
        ), gone AS (
          SELECT doc_id, unnest(gone) AS p FROM covered
        ), kept AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
          FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
               CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)
    """,
    "op9_warc": """
        WITH sized AS (
          SELECT page_id, coalesce(html, '') AS html,
                 CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
          FROM pages
        ), named AS (
          SELECT *, CASE WHEN payload_bytes >= 1000
                         THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS original
          FROM sized
        )
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to
        FROM named
    """,
    "op11_decontamination": r"""
        WITH split AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM documents
        ), items AS (
          SELECT item_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM benchmark
        ), item_windows AS (
          SELECT DISTINCT item_id, array_to_string(words[i:i + 9], ' ') AS w, least(len(words), 10) AS n
          FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i
                FROM items WHERE len(words) > 0)
        ), widths AS (
          SELECT DISTINCT n FROM item_windows
        ), doc_windows AS (
          SELECT r, i, n, array_to_string(words[i:i + n - 1], ' ') AS w
          FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM split, widths)
        ), found AS (
          SELECT r, i, n, item_id FROM doc_windows JOIN item_windows USING (w, n)
        ), hits AS (
          SELECT r, count(DISTINCT p) AS n_hit
          FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
        ), named AS (
          SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL)
          GROUP BY r
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               n_hit IS NOT NULL AS contaminated
        FROM split LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
    """,
    "op12_prefix_trie": r"""
        WITH bits AS (
          SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
          FROM range(256) AS r(i)
        ), own AS (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
                 sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS id,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
          FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
          SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT,
                   list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM own), bits
        ), rebuilt AS (
          SELECT c.conv_id, o.k, o.id, o.words FROM convs c JOIN own o
            ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.k <= c.h
          UNION ALL
          SELECT c.conv_id, o.k, o.id, o.words FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h
        ), seqs AS (
          SELECT c.conv_id, coalesce(list(id ORDER BY k) FILTER (id IS NOT NULL), []) AS ids,
                 coalesce(list(words ORDER BY k) FILTER (id IS NOT NULL), []) AS words
          FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
        ), members AS (
          SELECT conv_id, d, sha256(array_to_string(ids[1:d], ',')) AS node, len(ids) = d AS ends,
                 CASE WHEN d > 0 THEN sha256(array_to_string(ids[1:d - 1], ',')) END AS up,
                 CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words
          FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM seqs)
        ), nodes AS (
          SELECT node, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
          FROM members GROUP BY node, d
        ), children AS (
          SELECT up AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
        ), below AS (
          SELECT DISTINCT a.node, a.d, b.node AS under, b.d AS under_d
          FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.d >= a.d
        ), sums AS (
          SELECT b.node, b.d, count(*) FILTER (c.n IS NULL) AS n_leaves,
                 sum((n.n_convs - 1) * n.words) AS saved_tokens
          FROM below b JOIN nodes n ON n.node = b.under AND n.d = b.under_d
          LEFT JOIN children c ON c.node = n.node AND c.d = n.d GROUP BY b.node, b.d
        )
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
               s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
        FROM nodes n JOIN sums s ON s.node = n.node AND s.d = n.d
        LEFT JOIN children c ON c.node = n.node AND c.d = n.d
        LEFT JOIN nodes p ON p.node = n.up AND p.d = n.d - 1
    """,
    # DuckDB's levenshtein compares bytes, so one upper-case letter, digit or sign stands for each of
    # U+00C0 to U+00FF; words near each other share one of their texts with a letter left out.
    "op13_spelling": r"""
        WITH RECURSIVE bits AS (
          SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
          FROM range(256) AS r(i)
        ), letters AS (
          SELECT string_agg(chr(CAST(i AS INTEGER)), '' ORDER BY i) AS wide,
                 string_agg(chr(CAST(i - 159 AS INTEGER)), '' ORDER BY i) AS narrow
          FROM range(192, 256) AS r(i)
        ), runs AS (
          SELECT id, run, count(*) AS n
          FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
          GROUP BY id, run
        ), bytes AS (
          SELECT run, id, n, list_transform(range(0, octet_length(encode(id || ':' || run))),
                   lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2) AS BIGINT)) AS b
          FROM runs
        ), hashed AS (
          SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
                   lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h
          FROM bytes, bits
        ), words AS (
          SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word,
                 CAST(sum(n) AS BIGINT) AS n
          FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
        ), plain AS (
          SELECT word, n, translate(word, wide, narrow) AS p FROM words, letters
        ), parts AS (
          SELECT word, n, p, p AS part FROM plain
          UNION ALL
          SELECT DISTINCT word, n, p, p[1:i] || p[i + 2:] AS part
          FROM (SELECT *, unnest(range(0, length(p))) AS i FROM plain)
        ), near AS (
          SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
          FROM parts a JOIN parts b USING (part) WHERE a.word <> b.word AND levenshtein(a.p, b.p) = 1
        ), best AS (
          SELECT word, n, count(*) AS n_near, max(other_n) AS form_n,
                 min(other) FILTER (other_n = top) AS form
          FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word, n
        ), forms AS (
          SELECT word, form FROM best WHERE form_n >= 2 * n
        ), paths AS (
          SELECT word, form, 1 AS steps FROM forms
          UNION ALL
          SELECT p.word, f.form, p.steps + 1 FROM paths p JOIN forms f ON f.word = p.form
        ), roots AS (
          SELECT word, arg_max(form, steps) AS root FROM paths GROUP BY word
        )
        SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near,
               CASE WHEN f.form IS NOT NULL THEN b.form_n END AS form_n
        FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
    """,
}
