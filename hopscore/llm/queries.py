"""The registered queries of the subpackage: one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscore.llm import (
    byte_bpe,
    centroids,
    decontaminate,
    exact_dedup,
    html_text,
    jaccard_join,
    language,
    nearest,
    packed_ids,
    packing,
    passages,
    prefix_trie,
    warc,
)
from hopscore.llm.storage import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Ids that the results are defined with.
WORD_END, BYTE_END = 2, 1


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@_query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more that repeat an earlier document."""
    return passages.repeated_passages(_table(spark, folder, "documents"))


@_query
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@_query
def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join.similarity_join(_table(spark, folder, "documents"))


@_query
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all pages, read back from archives."""
    return warc.round_trip(spark, _table(spark, folder, "pages"))


@_query
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_pages(_table(spark, folder, "pages"))


@_query
def op6_ann_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth id."""
    rows = _table(spark, folder, "embeddings")
    return nearest.search(rows, F.col("vec_id") % 50 == 0)


@_query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    return language.identify_documents(_table(spark, folder, "documents"))


@_query
def op8_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of bit-packed id files, read back."""
    return packed_ids.round_trip(spark, _table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), WORD_END)


@_query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), BYTE_END)


@_query
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy of its text that stays."""
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


ORACLES["op10_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(text) AS text_sha256
FROM d WINDOW same AS (PARTITION BY text)
"""

ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     s AS (SELECT page_id, html, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id,
       CAST(n AS BIGINT) AS payload_bytes,
       sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM s
"""


@_query
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the benchmark items whose windows occur in it."""
    return decontaminate.contamination_digests(spark, _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query
def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its cluster after three rounds."""
    return centroids.cluster(_table(spark, folder, "embeddings"))


@_query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    conversations = saved(prefix_trie.steps(_table(spark, folder, "conversations")), "trie-conversations")
    return prefix_trie.trie(prefix_trie.rebuilt(conversations))


ORACLES["op11_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, w[i : i + 9] AS words, len(w[i : i + 9]) AS n FROM s),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT p.r, p.i, p.n, x.item_id FROM places AS p JOIN windows AS x ON p.n = x.n AND p.w[p.i : p.i + p.n - 1] = x.words),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def _clustering_sql(centroids: int, rounds: int, scale: int, size: int) -> str:
    """The rounds one after another: ``c<i>`` holds the centroids of a round, ``a<i>`` the assignment to them."""
    parts = [
        f"""p AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) AS r, vec_id, v
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"c0 AS (SELECT r - 1 AS cluster, v FROM p WHERE r <= {centroids})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, cluster, distance
  FROM (SELECT p.r, p.vec_id, p.v, c.cluster,
               list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
        FROM p, c{i} AS c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v
  FROM c{i} AS c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v
    FROM (SELECT cluster, j, sum(x) AS s, count(*) AS n
          FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY cluster, j)
    GROUP BY cluster) AS m ON c.cluster = m.cluster)""")
    last = f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.cluster = c.cluster"""
    return "WITH " + ",\n".join(parts) + last


ORACLES["op12_centroid_clustering"] = _clustering_sql(16, 3, 64, 64)

#: The CRC-32 is computed bit by bit from the bytes of the decimal id.
ORACLES["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS step,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM t),
h AS (
  SELECT conv_id, xor(4294967295, list_reduce(
           list_transform(range(1, length(c) + 1), lambda i: CAST(ascii(substr(c, CAST(i AS BIGINT), 1)) AS BIGINT)),
           lambda a, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)),
           4294967295)) % 4 AS h
  FROM ids),
turns AS (
  SELECT h.conv_id, 0 AS part, t.k, t.step, t.words FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.k <= h.h
  UNION ALL
  SELECT h.conv_id, 1, t.k, t.step, t.words FROM h JOIN t ON t.conv_id = h.conv_id AND t.k > h.h),
paths AS (
  SELECT conv_id, row_number() OVER o AS depth, string_agg(step, '') OVER (o ROWS UNBOUNDED PRECEDING) AS path, words,
         count(*) OVER (PARTITION BY conv_id) AS total
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY part, k)),
every AS (
  SELECT conv_id, depth, path, words, depth = total AS ends FROM paths
  UNION ALL
  SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM paths) FROM ids),
nodes AS MATERIALIZED (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM every GROUP BY path),
children AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (SELECT left(path, 64 * unnest(range(0, depth + 1))) AS top, path, (n_convs - 1) * words AS own FROM nodes),
below AS (
  SELECT top, count(*) FILTER (c.path IS NULL) AS n_leaves, sum(own) AS saved
  FROM above LEFT JOIN children AS c ON above.path = c.path GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes AS n JOIN below AS b ON b.top = n.path LEFT JOIN children AS c ON c.path = n.path
LEFT JOIN nodes AS p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
"""
