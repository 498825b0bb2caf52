"""The operators of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kpiforge.llm import decontam, embedding_dedup, extraction, langid, line_dedup, ngram_join, packing, resample, sharding, toxicity
from kpiforge.llm import fingerprints, prefix_trie, whitening
from kpiforge.sources.tables import read_table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have Jaccard similarity of 0.75 or more."""
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), n=5, percent=75)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn by importance resampling towards those labelled good."""
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_consensus_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the container path that its host's pages agree on."""
    return extraction.extract(read_table(spark, sf_dir, "pages"))


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 (two regions of two racks of four), and in one shard more."""
    return sharding.place(read_table(spark, sf_dir, "documents"), sharding.grid(16))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; ids whose CRC-32 leaves 0 modulo 5 are never learned from."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4096 ids of the public word vocabulary."""
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("class")


def op7_log_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs in three or more documents (the first keeps them)."""
    return line_dedup.drop_recurring(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of equal label with cosine of 0.98 or more."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.98)


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that leak into them, exactly or with other slot values."""
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; ids whose CRC-32 leaves 1 modulo 3 are never learned from."""
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op11_lookup_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invertible lookup sketches of every document and its edited text, and how alike they and the next document are."""
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 16 leading components of the distinct integer vectors, scaled to variance one."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_importance_resampling, op3_consensus_extraction, op4_hash_tree_sharding, op5_counterfactual_toxicity,
    op6_harmonic_packing, op7_log_template_lines, op8_cross_polytope_dedup, op9_template_decontamination, op10_byte_gru_language,
    op11_lookup_fingerprints, op12_prefix_trie, op13_embedding_whitening)}

_SHINGLES = r"""
words AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets)
"""

def _sketch_text(digests: str) -> str:
    """DuckDB: a sketch of three rows of four cells as text."""
    check = "[(k % 1000000007) * (k % 998244353) % 2147483647 for k in y]"
    return (f"""array_to_string([lower(to_hex(len(y))) || '.' || lower(to_hex(coalesce(list_aggregate(y, 'bit_xor'), 0))) || '.' ||
    lower(to_hex(coalesce(list_aggregate({check}, 'bit_xor'), 0)))
    for y in [[k for k in {digests} if ((k >> (2 * (z // 4))) & 3) = z % 4] for z in range(12)]], ' ')""")


def _alike(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / "
            f"len(list_distinct(list_concat({a}, {b}))) END")


_DIGESTS = ("list_distinct([('0x' || sha256(p)[1:15])::BIGINT for p in regexp_extract_all({text}, "
            "'(?:[^\n]{{96,256}}?[.!?]+|[^\n]{{1,256}})\n*|\n+')])")

# DuckDB: CRC-32 of a number's decimal digits, bit by bit
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(d)::BIGINT for d in string_split(conv_id::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op12_prefix_trie": f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (SELECT c.conv_id, 0 AS seg, k, r, t FROM convs c JOIN turns o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.k <= c.h
    UNION ALL SELECT c.conv_id, 1, k, r, t FROM convs c JOIN turns o ON o.conv_id = c.conv_id AND o.k > c.h),
numbered AS (SELECT conv_id, r, t, row_number() OVER (PARTITION BY conv_id ORDER BY seg, k) AS d FROM built),
paths AS (SELECT conv_id, d, octet_length(encode(t)) AS size, md5(string_agg(length(r) || ':' || r || length(t) || ':' || t, '|')
    OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS key FROM numbered
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
ends AS (SELECT conv_id, max(d) AS len FROM paths GROUP BY conv_id),
nodes AS (SELECT key, d, min(p.conv_id) AS conv_id, count(*) AS n, any_value(size) AS size, max(len) = d AS leaf,
    coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (len = d), '') AS ids FROM paths p JOIN ends USING (conv_id) GROUP BY key, d),
links AS (SELECT DISTINCT a.key AS upper, a.d AS ud, b.key AS lower, b.d AS ld FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.d <= b.d),
below AS (SELECT upper AS key, ud AS d, count(*) FILTER (ld = ud + 1) AS children, count(*) FILTER (leaf) AS leaves, sum((n - 1) * size) AS saved
    FROM links JOIN nodes ON key = lower AND d = ld GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, children AS n_children, leaves AS n_leaves,
    saved::BIGINT AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM nodes x JOIN below USING (key, d) LEFT JOIN links l ON l.lower = x.key AND l.ld = x.d AND l.ud = x.d - 1
LEFT JOIN nodes p ON p.key = l.upper AND p.d = l.ud
""",
    "op11_lookup_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC) AS k, count(*) OVER () AS m FROM documents),
pairs AS (SELECT a.doc_id, a.t, length(a.t) AS n, b.t AS x,
    left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) AS e FROM d a JOIN d b ON b.k = a.k % a.m + 1),
u AS (SELECT doc_id, n, e, {_DIGESTS.format(text='t')} AS ua, {_DIGESTS.format(text='e')} AS ue, {_DIGESTS.format(text='x')} AS ux FROM pairs)
SELECT doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256, {_sketch_text('ua')} AS fingerprint, {_sketch_text('ue')} AS edited_fingerprint,
    {_alike('ua', 'ue')} AS near_edited, {_alike('ua', 'ux')} AS near_next FROM u
""",
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE {_SHINGLES},
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM inter WHERE 100 * o >= 75 * (nx + ny - o)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id FROM sets s
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
""",
    "op8_cross_polytope_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum([x * x for x in e])) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) >= 0.98 * a.n * b.n),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON reach.r = links.x)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, m.component_id, vec_id = m.component_id AS kept
FROM (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) m
LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) d USING (vec_id)
""",
}
