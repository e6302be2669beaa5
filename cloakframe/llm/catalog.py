"""The registered queries of this subpackage and their SQL twins (only where SQL can express the whole result)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import read
from .embedding_dups import embedding_dups
from .fill_middle import MARKERS, PLAIN_FROM, SPM_BELOW, fill_middle, restore_middle
from .jaccard_join import jaccard_join
from .kk_packing import kk_packing
from .language_crf import language
from .line_rules import LEAST_LEFT, MAX_DOCS, MEASURES, line_rules
from .merkle_manifest import ARITY, verified_manifest
from .minimax_shards import minimax_shards
from .piece_codec import decode_pieces, encode_pieces
from .quality_svm import quality
from .source_mix import source_mix
from .suffix_dedup import suffix_dedup
from .toxicity_bag import toxicity


def op1_quality_svm(spark: SparkSession, sf: str) -> DataFrame:
    return quality(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_minimax_shards(spark: SparkSession, sf: str) -> DataFrame:
    return minimax_shards(read(spark, sf, "documents"))


def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join(read(spark, sf, "documents"), n=3, per_cent=90)


def op5_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return source_mix(read(spark, sf, "documents"))


def op6_language_crf(spark: SparkSession, sf: str) -> DataFrame:
    return language(read(spark, sf, "documents"))


def op7_toxicity_bag(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op8_kk_packing(spark: SparkSession, sf: str) -> DataFrame:
    return kk_packing(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_embedding_dups(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dups(read(spark, sf, "embeddings"))


def op10_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    return line_rules(read(spark, sf, "documents")).select("doc_id", *MEASURES, "base_failed", "kept", "removed_words")


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return verified_manifest(read(spark, sf, "documents"))


def op12_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    found = restore_middle(fill_middle(read(spark, sf, "documents")))
    return found.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def op13_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(read(spark, sf, "documents"), path).withColumn("n_bytes", F.element_at("edges", -1).cast("long"))
    found = decode_pieces(encoded.drop("edges"), path)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("text", 256).alias("decoded_sha256"), "n_bytes")


QUERIES = {
    "op1_quality_svm": op1_quality_svm,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minimax_shards": op3_minimax_shards,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_source_mix": op5_source_mix,
    "op6_language_crf": op6_language_crf,
    "op7_toxicity_bag": op7_toxicity_bag,
    "op8_kk_packing": op8_kk_packing,
    "op9_embedding_dups": op9_embedding_dups,
    "op10_line_rules": op10_line_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_middle": op12_fill_middle,
    "op13_piece_codec": op13_piece_codec,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LINE_RULES = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT row, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM d),
grams AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM windows),
repeated AS (SELECT row, count(DISTINCT i + j) AS n FROM grams, range(5) t(j) WHERE n > 1 GROUP BY row),
split AS (SELECT row, source, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS MATERIALIZED (SELECT row, source, line, {_WORDS.format(f"translate(line, '{_UPPER}', '{_LOWER}')")} AS lw FROM split),
real AS MATERIALIZED (SELECT row, source, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM lines WHERE len(lw) > 0),
copies AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM real GROUP BY row),
frequent AS (SELECT source, norm FROM real GROUP BY source, norm HAVING count(DISTINCT row) > {MAX_DOCS}),
removed AS (SELECT row, sum(real.n) AS n FROM real JOIN frequent ON real.norm = frequent.norm AND real.source IS NOT DISTINCT FROM frequent.source GROUP BY row),
m AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(copies.n, 0)::BIGINT AS n_dup_lines,
           coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS removed_words
    FROM d LEFT JOIN copies USING (row) LEFT JOIN repeated USING (row) LEFT JOIN removed USING (row)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - removed_words) >= {LEAST_LEFT} * n_words AS kept
FROM m"""
_EMBEDDING_DUPS = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS MATERIALIZED (SELECT vec_id, e, sqrt(list_sum([x * x for x in e])) AS norm FROM v
    WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
component AS (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
FROM v LEFT JOIN degree USING (vec_id) LEFT JOIN component USING (vec_id)"""

_SUFFIX_DEDUP = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
shared AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, i FROM w JOIN shared ON w.g = shared.g WHERE w.doc_id > least),
opened AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50 THEN 1 ELSE 0 END AS opens FROM hit),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM opened),
runs AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM runs
    UNION ALL SELECT doc_id, max(b), 4611686018427387904 FROM runs GROUP BY doc_id),
kept AS (SELECT gaps.doc_id, string_agg(substr(h, 2 * p + 1, least(2 * (least(q, len(h)) - p), len(h))), '' ORDER BY p) AS k FROM gaps JOIN d ON d.doc_id = gaps.doc_id GROUP BY gaps.doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""
_WORDS_OF = _WORDS.format(f"translate(coalesce(text, ''), '{_UPPER[:26]}', '{_LOWER[:26]}')")
_JACCARD_JOIN = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS_OF} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS MATERIALIZED (SELECT doc_id, g, n FROM s JOIN sizes USING (doc_id)),
half AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN component USING (doc_id)"""
_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{0}")) + ")"
_MERKLE = f"""
WITH RECURSIVE bits AS (SELECT list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c, i FROM range(256) t(i)),
table_of AS (SELECT list(c ORDER BY i) AS crc FROM bits),
d AS MATERIALIZED (SELECT *, {_LEAF.format("text")} AS leaf, {_LEAF.format(f"translate(text, '{_UPPER[:26]}', '{_LOWER[:26]}')")} AS changed,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda c, x: xor(c // 256, crc[(xor(c, x) % 256) + 1])), 4294967295) % 3 = 0 AS hit FROM documents, table_of),
leaves AS MATERIALIZED (SELECT *, CASE WHEN hit THEN changed ELSE leaf END AS start, coalesce('1' || lang, '0') AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
up AS MATERIALIZED (SELECT 0 AS level, tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
    UNION ALL SELECT level + 1, tree, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), any_value((n + {ARITY} - 1) // {ARITY}) FROM up WHERE n > 1 GROUP BY level, tree, i // {ARITY}),
subroots AS MATERIALIZED (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM up WHERE n = 1),
top AS MATERIALIZED (SELECT 0 AS level, i, h, count(*) OVER () AS n FROM subroots
    UNION ALL SELECT level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), any_value((n + {ARITY} - 1) // {ARITY}) FROM top WHERE n > 1 GROUP BY level, i // {ARITY}),
nodes AS MATERIALIZED (SELECT tree, level, i, h, n FROM up UNION ALL SELECT '', level, i, h, n FROM top),
sides AS MATERIALIZED (SELECT *, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM nodes WINDOW run AS (PARTITION BY tree, level, i // {ARITY} ORDER BY i)),
walk AS (SELECT 0 AS stage, leaves.tree AS own, leaves.tree, leaves.i AS doc, 0 AS level, leaves.i, start AS h, '' AS proof FROM leaves
    UNION ALL SELECT CASE WHEN n > 1 THEN stage WHEN stage = 0 THEN 1 ELSE 2 END, own, CASE WHEN n > 1 THEN walk.tree ELSE '' END, doc, CASE WHEN n > 1 THEN walk.level + 1 ELSE 0 END,
        CASE WHEN n > 1 THEN walk.i // {ARITY} ELSE subroots.i END, CASE WHEN n > 1 THEN sha256(before || walk.h || after) ELSE walk.h END, CASE WHEN n > 1 THEN proof || before || after ELSE proof END
    FROM walk JOIN sides ON sides.tree = walk.tree AND sides.level = walk.level AND sides.i = walk.i LEFT JOIN subroots ON subroots.tree = walk.own WHERE stage < 2)
SELECT doc_id, leaf, subroots.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, walk.h AS folded_root, walk.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM walk JOIN leaves ON leaves.tree = walk.own AND leaves.i = walk.doc JOIN subroots ON subroots.tree = walk.own WHERE stage = 2"""
_GROUP = "('0x' || substr(k, {}, 8))::BIGINT"
_FILL_MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '-')) AS k FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, {_GROUP.format(1)} AS h1, {_GROUP.format(9)} AS h2, {_GROUP.format(17)} AS h3, {_GROUP.format(25)} AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR {" OR ".join(f"contains(t, '{m}')" for m in MARKERS)} OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, t[:a] AS p, t[a + 1:b] AS m, t[b + 1:] AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{MARKERS[0]}' || p || '{MARKERS[1]}' || s || '{MARKERS[2]}' || m ELSE '{MARKERS[1]}' || s || '{MARKERS[0]}' || p || '{MARKERS[2]}' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts"""

#: The other operators draw, learn, search iteratively or go byte by byte; tests/llm holds those against brute force.
ORACLES: dict[str, str] = {"op2_suffix_dedup": _SUFFIX_DEDUP, "op4_jaccard_join": _JACCARD_JOIN, "op9_embedding_dups": _EMBEDDING_DUPS, "op10_line_rules": _LINE_RULES, "op11_merkle_manifest": _MERKLE, "op12_fill_middle": _FILL_MIDDLE}
