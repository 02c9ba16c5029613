"""The queries of this subpackage: each operator over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, html_text, line_dedup, manifest, media, mixing, ngram_join, oracles, packing, quality, repeats, sharding, sketches, spelling
from .common import pick, table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.media_features(media.wrap_media(media.store_texts(table(spark, sf_dir, "documents"))))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "embedded", "declared", "corrected", "item_start")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        sketches.as_string("sketch").alias("fingerprint"),
        sketches.as_string("edited_sketch").alias("edited_fingerprint"),
        sketches.likeness("sketch", "edited_sketch").alias("near_edited"),
        sketches.likeness("sketch", "next_sketch").alias("near_next"),
        sketches.containment("sketch", "edited_sketch").alias("in_edited"),
        sketches.containment("sketch", "next_sketch").alias("in_next"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    left = line_dedup.without_lines(docs, line_dedup.dedup_lines(docs, least=line_dedup.LEAST))
    return left.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_gone").cast("long").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered_manifest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge_divergence(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_mix_sources": op2_mix_sources,
    "op3_html_text": op3_html_text,
    "op4_fingerprints": op4_fingerprints,
    "op6_line_dedup": op6_line_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op7_repeated_strings": op7_repeated_strings,
    "op8_packing": op8_packing,
    "op9_shards": op9_shards,
    "op10_quality_field": op10_quality_field,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_divergence": op13_divergence,
}

#: Upper and lower case of the letters that op5 folds.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, t.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) t ON r.root = t.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) c USING (doc_id)""",
    "op6_line_dedup": r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
f AS (SELECT line, min(doc_id * 1000000 + k) AS id, length(line) AS n FROM l WHERE length(line) >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
e AS (SELECT x.id AS a, y.id AS b FROM f x JOIN f y ON x.n >= 20 AND y.n BETWEEN x.n AND x.n + 2 AND x.id <> y.id AND levenshtein(x.line, y.line) <= 2),
r AS (SELECT id, id AS root FROM f UNION SELECT r.id, t.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) t ON r.root = t.a),
c AS (SELECT id, min(root) AS root FROM r GROUP BY 1),
o AS (SELECT l.doc_id, l.k, l.line, c.root IS NOT NULL AND c.root <> l.doc_id * 1000000 + l.k AS gone FROM l LEFT JOIN f USING (line) LEFT JOIN c USING (id))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM o GROUP BY 1""",
    "op7_repeated_strings": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: struct_pack(i := i, m := md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200))))) AS w FROM t WHERE length(h) >= 200),
k AS (SELECT doc_id, w.i AS i, row_number() OVER (PARTITION BY w.m ORDER BY doc_id, w.i) AS nth FROM s),
d AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM k WHERE nth > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM d),
x AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, span),
y AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM x),
u AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM y JOIN t USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN u USING (doc_id)""",
    "op11_merkle_manifest": oracles.OP11,
    "op12_spelling_variants": oracles.OP12,
    "op13_divergence": oracles.OP13,
}
