"""The registered queries of this subpackage: each applies its operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, linededup, mixing, packing, pii, quality, runs, secrets, suffixes, toxicity, variants, wavelet
from .store import scratch_dir
from .tokens import vocabulary_path

_SPACE = r"[\x20\x09-\x0D]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_kind(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(F.split(spans, ","), lambda s: F.startswith(s, F.lit(kind + ":")))).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.fit_on(docs))
    counts = [_of_kind("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_added")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))
    counts = [_of_kind("base", k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_random")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", F.coalesce(F.col("slots")[0], F.lit(-1)).alias("first_slot"), "n_slots")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_documents(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    wavelet.write_shards(_table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"))
    return wavelet.read_documents(spark, path)


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = variants.word_counts(_table(spark, sf_dir, "documents"), least_length=6, least_count=5, delete_one_in=199)
    return variants.spelling_forms(counts, times=5)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), reword=True)


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(_table(spark, sf_dir, "documents"), length=400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_secrets, op4_jaccard, op5_mixing, op6_ann, op7_packing, op8_toxicity, op9_wavelet, op10_linededup, op11_variants, op12_runs, op13_suffixes)}

ORACLES = {
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || '#0' AS row FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS BIGINT) AS weight, 3 * source_size AS most FROM s),
f AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened,
             sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, CAST(total - before AS DOUBLE) / CAST(opened AS DOUBLE) AS lev FROM f),
g AS (SELECT *, max(CASE WHEN lev <= CAST(most AS DOUBLE) / weight THEN lev END) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN weight * final < most THEN weight * final ELSE CAST(most AS DOUBLE) END AS target, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM g),
c AS (SELECT *, CAST(floor(target) AS BIGINT) AS words, CAST(sum(CAST(floor(target) AS BIGINT)) OVER (ORDER BY place) AS BIGINT) AS upto, CAST(sum(CAST(floor(target) AS BIGINT)) OVER () AS BIGINT) AS total, 64 AS block FROM t),
r AS (SELECT unnest(range((max(total) + max(block) - 1) // max(block))) AS slot FROM c),
q AS (SELECT slot, (slot + 1)::HUGEINT * 11400714819323198485::HUGEINT % 18446744073709551616::HUGEINT AS point FROM r),
m AS (SELECT place, slot FROM q JOIN c ON point * total // 18446744073709551616::HUGEINT >= upto - words AND point * total // 18446744073709551616::HUGEINT < upto),
e AS (SELECT place, slot FROM m UNION ALL SELECT place, (total + block - 1) // block + place FROM c WHERE words > 0 AND place NOT IN (SELECT place FROM m)),
h AS (SELECT place, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS nth FROM e),
k AS (SELECT c.*, least(coalesce(n, 0) * block, words) AS goal FROM c LEFT JOIN (SELECT place, count(*) AS n FROM h GROUP BY 1) USING (place)),
b AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(row), row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
x AS (SELECT b.doc_id, b.size, b.start, k.*, unnest([0, 1, 2]) AS pass FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source),
y AS (SELECT *, start + pass * source_size AS a, least(start + pass * source_size + size, goal) AS z FROM x),
v AS (SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, z - a)) AS BIGINT) AS taken, min(start) AS start, any_value(place) AS place, any_value(block) AS block,
             CAST(sum(CASE WHEN a < z THEN (z - 1) // block - a // block + 1 ELSE 0 END) AS BIGINT) AS n_slots FROM y GROUP BY doc_id, size, source_size, target)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN slot ELSE -1 END AS first_slot, n_slots
FROM v LEFT JOIN h ON v.place = h.place AND v.start // v.block = h.nth
""",
    "op10_linededup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM n),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
s AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.holder AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
