"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, line_dedup, packing, quality, rlz_dedup, secrets, simhash, suffix_dedup, toxicity

#: Share of a host's pages above which a line is boilerplate. A line on one page is no repetition.
LINE_RATIO, LINE_PAGES = 0.02, 2


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out evenly where the files split into fewer parts than there are cores.

    Only small inputs come in so few parts; larger ones are read as they lie.
    """
    docs, cores = _read(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def vocabulary() -> str:
    """The vocabulary file of the public tokenizers; TESSERA_VOCABULARY names another."""
    if path := os.environ.get("TESSERA_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def crc_is(column: str, modulo: int, value: int):
    """Null ids are in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulo == value, F.lit(False))


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    field = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.judge(docs, field, ["doc_id"])


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    forest = secrets.train(*secrets.generated_findings())
    found = secrets.scan(docs, forest, ["doc_id"], "text", "source")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets", "redacted_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir)).withColumnRenamed("n", "n_bytes")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.phrase_matches(_documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"), ["doc_id"])
    return decontaminate.contamination(found, ["doc_id"])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    made = line_dedup.drop_boilerplate(docs, "source", "text", LINE_RATIO, LINE_PAGES, report=True)
    return made.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), "doc_id", "text", vocabulary())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    named = language_id.identify(docs, language_id.fit(docs), ["doc_id"])
    return named.select("doc_id", crc_is("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", crc_is("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op10_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.remove_repeats(_documents(spark, sf_dir)).select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_crf, op2_secret_forest, op3_suffix_dedup, op4_decontaminate, op5_line_dedup, op6_packing, op7_simhash, op8_language_id, op9_toxicity, op10_rlz_dedup)
}

_LINES = r"""
WITH lines AS (
  SELECT doc_id, coalesce('=' || source, '') AS host, i, l, trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), total AS (SELECT coalesce('=' || source, '') AS host, count(*) AS pages FROM documents GROUP BY 1),
gone AS (
  SELECT host, k FROM (SELECT host, k, count(DISTINCT doc_id) AS n FROM lines WHERE k <> '' GROUP BY host, k) JOIN total USING (host)
  WHERE n >= {pages} AND n > {ratio}::DOUBLE * pages
), per AS (
  SELECT doc_id, count(*) FILTER (WHERE l.k <> '') AS n_lines, count(g.k) AS n_dropped, coalesce(string_agg(l.l, chr(10) ORDER BY i) FILTER (WHERE g.k IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.host = g.host AND l.k = g.k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END) AS kept_md5
FROM documents d LEFT JOIN per USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PHRASES = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), iw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, pos.n, item FROM pos JOIN win ON pos.s = win.s AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_REPEATS = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM dw WHERE len(w) >= 35)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM win SEMI JOIN twice USING (s)),
flat AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM dw),
per AS (
  SELECT doc_id, count(g.j) AS n_removed, string_agg(x, ' ' ORDER BY flat.j) FILTER (WHERE g.j IS NULL) AS kept
  FROM flat LEFT JOIN gone g USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM dw LEFT JOIN per USING (doc_id)
"""

SQL: dict[str, str] = {
    "op4_decontaminate": _PHRASES,
    "op5_line_dedup": _LINES.format(ratio=LINE_RATIO, pages=LINE_PAGES),
    "op10_rlz_dedup": _REPEATS,
}
