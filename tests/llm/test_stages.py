"""The pipeline's stages on odd tables: clashing names, nulls, repeated ids, nothing at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language_id, line_dedup, secrets

TINY = "/root/testdata/sf0.001"
NAMES = ["score", "Accepted", "lang_pred", "n_words", "matches", "__host", "__lines", "__kept", "c0", "c1", "t", "k0", "row", "fp", "root", "gone", "host", "id", "n_lines", "window", "items"]


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with further columns that are named like computed ones, null rows and a repeated id."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "quite another text with the same id here", "en", None, 5), (1, None, "en", "s", 0), (None, "", "fr", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    for i, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.lit(f"{name}{i}"))
    return docs


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_carry_clashing_columns(spark, crowded, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, crowded, TINY)
    assert made.columns == crowded.columns
    rows = made.collect()
    assert rows and all(r[n] == f"{n}{i}" for r in rows for i, n in enumerate(NAMES))
    before = {(r.doc_id, r.text) for r in crowded.select("doc_id", "text").collect()}
    after = {(r.doc_id, r.text) for r in rows}
    if name == "line_dedup":
        assert len(rows) == crowded.count()
    else:
        assert after <= before
    if name == "simhash_near_dedup":  # neither text of the id 1 is a near copy of the other
        assert sum(i == 1 and t is not None for i, t in after) == 2 and sum(not (t or "").strip() for _, t in after) == 1
    assert stage(spark, crowded.limit(0), TINY).count() == 0


def test_packing_ignores_clashing_columns(spark, crowded):
    docs = crowded.limit(20).withColumn("pieces", F.lit(1)).withColumn("rest", F.lit(1)).withColumn("salt", F.lit(1))
    stage = dict(corpus_pipeline.STAGES)["packing"]
    assert stage(spark, docs, TINY).count() >= 20 and stage(spark, docs.limit(0), TINY).count() == 0


def test_kept_columns_named_like_results_are_renamed(spark):
    docs = spark.createDataFrame([(1, "some words of it here", "en", "x", 7)], "doc_id long, text string, lang string, Score string, n_candidates long")
    model = language_id.LanguageIdentifier([], [])
    got = language_id.identify(docs, model, ["doc_id", "Score", "lang"])
    assert got.columns == ["doc_id", "Score_in", "lang", "lang_pred", "score", "accepted"] and got.first().Score_in == "x"
    forest = secrets.train(*secrets.generated_findings(200))
    assert secrets.scan(docs, forest, ["n_candidates"]).columns == ["n_candidates_in", "n_candidates", "secrets", "redacted_sha256"]
    assert line_dedup.drop_boilerplate(docs.withColumn("n_lines", F.lit(1)), "lang", "text", report=True).columns[-3:] == ["n_lines_in", "n_lines", "n_dropped"]


def test_second_line_hash_is_not_made_of_the_first(spark):
    a, b = line_dedup._hash(F.col("t"))
    row = spark.createDataFrame([("x",)], "t string").select(a, b, F.xxhash64("t", F.lit(1)).alias("seeded"), F.hash("t").alias("h")).first()
    assert row.b not in (row.a, row.seeded)


def test_a_path_with_any_character(spark):
    forest = secrets.train(*secrets.generated_findings())
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    docs = spark.createDataFrame([(1, f'token = "{key}"', "a\x01b 12 é"), (2, f'token = "{key}"', None), (3, None, "p"), (4, "", "p")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in secrets.scan(docs, forest, ["doc_id"], "text", "source").collect()}
    assert [x.start for x in rows[1].secrets] == [x.start for x in rows[2].secrets] == [9] and rows[3].redacted_sha256 is None and rows[4].n_candidates == 0
