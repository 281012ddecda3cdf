"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``. The driver writes the
stages itself; :func:`run` does it in the shared folder.

Every stage takes further columns of any name through unchanged (the last one ignores them) and gives an
empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, line_dedup, packing, simhash
from tessera.llm._util import at, materialise, named, numbered
from tessera.llm.queries import LINE_PAGES, LINE_RATIO, vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text one of the learned languages accepts (op 8).

    Null and empty texts and texts without a letter are rejected; null languages are not learned from.
    """
    plain = numbered(docs)
    model = language_id.fit(plain, at(docs, "doc_id"), at(docs, "text"), at(docs, "lang"))
    return named(language_id.identify(plain, model, plain.columns, at(docs, "text")).filter(F.col("accepted")), docs)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of each source out of its documents; n_chars follows (op 5).

    Copies are still there and count once, so that they keep their lines until the next stage. Every row
    stays; a null text stays null, and a null source is a host of its own.
    """
    made = line_dedup.drop_boilerplate(docs, "source", "text", LINE_RATIO, LINE_PAGES, copies_once=True)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of every component (op 7).

    Rows without an id come last; texts that no link joins all stay, also under one id. Null and blank
    texts are copies of each other.
    """
    return simhash.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a phrase of a benchmark item occurs (op 4); null and empty texts stay."""
    plain = numbered(docs)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.phrase_matches(plain, items, plain.columns, at(docs, "text"))
    return named(found.filter(F.size("matches") == 0), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences (op 6); a null or empty text is its closing id alone."""
    return packing.pack(docs, "doc_id", "text", vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_site_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No SQL expresses the language models and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
