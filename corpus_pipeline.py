"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each result as
Parquet in the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.llm import common, exact_dedup, langid, mixing, packing, simhash
from inkmeter.llm.common import on_workers, read_table, stable
from inkmeter.llm.queries import END_ID, WIDTH, language_profiles, tokenizer_path

#: Near copies: words of a shingle, and the similarity of shingle sets from which on documents are near copies.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8


#: Documents that a Python worker gets at once: few, as texts can be long.
BATCH = "2000"


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _ready(spark: SparkSession) -> None:
    on_workers(spark)
    spark.conf.set(BATCH_KEY, BATCH)  # a stage's plan runs after it returns; ``run`` restores the setting


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one struct, so that input columns of any name can't clash with what a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and those without a letter."""
    _ready(spark)
    known = langid.predict_languages(_rows(docs).select("row", "row.text"), language_profiles(docs))
    return known.filter(F.col("lang_pred") != "und").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    _ready(spark)
    return exact_dedup.content_sort_dedup(docs, carry=True).filter("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; rows without an id stay.

    Near copies are found by SimHash fingerprints through sharded BK-trees, and compared exactly.
    """
    _ready(spark)
    groups = simhash.similar_components(docs, NEAR_SHINGLE, NEAR_SIMILARITY)
    gone = groups.groupBy(F.col("doc_id").alias("gone_id")).agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone")
    return _rows(docs).join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows that repeat an id are taken alike."""
    _ready(spark)
    copies = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("mix_id")).agg(F.max("copies").alias("copies")).filter("copies > 0")
    taken = _rows(docs).join(copies, F.col("row.doc_id").eqNullSafe(F.col("mix_id")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    _ready(spark)
    return packing.pack(docs, tokenizer_path(), END_ID, WIDTH)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express the language and packing stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH_KEY)
    try:
        for name, stage in STAGES:
            kept = len(common._written)
            docs = stable(stage(spark, docs, sf_dir), f"pipeline-{name}")
            common.release(spark, common._written[kept:-1])  # what the stage wrote on its way, and read for the last time
    finally:
        spark.conf.set(BATCH_KEY, before)
    return docs
