"""Training-corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it gets and returns a
DataFrame that is written and read again as the next one's docs. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrispark.llm import decontaminate, exact_dedup, language, packing, simhash
from agrispark.llm.common import keep_rows, materialize, prepare, remove, scratch
from agrispark.llm.queries import SEQUENCE, tokenizer_path
from agrispark.session import table_path

#: A document in which no language makes up this much is rejected, and one without letters.
MIN_LANGUAGE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told (null and empty texts too). Null and repeated ids are rows like others; no rows give none."""
    prepare(spark)
    return language.identify(docs, keep_above=MIN_LANGUAGE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of equal texts (null counts as empty, a null id as the lowest); of repeated rows one."""
    prepare(spark)
    found = exact_dedup.exact_duplicates(docs)
    return keep_rows(docs, found.select("id", F.col("text_sha256").alias("sha"), "kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate component; texts without words are one component. No rows give none."""
    prepare(spark)
    found = simhash.near_duplicates(docs, shingle=3, max_distance=2)
    kept = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("first_sha"))
    return keep_rows(docs, found.select("id", "sha", kept.alias("kept")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none and stay, and an empty benchmark drops nothing."""
    prepare(spark)
    return decontaminate.clean_rows(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a null or empty text is its end token."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path(), SEQUENCE).withColumnRenamed("id", "doc_id").drop("ids")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("packing", packed)]

#: No SQL: language models, SimHash components and edit distances are checked against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it.

    When a stage's table is written, the tables that it needed on the way and
    the one it read are deleted; those of the last stage stay, its result is read from them.
    """
    docs, before = spark.read.parquet(table_path(sf_dir, "documents")), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept = made.pop()
        remove(spark, before)
        before = [kept]
    return STAGES[-1][1](spark, docs, sf_dir)
