"""A training corpus from ``documents``: quality, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's ``docs``.  The first three keep the
columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, neardup, packing, quality
from tessera.llm.util import discard, free_name, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 7 scores 0.5 or more.

    Null and empty texts are scored like others; rows that share an id are scored each; without labels
    of both kinds every score is the share of label 1, so all rows stay or none; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_documents(docs, labels, keep=0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): that of the least doc_id, nulls last, then the first.

    Rows are told apart by a written row key, so rows with a null doc_id, or with one that others share, are judged like all others.
    Rows without words (null, empty, white space) are no near-duplicates of any; of those that agree in doc_id and text, the first stays.
    """
    name = free_name(docs, "_row")
    rows = materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    groups = neardup.near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"), shingle=5, percent=80)
    groups = groups.select(F.col("doc_id").alias(name), "n_shingles", "component_id")
    keys = rows.select(name, "doc_id", F.xxhash64("doc_id", "text").alias("same")).join(groups, name)
    wordless = F.col("n_shingles") == 0
    group = [wordless.alias("wordless"), F.when(wordless, F.col("same")).otherwise(F.col("component_id")).alias("group")]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(name).alias("row")))
    kept = keys.groupBy(*group).agg(best.alias("best")).select(F.col("best.row").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null texts have no words and stay; rows that share an id are judged each by their text; an empty benchmark drops nothing.
    """
    return decontam.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids.

    A null or empty text is its end token alone; rows that share an id are packed each; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, cache_words=150_000)  # workers are shared with the other stages


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
