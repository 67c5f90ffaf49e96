"""Global numbering and ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import materialize


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """Adds the row's number in the given order: range partitions, their sizes, numbers within."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # one row a partition
    sizes = sizes.select("_part", "_low", before.alias("_before"))
    out = ranged.join(F.broadcast(sizes), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at") - F.col("_low") + first).drop("_part", "_at", "_n", "_low", "_before")


def rank_by_mean(means: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """(id, score, rank) of rows with the mean score of their neighbours (src, score): best first, ties by position; no neighbours is null and last."""
    scored = rows.select(F.col(id_col).alias("_id")).join(means, F.col("_id") == F.col("src"), "left").select(F.col("_id").alias(id_col), "score")
    return numbered(scored, [F.col("score").desc_nulls_last(), F.col(id_col).asc()], "rank")
