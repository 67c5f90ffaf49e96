"""Shared helpers: written tables in the shared folder, sessions, text kernels."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import discard, fresh_path, materialize  # noqa: F401

#: ASCII capitals only: the contracts lower-case A-Z and leave other letters.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is written by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; extra columns never reach an operator."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
