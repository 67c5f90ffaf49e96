"""Exact copies by key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.records import same_key
from tessera.sources.tables import POS


def with_groups(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``group_pos``: the least position of the record's key (nulls are equal).

    An aggregate and a join rather than a window: partial sums shrink a key that
    holds many rows before the shuffle, and a skewed join can be split.
    """
    first = records.groupBy(*columns).agg(F.min(POS).alias("group_pos"))
    joined = records.alias("r").join(first.alias("g"), same_key("r", "g", columns))
    return joined.select("r.*", "g.group_pos")


def match_exact(queries: DataFrame, records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Queries with ``group_pos`` of the fitted item of the same key, or null."""
    items = records.where(F.col(POS) == F.col("group_pos")).select(*columns, "group_pos")
    return queries.alias("q").join(items.alias("i"), same_key("q", "i", columns), "left").select("q.*", F.col("i.group_pos").alias("group_pos"))
