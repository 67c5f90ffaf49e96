"""Record-level column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dict_to_string(columns: Sequence[str]) -> Column:
    """Values in column order, joined by tabs; tabs inside a value become spaces, null is empty."""
    return F.concat_ws("\t", *[F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t", " ") for c in columns])


def full_record(columns: Sequence[str]) -> Column:
    """The whole record as canonical JSON: columns by name, so nested values and maps compare too."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def same_key(left: str, right: str, columns: Sequence[str]) -> Column:
    """Null-safe equality of the key columns of two aliased frames."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out
