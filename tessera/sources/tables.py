"""Sources, sinks and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POS = "_pos"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where one process runs all (tests, local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the folder in spark.checkpoint.dir and reread it: cuts lineage, survives lost executors.  With ``path``: add it to what lies there."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


#: Rows of a few numbers each that one broadcast may hold.
FEW = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """``df`` broadcast to what it is joined with where it has at most FEW rows, so that this is not shuffled; read twice."""
    return F.broadcast(df) if df.count() <= FEW else df


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options: Any) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(fmt).mode(mode).save(path)


def as_list(records: Any) -> Any:
    """Rows of a pandas frame as dictionaries; strings and dictionaries as they are."""
    return records.to_dict("records") if hasattr(records, "to_dict") and hasattr(records, "iloc") else records


def prepare(spark: SparkSession, records: DataFrame | Sequence, columns: Sequence[str] | None, order_by: str | Sequence[str] | None = None) -> tuple[DataFrame, list[str], bool]:
    """(rows with ``_pos``, columns, whether they were strings).

    Lists are numbered as they come.  A DataFrame has no order of its own, so it
    needs ``order_by``: columns that order its rows; a single column of integers
    is taken as the position itself.
    """
    if isinstance(records, DataFrame):
        if columns is None:
            raise ValueError("columns must be given for a DataFrame")
        if missing := [c for c in columns if c not in records.columns]:
            raise ValueError(f"no such columns: {missing}")
        if order_by is None:
            raise ValueError("order_by must be given for a DataFrame")
        names = [order_by] if isinstance(order_by, str) else list(order_by)
        if len(names) == 1 and dict(records.dtypes)[names[0]] in ("bigint", "int"):
            return records.withColumn(POS, F.col(names[0]).cast("long")), list(columns), False
        from tessera.operators.ranking import numbered

        return numbered(records, [F.col(n).asc() for n in names], POS, 0), list(columns), False
    records = as_list(records)
    if len(records) == 0:
        raise ValueError("there are no records")
    if isinstance(records[0], str):
        rows = [(i, str(r)) for i, r in enumerate(records)]
        return spark.createDataFrame(rows, f"{POS} long, text string"), ["text"], True
    if columns is None:
        raise ValueError("dictionaries need the columns that make up their key")
    names = list(dict.fromkeys(k for r in records for k in r))
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"no such columns: {missing}")
    rows = [{POS: i, **{k: r.get(k, "" if k in columns else None) for k in names}} for i, r in enumerate(records)]
    return spark.createDataFrame(rows), list(columns), False


def check_like(records: DataFrame | Sequence, was_string: bool, columns: Sequence[str]) -> None:
    """Later inputs must fit the first: strings only where strings were fitted, no mixture."""
    if isinstance(records, DataFrame):
        if missing := [c for c in columns if c not in records.columns]:
            raise ValueError(f"no such columns: {missing}")
        return
    records = as_list(records)
    if len(records) == 0:
        raise ValueError("there are no records")
    kinds = {isinstance(r, str) for r in records}
    if len(kinds) > 1 or not all(isinstance(r, str | dict) for r in records):
        raise ValueError("records must be all strings or all dictionaries")
    if kinds == {True} and not was_string:
        raise ValueError("strings were passed, but the index was not fitted on strings")
