"""Reading, selecting, writing and reloading tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pmtspark.sources.modules import MODULES


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: StructType | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Scan ``path``; only the named columns reach the reader."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        options = {"header": "true", **options}
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.options(**options).load(path)
    return df if columns is None else df.select(*columns)


def read_module(
    spark: SparkSession,
    path: str,
    module: str,
    columns: Sequence[str] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Scan a survey module under its declared schema."""
    return read_table(spark, path, columns, MODULES[module], fmt)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is made
    only where that is unset and the session is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="pmtspark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def write_scratch(df: DataFrame, name: str = "table") -> str:
    """Write ``df`` under a new path of the shared folder and return the path."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_table(df, path)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and scan it back.

    Cuts lineage and keeps column pruning, so a table that several passes read
    is computed once and survives the loss of an executor.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name))


def literal_table(
    spark: SparkSession, columns: Mapping[str, Sequence], schema: str | StructType
) -> DataFrame:
    """Small inline table; shorter columns are recycled to the longest."""
    n = max(len(v) for v in columns.values())
    for name, values in columns.items():
        if n % len(values):
            raise ValueError(f"column {name} of length {len(values)} does not recycle to {n}")
    rows = [tuple(v[i % len(v)] for v in columns.values()) for i in range(n)]
    return spark.createDataFrame(rows, schema)


def pick(df: DataFrame, *keep: str, **renamed: str) -> DataFrame:
    """Keep columns, renaming those given as ``new="old"``."""
    return df.select(*keep, *[F.col(old).alias(new) for new, old in renamed.items()])


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Drop the columns standing between ``first`` and ``last``, both included."""
    names = df.columns
    return df.drop(*names[names.index(first) : names.index(last) + 1])


def strip_labels(df: DataFrame) -> DataFrame:
    """Remove value labels (column metadata)."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={}) for c in df.columns])
