"""Survey modules on disk -> the household analysis table on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pmtspark.operators.households import build_households
from pmtspark.sources import MODULES, read_module, read_table, write_table


def prepare_households(
    spark: SparkSession, folder: str, out: str, fmt: str = "parquet"
) -> DataFrame:
    """Read every module under ``folder``, write the analysis table, scan it back."""
    suffix = "csv" if fmt == "csv" else "parquet"
    modules = {m: read_module(spark, f"{folder}/{m}.{suffix}", m, fmt=fmt) for m in MODULES}
    write_table(build_households(modules), out)
    return read_table(spark, out)
