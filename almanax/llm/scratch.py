"""Tables that cut lineage, written under the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from almanax.session import clear_scratch as clear
from almanax.session import drop_scratch as drop
from almanax.session import scratch_path as new_path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet and read it back: later uses neither recompute it nor depend on executors that ran it."""
    return read(df.sparkSession, write(df, name), df.schema)


def write(df: DataFrame, name: str) -> str:
    """The path of df's table, which stays until drop() or clear()."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


__all__ = ["clear", "drop", "new_path", "read", "save", "write"]
