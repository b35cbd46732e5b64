"""Sinks (S15-S18, S22, S23): guarded, split, appended, dated.  Tables that are upserted are in ``versions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """S15."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_once(df: DataFrame, path: str) -> None:
    """Fails if there is anything already."""
    df.write.mode("errorifexists").parquet(path)


def write_split(df: DataFrame, path: str, stage: str, log: DataFrame | None = None) -> None:
    """One folder for each status, and the reason log beside them."""
    df.write.mode("overwrite").partitionBy(f"{stage}_status").parquet(f"{path}/{stage}")
    if log is not None:
        log.write.mode("overwrite").parquet(f"{path}/{stage}_log")


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """S18."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def export_bundle(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """S22."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}/{name}")


def save_cache(df: DataFrame, path: str, **key: str) -> None:
    """Dated cache, keyed by name, mode, period and date as partitions."""
    folder = "/".join(f"{k}={v}" for k, v in key.items())
    df.write.mode("overwrite").parquet(f"{path}/{folder}")


def load_cache(spark: SparkSession, path: str, **key: str) -> DataFrame:
    df = spark.read.option("basePath", path).parquet(path)
    for k, v in key.items():
        df = df.where(F.col(k).cast("string") == v)
    return df
