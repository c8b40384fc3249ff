"""Tables, appends, CSV exports and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace a Parquet table and return it as a fresh scan with short lineage."""
    _writer(df, partition_by).mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add one batch; the whole fleet goes in a single distributed write."""
    _writer(df, partition_by).mode("append").parquet(path)


def _writer(df: DataFrame, partition_by: list[str] | None):
    if not partition_by:
        return df.write
    # One shuffle by partition value and file share, so a month that holds most
    # rows is still written by many tasks (AQE splits oversized shares).
    return df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)


def export_csv(df: DataFrame, path: str, order: list[Column | str] | None = None) -> None:
    """Comma-separated text with a header; range-sorted files when an order is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
