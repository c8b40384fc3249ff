"""Reading wide telemetry: one row per timestamp, one column per (device, signal)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lossledger.functions import clean_number

# Layout of the wide column names.
SIGNAL_PATTERN = r"^(INV \d{2}\.\d{2}\.\d{3}) / (P_AC|I_DC_SUM|U_DC)"
ERROR_PATTERN = r"^(INV \d{2}\.\d{2}\.\d{3}) / (Error|Operational State)"
INDEX_COLUMN = "__index_level_0__"


def read_wide(spark: SparkSession, path: str, timestamp: str = "timestamp") -> DataFrame:
    """Lazy Parquet scan; later selects prune the columns that are read."""
    return recover_timestamp(spark.read.parquet(path), timestamp)


def recover_timestamp(wide: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """A timestamp that was saved as a data-frame index comes back as an ordinary column."""
    if timestamp in wide.columns:
        return wide
    if INDEX_COLUMN in wide.columns:
        return wide.withColumnRenamed(INDEX_COLUMN, timestamp)
    raise ValueError(f"no column {timestamp!r} and no saved index in {wide.columns[:5]}...")


def device_signals(columns: list[str], pattern: str = SIGNAL_PATTERN) -> dict[str, dict[str, str]]:
    """{device: {signal: column name}} found by name, devices in order. Works on the schema only."""
    found: dict[str, dict[str, str]] = {}
    for name in columns:
        match = re.match(pattern, name)
        if match:
            found.setdefault(match.group(1), {})[match.group(2)] = name
    return {device: found[device] for device in sorted(found)}


def clean_columns(df: DataFrame, columns: dict[str, str]) -> list[Column]:
    """Cleaned doubles for ``{output: source}``; numeric sources skip the text round trip."""
    out = []
    for name, source in columns.items():
        if source not in df.columns:
            out.append(F.lit(None).cast("double").alias(name))
            continue
        col = F.col(f"`{source}`")
        numeric = isinstance(df.schema[source].dataType, T.NumericType)
        out.append((col.cast("double") if numeric else clean_number(col)).alias(name))
    return out


def read_extract(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A sheet extract with a ``row_no`` column, CSV (with header) or Parquet by file ending."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)
