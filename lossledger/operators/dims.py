"""Device, tariff and ticket dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def roll_up_devices(detail: DataFrame, sheet: str = "sheet", row_no: str = "row_no") -> DataFrame:
    """One row per device from its (possibly several) overview rows.

    Only sums, means, minima and sets of catalog names: all combine map-side.
    """

    def names(column: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(column)), " + ")

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), F.struct(sheet, row_no)))

    group = F.regexp_extract("inverter", r"INV 01\.(\d{2})\.", 1)
    return detail.groupBy("inverter").agg(
        F.sum("kwp").alias("kwp"),
        F.coalesce(F.sum("modules"), F.lit(0.0)).alias("modules"),
        F.coalesce(F.sum("strings"), F.lit(0.0)).alias("strings"),
        names("module_type").alias("module_type"),
        names("manufacturer").alias("manufacturer"),
        F.avg("module_wp").alias("module_wp"),
        F.avg("modules_per_string").alias("modules_per_string"),
        F.first(F.when(group != "", group), ignorenulls=True).alias("combiner_group"),
        first(F.col("location_a")).alias("location_a"),
        first(F.col("location_b")).alias("location_b"),
    )


def monthly_tariffs(tariffs: DataFrame) -> DataFrame:
    return tariffs.groupBy("inverter", "month").agg(F.avg("ct_per_kwh").alias("ct_per_kwh"))
