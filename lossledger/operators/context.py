"""Plant context, fleet profile, monthly energy and sanity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lossledger.functions import (
    energy_kwh,
    epoch_seconds,
    month_of,
    parse_minute,
    try_parse_minute,
    within,
)
from lossledger.operators.windows import previous_in_series
from lossledger.params import Params
from lossledger.sources.wide import clean_columns

# Output name -> wide column name of the plant signals (fixed values).
PLANT_COLUMNS = {
    "irradiation_w_m2": "Plant / Irradiation_average (W/m²)",
    "altitude_deg": "Plant / Altitude (°)",
    "ambient_temp_c": "Temperature Sensor / Ambient (°C)",
    "module_temp_c": "Temperature Sensor / Module (°C)",
    "dv_pct": "DRD11A / DV (%)",
    "evu_pct": "DRD11A / EVU (%)",
    "janitza_p_ac_kw": "Janitza UMG 604 - DRD11A / P_AC_L1..L3 (kW)",
    "cosphi": "Janitza UMG 604 - DRD11A / CosPhi_L1..L3",
    "s_ac_kva": "Janitza UMG 604 - DRD11A / S_AC_L1..L3 (kVA)",
}


def plant_from_wide(wide: DataFrame, params: Params, timestamp: str = "timestamp") -> DataFrame:
    """Cleaned plant signals with flags; only the nine signal columns are read."""
    cleaned = wide.select(
        parse_minute(F.col(timestamp)).alias("ts"), *clean_columns(wide, PLANT_COLUMNS)
    )
    return plant_flags(cleaned, params)


def plant_flags(plant: DataFrame, params: Params) -> DataFrame:
    """Add three-valued ``is_day`` and ``is_curtailed`` to cleaned plant signals."""
    free = params.curtailment_free_pct
    return plant.withColumns(
        {
            "is_day": F.col("altitude_deg") > params.day_altitude_deg,
            "is_curtailed": (F.col("dv_pct") < free) | (F.col("evu_pct") < free),
        }
    )


def canonical_plant(plant: DataFrame) -> DataFrame:
    """One row per timestamp: mean of each signal, flags combined with OR."""
    return plant.groupBy("ts").agg(
        *[F.avg(c).alias(c) for c in PLANT_COLUMNS],
        F.bool_or("is_day").alias("is_day"),
        F.bool_or("is_curtailed").alias("is_curtailed"),
    )


def canonical_readings(readings: DataFrame) -> DataFrame:
    """One row per (ts, inverter). Repeats, however many, average away map-side."""
    return readings.groupBy("ts", "inverter").agg(
        *[F.avg(c).alias(c) for c in ("p_ac_kw", "i_dc_a", "u_dc_v")]
    )


def plant_controls(plant: DataFrame) -> DataFrame:
    """Set-points and feed-in per timestamp; an unknown set-point means no curtailment."""
    return plant.groupBy("ts").agg(
        F.avg(F.coalesce("dv_pct", F.lit(100.0))).alias("dv_pct"),
        F.avg(F.coalesce("evu_pct", F.lit(100.0))).alias("evu_pct"),
        F.bool_or(F.coalesce("is_curtailed", F.lit(False))).alias("is_curtailed"),
        F.avg(-F.col("janitza_p_ac_kw")).alias("plant_feed_in_kw"),
    )


def error_intervals(error_events: DataFrame) -> DataFrame:
    """One row per (ts, inverter) with an error: smallest code and number of rows."""
    return error_events.groupBy("ts", "inverter").agg(
        F.min("error_code").alias("error_code"), F.count(F.lit(1)).alias("n_error_rows")
    )


def readings_with_context(
    readings: DataFrame, inverters: DataFrame, plant: DataFrame
) -> DataFrame:
    """Readings with device and plant columns; readings without a match are kept."""
    device = inverters.select("inverter", "kwp", "module_type", "manufacturer", "combiner_group")
    weather = plant.select(
        "ts",
        "irradiation_w_m2",
        "altitude_deg",
        "ambient_temp_c",
        "module_temp_c",
        "dv_pct",
        "evu_pct",
        "is_day",
        "is_curtailed",
    )
    return (
        readings.select("ts", "inverter", "p_ac_kw", "i_dc_a", "u_dc_v")
        .join(device, "inverter", "left")
        .join(weather, "ts", "left")
        .withColumn("p_ac_per_kwp", per_kwp())
    )


def per_kwp() -> Column:
    return F.col("p_ac_kw") / F.nullif(F.col("kwp"), F.lit(0.0))


def fleet_profile(readings: DataFrame, inverters: DataFrame, plant: DataFrame) -> DataFrame:
    """Median and mean specific power of the fleet per daylight timestamp.

    One scan of the readings: the join on ``ts`` comes last, so the group by ``ts`` needs no
    further shuffle. A timestamp has one row per device (readings are unique per key), which
    bounds the median's buffer by the number of devices.
    """
    daylight = plant.where("is_day").select("ts")
    specific = F.col("specific")
    return (
        readings.select("ts", "inverter", "p_ac_kw")
        .join(inverters.select("inverter", "kwp").hint("merge"), "inverter")
        .select("ts", "p_ac_kw", per_kwp().alias("specific"))
        .join(daylight, "ts")
        .groupBy("ts")
        .agg(
            F.median(F.when(~F.isnan(specific), specific)).alias("fleet_median_kw_per_kwp"),
            F.avg(specific).alias("fleet_avg_kw_per_kwp"),
            F.count("p_ac_kw").alias("n_reporting"),
        )
    )


def readings_monthly(
    readings: DataFrame, inverters: DataFrame, plant: DataFrame, params: Params
) -> DataFrame:
    joined = (
        readings.select("ts", "inverter", "p_ac_kw")
        .join(inverters.select("inverter", "kwp"), "inverter")
        .join(plant.select("ts", "is_day"), "ts")
    )
    return joined.groupBy(month_of(F.col("ts")).alias("month"), "inverter").agg(
        F.sum(energy_kwh(F.col("p_ac_kw"), params.step_hours)).alias("energy_kwh"),
        F.avg(F.when(F.col("is_day"), per_kwp())).alias("avg_day_kw_per_kwp"),
        F.count(F.lit(1)).alias("n_intervals"),
        F.count_if("is_day").alias("n_day_intervals"),
    )


def meter_check(readings: DataFrame, plant: DataFrame, params: Params) -> DataFrame:
    """Sum of the devices against the plant meter (negative = feed-in) in a sample window."""
    total = F.col("inverter_p_ac_kw")
    gap = F.abs(total + F.col("janitza_p_ac_kw"))
    summed = (
        within(readings, params.meter_check_from, params.meter_check_to)
        .groupBy("ts")
        .agg(F.sum("p_ac_kw").alias("inverter_p_ac_kw"))
        .where(total > params.meter_check_min_kw)
    )
    meter = plant.where(F.col("is_day") & F.col("janitza_p_ac_kw").isNotNull()).select(
        "ts", "janitza_p_ac_kw"
    )
    return summed.join(meter, "ts").agg(
        F.avg(total).alias("avg_inverter_kw"),
        F.avg(-F.col("janitza_p_ac_kw")).alias("avg_janitza_feed_in_kw"),
        F.avg(gap).alias("avg_abs_gap_kw"),
        F.avg(gap / F.nullif(total, F.lit(0.0))).alias("avg_rel_gap"),
    )


def capacity_exceedance(readings: DataFrame, inverters: DataFrame, params: Params) -> DataFrame:
    limit = F.col("kwp") * params.capacity_tolerance
    return (
        readings.join(inverters.select("inverter", "kwp"), "inverter")
        .where(F.col("p_ac_kw") > limit)
        .agg(F.count(F.lit(1)).alias("n_over_capacity"))
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows); every count is one aggregate of the same job."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per cleaned numeric column: rows, numeric rows, min, mean, max, distinct values.

    Columns unpivot in place; distinct values are counted after a map-side
    combined (column, value) aggregate, so no task holds a set of values.
    """
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value"
    )
    values = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n"))
    weight = F.when(F.col("value").isNotNull(), F.col("_n"))
    return values.groupBy("column_name").agg(
        F.sum("_n").alias("n"),
        F.coalesce(F.sum(weight), F.lit(0)).alias("n_numeric"),
        F.min("value").alias("min_value"),
        (F.sum(F.col("value") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("avg_value"),
        F.max("value").alias("max_value"),
        F.count("value").alias("n_distinct"),
    )


def power_ranges(readings: DataFrame) -> DataFrame:
    return readings.groupBy("inverter").agg(
        F.max("p_ac_kw").alias("p_ac_max_kw"),
        F.avg("p_ac_kw").alias("p_ac_avg_kw"),
        F.count("p_ac_kw").alias("n_numeric"),
    )


def timestamp_profile(raw: DataFrame, text_column: str) -> DataFrame:
    """Range, unreadable rows and median step in minutes of raw text timestamps.

    Repeated timestamps count as zero steps. Steps inside a day come from a window
    per day; the step to the next day with data from the day edges, a table with
    one row per calendar day.
    """
    parsed = raw.select(
        F.col(text_column).alias("raw"), try_parse_minute(F.col(text_column)).alias("ts")
    )
    counted = parsed.groupBy("raw", "ts").agg(F.count(F.lit(1)).alias("n"))
    facts = counted.agg(
        F.min("raw").alias("raw_min"),
        F.max("raw").alias("raw_max"),
        F.min("ts").alias("parsed_min"),
        F.max("ts").alias("parsed_max"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("ts").isNull(), F.col("n"))), F.lit(0)).alias(
            "n_parse_failures"
        ),
    )
    distinct = counted.where("ts is not null").select("ts", "n")
    steps = (
        previous_in_series(distinct, "ts", ["n"])
        .select(
            (epoch_seconds(F.col("ts")) - epoch_seconds(F.col("prev_ts"))).cast("double").alias("step"),
            F.col("n"),
        )
    )
    # n - 1 repeats of a timestamp are steps of zero seconds
    weighted = (
        steps.where("step is not null")
        .select("step", F.lit(1).cast("bigint").alias("w"))
        .unionByName(steps.where("n > 1").select(F.lit(0.0).alias("step"), (F.col("n") - 1).alias("w")))
        .groupBy("step")
        .agg(F.sum("w").alias("w"))
    )
    median = weighted.agg(
        (F.percentile("step", F.lit(0.5), F.col("w")) / 60.0).alias("median_delta_minutes")
    )
    return facts.withColumn("median_delta_minutes", median.scalar())
