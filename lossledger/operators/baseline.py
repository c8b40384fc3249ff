"""Physics expectation per device: system efficiency, bands, peer ratio, monthly ratios.

All device groups here are one training year or one month of one device, so with
unique (ts, inverter) rows a group never exceeds window length / step length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lossledger.functions import clip_to_capacity, energy_kwh, month_of, within
from lossledger.operators.quantiles import exact_quantiles
from lossledger.params import Params


def derating(temp_c: Column, params: Params) -> Column:
    """Temperature factor of the module output, with a floor."""
    rise = temp_c - params.reference_temp_c
    return F.greatest(F.lit(params.derate_floor), 1.0 + params.temp_coefficient_per_c * rise)


def known_temperature(params: Params) -> Column:
    return F.coalesce("module_temp_c", "ambient_temp_c", F.lit(params.reference_temp_c))


def ideal_kw(params: Params) -> Column:
    """Output of a loss-free device under the plant's weather; NULL if irradiation is unknown."""
    sun = F.col("irradiation_w_m2") / 1000.0
    return F.col("kwp") * sun * derating(known_temperature(params), params)


def fit_eta(
    readings: DataFrame, inverters: DataFrame, plant: DataFrame, params: Params
) -> DataFrame:
    """Median ratio of real to ideal output over the clean rows of the training window."""
    year = (params.train_from, params.train_to)
    sunny = within(plant, *year).where(
        (F.col("altitude_deg") > params.day_altitude_deg)
        & (F.col("irradiation_w_m2") > params.eta_min_irradiation)
        & ~F.coalesce("is_curtailed", F.lit(False))
    ).select("ts", "irradiation_w_m2", "module_temp_c", "ambient_temp_c")
    ratio = F.col("p_ac_kw") / F.col("_ideal")
    return (
        within(readings, *year)
        .where("p_ac_kw > 0")
        .select("ts", "inverter", "p_ac_kw")
        .join(sunny, "ts")
        .join(inverters.select("inverter", "kwp").hint("merge"), "inverter")
        .withColumn("_ideal", ideal_kw(params))
        .where(F.col("_ideal") > 0)
        .withColumn("_ratio", ratio)
        .where(F.col("_ratio").between(params.eta_ratio_low, params.eta_ratio_high))
        .groupBy("inverter")
        .agg(F.median("_ratio").alias("eta_system"), F.count(F.lit(1)).alias("n_train_points"))
    )


def peer_ratio(power: Column) -> Column:
    """Specific power of a device over the fleet median at the same time."""
    median = F.col("fleet_median_kw_per_kwp")
    specific = power / F.nullif(F.col("kwp"), F.lit(0.0))
    return F.when(median != 0, specific / median)


def physics_predictions(
    readings: DataFrame,
    inverters: DataFrame,
    plant: DataFrame,
    eta: DataFrame,
    fleet: DataFrame,
    params: Params,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """p50/p10/p90 of the physics model within [0, capacity], and the peer ratio.

    ``carry``: plant columns to keep beside them.

    Weather and fleet profile meet first (both one row per timestamp), device
    facts and efficiency likewise, so the readings are joined twice only.
    """
    signals = dict.fromkeys(["irradiation_w_m2", "module_temp_c", "ambient_temp_c", *carry])
    weather = plant.select("ts", *signals).join(
        fleet.select("ts", "fleet_median_kw_per_kwp"), "ts", "left"
    )
    device = inverters.select("inverter", "kwp").join(
        eta.select("inverter", "eta_system"), "inverter", "left"
    )
    expected = ideal_kw(params) * F.coalesce("eta_system", F.lit(params.default_eta))
    capacity = F.col("kwp")
    return (
        readings.select("ts", "inverter", "p_ac_kw")
        .join(weather, "ts")
        .join(device, "inverter")
        .select(
            "ts",
            "inverter",
            clip_to_capacity(expected, capacity).alias("p50_physics_kw"),
            clip_to_capacity(expected * params.physics_p10_factor, capacity).alias("p10_physics_kw"),
            clip_to_capacity(expected * params.physics_p90_factor, capacity).alias("p90_physics_kw"),
            "eta_system",
            peer_ratio(F.col("p_ac_kw")).alias("peer_ratio"),
            "p_ac_kw",
            *carry,
        )
    )


def performance_ratio_monthly(
    readings: DataFrame, inverters: DataFrame, plant: DataFrame, params: Params
) -> DataFrame:
    sun = plant.where(
        F.col("is_day") & (F.col("irradiation_w_m2") > params.model_day_irradiation)
    ).select("ts", "irradiation_w_m2")
    reference = F.col("kwp") * (F.col("irradiation_w_m2") / 1000.0) * params.step_hours
    return (
        readings.where(F.col("p_ac_kw").isNotNull())
        .select("ts", "inverter", "p_ac_kw")
        .join(sun, "ts")
        .join(inverters.select("inverter", "kwp"), "inverter")
        .groupBy(month_of(F.col("ts")).alias("month"), "inverter")
        .agg(
            F.sum(energy_kwh(F.col("p_ac_kw"), params.step_hours)).alias("actual_energy_kwh"),
            F.sum(reference).alias("reference_energy_kwh"),
        )
        .withColumn(
            "performance_ratio",
            F.col("actual_energy_kwh") / F.nullif(F.col("reference_energy_kwh"), F.lit(0.0)),
        )
    )


def physics_monthly(predictions: DataFrame, params: Params) -> DataFrame:
    """Monthly actual, expected and positive shortfall, with daylight peer ratios.

    ``predictions`` carries the reading, ``is_day`` and ``irradiation_w_m2``, so no long
    table is joined again.
    """
    expected = F.col("p50_physics_kw")
    shortfall = expected - F.coalesce("p_ac_kw", F.lit(0.0))
    step = params.step_hours
    bright = F.col("is_day") & (F.col("irradiation_w_m2") > params.train_min_irradiation)
    peers = F.when(bright, F.col("peer_ratio"))
    return (
        predictions.groupBy(month_of(F.col("ts")).alias("month"), "inverter")
        .agg(
            F.sum(energy_kwh(F.col("p_ac_kw"), step)).alias("actual_energy_kwh"),
            F.sum(energy_kwh(expected, step)).alias("physics_expected_kwh"),
            F.sum(energy_kwh(shortfall, step)).alias("positive_shortfall_kwh"),
            F.median(peers).alias("median_peer_ratio"),
            F.avg(peers).alias("avg_peer_ratio"),
        )
    )


def _spread(df: DataFrame, value: str, stat: str) -> DataFrame:
    """(stat, min, median, max) of one column over a whole table."""
    ends = {"min_value": 0.0, "median_value": 0.5, "max_value": 1.0}
    return exact_quantiles(df, [], value, ends).withColumn("stat", F.lit(stat))


def physics_stats(eta: DataFrame, ratio: DataFrame, monthly: DataFrame) -> DataFrame:
    """Spread of efficiency, training points, performance ratio and peer ratio over the fleet."""
    large = ratio.where(F.col("reference_energy_kwh") > 100)
    return (
        _spread(eta, "eta_system", "eta_system")
        .unionByName(_spread(eta, "n_train_points", "n_train_points"))
        .unionByName(_spread(large, "performance_ratio", "performance_ratio"))
        .unionByName(_spread(monthly, "median_peer_ratio", "median_peer_ratio"))
    )


def daily_peak(plant: DataFrame, params: Params) -> DataFrame:
    """When the sun stands highest in a sample window; the earliest row wins a tie.

    The peak row of a day is an aggregate that combines map-side.
    """
    ts = F.col("ts")
    at = F.col("peak.ts")
    return (
        within(plant, params.peak_from, params.peak_to)
        .where("altitude_deg is not null")
        .groupBy(ts.cast("date").alias("d"))
        .agg(
            F.max("altitude_deg").alias("altitude_deg"),
            F.min_by(F.struct("ts"), F.struct(-F.col("altitude_deg"), ts)).alias("peak"),
        )
        .agg(
            F.avg(F.hour(at) * 60 + F.minute(at)).alias("avg_peak_minute"),
            F.min(at).alias("first_peak"),
            F.max(at).alias("last_peak"),
            F.avg("altitude_deg").alias("avg_max_altitude"),
        )
    )
