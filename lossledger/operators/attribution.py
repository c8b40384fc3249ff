"""From readings and expectation to one cause and one price per lost interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lossledger import params as P
from lossledger.functions import code_base, month_of
from lossledger.operators.baseline import peer_ratio
from lossledger.operators.twin import predict
from lossledger.operators.windows import count_within_reach
from lossledger.params import Params


def describe_codes(errors: DataFrame, catalog: DataFrame, params: Params) -> DataFrame:
    """Add base code, description and severity of ``error_code``; unknown codes stay."""
    texts = catalog.select(
        F.col("code").alias("error_code_base"),
        F.col("description").alias("error_description"),
        F.col("severity_class").alias("error_severity"),
    )
    return errors.withColumn(
        "error_code_base", code_base(F.col("error_code"), params.code_modulus)
    ).join(texts, "error_code_base", "left")


def lookup_code(catalog: DataFrame, code: int, params: Params) -> DataFrame:
    """The catalog row of one full error code."""
    return catalog.where(F.col("code") == int(code) % params.code_modulus).select(
        "code", "description", "severity_class"
    )


def error_context(
    errors: DataFrame, known_times: DataFrame, catalog: DataFrame, params: Params
) -> DataFrame:
    """Errors spread over the neighbouring intervals, smallest code first, known times only.

    The few offsets expand in place and collapse again in a map-side combined
    aggregate; the time filter is a semi join.
    """
    offsets = F.array(*[F.lit(m) for m in params.dilation_offsets_minutes])
    shifted = F.timestamp_add("MINUTE", F.col("_offset"), F.col("ts"))
    spread = (
        errors.withColumn("_offset", F.explode(offsets))
        .groupBy(shifted.alias("ts"), "inverter")
        .agg(F.min("error_code").alias("error_code"), F.count(F.lit(1)).alias("n_error_rows"))
        .join(known_times.select("ts"), "ts", "left_semi")
    )
    return describe_codes(spread, catalog, params)


def moments(binned_features: DataFrame, controls: DataFrame, fleet: DataFrame) -> DataFrame:
    """All that is known about a timestamp in one row."""
    return binned_features.join(
        controls.select("ts", "dv_pct", "evu_pct", "plant_feed_in_kw"), "ts", "left"
    ).join(fleet.select("ts", "fleet_median_kw_per_kwp"), "ts", "left")


def interval_base(
    readings: DataFrame,
    moments: DataFrame,
    models: DataFrame,
    params: Params,
    predictor=None,
    features: tuple[str, ...] = (),
    model_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Readings in model daylight with bands, set-points, feed-in and fleet median.

    Timestamp facts are one row per timestamp and device facts one row per device,
    so the long readings take part in exactly two joins. ``predictor`` (default: the
    power-curve twin) gives the bands; ``features`` are the timestamp columns it needs
    besides, and ``model_columns`` the device columns it leaves that later steps do not read.
    """
    predictor = predictor or predict
    extra = [c for c in features if c not in ("irradiation_w_m2",)]
    daylight = moments.where("is_model_day").select(
        "ts",
        "irradiation_w_m2",
        "bin",
        "fleet_p50_per_kwp",
        "is_model_day",
        "dv_pct",
        "evu_pct",
        "plant_feed_in_kw",
        "fleet_median_kw_per_kwp",
        *extra,
    )
    zero = F.lit(0.0)
    rows = readings.select(
        "ts",
        "inverter",
        F.greatest(F.coalesce("p_ac_kw", zero), zero).alias("actual_kw"),
        F.col("p_ac_kw").isNull().alias("actual_missing"),
    )
    return (
        predictor(rows, daylight, models, params)
        .where("p50_twin_kw > 0")
        .withColumns(
            {
                "peer_ratio": peer_ratio(F.col("actual_kw")),
                "below_p10": ~F.col("actual_missing") & (F.col("actual_kw") < F.col("p10_twin_kw")),
            }
        )
        .drop("curve", "bin", "fleet_p50_per_kwp", "eta_system")
        .drop("low_factor", "low_shift", "high_factor", "high_shift")
        .drop(*extra, *model_columns)
    )


def with_persistence(rows: DataFrame, params: Params) -> DataFrame:
    """Count the below-band intervals of the same device around each row."""
    return count_within_reach(
        rows,
        ["inverter"],
        "ts",
        F.col("below_p10"),
        params.persistence_reach_minutes * 60,
        "below_p10_count",
    )


def _curtailed(signal: str, params: Params) -> Column:
    return F.col(signal) < params.curtail_threshold_pct


def cause(total_kwp: Column, params: Params) -> Column:
    """First matching cause of an interval, NULL when none applies."""
    fleet = F.coalesce("fleet_median_kw_per_kwp", F.lit(0.0))
    fleet_alive = fleet > params.fleet_alive
    missing = F.col("actual_missing")
    feed_in = F.col("plant_feed_in_kw")
    plant_produces = feed_in.isNull() | (feed_in > params.data_gap_ratio * fleet * total_kwp)
    dead = missing | (F.col("actual_kw") <= params.dead_share * F.col("kwp"))
    lasting = F.col("below_p10_count") >= params.persistence_min_count
    return (
        F.when(_curtailed("evu_pct", params), P.GRID)
        .when(_curtailed("dv_pct", params), P.PRICE)
        .when(F.col("error_code").isNotNull(), P.FAULT)
        .when(missing & fleet_alive & plant_produces, P.DATA_GAP)
        .when(dead & fleet_alive, P.OUTAGE)
        .when(F.col("below_p10") & lasting, P.UNDERPERFORMANCE)
    )


def effective_actual(params: Params) -> Column:
    """Output that a curtailed device is judged by: never above its set-point."""
    actual = F.col("actual_kw")

    def setpoint(signal: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(signal) / 100.0 * F.col("kwp"))

    return (
        F.when(_curtailed("evu_pct", params), F.least(actual, setpoint("evu_pct")))
        .when(_curtailed("dv_pct", params), F.least(actual, setpoint("dv_pct")))
        .otherwise(actual)
    )


def loss_intervals(
    base: DataFrame,
    errors: DataFrame,
    tariffs: DataFrame,
    total_kwp: Column,
    params: Params,
) -> DataFrame:
    """Classified and priced intervals.

    Every below-band row is a candidate, so counting persistence among candidates
    equals counting it among all rows; the window and the joins with errors and
    tariffs therefore run on the few candidate rows only. Errors and tariffs grow with the
    fleet and pack into small files: the hints keep them from being broadcast.
    """
    actual, p50 = F.col("actual_kw"), F.col("p50_twin_kw")
    held_back = F.coalesce(_curtailed("evu_pct", params), F.lit(False)) | F.coalesce(
        _curtailed("dv_pct", params), F.lit(False)
    )
    candidates = base.where(
        (held_back & (actual < p50)) | (actual < F.col("p10_twin_kw")) | F.col("actual_missing")
    )
    lost_kw = F.greatest(p50 - F.col("effective_actual_kw"), F.lit(0.0))
    lost = (
        with_persistence(candidates, params)
        .join(errors.drop("n_error_rows").hint("merge"), ["ts", "inverter"], "left")
        .withColumns({"bucket": cause(total_kwp, params), "effective_actual_kw": effective_actual(params)})
        .withColumn("lost_kw", lost_kw)
        .where(F.col("bucket").isNotNull() & (F.col("lost_kw") > params.min_loss_kw))
        .withColumn("month", month_of(F.col("ts")))
    )
    price = F.coalesce("ct_per_kwh", F.lit(params.default_ct_per_kwh))
    lost_kwh = F.col("lost_kw") * params.step_hours
    prices = tariffs.select("inverter", "month", "ct_per_kwh").hint("merge")
    return lost.join(prices, ["inverter", "month"], "left").select(
        "ts",
        "inverter",
        F.year("ts").alias("year"),
        "month",
        "module_type",
        "bucket",
        "error_code",
        "error_code_base",
        "error_description",
        "error_severity",
        "kwp",
        "actual_kw",
        "effective_actual_kw",
        "p10_twin_kw",
        "p50_twin_kw",
        "p90_twin_kw",
        "irradiation_w_m2",
        "dv_pct",
        "evu_pct",
        "peer_ratio",
        "fleet_median_kw_per_kwp",
        price.alias("ct_per_kwh"),
        "lost_kw",
        lost_kwh.alias("lost_kwh"),
        (lost_kwh * price / 100.0).alias("lost_eur"),
    )
