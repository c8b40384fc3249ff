"""Long-term performance trend per device (Theil-Sen) and per module type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lossledger.functions import energy_kwh, month_of
from lossledger.operators.quantiles import exact_quantiles
from lossledger.operators.twin import predict
from lossledger.params import Params

# Normal quantile at 0.05: two-sided 90 % interval.
_Z = -1.6448536269514729


def monthly_health(
    readings: DataFrame,
    moments: DataFrame,
    models: DataFrame,
    error_intervals: DataFrame,
    params: Params,
) -> DataFrame:
    """Energy ratio and median ratio to the twin per device and month, clean rows only.

    A group is one device in one calendar month.
    """
    clear = moments.where(
        F.col("is_day")
        & (F.col("irradiation_w_m2") > params.health_min_irradiation)
        & ~F.col("is_curtailed")
    ).select("ts", "bin", "fleet_p50_per_kwp", "is_model_day")
    rows = (
        readings.where("p_ac_kw > 0")
        .select("ts", "inverter", "p_ac_kw")
        .join(error_intervals.select("ts", "inverter").hint("merge"), ["ts", "inverter"], "left_anti")
    )
    p50 = F.col("p50_twin_kw")
    step = params.step_hours
    return (
        predict(rows, clear, models, params)
        .where(p50 > params.health_min_expected_share * F.col("kwp"))
        .groupBy(month_of(F.col("ts")).alias("month"), "inverter")
        .agg(
            F.min("module_type").alias("module_type"),
            F.min("kwp").alias("kwp"),
            F.count(F.lit(1)).alias("n_points"),
            F.sum(energy_kwh(F.col("p_ac_kw"), step)).alias("actual_kwh"),
            F.sum(energy_kwh(p50, step)).alias("expected_kwh"),
            F.median(F.col("p_ac_kw") / F.nullif(p50, F.lit(0.0))).alias("median_ratio"),
        )
        .where(F.col("n_points") >= params.health_min_points)
        .withColumn(
            "energy_ratio", F.col("actual_kwh") / F.nullif(F.col("expected_kwh"), F.lit(0.0))
        )
    )


def _middle(values: Column) -> Column:
    """Median of a sorted array."""
    last = F.size(values) - 1
    low = F.get(values, F.floor(last / 2.0).cast("int"))
    high = F.get(values, F.ceil(last / 2.0).cast("int"))
    return (low + high) / 2.0


def theil_sen(health: DataFrame, params: Params) -> DataFrame:
    """Median pair slope of the monthly ratio per device with its 90 % interval (Sen 1968).

    A device's months form one array (its length is the number of calendar months),
    and the pair slopes are computed inside that row: no pair ever becomes a row
    and the only shuffle is the one that gathers the months. Its partition count is
    stated because the work per byte is large, so partitions should not be merged
    by size.
    """
    y = F.col("median_ratio")
    tasks = int(health.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = (
        health.repartition(tasks, "inverter")
        .where((F.col("month") >= F.lit(params.trend_from).cast("date")) & y.isNotNull())
        .groupBy("inverter")
        .agg(
            F.min_by("module_type", "month").alias("module_type"),
            F.min("month").alias("_origin"),
            F.sort_array(
                F.collect_list(F.when((y > 0) & ~F.isnan(y), F.struct("month", y.alias("y"))))
            ).alias("_raw"),
        )
        .where(F.size("_raw") >= params.trend_min_months)
        .withColumn(
            "_points",
            F.transform(
                "_raw",
                lambda p: F.struct(
                    (F.datediff(p.month, F.col("_origin")) / params.days_per_year).alias("x"),
                    p.y.alias("y"),
                ),
            ),
        )
    )
    pair_slopes = F.flatten(
        F.transform(
            "_points",
            lambda p, i: F.transform(
                F.slice("_points", F.lit(1), i), lambda q: (p.y - q.y) / (p.x - q.x)
            ),
        )
    )
    ys = F.sort_array(F.transform("_points", lambda p: p.y))
    xs = F.transform("_points", lambda p: p.x)
    # months are distinct, so only equal y values form tie groups
    distinct = F.array_distinct("_ys")
    tie_term = F.when(F.size(distinct) == F.size("_ys"), 0.0).otherwise(
        F.aggregate(
            distinct,
            F.lit(0.0),
            lambda total, v: total + _tie(F.size(F.filter("_ys", lambda w: w == v)).cast("double")),
        )
    )
    n = F.size("_ys").cast("double")
    n_pairs = F.size("_slopes").cast("double")
    sigma = F.sqrt((n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18.0)
    upper = F.least(F.bround((n_pairs - _Z * sigma) / 2.0), n_pairs - 1).cast("int")
    lower = F.greatest(F.bround((n_pairs + _Z * sigma) / 2.0) - 1, F.lit(0.0)).cast("int")
    slope = F.col("_slope")
    return (
        points.withColumns(
            {"_slopes": F.sort_array(pair_slopes), "_ys": ys, "_xs": xs}
        )
        .withColumn("_ties", tie_term)
        .withColumn("_slope", _middle(F.col("_slopes")))
        .select(
            "inverter",
            "module_type",
            F.size("_ys").alias("n_months"),
            F.element_at("_raw", 1).month.alias("first_month"),
            F.element_at("_raw", -1).month.alias("last_month"),
            F.element_at("_raw", 1).y.alias("start_ratio"),
            F.element_at("_raw", -1).y.alias("end_ratio"),
            slope.alias("slope_ratio_per_year"),
            (slope * 100.0).alias("slope_pct_per_year"),
            (F.get("_slopes", lower) * 100.0).alias("ci_low_pct_per_year"),
            (F.get("_slopes", upper) * 100.0).alias("ci_high_pct_per_year"),
            (_middle(F.col("_ys")) - slope * _middle(F.col("_xs"))).alias("intercept_ratio"),
        )
    )


def _tie(k: Column) -> Column:
    return k * (k - 1) * (2 * k + 5)


def slopes_by_module(slopes: DataFrame) -> DataFrame:
    """Trend per module type; devices of unknown type form their own group."""
    value = "slope_pct_per_year"
    counts = slopes.groupBy("module_type").agg(
        F.count(F.lit(1)).alias("n_inverters"), F.avg(value).alias("mean_slope_pct_per_year")
    )
    spread = exact_quantiles(
        slopes,
        ["module_type"],
        value,
        {
            "median_slope_pct_per_year": 0.5,
            "p10_slope_pct_per_year": 0.1,
            "p90_slope_pct_per_year": 0.9,
        },
    ).withColumnRenamed("module_type", "_type")
    return counts.join(spread, F.col("module_type").eqNullSafe(F.col("_type")), "left").drop("_type")


def slope_summary(slopes: DataFrame) -> DataFrame:
    """Number of devices with a trend and the range of their slopes."""
    value = "slope_pct_per_year"
    spread = {f"{k}_slope_pct_per_year": p for k, p in (("min", 0.0), ("median", 0.5), ("max", 1.0))}
    number = slopes.agg(F.count(F.lit(1))).scalar()
    return exact_quantiles(slopes, [], value, spread).withColumn("n_inverters", number)


def major_groups(slopes: DataFrame, params: Params) -> DataFrame:
    """Each device with its module group; types with few devices share one group.

    Type sizes are a small aggregate joined back, so a type holding most devices
    is not gathered in one window.
    """
    sizes = slopes.groupBy("module_type").agg(F.count(F.lit(1)).alias("_size"))
    major = sizes.where(F.col("_size") >= params.major_group_size).select(
        F.col("module_type").alias("_major")
    )
    other = f"Other (n<{params.major_group_size})"
    return slopes.join(major, F.col("module_type") == F.col("_major"), "left").withColumn(
        "module_group", F.coalesce("_major", F.lit(other))
    ).drop("_major")


def group_quartiles(grouped: DataFrame) -> DataFrame:
    """Box-plot figures of the slope per module group."""
    value = "slope_pct_per_year"
    counts = grouped.groupBy("module_group").agg(F.count(F.lit(1)).alias("n_inverters"))
    box = {"min_slope": 0.0, "q1_slope": 0.25, "median_slope": 0.5, "q3_slope": 0.75, "max_slope": 1.0}
    return counts.join(exact_quantiles(grouped, ["module_group"], value, box), "module_group")
