"""Learned expectation per device ("twin") with calibrated bands.

Two learners share features, split, metrics and bands:

* the power-curve twin, the default: per device the median specific power in each
  bin of the physics value, falling back to the fleet's bin, then to physics;
* the pooled boosted-tree twin: one distributed fit over all devices.

A bin depends on the timestamp only. Expected energy over any period is therefore
(rows per bin) x (curve value), with no need for the timestamps x devices grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lossledger.functions import clip_to_capacity, cyclic_features, month_of, within
from lossledger.operators.baseline import derating
from lossledger.operators.quantiles import exact_quantiles
from lossledger.operators.windows import rolling_neighbours
from lossledger.params import Params

# Model values are kept to these digits. A reading can lie exactly on its band end;
# rounding makes that comparison the same whatever order values were summed in.
_CURVE_DIGITS = 12
_RESIDUAL_DIGITS = 9

FEATURES = (
    "irradiation_w_m2",
    "altitude_deg",
    "module_temp_c",
    "ambient_temp_c",
    "irradiation_roll15_mean",
    "irradiation_roll15_std",
    "hour_sin",
    "hour_cos",
    "doy_sin",
    "doy_cos",
)


def twin_features(plant: DataFrame, params: Params) -> DataFrame:
    """One row of environment features per timestamp; gaps in the signals get defaults."""
    zero = F.lit(0.0)
    single = plant.groupBy("ts").agg(
        F.avg(F.greatest(F.coalesce("irradiation_w_m2", zero), zero)).alias("irradiation_w_m2"),
        F.avg(F.coalesce("altitude_deg", F.lit(-90.0))).alias("altitude_deg"),
        F.avg(F.coalesce("module_temp_c", "ambient_temp_c", F.lit(25.0))).alias("module_temp_c"),
        F.avg(F.coalesce("ambient_temp_c", "module_temp_c", F.lit(20.0))).alias("ambient_temp_c"),
        F.bool_or(F.coalesce("is_curtailed", F.lit(False))).alias("is_curtailed"),
        F.bool_or(F.coalesce("is_day", F.lit(False))).alias("is_day"),
    )
    irradiation = F.col("irradiation_w_m2")
    rolled = rolling_neighbours(single, "ts", "irradiation_w_m2")
    return rolled.select(
        "ts",
        "irradiation_w_m2",
        "altitude_deg",
        "module_temp_c",
        "ambient_temp_c",
        F.coalesce("irradiation_w_m2_roll_mean", irradiation).alias("irradiation_roll15_mean"),
        F.coalesce("irradiation_w_m2_roll_std", zero).alias("irradiation_roll15_std"),
        *[c.alias(name) for name, c in cyclic_features(F.col("ts")).items()],
        (irradiation / 1000.0 * derating(F.col("module_temp_c"), params)).alias(
            "physics_base_kw_per_kwp"
        ),
        "is_day",
        "is_curtailed",
        (F.col("is_day") & (irradiation > params.model_day_irradiation)).alias("is_model_day"),
    )


def physics_bin(params: Params) -> Column:
    """Bin number of the physics value."""
    return F.floor(F.col("physics_base_kw_per_kwp") * params.curve_bins_per_unit).cast("int")


def training_rows(
    readings: DataFrame,
    features: DataFrame,
    inverters: DataFrame,
    eta: DataFrame,
    error_intervals: DataFrame,
    params: Params,
) -> DataFrame:
    """Clean rows of the training window: bright, uncurtailed, error-free, producing."""
    year = (params.train_from, params.train_to)
    failed = within(error_intervals, *year).select("ts", "inverter")
    bright = within(features, *year).where(
        F.col("is_model_day")
        & (F.col("irradiation_w_m2") > params.train_min_irradiation)
        & ~F.col("is_curtailed")
    )
    device = inverters.select("inverter", "kwp").join(
        eta.select("inverter", "eta_system").hint("merge"), "inverter", "left"
    )
    eta_known = F.coalesce("eta_system", F.lit(params.default_eta))
    physics = F.col("kwp") * F.col("physics_base_kw_per_kwp") * eta_known
    return (
        within(readings, *year)
        .where("p_ac_kw > 0")
        .select("ts", "inverter", "p_ac_kw")
        .join(failed.hint("merge"), ["ts", "inverter"], "left_anti")
        .join(bright, "ts")
        .join(device.hint("merge"), "inverter")
        .select(
            "ts",
            "inverter",
            *FEATURES,
            clip_to_capacity(physics, F.col("kwp")).alias("p50_physics_kw"),
            "physics_base_kw_per_kwp",
            eta_known.alias("eta_system"),
            "p_ac_kw",
            "kwp",
        )
    )


def split_rows(rows: DataFrame, params: Params) -> DataFrame:
    """Mark rows ``is_fit`` / ``is_valid``: by date, or the first share where a side is too small.

    Devices with too few clean rows are left out; the twin serves them from the
    fleet's curve. A cut at the k-th row of a device in time is found without ordering
    the device's year: per-device counts, a (device, day) histogram with running counts
    gives the day that holds rank k, and only that day's rows are ranked. Flags are then
    comparisons with the cut timestamps. ``(ts, inverter)`` is a key of ``rows``.
    """
    early = F.col("ts") < F.lit(params.holdout_from).cast("timestamp_ntz")
    n, n_early = F.col("_n"), F.col("_n_early")
    by_date = (n_early >= params.min_fit_rows) & (n - n_early >= params.min_valid_rows)
    cut = F.greatest(F.lit(params.min_fit_rows), F.floor(n * params.fit_share))
    n_fit = F.when(by_date, n_early).otherwise(F.least(cut, n)).cast("long")
    tail = F.least(F.lit(params.holdout_tail_rows), n)
    stats = (
        rows.groupBy("inverter")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(early).alias("_n_early"))
        .where(n >= params.min_rows_per_device)
        .select(
            "inverter",
            "_n",
            n_fit.alias("_fit"),
            (n - tail).cast("long").alias("_tail_from"),
            (n - n_fit >= params.min_holdout_rows).alias("_enough"),
        )
    )
    day = F.to_date("ts")
    days = rows.groupBy("inverter", day.alias("_day")).agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy("inverter").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("_through", F.sum("_c").over(running))  # one row a device and day
    wanted = stats.select(
        "inverter",
        F.explode(F.array(F.struct(F.lit("fit").alias("which"), F.col("_fit").alias("k")),
                          F.struct(F.lit("tail").alias("which"), F.col("_tail_from").alias("k")))).alias("_w"),
    ).select("inverter", "_w.which", "_w.k")
    at_day = wanted.join(days, "inverter").where((F.col("_through") - F.col("_c") < F.col("k")) & (F.col("k") <= F.col("_through")))
    own_day = Window.partitionBy("inverter", "which").orderBy("ts")
    cuts = (
        rows.select("inverter", "ts", day.alias("_day"))
        .join(at_day.select("inverter", "_day", "which", (F.col("k") - F.col("_through") + F.col("_c")).alias("_r")), ["inverter", "_day"])
        .withColumn("_rank", F.row_number().over(own_day))
        .where(F.col("_rank") == F.col("_r"))
        .groupBy("inverter")
        .agg(F.max(F.when(F.col("which") == "fit", F.col("ts"))).alias("_fit_ts"), F.max(F.when(F.col("which") == "tail", F.col("ts"))).alias("_tail_ts"))
    )
    after_fit = F.coalesce(F.col("ts") > F.col("_fit_ts"), F.lit(True))  # no fit rows: all come after
    return (
        rows.join(stats.join(cuts, "inverter", "left"), "inverter")
        .withColumns(
            {
                "is_fit": F.coalesce(F.col("ts") <= F.col("_fit_ts"), F.lit(False)),
                "is_valid": F.when(F.col("_enough"), after_fit).otherwise(F.coalesce(F.col("ts") > F.col("_tail_ts"), F.lit(True))),
                "n_clean": F.col("_n"),
            }
        )
        .select(*rows.columns, "is_fit", "is_valid", "n_clean")
    )


def fit_curve(split: DataFrame, params: Params) -> DataFrame:
    """(inverter, bin, p50_per_kwp, n_rows): one device's median per physics bin."""
    return (
        split.where("is_fit")
        .groupBy("inverter", physics_bin(params).alias("bin"))
        .agg(
            F.round(F.median(F.col("p_ac_kw") / F.col("kwp")), _CURVE_DIGITS).alias("p50_per_kwp"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )


def fit_fleet_curve(split: DataFrame, params: Params) -> DataFrame:
    """(bin, fleet_p50_per_kwp) over all devices: a bin grows with the fleet."""
    rows = split.where("is_fit").select(
        physics_bin(params).alias("bin"), (F.col("p_ac_kw") / F.col("kwp")).alias("specific")
    )
    return exact_quantiles(rows, ["bin"], "specific", {"fleet_p50_per_kwp": 0.5}).withColumn(
        "fleet_p50_per_kwp", F.round("fleet_p50_per_kwp", _CURVE_DIGITS)
    )


def device_models(
    inverters: DataFrame,
    eta: DataFrame,
    curve: DataFrame,
    params: Params,
    metrics: DataFrame | None = None,
) -> DataFrame:
    """One row per device with all that prediction needs.

    The curve is an array indexed by bin, as long as the device's largest fitted bin needs.
    Each band is a line over p50: shifted by the residual quantile, or scaled by the physics band
    factor for a device without held-out rows.
    """
    points = F.map_from_entries(F.collect_list(F.struct("bin", "p50_per_kwp")))
    bins = F.sequence(F.lit(0), F.greatest(F.lit(0), F.array_max(F.map_keys("_points"))))
    curves = (
        curve.where("bin is not null")
        .groupBy("inverter")
        .agg(points.alias("_points"))
        .select(
            "inverter",
            F.transform(bins, lambda b: F.try_element_at("_points", b)).alias("curve"),
        )
    )
    models = (
        inverters.where("kwp > 0")
        .select("inverter", "kwp", "module_type")
        .join(eta.select("inverter", "eta_system").hint("merge"), "inverter", "left")
        .join(curves.hint("merge"), "inverter", "left")
    )
    if metrics is None:
        return models
    quantiles = metrics.select("inverter", "residual_q10_kw", "residual_q90_kw")
    return with_band_lines(models.join(quantiles.hint("merge"), "inverter", "left"), params)


def with_band_lines(models: DataFrame, params: Params) -> DataFrame:
    """Replace the residual quantiles by (factor, shift) of the lower and upper band."""
    sides = (
        ("low", "residual_q10_kw", params.physics_p10_factor),
        ("high", "residual_q90_kw", params.physics_p90_factor),
    )
    lines = {}
    for side, quantile, factor in sides:
        known = F.col(quantile).isNotNull()
        lines[f"{side}_factor"] = F.when(known, 1.0).otherwise(factor)
        lines[f"{side}_shift"] = F.coalesce(quantile, F.lit(0.0))
    return models.withColumns(lines).drop("residual_q10_kw", "residual_q90_kw")


def curve_p50(params: Params, bin_: Column | None = None, fleet: Column | None = None) -> Column:
    """Expected power of a row holding curve, eta_system and kwp, in a physics bin.

    Never NULL, so a plain clip is enough; every input is named once, which keeps
    filters on the result small when they move below it.
    """
    bin_ = F.col("bin") if bin_ is None else bin_
    fleet = F.col("fleet_p50_per_kwp") if fleet is None else fleet
    middle = (bin_ + 0.5) / params.curve_bins_per_unit
    physics = F.least(F.lit(1.0), middle * F.coalesce("eta_system", F.lit(params.default_eta)))
    specific = F.coalesce(F.get("curve", bin_), fleet, physics)
    return F.col("kwp") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), specific))


def with_bins(features: DataFrame, fleet_curve: DataFrame, params: Params) -> DataFrame:
    """Features with their bin and the fleet's value in it (one row for each bin in use)."""
    return features.withColumn("bin", physics_bin(params)).join(fleet_curve, "bin", "left")


def holdout_predictions(
    split: DataFrame, models: DataFrame, fleet_curve: DataFrame, params: Params
) -> DataFrame:
    """(inverter, kwp, p_ac_kw, p50, is_fit...) of the held-out rows."""
    rows = split.where("is_valid").select(
        "inverter", "p_ac_kw", "n_clean", physics_bin(params).alias("bin")
    )
    return (
        rows.join(fleet_curve, "bin", "left")
        .join(models.hint("merge"), "inverter")
        .select("inverter", "kwp", "p_ac_kw", "n_clean", curve_p50(params).alias("p50"))
    )


def validation_metrics(holdout: DataFrame, split: DataFrame) -> DataFrame:
    """Error, bias, fit and residual quantiles per device on held-out rows.

    Band coverage needs the quantiles first; they come back to the rows by a join
    on the device.
    """
    actual, predicted = F.col("p_ac_kw"), F.col("p50")
    error = predicted - actual
    per_device = holdout.groupBy("inverter").agg(
        F.first("kwp").alias("kwp"),
        F.first("n_clean").alias("n_rows_clean"),
        F.count(F.lit(1)).alias("n_valid"),
        F.avg(error * error).alias("_mse"),
        F.avg(error).alias("_bias"),
        F.sum(F.abs(error)).alias("_abs"),
        F.sum(actual).alias("_energy"),
        F.var_pop(actual).alias("_var"),
    )
    quantiles = exact_quantiles(
        holdout.withColumn("_residual", actual - predicted),
        ["inverter"],
        "_residual",
        {"residual_q10_kw": 0.10, "residual_q90_kw": 0.90},
        many_groups=True,
    ).withColumns(
        {q: F.round(q, _RESIDUAL_DIGITS) for q in ("residual_q10_kw", "residual_q90_kw")}
    )
    p10, p90 = bands(
        predicted, predicted + F.col("residual_q10_kw"), predicted + F.col("residual_q90_kw")
    )
    coverage = (
        holdout.join(quantiles.hint("merge"), "inverter")
        .groupBy("inverter")
        .agg(F.avg(actual.between(p10, p90).cast("double")).alias("band_coverage"))
    )
    fitted = split.groupBy("inverter").agg(F.count_if("is_fit").alias("n_train"))
    kwp = F.nullif(F.col("kwp"), F.lit(0.0))
    return (
        per_device.join(quantiles.hint("merge"), "inverter")
        .join(coverage.hint("merge"), "inverter")
        .join(fitted.hint("merge"), "inverter")
        .select(
            "inverter",
            "kwp",
            "n_rows_clean",
            "n_train",
            "n_valid",
            (F.sqrt("_mse") / kwp).alias("nrmse"),
            F.sqrt("_mse").alias("rmse_kw"),
            (F.col("_bias") / kwp).alias("mbe_norm"),
            (1.0 - F.col("_mse") / F.nullif(F.col("_var"), F.lit(0.0))).alias("r2"),
            (F.col("_abs") / F.when(F.col("_energy") > 0, F.col("_energy"))).alias(
                "energy_weighted_abs_error"
            ),
            "residual_q10_kw",
            "residual_q90_kw",
            "band_coverage",
        )
    )


def bands(p50: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(p10, p90) around p50 and within [0, kwp], given the raw band ends and 0 <= p50 <= kwp."""
    return F.greatest(F.lit(0.0), F.least(p50, low)), F.greatest(p50, F.least(F.col("kwp"), high))


def predict(rows: DataFrame, moments: DataFrame, models: DataFrame, params: Params) -> DataFrame:
    """Bands for the (ts, inverter) pairs of ``rows``; zero outside model daylight.

    Wide telemetry unpivots to every (timestamp, device) pair, so predicting its
    rows replays the whole history for the whole fleet in one job. Models grow with the
    fleet, but their curves pack into a small file: the hint keeps them from being broadcast.
    """
    p50 = F.col("p50_twin_kw")
    p10, p90 = bands(
        p50,
        p50 * F.col("low_factor") + F.col("low_shift"),
        p50 * F.col("high_factor") + F.col("high_shift"),
    )
    day = F.col("is_model_day")
    return (
        rows.join(moments, "ts")
        .join(models.hint("merge"), "inverter")
        .withColumn("p50_twin_kw", F.when(day, curve_p50(params)).otherwise(0.0))
        .withColumns(
            {
                "p10_twin_kw": F.when(day, p10).otherwise(0.0),
                "p90_twin_kw": F.when(day, p90).otherwise(0.0),
            }
        )
    )


def expected_monthly(moments: DataFrame, models: DataFrame, params: Params) -> DataFrame:
    """(month, inverter, module_type, expected_daylight_kwh) for every device and month.

    Timestamps fold into (month, bin) counts before they meet a device. That calendar
    is one small value (months x bins in use); each device row expands
    to its months and sums a month's bins in place, with no timestamps x devices grid.
    The models are a small file that expands to many rows, so its devices are dealt first.
    """
    tasks = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = (
        moments.where("is_model_day")
        .groupBy(month_of(F.col("ts")).alias("month"), "bin", "fleet_p50_per_kwp")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("month")
        .agg(F.sort_array(F.collect_list(F.struct("bin", "fleet_p50_per_kwp", "n"))).alias("bins"))
    )
    calendar = bins.agg(F.collect_list(F.struct("month", "bins"))).scalar()
    energy = F.aggregate(
        F.col("_slot.bins"),
        F.lit(0.0),
        lambda total, b: total + curve_p50(params, b.bin, b.fleet_p50_per_kwp) * b.n,
    )
    return (
        models.repartition(tasks, "inverter")
        .withColumn("_calendar", calendar)
        .withColumn("_slot", F.explode("_calendar"))
        .select(
            F.col("_slot.month").alias("month"),
            "inverter",
            "module_type",
            (energy * params.step_hours).alias("expected_daylight_kwh"),
        )
    )


def evaluation(metrics: DataFrame) -> DataFrame:
    """Fleet summary of the validation metrics, one row per figure."""
    out = None
    for name in ("nrmse", "r2", "energy_weighted_abs_error", "band_coverage"):
        median = exact_quantiles(metrics, [], name, {"median_value": 0.5})
        row = (
            metrics.agg(F.avg(name).alias("mean_value"), F.max(name).alias("max_value"))
            .select(F.lit(name).alias("metric"), "mean_value", "max_value")
            .withColumn("median_value", median.scalar())
        )
        out = row if out is None else out.unionByName(row)
    return out


def accuracy(metrics: DataFrame) -> DataFrame:
    """Held-out error of each device in percent next to the fleet's median."""
    percent = metrics.select(
        "inverter", (F.col("nrmse") * 100.0).alias("nrmse_pct"), "r2", "band_coverage"
    )
    median = exact_quantiles(percent, [], "nrmse_pct", {"m": 0.5})
    return percent.withColumn("median_nrmse_pct", median.scalar())


def fit_gbt(split: DataFrame, params: Params):
    """Pooled boosted trees on specific power with early stopping.

    Rows held out for early stopping are chosen by a hash of their key, so the
    choice does not depend on partitioning. Rounds are fitted and evaluated on those rows, three
    times as many again until ``gbt_patience`` rounds bring no better one or ``gbt_iterations``
    are reached; the model keeps the best rounds before that, as after a fit of all rounds.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    share = int(params.gbt_validation_share * 1000)
    rows = gbt_columns(split.where("is_fit")).select(
        *FEATURES,
        "p50_physics_kw",
        "eta_system",
        "kwp",
        (F.col("p_ac_kw") / F.col("kwp")).alias("label"),
        (F.pmod(F.xxhash64("ts", "inverter", F.lit(params.seed)), F.lit(1000)) < share).alias(
            "is_early_stop"
        ),
    )
    assembler = VectorAssembler(
        inputCols=[*FEATURES, "p50_physics_kw", "eta_system", "kwp"], outputCol="features"
    )
    learner = GBTRegressor(
        maxIter=params.gbt_iterations,
        stepSize=params.gbt_step,
        maxDepth=params.gbt_depth,
        minInstancesPerNode=params.gbt_min_instances,
        maxBins=params.gbt_bins,
        seed=params.seed,
    )
    ready = assembler.transform(rows).select("features", "label", "is_early_stop")
    grown, held = ready.where("not is_early_stop"), ready.where("is_early_stop")
    if held.isEmpty():
        return PipelineModel(stages=[assembler, learner.fit(grown)])
    fitted = min(2 * params.gbt_patience, params.gbt_iterations)
    while True:  # the same seed grows the same first trees again
        model = learner.copy({learner.maxIter: fitted}).fit(grown)
        rounds = best_rounds(model.evaluateEachIteration(held, "squared"), params.gbt_patience)
        if fitted == params.gbt_iterations or fitted >= rounds + params.gbt_patience:
            break
        fitted = min(3 * fitted, params.gbt_iterations)
    if rounds < fitted:
        model = first_trees(model, rounds)
    return PipelineModel(stages=[assembler, model])


def first_trees(model, rounds: int):
    """The model of the first ``rounds`` trees: what a fit of so many rounds with the same seed grows.

    The constructor from trees and weights is public in Scala only.
    """
    from pyspark import SparkContext
    from pyspark.ml.regression import GBTRegressionModel

    gateway = SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(ml.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = model.trees[i]._java_obj, model.treeWeights[i]
    return GBTRegressionModel(ml.GBTRegressionModel(model.uid, trees, weights))


def best_rounds(errors: list[float], patience: int) -> int:
    """Rounds up to the least error that no later one beats within ``patience`` rounds."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def gbt_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in ("eta_system", "kwp")})


def gbt_holdout(split: DataFrame, model, params: Params) -> DataFrame:
    """Held-out rows of the boosted-tree twin in the shape :func:`validation_metrics` reads."""
    scored = model.transform(gbt_columns(split.where("is_valid")))
    p50 = clip_to_capacity(F.col("prediction") * F.col("kwp"), F.col("kwp"))
    return scored.select("inverter", "kwp", "p_ac_kw", "n_clean", p50.alias("p50"))
