"""Every registered query: name -> callable(spark, data folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lossledger.functions import (
    bucket_label,
    clean_number,
    cyclic_features,
    device_id,
    parse_minute,
    severity_class,
    try_parse_minute,
)
from lossledger.operators import (
    attribution,
    baseline,
    boosting,
    context,
    dims,
    ledger,
    marts,
    reshape,
    tickets,
    trend,
    twin,
    windows,
)
from lossledger.plans.driver_tables import DAILY, FIVE_MINUTES, DriverTables, comma, tables
from lossledger.plans.rounding import half_shift
from lossledger.sources import append_table

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}

# Months of the test tables; a loss in any other month fails the pivot.
MONTHS = [f"{year}-{month:02d}" for year in range(1995, 2002) for month in range(1, 13)]


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded for comparison with another engine, exact halves shifted away."""
    shift = half_shift(digits)
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`") + shift, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, digits: int = 4):
    def register(build: Callable[[DriverTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _rounded(build(tables(spark, sf_dir)), digits)

        _registry[name] = run
        return build

    return register


def all_queries() -> dict[str, Query]:
    return dict(_registry)


# cleaning ----------------------------------------------------------------------
@query("q_numeric_clean")
def _(d: DriverTables) -> DataFrame:
    kind = F.pmod("l_linenumber", F.lit(4))
    text = (
        F.when(kind == 0, comma(F.col("l_discount")))
        .when(kind == 1, F.concat(F.lit(" "), comma(F.col("l_tax") * 100, 1)))
        .when(kind == 2, F.concat(F.lit("ca. "), comma(F.col("l_tax"))))
        .otherwise("")
    )
    return d.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", clean_number(text).alias("value")
    )


@query("q_parse_ts")
def _(d: DriverTables) -> DataFrame:
    text = F.date_format("l_shipdate", "yyyy.MM.dd HH:mm")
    damaged = F.when(F.col("l_linenumber") == 3, F.replace(text, F.lit("."), F.lit("/"))).when(
        F.col("l_linenumber") == 4, F.concat(F.substring(text, 1, 5), F.lit("13.01 00:00"))
    ).otherwise(text)
    return d.read("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        parse_minute(text).alias("ts"),
        try_parse_minute(damaged).alias("ts_or_null"),
    )


@query("q_plant")
def _(d: DriverTables) -> DataFrame:
    return context.plant_from_wide(d.plant_wide, DAILY)


@query("q_normalize_id")
def _(d: DriverTables) -> DataFrame:
    part = [F.substring("inverter", start, length) for start, length in ((5, 2), (8, 2), (11, 3))]
    kind = F.col("l_linenumber")
    text = (
        F.when(kind == 1, F.concat(F.lit("WR "), part[0], F.lit(" ."), part[1], F.lit(" ."), part[2]))
        .when(kind == 2, F.concat(F.lit("Stoerung INV"), part[0], F.lit("."), part[1], F.lit("."), part[2], F.lit("-A")))
        .when(kind == 3, F.concat(F.lit("WR  "), part[0], F.lit(" "), part[1], F.lit(". "), part[2]))
        .when(kind == 4, F.concat(F.lit("wr "), part[0], F.lit("."), part[1], F.lit("."), part[2]))
        .when(kind == 5, F.concat(F.lit("INV "), part[0], F.lit("."), part[1]))
        .when(kind == 6, F.col("inverter"))
    )
    return (
        d.read("lineitem")
        .join(d.keys, "l_suppkey")
        .groupBy(text.alias("raw_text"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("inverter", device_id(F.col("raw_text")))
    )


@query("q_severity")
def _(d: DriverTables) -> DataFrame:
    code = clean_number(F.col("code")).cast("bigint")
    return d.catalog_extract.select(
        "row_no",
        code.alias("code"),
        "description",
        severity_class(code, F.col("description")).alias("severity_class"),
    )


@query("q_error_lookup")
def _(d: DriverTables) -> DataFrame:
    described = attribution.describe_codes(d.error_events, d.error_catalog, DAILY)
    return described.groupBy(
        "error_code", "error_code_base", "error_description", "error_severity"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("q_cyclic_features", digits=6)
def _(d: DriverTables) -> DataFrame:
    return d.events.select(
        "event_id", *[c.alias(name) for name, c in cyclic_features(F.col("ts")).items()]
    )


@query("q_bucket_labels")
def _(d: DriverTables) -> DataFrame:
    return (
        d.run.ledger.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("label", bucket_label(F.col("bucket")))
    )


# reshape -----------------------------------------------------------------------
@query("q_track_completeness")
def _(d: DriverTables) -> DataFrame:
    return reshape.track_completeness(d.column_names)


@query("q_unpivot_readings")
def _(d: DriverTables) -> DataFrame:
    return reshape.unpivot_readings(d.wide_main)


@query("q_error_events")
def _(d: DriverTables) -> DataFrame:
    return reshape.unpivot_errors(d.wide_errors)


@query("q_unpivot_tariffs")
def _(d: DriverTables) -> DataFrame:
    return d.tariffs


@query("q_fill_continuation")
def _(d: DriverTables) -> DataFrame:
    return reshape.fill_continuation(d.overview_extract)


@query("q_heatmap_pivot", digits=2)
def _(d: DriverTables) -> DataFrame:
    return reshape.pivot_months(marts.heatmap(d.run.ledger), MONTHS)


@query("q_tickets_union")
def _(d: DriverTables) -> DataFrame:
    return d.tickets


@query("q_error_catalog")
def _(d: DriverTables) -> DataFrame:
    return d.error_catalog


# dimensions --------------------------------------------------------------------
@query("q_inverters")
def _(d: DriverTables) -> DataFrame:
    return dims.roll_up_devices(reshape.fill_continuation(d.overview_extract))


@query("q_tariffs_monthly")
def _(d: DriverTables) -> DataFrame:
    return dims.monthly_tariffs(d.tariffs)


# context -----------------------------------------------------------------------
@query("q_readings_with_context")
def _(d: DriverTables) -> DataFrame:
    return context.readings_with_context(d.run.readings, d.run.inverters, d.run.plant)


@query("q_plant_controls")
def _(d: DriverTables) -> DataFrame:
    return context.plant_controls(d.plant_raw)


@query("q_error_intervals")
def _(d: DriverTables) -> DataFrame:
    return context.error_intervals(d.error_events)


@query("q_fleet", digits=6)
def _(d: DriverTables) -> DataFrame:
    return d.run.build_fleet()


@query("q_readings_monthly")
def _(d: DriverTables) -> DataFrame:
    return context.readings_monthly(d.run.readings, d.run.inverters, d.run.plant, DAILY)


@query("q_meter_check")
def _(d: DriverTables) -> DataFrame:
    return context.meter_check(d.run.readings, d.run.plant, DAILY)


@query("q_capacity_check")
def _(d: DriverTables) -> DataFrame:
    return context.capacity_exceedance(d.run.readings, d.run.inverters, DAILY)


@query("q_row_counts")
def _(d: DriverTables) -> DataFrame:
    run = d.run
    return context.row_counts(
        {
            "plant": d.plant_raw,
            "readings": run.readings,
            "inverters": run.inverters,
            "error_events": d.error_events,
            "tickets": run.tickets,
            "tariffs_monthly": run.tariffs,
            "loss_intervals": run.intervals,
            "ledger": run.ledger,
        }
    )


@query("q_profile")
def _(d: DriverTables) -> DataFrame:
    return context.column_profile(d.plant_raw, list(context.PLANT_COLUMNS))


@query("q_power_ranges")
def _(d: DriverTables) -> DataFrame:
    return context.power_ranges(d.run.readings)


@query("q_ts_profile")
def _(d: DriverTables) -> DataFrame:
    text = F.date_format("ts", "yyyy.MM.dd HH:mm")
    raw = d.events.select(
        F.when(F.pmod("user_id", F.lit(50)) == 3, F.concat(text, F.lit(" ?"))).otherwise(text).alias("timestamp")
    )
    return context.timestamp_profile(raw, "timestamp")


@query("q_clean_intervals")
def _(d: DriverTables) -> DataFrame:
    errors = d.run.error_intervals.select("ts", "inverter")
    return d.run.readings.join(errors, ["ts", "inverter"], "left_anti").select(
        "ts", "inverter", "p_ac_kw"
    )


# windows -----------------------------------------------------------------------
@query("q_daily_peak")
def _(d: DriverTables) -> DataFrame:
    return baseline.daily_peak(d.event_plant, FIVE_MINUTES)


@query("q_rolling_features", digits=6)
def _(d: DriverTables) -> DataFrame:
    series = d.events.groupBy("ts").agg(F.avg("value").alias("value"))
    return windows.rolling_neighbours(series, "ts", "value")


@query("q_persistence")
def _(d: DriverTables) -> DataFrame:
    return attribution.with_persistence(d.run.interval_base, DAILY).select(
        "ts", "inverter", "actual_kw", "p10_twin_kw", "below_p10", "below_p10_count"
    )


# physics -----------------------------------------------------------------------
@query("q_eta", digits=6)
def _(d: DriverTables) -> DataFrame:
    return d.run.build_eta()


@query("q_physics_bands")
def _(d: DriverTables) -> DataFrame:
    return d.run.physics.drop("p_ac_kw")


@query("q_performance_ratio")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_performance_ratio()


@query("q_physics_monthly")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_physics_monthly()


@query("q_physics_stats")
def _(d: DriverTables) -> DataFrame:
    return baseline.physics_stats(d.run.eta, d.run.performance_ratio, d.run.physics_monthly)


# twin --------------------------------------------------------------------------
@query("q_twin_features")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_features()


@query("q_training_rows")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_training_rows()


@query("q_split_counts")
def _(d: DriverTables) -> DataFrame:
    split = twin.split_rows(d.run.build_training_rows(), DAILY)
    return split.groupBy("inverter").agg(
        F.count(F.lit(1)).alias("n_clean"),
        F.count_if("is_fit").alias("n_fit"),
        F.count_if("is_valid").alias("n_valid"),
    )


@query("q_twin_curve")
def _(d: DriverTables) -> DataFrame:
    fleet = twin.fit_fleet_curve(d.run.split, DAILY)
    return twin.fit_curve(d.run.split, DAILY).join(fleet, "bin")


@query("q_twin_metrics")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_metrics()


@query("q_twin_bands")
def _(d: DriverTables) -> DataFrame:
    return d.run.predictions.select(
        "ts", "inverter", "p10_twin_kw", "p50_twin_kw", "p90_twin_kw"
    )


@query("q_prediction_grid")
def _(d: DriverTables) -> DataFrame:
    # Wide telemetry gives every (timestamp, device) pair; groups have no own curve.
    groups = d.inverters.groupBy(
        F.format_string("INV 01.%02d.000", F.pmod(F.col("combiner_group").cast("int"), F.lit(9)) + 1).alias(
            "inverter"
        )
    ).agg(F.sum("kwp").alias("kwp"))
    unknown = F.lit(None).cast("double")
    models = groups.withColumns(
        {
            "eta_system": unknown,
            "curve": F.lit(None).cast("array<double>"),
            "residual_q10_kw": unknown,
            "residual_q90_kw": unknown,
        }
    )
    pairs = reshape.unpivot_readings(d.wide_main).select("ts", "inverter")
    models = twin.with_band_lines(models, DAILY)
    return twin.predict(pairs, d.run.moments, models, DAILY).select(
        "ts", "inverter", "p10_twin_kw", "p50_twin_kw", "p90_twin_kw"
    )


@query("q_twin_gbt")
def _(d: DriverTables) -> DataFrame:
    model = twin.fit_gbt(d.run.split, DAILY)
    metrics = twin.validation_metrics(twin.gbt_holdout(d.run.split, model, DAILY), d.run.split)
    return metrics.select(
        "inverter",
        "n_rows_clean",
        "n_train",
        "n_valid",
        (F.col("residual_q10_kw") <= F.col("residual_q90_kw")).alias("bands_in_order"),
        F.col("band_coverage").between(0.0, 1.0).alias("coverage_is_share"),
        F.lit(1 <= model.stages[-1].getNumTrees <= DAILY.gbt_iterations).alias("rounds_within_limit"),
    )


@query("q_twin_trees")
def _(d: DriverTables) -> DataFrame:
    return d.run.tree_metrics


@query("q_twin_bands_trees")
def _(d: DriverTables) -> DataFrame:
    return d.tree_run.predictions.select("ts", "inverter", "p10_twin_kw", "p50_twin_kw", "p90_twin_kw")


@query("q_by_year_cause_trees", digits=2)
def _(d: DriverTables) -> DataFrame:
    return ledger.by_year_cause(d.tree_run.ledger)


@query("q_twin_eval", digits=3)
def _(d: DriverTables) -> DataFrame:
    slopes = trend.slope_summary(d.run.slopes).select(
        F.lit("slope_pct_per_year").alias("metric"),
        F.col("min_slope_pct_per_year").alias("mean_value"),
        F.col("max_slope_pct_per_year").alias("max_value"),
        F.col("median_slope_pct_per_year").alias("median_value"),
    )
    return twin.evaluation(d.run.metrics).unionByName(slopes)


@query("q_accuracy")
def _(d: DriverTables) -> DataFrame:
    return twin.accuracy(d.run.metrics)


# trend -------------------------------------------------------------------------
@query("q_monthly_health")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_health()


@query("q_theil_sen")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_slopes()


@query("q_slope_by_module")
def _(d: DriverTables) -> DataFrame:
    return trend.slopes_by_module(d.run.slopes)


@query("q_major_groups")
def _(d: DriverTables) -> DataFrame:
    return trend.group_quartiles(trend.major_groups(d.run.slopes, DAILY))


@query("q_degradation_list")
def _(d: DriverTables) -> DataFrame:
    return marts.degradation_list(d.run.slopes)


# attribution -------------------------------------------------------------------
@query("q_error_context")
def _(d: DriverTables) -> DataFrame:
    known = d.event_slots.where("event_type != 'error'").select("ts").distinct()
    return attribution.error_context(d.event_errors, known, d.error_catalog, FIVE_MINUTES)


@query("q_loss_intervals")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_intervals()


# ledger ------------------------------------------------------------------------
@query("q_ledger_raw")
def _(d: DriverTables) -> DataFrame:
    return ledger.ledger_raw(d.run.intervals)


@query("q_degradation_loss")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_degradation()


@query("q_ledger_adjusted")
def _(d: DriverTables) -> DataFrame:
    return d.run.adjusted


@query("q_ledger_validated")
def _(d: DriverTables) -> DataFrame:
    return d.run.build_ledger()


# ingest and publish ------------------------------------------------------------
@query("q_ingest_counts", digits=2)
def _(d: DriverTables) -> DataFrame:
    parts = d.ingested
    sums = {
        "plant": (parts.plant, "evu_pct"),
        "readings": (parts.readings, "p_ac_kw"),
        "error_events": (parts.error_events, "error_code"),
        "inverters": (parts.inverters, "kwp"),
        "tariffs_monthly": (parts.tariffs_monthly, "ct_per_kwh"),
        "error_catalog": (parts.error_catalog, "code"),
    }
    out = parts.tickets.agg(F.lit("tickets").alias("table_name"), F.count("*").alias("n_rows"), F.lit(0.0).alias("total"))
    for name, (table, value) in sums.items():
        out = out.unionByName(
            table.agg(
                F.lit(name).alias("table_name"),
                F.count("*").alias("n_rows"),
                F.sum(F.col(value).cast("double")).alias("total"),
            )
        )
    return out


@query("q_export_ledger")
def _(d: DriverTables) -> DataFrame:
    table = d.published["loss_ledger"]
    folder = f"{d.staging.root}/published/csv/loss_ledger"
    return d.spark.read.schema(table.schema).option("header", True).csv(folder)


@query("q_view_year_cause", digits=2)
def _(d: DriverTables) -> DataFrame:
    assert "loss_by_year_cause" in d.published
    return d.spark.table("loss_by_year_cause")


@query("q_ask", digits=2)
def _(d: DriverTables) -> DataFrame:
    assert "loss_ledger" in d.published
    sql = "select bucket, sum(lost_eur) as lost_eur, count(*) as n_rows from loss_ledger where year = ? group by bucket"
    return marts.ask(d.spark, sql, [1998])


@query("q_append_table")
def _(d: DriverTables) -> DataFrame:
    path = f"{d.staging.root}/appended-{uuid.uuid4().hex}"
    for sheet in ("modern", "old"):
        append_table(d.tickets.where(F.col("source_sheet") == sheet), path)
    return d.spark.read.parquet(path)


@query("q_by_year_cause", digits=2)
def _(d: DriverTables) -> DataFrame:
    return ledger.by_year_cause(d.run.ledger)


@query("q_top20", digits=2)
def _(d: DriverTables) -> DataFrame:
    return ledger.top_inverter_cause(d.run.ledger)


@query("q_module_year", digits=2)
def _(d: DriverTables) -> DataFrame:
    return ledger.by_module_year(d.run.ledger)


@query("q_totals", digits=2)
def _(d: DriverTables) -> DataFrame:
    return ledger.totals_by_bucket(d.run.ledger)


@query("q_grand_totals", digits=2)
def _(d: DriverTables) -> DataFrame:
    return ledger.grand_totals(d.run.ledger)


@query("q_accounting", digits=2)
def _(d: DriverTables) -> DataFrame:
    run = d.run
    return ledger.accounting(run.raw, run.adjusted, run.degradation, run.ledger, DAILY)


# tickets -----------------------------------------------------------------------
@query("q_top_events")
def _(d: DriverTables) -> DataFrame:
    return tickets.top_events(d.run.intervals, DAILY)


@query("q_ticket_nearest")
def _(d: DriverTables) -> DataFrame:
    return d.run.ticket_events


@query("q_lag_summary")
def _(d: DriverTables) -> DataFrame:
    return tickets.lag_summary(d.run.ticket_events)


@query("q_ticket_lead")
def _(d: DriverTables) -> DataFrame:
    return d.run.lead_events


@query("q_lead_summary", digits=2)
def _(d: DriverTables) -> DataFrame:
    return tickets.lead_summary(d.run.lead_events)


@query("q_lead_list")
def _(d: DriverTables) -> DataFrame:
    return marts.lead_list(d.run.lead_events)


@query("q_cumulative_loss")
def _(d: DriverTables) -> DataFrame:
    return tickets.loss_until_ticket(d.run.intervals, d.run.lead_events)


@query("q_cumulative_losses")
def _(d: DriverTables) -> DataFrame:
    return tickets.losses_until_tickets(d.run.intervals, d.run.lead_events)


# marts -------------------------------------------------------------------------
@query("q_plant_facts")
def _(d: DriverTables) -> DataFrame:
    return marts.plant_facts(d.run.inverters, d.run.ledger)


@query("q_kpis", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.kpis(d.run.ledger)


@query("q_cause_share", digits=3)
def _(d: DriverTables) -> DataFrame:
    return marts.cause_share(d.run.ledger)


@query("q_heatmap", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.heatmap(d.run.ledger)


@query("q_inverter_rank", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.inverter_rank(d.run.ledger)


@query("q_inverter_months", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.inverter_months(d.run.ledger)


@query("q_inverter_summary", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.inverter_summary(marts.inverter_months(d.run.ledger))


def _first_device(d: DriverTables) -> Column:
    return d.run.inverters.agg(F.min("inverter")).scalar()


@query("q_inverter_timeseries")
def _(d: DriverTables) -> DataFrame:
    return marts.inverter_timeseries(
        d.run.predictions, d.run.intervals, _first_device(d), "1998-01-01", "1998-07-01"
    )


@query("q_inverter_tickets")
def _(d: DriverTables) -> DataFrame:
    busy = d.run.tickets.agg(F.min("inverter")).scalar()
    return marts.inverter_tickets(d.run.tickets, busy, "1995-06-01", "2001-06-01")


@query("q_busiest_tickets")
def _(d: DriverTables) -> DataFrame:
    counts = d.run.tickets.where("inverter is not null").groupBy("inverter").agg(F.count("*").alias("n"))
    busy = counts.agg(F.min_by("inverter", F.struct(-F.col("n"), F.col("inverter")))).scalar()
    return marts.inverter_tickets(d.run.tickets, busy)


@query("q_ledger_filtered")
def _(d: DriverTables) -> DataFrame:
    return marts.ledger_filtered(d.run.ledger, [1998, 1999], ["FAULT", "OUTAGE", "DEGRADATION"])


@query("q_filter_summary", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.filter_summary(d.run.ledger, [1998, 1999], ["FAULT", "OUTAGE", "DEGRADATION"])


@query("q_filter_choices")
def _(d: DriverTables) -> DataFrame:
    return marts.filter_choices(d.run.ledger)


@query("q_error_ranking")
def _(d: DriverTables) -> DataFrame:
    return marts.error_ranking(d.run.ledger)


@query("q_service_priority", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.service_priority(d.run.ledger)


@query("q_curtailment_year", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.curtailment_of_year(d.run.ledger, 1999)


@query("q_worst_month", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.worst_months(d.run.ledger)


@query("q_worst_rows", digits=2)
def _(d: DriverTables) -> DataFrame:
    return marts.worst_rows(d.run.ledger)
