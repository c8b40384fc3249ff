"""Serving queries over the published ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lossledger import params as P
from lossledger.functions import bucket_label, within


def _verified() -> Column:
    return F.col("bucket") != P.DATA_GAP


def _month_label() -> Column:
    return F.date_format("month", "yyyy-MM")


def plant_facts(inverters: DataFrame, ledger: DataFrame) -> DataFrame:
    """Fleet size and covered months in one row."""
    fleet = inverters.agg(
        F.count(F.lit(1)).alias("n_inverters"), F.round(F.sum("kwp"), 1).alias("kwp")
    )
    span = ledger.agg(
        F.date_format(F.min("month"), "yyyy-MM").alias("first_month"),
        F.date_format(F.max("month"), "yyyy-MM").alias("last_month"),
        F.count(F.lit(1)).alias("ledger_rows"),
    )
    return span.withColumns(
        {
            "n_inverters": fleet.select("n_inverters").scalar(),
            "kwp": fleet.select("kwp").scalar(),
        }
    )


def kpis(ledger: DataFrame) -> DataFrame:
    """Headline figures, top actionable device and top verified cause in one row."""
    verified = _verified()
    total = ledger.agg(
        F.sum(F.when(verified, F.col("lost_eur"))).alias("lost_eur"),
        F.sum(F.when(verified, F.col("lost_kwh"))).alias("lost_kwh"),
        F.coalesce(F.sum(F.when(~verified, F.col("lost_kwh"))), F.lit(0.0)).alias("data_gap_kwh"),
        F.count(F.lit(1)).alias("ledger_rows"),
        F.count_if("validated_by_ticket").alias("validated_rows"),
    )

    def top(rows: DataFrame, key: str) -> DataFrame:
        summed = rows.groupBy(key).agg(F.sum("lost_eur").alias("lost_eur"))
        return summed.agg(F.min_by(key, F.struct(-F.col("lost_eur"), F.col(key))).alias(key))

    actionable = ledger.where(F.col("bucket").isin(*P.ACTIONABLE))
    return total.withColumns(
        {
            "top_inverter": top(actionable, "inverter").scalar(),
            "top_bucket": top(ledger.where(verified), "bucket").scalar(),
        }
    )


def cause_share(ledger: DataFrame) -> DataFrame:
    """Loss per year and cause with its share of all verified loss.

    The window runs over years x causes, a fixed handful of rows.
    """
    grouped = (
        ledger.where(_verified())
        .groupBy("year", "bucket")
        .agg(F.sum("lost_eur").alias("lost_eur"), F.sum("lost_kwh").alias("lost_kwh"))
    )
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("lost_eur").over(everything)
    return grouped.withColumn("share", F.col("lost_eur") / F.nullif(total, F.lit(0.0))).withColumn(
        "label", bucket_label(F.col("bucket"))
    )


def heatmap(ledger: DataFrame) -> DataFrame:
    return (
        ledger.where(_verified())
        .groupBy("inverter", _month_label().alias("month_label"))
        .agg(F.sum("lost_eur").alias("lost_eur"))
    )


def inverter_rank(ledger: DataFrame) -> DataFrame:
    loss = F.when(_verified(), F.col("lost_eur"))
    return ledger.groupBy("inverter").agg(F.sum(loss).alias("lost_eur"))


def inverter_months(ledger: DataFrame, inverter: str | None = None) -> DataFrame:
    """Loss per month and cause, for one device or for all."""
    rows = ledger if inverter is None else ledger.where(F.col("inverter") == inverter)
    return rows.groupBy("inverter", "month", "bucket").agg(
        F.sum("lost_eur").alias("lost_eur"),
        F.sum("lost_kwh").alias("lost_kwh"),
        F.bool_or("validated_by_ticket").alias("validated_by_ticket"),
    )


def inverter_summary(months: DataFrame) -> DataFrame:
    """Per device: gap energy, verified and actionable loss, and the month with most loss."""
    verified = _verified()
    loss = F.col("lost_eur")
    by_month = months.groupBy("inverter", "month").agg(
        F.sum(F.when(~verified, F.col("lost_kwh"))).alias("gap_kwh"),
        F.sum(F.when(verified, loss)).alias("verified_eur"),
        F.sum(F.when(F.col("bucket").isin(*P.ACTIONABLE), loss)).alias("actionable_eur"),
    )
    zero = F.lit(0.0)
    rank = F.when(
        F.col("verified_eur").isNotNull(), F.struct(-F.col("verified_eur"), F.col("month"))
    )
    best = F.coalesce(F.min_by("month", rank), F.max("month"))
    return by_month.groupBy("inverter").agg(
        F.coalesce(F.sum("gap_kwh"), zero).alias("gap_kwh"),
        F.coalesce(F.sum("verified_eur"), zero).alias("verified_eur"),
        F.coalesce(F.sum("actionable_eur"), zero).alias("actionable_eur"),
        best.alias("best_month"),
    )


def inverter_timeseries(
    rows: DataFrame, intervals: DataFrame, inverter: str | Column, start: str, stop: str
) -> DataFrame:
    """Reading, band and loss of one device in [start, stop).

    ``rows`` are readings with bands. Both scans get the device and time predicates.
    """

    def window(df: DataFrame) -> DataFrame:
        return within(df.where(F.col("inverter") == inverter), start, stop)

    losses = window(intervals).select("ts", "inverter", "bucket", "lost_eur")
    return (
        window(rows)
        .select("ts", "inverter", "p_ac_kw", "p10_twin_kw", "p50_twin_kw", "p90_twin_kw")
        .join(losses, ["ts", "inverter"], "left")
    )


def inverter_tickets(
    tickets: DataFrame,
    inverter: str | Column,
    start: str | None = None,
    stop: str | None = None,
) -> DataFrame:
    """Dated tickets of one device, optionally only those inside [start, stop]."""
    found = tickets.where((F.col("inverter") == inverter) & F.col("start_ts").isNotNull())
    if start is not None:
        found = found.where(F.col("start_ts") >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        found = found.where(F.col("start_ts") <= F.lit(stop).cast("timestamp_ntz"))
    return found.select("start_ts", "end_ts", "category", "text")


def _chosen(ledger: DataFrame, years: Sequence[int], buckets: Sequence[str]) -> DataFrame:
    """An empty choice means no restriction."""
    if years:
        ledger = ledger.where(F.col("year").isin(*years))
    if buckets:
        ledger = ledger.where(F.col("bucket").isin(*buckets))
    return ledger


def ledger_filtered(
    ledger: DataFrame, years: Sequence[int] = (), buckets: Sequence[str] = (), limit: int = 1000
) -> DataFrame:
    """The largest rounded ledger rows of a choice; ties are broken by the ledger keys."""
    return (
        _chosen(ledger, years, buckets)
        .select(
            "inverter",
            "year",
            "month",
            "bucket",
            "error_code",
            "error_description",
            F.round("lost_kwh", 1).alias("lost_kwh"),
            F.round("lost_eur", 1).alias("lost_eur"),
            "n_intervals",
            "validated_by_ticket",
        )
        .orderBy(
            F.desc("lost_eur"), "inverter", "month", "bucket", F.asc_nulls_last("error_code")
        )
        .limit(limit)
    )


def filter_summary(
    ledger: DataFrame, years: Sequence[int] = (), buckets: Sequence[str] = ()
) -> DataFrame:
    """Totals of a choice (bucket NULL) and its loss per cause, from one grouping pass."""
    per_bucket = (
        _chosen(ledger, years, buckets)
        .groupBy("bucket")
        .agg(
            F.sum("lost_eur").alias("lost_eur"),
            F.sum("lost_kwh").alias("lost_kwh"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if("validated_by_ticket").alias("ticket_rows"),
        )
    )
    zero = F.lit(0)
    total = per_bucket.agg(
        *[
            F.coalesce(F.sum(c), zero.cast(t)).alias(c)
            for c, t in (
                ("lost_eur", "double"),
                ("lost_kwh", "double"),
                ("rows", "bigint"),
                ("ticket_rows", "bigint"),
            )
        ]
    ).withColumn("bucket", F.lit(None).cast("string"))
    return per_bucket.unionByName(total)


def filter_choices(ledger: DataFrame) -> DataFrame:
    """Years and causes that occur, for the filter boxes."""
    return ledger.select("year", "bucket").distinct()


def error_ranking(ledger: DataFrame, n: int = 8) -> DataFrame:
    label = F.coalesce(
        "error_description", F.concat(F.lit("code "), F.col("error_code_base").cast("string"))
    )
    return (
        ledger.where(F.col("bucket") == P.FAULT)
        .groupBy(label.alias("error"))
        .agg(
            F.count(F.lit(1)).alias("months_affected"), F.round(F.sum("lost_eur")).alias("lost_eur")
        )
        .orderBy(F.desc("lost_eur"), "error")
        .limit(n)
    )


def degradation_list(slopes: DataFrame) -> DataFrame:
    return slopes.select(
        "inverter",
        "module_type",
        "slope_pct_per_year",
        "ci_low_pct_per_year",
        "ci_high_pct_per_year",
        "n_months",
    )


def lead_list(lead: DataFrame) -> DataFrame:
    return lead.select(
        "event_date",
        "inverter",
        "bucket",
        F.round("lost_eur", 1).alias("lost_eur"),
        "ticket_start_ts",
        "ticket_lag_days",
        "ticket_category",
    )


def service_priority(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Devices with most actionable loss and the causes behind it."""
    return (
        ledger.where(F.col("bucket").isin(*P.ACTIONABLE))
        .groupBy("inverter")
        .agg(
            F.sum("lost_eur").alias("lost_eur"),
            F.sum("lost_kwh").alias("lost_kwh"),
            F.array_join(F.array_sort(F.collect_set("bucket")), ", ").alias("buckets"),
            F.bool_or("validated_by_ticket").alias("has_ticket_validation"),
        )
        .orderBy(F.desc("lost_eur"), "inverter")
        .limit(n)
    )


def curtailment_of_year(ledger: DataFrame, year: int) -> DataFrame:
    """Both curtailment causes of a year; a cause that did not occur reports zero."""
    rows = ledger.where((F.col("year") == year) & F.col("bucket").isin(*P.CURTAILMENT))
    amounts = []
    for name, kind in (("lost_kwh", "double"), ("lost_eur", "double"), ("n_intervals", "bigint")):
        for cause in P.CURTAILMENT:
            hit = F.when(F.col("bucket") == cause, F.col(name))
            amounts.append(F.coalesce(F.sum(hit), F.lit(0).cast(kind)).alias(f"{cause}_{name}"))
    per_cause = [
        F.struct(
            F.lit(cause).alias("bucket"),
            *[F.col(f"{cause}_{n}").alias(n) for n in ("lost_kwh", "lost_eur", "n_intervals")],
        )
        for cause in P.CURTAILMENT
    ]
    return rows.agg(*amounts).select(F.inline(F.array(*per_cause)))


def worst_months(ledger: DataFrame) -> DataFrame:
    """Per device the (month, cause) with the largest verified loss, and its gap energy.

    A device that has nothing but data gaps keeps its gap energy, with no month.

    The worst month is a map-side combined minimum, not a sort of the device's rows.
    """
    rows = ledger.groupBy("inverter", "month", "bucket").agg(
        F.sum("lost_kwh").alias("lost_kwh"),
        F.sum("lost_eur").alias("lost_eur"),
        F.bool_or("validated_by_ticket").alias("validated_by_ticket"),
    )
    verified = _verified()
    order = F.when(verified, F.struct(-F.col("lost_eur"), F.col("month"), F.col("bucket")))
    worst = F.struct("month", "bucket", "lost_kwh", "lost_eur", "validated_by_ticket")
    return (
        rows.groupBy("inverter")
        .agg(
            F.min_by(worst, order).alias("_worst"),
            F.coalesce(F.sum(F.when(~verified, F.col("lost_kwh"))), F.lit(0.0)).alias("gap_kwh"),
        )
        .select("inverter", "_worst.*", "gap_kwh")
    )


def worst_rows(ledger: DataFrame, inverter: str | None = None, n: int = 10) -> DataFrame:
    """The largest verified (month, cause) rows of one device, by default the costliest device."""
    if inverter is None:
        summed = ledger.groupBy("inverter").agg(F.sum("lost_eur").alias("lost_eur"))
        device = summed.agg(
            F.min_by("inverter", F.struct(-F.col("lost_eur"), F.col("inverter")))
        ).scalar()
    else:
        device = F.lit(inverter)
    return (
        ledger.where((F.col("inverter") == device) & _verified())
        .groupBy("inverter", "month", "bucket")
        .agg(
            F.sum("lost_kwh").alias("lost_kwh"),
            F.sum("lost_eur").alias("lost_eur"),
            F.bool_or("validated_by_ticket").alias("validated_by_ticket"),
        )
        .orderBy(F.desc("lost_eur"), "month", "bucket")
        .limit(n)
    )


def ask(spark: SparkSession, sql: str, args: list | None = None, max_rows: int | None = None) -> DataFrame:
    """A parameterised SQL query over the registered views, limited only where asked for."""
    out = spark.sql(sql, args=args or [])
    return out if max_rows is None else out.limit(max_rows)
