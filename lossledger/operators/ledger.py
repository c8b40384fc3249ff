"""Monthly loss ledger: roll-up, degradation share, overlap removal, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lossledger import params as P
from lossledger.params import Params

LEDGER_KEYS = ("inverter", "year", "month", "module_type", "bucket", "error_code", "error_code_base")
SORT_LOSS = ("lost_kwh", "lost_eur", "n_intervals")


def ledger_raw(intervals: DataFrame) -> DataFrame:
    """Intervals summed per device, month, cause and code; sums combine map-side."""
    return intervals.groupBy(*LEDGER_KEYS).agg(
        F.min("error_description").alias("error_description"),
        F.sum("lost_kwh").alias("lost_kwh"),
        F.sum("lost_eur").alias("lost_eur"),
        F.count(F.lit(1)).alias("n_intervals"),
        F.avg("ct_per_kwh").alias("avg_ct_per_kwh"),
    )


def degradation_loss(
    expected: DataFrame, slopes: DataFrame, raw: DataFrame, tariffs: DataFrame, params: Params
) -> DataFrame:
    """Expected energy times the loss share that the trend has reached by each month.

    ``expected`` has a row for each device and month, but its size is estimated from the models' small
    file: the hint keeps it from being broadcast. So it is with the other tables of devices and months.
    """
    trend = slopes.select("inverter", "first_month", "slope_ratio_per_year")
    years = F.datediff("month", "first_month") / params.days_per_year
    share = F.greatest(
        F.lit(0.0),
        F.least(F.lit(params.degradation_cap), -F.col("slope_ratio_per_year") * years),
    )
    local = (
        raw.where(F.col("bucket") == P.UNDERPERFORMANCE)
        .groupBy("inverter", "month")
        .agg(
            F.sum("lost_kwh").alias("underperformance_lost_kwh"),
            F.avg("avg_ct_per_kwh").alias("_local_ct"),
        )
    )
    tariff = tariffs.select("inverter", "month", F.col("ct_per_kwh").alias("_tariff_ct"))
    price = F.coalesce("_local_ct", "_tariff_ct", F.lit(params.default_ct_per_kwh))
    lost = F.col("expected_daylight_kwh") * F.col("degradation_fraction")
    return (
        expected.hint("merge").join(trend, "inverter")
        .where(F.col("month") >= F.col("first_month"))
        .withColumn("degradation_fraction", share)
        .withColumn("lost_kwh", lost)
        .where(F.col("lost_kwh") > params.min_ledger_kwh)
        .join(local.hint("merge"), ["inverter", "month"], "left")
        .join(tariff.hint("merge"), ["inverter", "month"], "left")
        .select(
            "inverter",
            F.year("month").alias("year"),
            "month",
            "module_type",
            "lost_kwh",
            (F.col("lost_kwh") * price / 100.0).alias("lost_eur"),
            price.alias("ct_per_kwh"),
            "degradation_fraction",
            F.col("lost_kwh").alias("raw_degradation_kwh"),
            F.coalesce("underperformance_lost_kwh", F.lit(0.0)).alias("underperformance_lost_kwh"),
        )
    )


def remove_overlap(raw: DataFrame, degradation: DataFrame, params: Params) -> DataFrame:
    """Take the degradation share out of local underperformance, so nothing counts twice.

    Only underperformance rows meet the degradation table; the rest passes by
    without a shuffle.
    """
    local = F.col("bucket") == P.UNDERPERFORMANCE
    share = degradation.select(
        "inverter",
        "month",
        F.col("lost_kwh").alias("_share_kwh"),
        F.col("lost_eur").alias("_share_eur"),
    )
    zero = F.lit(0.0)
    reduced = (
        raw.where(local)
        .join(share.hint("merge"), ["inverter", "month"], "left")
        .withColumns(
            {
                f"lost_{unit}": F.greatest(
                    F.col(f"lost_{unit}") - F.coalesce(f"_share_{unit}", zero), zero
                )
                for unit in ("kwh", "eur")
            }
        )
        .select(*raw.columns)
    )
    return raw.where(~local).unionByName(reduced).where(F.col("lost_kwh") > params.min_ledger_kwh)


def unvalidated_ledger(adjusted: DataFrame, degradation: DataFrame, params: Params) -> DataFrame:
    """Interval causes and degradation under one schema."""
    trend_rows = degradation.select(
        "inverter",
        "year",
        "month",
        "module_type",
        F.lit(P.DEGRADATION).alias("bucket"),
        "lost_kwh",
        "lost_eur",
        F.lit(0).cast("bigint").alias("n_intervals"),
        F.col("ct_per_kwh").alias("avg_ct_per_kwh"),
    )
    rows = adjusted.unionByName(trend_rows, allowMissingColumns=True)
    return rows.where(F.col("lost_kwh") > params.min_ledger_kwh)


def ticket_months(tickets: DataFrame, params: Params) -> DataFrame:
    """Each dated ticket with every month it can vouch for (month -slack .. next month +slack).

    Turns the range condition into an equi-join key: a ticket gives two or three rows.
    """
    slack = params.ticket_slack_days
    reach = slack // 28 + 1
    start_month = F.trunc(F.col("start_ts").cast("date"), "month")
    month = F.col("month")
    return (
        tickets.where(F.col("start_ts").isNotNull())
        .withColumn(
            "month",
            F.explode(F.array(*[F.add_months(start_month, k) for k in range(-reach, reach + 1)])),
        )
        .where(
            (F.col("start_ts") >= F.date_sub(month, slack).cast("timestamp_ntz"))
            & (F.col("start_ts") < F.date_add(F.add_months(month, 1), slack).cast("timestamp_ntz"))
        )
    )


def validate_by_ticket(ledger: DataFrame, tickets: DataFrame, params: Params) -> DataFrame:
    """Flag rows backed by the device's own ticket or, for grid rows, by a site-wide grid ticket.

    Two equi-joins with distinct keys instead of an OR condition, which would
    need a nested loop over ledger and tickets.
    """
    months = ticket_months(tickets, params)
    own = (
        months.where(F.col("inverter").isNotNull())
        .select("inverter", "month")
        .distinct()
        .withColumn("_own", F.lit(True))
    )
    site = (
        months.where(F.col("inverter").isNull() & F.lower("text").contains("netz"))
        .select("month")
        .distinct()
        .withColumn("_site", F.lit(True))
    )
    grid = F.col("bucket") == P.GRID
    flag = F.coalesce("_own", F.lit(False)) | (grid & F.coalesce("_site", F.lit(False)))
    return (
        ledger.join(own.hint("merge"), ["inverter", "month"], "left")
        .join(site, "month", "left")
        .select(
            *LEDGER_KEYS,
            "error_description",
            *SORT_LOSS,
            "avg_ct_per_kwh",
            flag.alias("validated_by_ticket"),
        )
    )


def _sums(*names: str) -> list:
    return [F.sum(n).alias(n) for n in names]


def by_year_cause(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("year", "bucket").agg(*_sums(*SORT_LOSS))


def top_inverter_cause(ledger: DataFrame, n: int = 20) -> DataFrame:
    return (
        ledger.groupBy("inverter", "bucket")
        .agg(*_sums(*SORT_LOSS))
        .orderBy(F.desc("lost_eur"), "inverter", "bucket")
        .limit(n)
    )


def by_module_year(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("year", "module_type", "bucket").agg(*_sums("lost_kwh", "lost_eur"))


def totals_by_bucket(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("bucket").agg(*_sums(*SORT_LOSS), F.count(F.lit(1)).alias("ledger_rows"))


def grand_totals(ledger: DataFrame) -> DataFrame:
    """Verified loss, telemetry gaps and validated rows in one aggregate."""
    gap = F.col("bucket") == P.DATA_GAP
    return ledger.agg(
        F.sum(F.when(~gap, F.col("lost_kwh"))).alias("lost_kwh"),
        F.sum(F.when(~gap, F.col("lost_eur"))).alias("lost_eur"),
        F.sum(F.when(gap, F.col("lost_kwh"))).alias("data_gap_kwh"),
        F.sum(F.when(gap, F.col("lost_eur"))).alias("data_gap_eur"),
        F.count(F.lit(1)).alias("ledger_rows"),
        F.count_if("validated_by_ticket").alias("validated_rows"),
    )


def accounting(
    raw: DataFrame, adjusted: DataFrame, degradation: DataFrame, ledger: DataFrame, params: Params
) -> DataFrame:
    """Adjusted intervals + degradation = ledger; raw - adjusted = removed overlap.

    The removed overlap also holds rows that fell below the minimum. Every stage is
    summed once, in one job.
    """
    stages = {
        "raw": raw,
        "adjusted": adjusted,
        "degradation": degradation,
        "ledger": ledger,
    }
    summed = None
    for name, df in stages.items():
        part = df.agg(F.sum("lost_kwh").alias("kwh"), F.sum("lost_eur").alias("eur")).select(
            F.lit(name).alias("stage"),
            F.coalesce("kwh", F.lit(0.0)).alias("kwh"),
            F.coalesce("eur", F.lit(0.0)).alias("eur"),
        )
        summed = part if summed is None else summed.unionByName(part)

    def of(stage: str, unit: str):
        return F.sum(F.when(F.col("stage") == stage, F.col(unit)).otherwise(0.0))

    return summed.agg(
        of("raw", "kwh").alias("interval_raw_kwh"),
        of("adjusted", "kwh").alias("adjusted_kwh"),
        of("degradation", "kwh").alias("degradation_kwh"),
        (of("raw", "kwh") - of("adjusted", "kwh")).alias("overlap_removed_kwh"),
        of("ledger", "kwh").alias("ledger_total_kwh"),
        (of("adjusted", "eur") + of("degradation", "eur")).alias("split_eur"),
        of("ledger", "eur").alias("ledger_total_eur"),
    )
