"""Daily loss events and the service tickets around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lossledger import params as P
from lossledger.functions import epoch_seconds
from lossledger.params import Params

EVENT_KEYS = ("event_date", "inverter", "bucket", "error_code")


def _by_loss() -> list[Column]:
    return [F.desc("lost_eur"), *[F.asc_nulls_last(k) for k in EVENT_KEYS]]


def daily_events(intervals: DataFrame) -> DataFrame:
    """Actionable losses per day, device, cause and code."""
    return (
        intervals.where(F.col("bucket").isin(*P.ACTIONABLE))
        .groupBy(F.col("ts").cast("date").alias("event_date"), "inverter", "bucket", "error_code")
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min("error_description").alias("error_description"),
            F.sum("lost_kwh").alias("lost_kwh"),
            F.sum("lost_eur").alias("lost_eur"),
            F.count(F.lit(1)).alias("n_intervals"),
        )
    )


def _ranked_top(events: DataFrame, n: int, rank: str) -> DataFrame:
    """The n largest events with their rank; only those n rows are ever ranked."""
    top = events.orderBy(*_by_loss()).limit(n)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*_by_loss())))


def top_events(intervals: DataFrame, params: Params) -> DataFrame:
    return _ranked_top(daily_events(intervals), params.top_events, "event_id")


def _ticket_part() -> Column:
    return F.struct("start_ts", "text", "end_ts", "category")


def _unpacked(match: str) -> list[Column]:
    return [
        F.col(f"{match}.start_ts").alias("ticket_start_ts"),
        F.col(f"{match}.end_ts").alias("ticket_end_ts"),
        F.col(f"{match}.category").alias("ticket_category"),
        F.col(f"{match}.text").alias("ticket_text"),
    ]


def nearest_ticket(events: DataFrame, tickets: DataFrame, params: Params) -> DataFrame:
    """Each top event with the ticket of the same device that is nearest in days.

    ``events`` has at most ``top_events`` rows by construction, so it is the side
    that is broadcast to the tickets; the nearest one is a map-side combined
    minimum. Events without a ticket within the slack are kept.
    """
    slack = params.ticket_slack_days
    day = F.expr("interval 1 day")
    near = (F.col("start_ts") >= F.col("first_ts") - day * slack) & (
        F.col("start_ts") < F.col("first_ts") + day * slack
    )
    lag = F.datediff("start_ts", "first_ts")
    keys = events.select("event_id", "inverter", "first_ts")
    dated = tickets.where(F.col("start_ts").isNotNull() & F.col("inverter").isNotNull())
    best = (
        dated.join(F.broadcast(keys), "inverter")
        .where(near)
        .groupBy("event_id")
        .agg(
            F.min_by(_ticket_part(), F.struct(F.abs(lag), F.col("start_ts"), F.col("text"))).alias(
                "_match"
            )
        )
    )
    return (
        events.join(best, "event_id", "left")
        .select(*events.columns, *_unpacked("_match"))
        .withColumns(
            {
                "ticket_lag_days": F.datediff("ticket_start_ts", "first_ts"),
                "validated_by_ticket": F.col("ticket_start_ts").isNotNull(),
            }
        )
    )


def lag_summary(matched: DataFrame) -> DataFrame:
    """Counts and lag range of the matched top events (a table of at most ``top_events`` rows)."""
    lag = F.when(F.col("validated_by_ticket"), F.col("ticket_lag_days"))
    return matched.agg(
        F.count(F.lit(1)).alias("top_events"),
        F.count_if("validated_by_ticket").alias("validated_top_events"),
        F.min(lag).alias("min_lag_days"),
        F.median(lag).alias("median_lag_days"),
        F.max(lag).alias("max_lag_days"),
    )


def lead_events(intervals: DataFrame, tickets: DataFrame, params: Params) -> DataFrame:
    """Events followed by a ticket of the device within the lead time, largest first.

    Event and ticket meet on (device, span of lead-time length): a ticket is put
    into its own span and the one before, where an event up to one lead time
    earlier lies. A device with most tickets thus spreads over many join keys. The hint keeps
    the tickets, a small packed file, from being broadcast.
    """
    span = params.lead_days * 86400
    number = F.floor(epoch_seconds(F.col("first_ts")) / span).cast("bigint")
    events = daily_events(intervals).withColumn("_span", number)
    at = F.floor(epoch_seconds(F.col("start_ts")) / span).cast("bigint")
    dated = (
        tickets.where(F.col("start_ts").isNotNull() & F.col("inverter").isNotNull())
        .select("inverter", "start_ts", "end_ts", "category", "text")
        .withColumn("_span", F.explode(F.array(at, at - 1)))
    )
    soon = (F.col("start_ts") >= F.col("first_ts")) & (
        F.col("start_ts") < F.col("first_ts") + F.expr("interval 1 day") * params.lead_days
    )
    carried = [c for c in events.columns if c not in (*EVENT_KEYS, "_span")]
    first = (
        events.join(dated.hint("merge"), ["inverter", "_span"])
        .where(soon)
        .groupBy(*EVENT_KEYS)
        .agg(
            *[F.first(c).alias(c) for c in carried],
            F.min_by(_ticket_part(), F.struct("start_ts", "text")).alias("_match"),
        )
    )
    return _ranked_top(
        first.select(*EVENT_KEYS, *carried, *_unpacked("_match")).withColumn(
            "ticket_lag_days", F.datediff("ticket_start_ts", "first_ts")
        ),
        params.top_events,
        "lead_event_id",
    )


def lead_summary(lead: DataFrame) -> DataFrame:
    return lead.agg(
        F.count(F.lit(1)).alias("lead_events"),
        F.min("ticket_lag_days").alias("min_lag_days"),
        F.median("ticket_lag_days").alias("median_lag_days"),
        F.max("ticket_lag_days").alias("max_lag_days"),
        F.sum("lost_eur").alias("lead_event_lost_eur"),
    )


def loss_until_ticket(intervals: DataFrame, lead: DataFrame) -> DataFrame:
    """Daily and running loss of the largest lead event until its ticket came."""
    case = lead.where("ticket_lag_days > 0").orderBy(*_by_loss()).limit(1)
    return losses_until_tickets(intervals, case).drop("lead_event_id")


def losses_until_tickets(intervals: DataFrame, lead: DataFrame) -> DataFrame:
    """Daily and running loss of each lead event until its ticket came.

    The lead list is broadcast (it is limited to the top events); a running sum covers at
    most one lead time of days.
    """
    cases = lead.select(
        "lead_event_id",
        F.col("inverter").alias("_device"),
        F.col("bucket").alias("_cause"),
        F.col("first_ts").alias("_from"),
        F.col("ticket_start_ts").alias("_to"),
    )
    in_order = (
        Window.partitionBy("lead_event_id")
        .orderBy("d")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same = (F.col("inverter") == F.col("_device")) & (F.col("bucket") == F.col("_cause"))
    return (
        intervals.join(F.broadcast(cases), same)
        .where((F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to")))
        .groupBy("lead_event_id", "inverter", "bucket", F.col("ts").cast("date").alias("d"))
        .agg(F.sum("lost_eur").alias("lost_eur"))
        .withColumn("cumulative_lost_eur", F.sum("lost_eur").over(in_order))
    )
