"""From the delivered files to the inputs of a run, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lossledger.operators import context, dims, reshape
from lossledger.params import Params
from lossledger.plans.ledger_run import Inputs, LedgerRun
from lossledger.sources import Staging
from lossledger.sources.wide import recover_timestamp


def ingest(
    main_wide: DataFrame,
    errors_wide: DataFrame,
    overview: DataFrame,
    tariffs: DataFrame,
    tickets_new: DataFrame,
    tickets_old: DataFrame,
    catalog: DataFrame,
    params: Params = Params(),
    timestamp: str = "timestamp",
) -> Inputs:
    """The wide telemetry and error tables and the sheet extracts as the inputs of a run.

    Each wide table is read once for each of its parts (plant signals, device signals), with
    only that part's columns; nothing is shuffled here but small sheets.
    """
    main = recover_timestamp(main_wide, timestamp)
    return Inputs(
        plant=context.plant_from_wide(main, params, timestamp),
        readings=reshape.unpivot_readings(main, timestamp),
        error_events=reshape.unpivot_errors(recover_timestamp(errors_wide, timestamp), timestamp),
        inverters=dims.roll_up_devices(reshape.fill_continuation(overview)),
        tariffs_monthly=dims.monthly_tariffs(reshape.unpivot_tariffs(tariffs)),
        tickets=reshape.union_tickets(tickets_new, tickets_old),
        error_catalog=reshape.error_catalog(catalog),
    )


def ledger_from_files(inputs: Inputs, params: Params, staging: Staging) -> DataFrame:
    """The published ledger of ingested files."""
    return LedgerRun(inputs, params, staging).ledger
