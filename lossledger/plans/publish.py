"""What a finished run leaves behind: tables, views and ordered CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lossledger.operators import ledger
from lossledger.plans.ledger_run import LedgerRun
from lossledger.sources.sinks import export_csv, register_views, write_table


def publish(run: LedgerRun, root: str, views: bool = True) -> dict[str, DataFrame]:
    """Writes the ledger, its three roll-ups and the two event tables under ``root``.

    Each is a Parquet table (tables/) and an ordered CSV folder (csv/); with ``views`` also a
    view of its name. Returns the tables.
    """
    root = root.rstrip("/")
    whole = run.ledger
    parts = {
        "loss_ledger": (whole, ["month", "inverter", "bucket"]),
        "loss_by_year_cause": (ledger.by_year_cause(whole), ["year", "bucket"]),
        "loss_top20": (ledger.top_inverter_cause(whole), [F.desc("lost_eur"), "inverter", "bucket"]),
        "loss_by_module_year": (ledger.by_module_year(whole), ["year", "module_type", "bucket"]),
        "ticket_events": (run.ticket_events, None),
        "lead_events": (run.lead_events, None),
    }
    out = {}
    for name, (table, order) in parts.items():
        out[name] = write_table(table, f"{root}/tables/{name}")
        export_csv(out[name], f"{root}/csv/{name}", order)
    if views:
        register_views(out)
    return out
