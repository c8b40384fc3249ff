"""Telemetry loss ledger on Spark: wide device telemetry in, priced and attributed losses out."""

from lossledger.params import Params

__all__ = ["Params"]
