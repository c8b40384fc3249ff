"""Every tunable of the ledger in one immutable record.

The defaults describe a plant sampled every five minutes whose first full year
is 2017. All of them can be replaced, e.g. ``replace(Params(), step_hours=1.0)``.
"""

from __future__ import annotations

from dataclasses import dataclass

GRID = "CURTAILMENT_GRID"
PRICE = "CURTAILMENT_PRICE"
FAULT = "FAULT"
DATA_GAP = "DATA_GAP"
OUTAGE = "OUTAGE"
UNDERPERFORMANCE = "UNDERPERFORMANCE_LOCAL"
DEGRADATION = "DEGRADATION"

# Causes a service crew can act on; a telemetry gap is never counted as a loss.
ACTIONABLE = (FAULT, OUTAGE, UNDERPERFORMANCE)
CURTAILMENT = (GRID, PRICE)

# Display names of the cause codes.
BUCKET_LABELS = {
    "DEGRADATION": "Degradation",
    "FAULT": "Fault",
    "OUTAGE": "Outage",
    "UNDERPERFORMANCE_LOCAL": "Underperformance",
    "CURTAILMENT_PRICE": "Curtailment — price (DV)",
    "CURTAILMENT_GRID": "Curtailment — grid (EVU)",
    "DATA_GAP": "Telemetry gap",
}


@dataclass(frozen=True)
class Params:
    # sampling grid
    step_hours: float = 5.0 / 60.0

    # daylight and curtailment
    day_altitude_deg: float = 5.0
    curtailment_free_pct: float = 100.0
    curtail_threshold_pct: float = 99.5
    model_day_irradiation: float = 20.0

    # physics baseline
    temp_coefficient_per_c: float = -0.004
    reference_temp_c: float = 25.0
    derate_floor: float = 0.65
    default_eta: float = 0.82
    eta_ratio_low: float = 0.2
    eta_ratio_high: float = 1.2
    eta_min_irradiation: float = 200.0
    physics_p10_factor: float = 0.90
    physics_p90_factor: float = 1.10
    train_from: str = "2017-01-01"
    train_to: str = "2018-01-01"

    # learned twin
    train_min_irradiation: float = 50.0
    holdout_from: str = "2017-12-01"
    min_rows_per_device: int = 2000
    min_fit_rows: int = 1000
    min_valid_rows: int = 200
    min_holdout_rows: int = 100
    holdout_tail_rows: int = 2000
    fit_share: float = 0.8
    curve_bins_per_unit: int = 20
    gbt_iterations: int = 180
    gbt_step: float = 0.08
    gbt_depth: int = 5
    gbt_min_instances: int = 40
    gbt_bins: int = 256
    gbt_patience: int = 15
    gbt_validation_share: float = 0.12
    seed: int = 42

    # long-term trend
    health_min_irradiation: float = 100.0
    health_min_expected_share: float = 0.10
    health_min_points: int = 100
    trend_from: str = "2018-01-01"
    trend_min_months: int = 12
    days_per_year: float = 365.25
    degradation_cap: float = 0.40

    # cause ladder
    min_loss_kw: float = 0.02
    data_gap_ratio: float = 0.7
    fleet_alive: float = 0.10
    dead_share: float = 0.01
    persistence_reach_minutes: int = 30
    persistence_min_count: int = 9
    dilation_offsets_minutes: tuple[int, ...] = (-15, -10, -5, 0, 5, 10, 15)
    code_modulus: int = 65536
    default_ct_per_kwh: float = 10.0
    min_ledger_kwh: float = 0.001

    # tickets
    ticket_slack_days: int = 14
    lead_days: int = 30
    top_events: int = 50

    # sanity checks
    meter_check_from: str = "2018-06-01"
    meter_check_to: str = "2018-06-08"
    meter_check_min_kw: float = 10.0
    peak_from: str = "2018-06-01"
    peak_to: str = "2018-07-01"
    capacity_tolerance: float = 1.1
    major_group_size: int = 5
