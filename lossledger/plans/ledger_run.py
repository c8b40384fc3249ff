"""The whole ledger as a chain of tables.

Each property is a DataFrame. The ones that many later steps read are written
once through :class:`~lossledger.sources.staging.Staging`; all others stay lazy
and fuse into the query that uses them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, functions as F

from lossledger.functions import month_of
from lossledger.operators import attribution, baseline, boosting, context, ledger, tickets, trend, twin
from lossledger.params import Params
from lossledger.sources import Staging


@dataclass(frozen=True)
class Inputs:
    """Cleaned tables a run starts from. Plant and readings may hold repeated keys."""

    plant: DataFrame
    readings: DataFrame
    error_events: DataFrame
    inverters: DataFrame
    tariffs_monthly: DataFrame
    tickets: DataFrame
    error_catalog: DataFrame


class LedgerRun:
    """Long tables are partitioned by month, so that time windows read only their months.

    ``learner`` picks the twin whose bands drive interval losses: ``curve`` (per-device power
    curve) or ``trees`` (boosted trees per device). Runs on one ``Staging`` share every table that
    does not depend on the learner; the others get the learner's name. Degradation and health stay
    on the curve's monthly calendar with either learner (the calendar sums bins, never the
    timestamps x devices grid, which a tree expectation would need).
    """

    LEARNERS = ("curve", "trees")

    def __init__(self, inputs: Inputs, params: Params, staging: Staging, learner: str = "curve"):
        if learner not in self.LEARNERS:
            raise ValueError(f"learner must be one of {self.LEARNERS}")
        self.inputs = inputs
        self.params = params
        self.staging = staging
        self.learner = learner

    def _own(self, name: str) -> str:
        """The staged name of a table that depends on the learner."""
        return name if self.learner == "curve" else f"{name}_{self.learner}"

    def _long_table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        month = month_of(F.col("ts"))
        return self.staging.table(name, lambda: build().withColumn("month", month), ["month"])

    # canonical inputs ---------------------------------------------------------
    @cached_property
    def inverters(self) -> DataFrame:
        return self.staging.table("inverters", lambda: self.inputs.inverters)

    @cached_property
    def plant(self) -> DataFrame:
        return self.staging.table("plant", lambda: context.canonical_plant(self.inputs.plant))

    @cached_property
    def readings(self) -> DataFrame:
        return self._long_table(
            "readings", lambda: context.canonical_readings(self.inputs.readings)
        )

    @cached_property
    def error_intervals(self) -> DataFrame:
        return self.staging.table(
            "error_intervals", lambda: context.error_intervals(self.inputs.error_events)
        )

    @cached_property
    def tickets(self) -> DataFrame:
        return self.staging.table("tickets", lambda: self.inputs.tickets)

    @cached_property
    def tariffs(self) -> DataFrame:
        return self.staging.table("tariffs_monthly", lambda: self.inputs.tariffs_monthly)

    @cached_property
    def error_catalog(self) -> DataFrame:
        return self.staging.table("error_catalog", lambda: self.inputs.error_catalog)

    @property
    def total_kwp(self) -> Column:
        return self.inverters.agg(F.sum("kwp")).scalar()

    # context -------------------------------------------------------------------
    @cached_property
    def controls(self) -> DataFrame:
        return context.plant_controls(self.inputs.plant)

    def build_fleet(self) -> DataFrame:
        return context.fleet_profile(self.readings, self.inverters, self.plant)

    @cached_property
    def fleet(self) -> DataFrame:
        return self.staging.table("fleet", self.build_fleet)

    # physics -------------------------------------------------------------------
    def build_eta(self) -> DataFrame:
        return baseline.fit_eta(self.readings, self.inverters, self.plant, self.params)

    @cached_property
    def eta(self) -> DataFrame:
        return self.staging.table("eta", self.build_eta)

    @cached_property
    def physics(self) -> DataFrame:
        return baseline.physics_predictions(
            self.readings, self.inverters, self.plant, self.eta, self.fleet, self.params
        )

    def build_physics_monthly(self) -> DataFrame:
        predictions = baseline.physics_predictions(
            self.readings,
            self.inverters,
            self.plant,
            self.eta,
            self.fleet,
            self.params,
            carry=("is_day", "irradiation_w_m2"),
        )
        return baseline.physics_monthly(predictions, self.params)

    @cached_property
    def physics_monthly(self) -> DataFrame:
        return self.staging.table("physics_monthly", self.build_physics_monthly)

    def build_performance_ratio(self) -> DataFrame:
        return baseline.performance_ratio_monthly(
            self.readings, self.inverters, self.plant, self.params
        )

    @cached_property
    def performance_ratio(self) -> DataFrame:
        return self.staging.table("performance_ratio", self.build_performance_ratio)

    # twin ----------------------------------------------------------------------
    def build_features(self) -> DataFrame:
        return twin.twin_features(self.inputs.plant, self.params)

    @cached_property
    def features(self) -> DataFrame:
        return self.staging.table("features", self.build_features)

    def build_training_rows(self) -> DataFrame:
        return twin.training_rows(
            self.readings,
            self.features,
            self.inverters,
            self.eta,
            self.error_intervals,
            self.params,
        )

    @cached_property
    def split(self) -> DataFrame:
        return self.staging.table(
            "split_rows", lambda: twin.split_rows(self.build_training_rows(), self.params)
        )

    @cached_property
    def curve(self) -> DataFrame:
        return self.staging.table("curve", lambda: twin.fit_curve(self.split, self.params))

    @cached_property
    def fleet_curve(self) -> DataFrame:
        return self.staging.table(
            "fleet_curve", lambda: twin.fit_fleet_curve(self.split, self.params)
        )

    @cached_property
    def holdout(self) -> DataFrame:
        def build() -> DataFrame:
            models = twin.device_models(self.inverters, self.eta, self.curve, self.params)
            return twin.holdout_predictions(self.split, models, self.fleet_curve, self.params)

        return self.staging.table("holdout", build)

    def build_metrics(self) -> DataFrame:
        return twin.validation_metrics(self.holdout, self.split)

    @cached_property
    def metrics(self) -> DataFrame:
        return self.staging.table("metrics", self.build_metrics)

    @cached_property
    def curve_models(self) -> DataFrame:
        return self.staging.table(
            "models",
            lambda: twin.device_models(
                self.inverters, self.eta, self.curve, self.params, self.metrics
            ),
        )

    @cached_property
    def tree_fit(self) -> DataFrame:
        return self.staging.table("tree_fit", lambda: boosting.fit_devices(self.split, self.params))

    def build_tree_metrics(self) -> DataFrame:
        holdout = boosting.tree_holdout(self.split, self.tree_fit, self.params)
        metrics = twin.validation_metrics(holdout, self.split)
        iterations = self.tree_fit.select("inverter", F.col("rounds_run").alias("model_iterations"), "trees_kept")
        return metrics.join(iterations.hint("merge"), "inverter")

    @cached_property
    def tree_metrics(self) -> DataFrame:
        return self.staging.table("tree_metrics", self.build_tree_metrics)

    @cached_property
    def models(self) -> DataFrame:
        if self.learner == "curve":
            return self.curve_models
        return self.staging.table(
            self._own("models"),
            lambda: twin.with_band_lines(
                boosting.tree_models(self.inverters, self.eta, self.tree_metrics), self.params
            ),
        )

    @property
    def tree_predictor(self) -> Callable[..., DataFrame]:
        return partial(boosting.predict_trees, fitted=self.tree_fit)

    @cached_property
    def moments(self) -> DataFrame:
        def build() -> DataFrame:
            binned = twin.with_bins(self.features, self.fleet_curve, self.params)
            return attribution.moments(binned, self.controls, self.fleet)

        return self.staging.table("moments", build)

    @cached_property
    def predictions(self) -> DataFrame:
        if self.learner == "trees":
            return self.tree_predictor(self.readings, self.moments, self.models, self.params)
        return twin.predict(self.readings, self.moments, self.models, self.params)

    # trend ---------------------------------------------------------------------
    def build_health(self) -> DataFrame:
        return trend.monthly_health(
            self.readings, self.moments, self.curve_models, self.error_intervals, self.params
        )

    @cached_property
    def health(self) -> DataFrame:
        return self.staging.table("health", self.build_health)

    def build_slopes(self) -> DataFrame:
        return trend.theil_sen(self.health, self.params)

    @cached_property
    def slopes(self) -> DataFrame:
        return self.staging.table("slopes", self.build_slopes)

    @cached_property
    def expected_monthly(self) -> DataFrame:
        return twin.expected_monthly(self.moments, self.curve_models, self.params)

    # attribution ---------------------------------------------------------------
    def build_error_context(self) -> DataFrame:
        return attribution.error_context(
            self.error_intervals, self.features, self.error_catalog, self.params
        )

    @cached_property
    def interval_base(self) -> DataFrame:
        if self.learner == "trees":
            return attribution.interval_base(
                self.readings,
                self.moments,
                self.models,
                self.params,
                predictor=self.tree_predictor,
                features=(*twin.FEATURES, "physics_base_kw_per_kwp"),
                model_columns=("p50_physics_kw",),
            )
        return attribution.interval_base(
            self.readings, self.moments, self.models, self.params
        )

    def build_intervals(self) -> DataFrame:
        return attribution.loss_intervals(
            self.interval_base,
            self.build_error_context(),
            self.tariffs,
            self.total_kwp,
            self.params,
        )

    @cached_property
    def intervals(self) -> DataFrame:
        return self._long_table(self._own("loss_intervals"), self.build_intervals)

    # ledger --------------------------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        return self.staging.table(self._own("ledger_raw"), lambda: ledger.ledger_raw(self.intervals))

    def build_degradation(self) -> DataFrame:
        return ledger.degradation_loss(
            self.expected_monthly, self.slopes, self.raw, self.tariffs, self.params
        )

    @cached_property
    def degradation(self) -> DataFrame:
        return self.staging.table(self._own("degradation_loss"), self.build_degradation)

    @cached_property
    def adjusted(self) -> DataFrame:
        return ledger.remove_overlap(self.raw, self.degradation, self.params)

    def build_ledger(self) -> DataFrame:
        rows = ledger.unvalidated_ledger(self.adjusted, self.degradation, self.params)
        return ledger.validate_by_ticket(rows, self.tickets, self.params)

    @cached_property
    def ledger(self) -> DataFrame:
        return self.staging.table(self._own("ledger"), self.build_ledger)

    # tickets -------------------------------------------------------------------
    @cached_property
    def ticket_events(self) -> DataFrame:
        top = tickets.top_events(self.intervals, self.params)
        return tickets.nearest_ticket(top, self.tickets, self.params)

    @cached_property
    def lead_events(self) -> DataFrame:
        return tickets.lead_events(self.intervals, self.tickets, self.params)
