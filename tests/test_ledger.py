from dataclasses import replace
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossledger.operators import attribution, context, ledger, reshape, tickets, trend, twin
from lossledger.params import Params
from lossledger.plans import driver_tables
from lossledger.plans.ledger_run import LedgerRun
from lossledger.sources import Staging

DEFAULT = Params()
NOON = datetime(2020, 6, 1, 12)
BASE = (
    "ts timestamp_ntz, inverter string, module_type string, kwp double, actual_kw double, "
    "actual_missing boolean, p10_twin_kw double, p50_twin_kw double, p90_twin_kw double, "
    "irradiation_w_m2 double, dv_pct double, evu_pct double, plant_feed_in_kw double, "
    "fleet_median_kw_per_kwp double, peer_ratio double, below_p10 boolean"
)


def base_row(device, ts=NOON, actual=1.0, missing=False, dv=100.0, evu=100.0, feed=100.0, fleet=0.5):
    return (ts, device, "M", 10.0, actual, missing, 4.0, 5.0, 6.0, 500.0, dv, evu, feed, fleet, 0.2,
            not missing and actual < 4.0)


def classify(spark, rows, errors=(), tariffs=(), params=DEFAULT):
    base = spark.createDataFrame(rows, BASE)
    error_rows = spark.createDataFrame(
        list(errors),
        "ts timestamp_ntz, inverter string, error_code long, error_code_base long, "
        "error_description string, error_severity string, n_error_rows long",
    )
    prices = spark.createDataFrame(list(tariffs), "inverter string, month date, ct_per_kwh double")
    out = attribution.loss_intervals(base, error_rows, prices, F.lit(100.0), params)
    return {(r["inverter"], r["ts"]): r for r in out.collect()}


def test_ladder_branches(spark):
    fault = [(NOON, d, 65541, 5, "Fan", "fault", 1) for d in ("fault", "both")]
    rows = [
        base_row("grid", evu=30.0, dv=60.0),
        base_row("price", dv=60.0),
        base_row("both", evu=30.0),
        base_row("fault"),
        base_row("gap", actual=0.0, missing=True, feed=36.0),
        base_row("gap-no-meter", actual=0.0, missing=True, feed=None),
        base_row("out-low-meter", actual=0.0, missing=True, feed=35.0),
        base_row("dead", actual=0.1),
        base_row("alone", actual=0.1001),
        base_row("night", actual=0.0, missing=True, fleet=0.10),
        base_row("unknown-fleet", actual=0.0, fleet=None),
        base_row("fine", actual=4.5),
    ]
    got = classify(spark, rows, fault)
    causes = {d: r["bucket"] for (d, _), r in got.items()}
    assert causes == {
        "grid": "CURTAILMENT_GRID",
        "price": "CURTAILMENT_PRICE",
        "both": "CURTAILMENT_GRID",
        "fault": "FAULT",
        "gap": "DATA_GAP",
        "gap-no-meter": "DATA_GAP",
        "out-low-meter": "OUTAGE",
        "dead": "OUTAGE",
    }
    assert got[("grid", NOON)]["effective_actual_kw"] == 1.0


def test_curtailed_device_is_judged_by_its_set_point(spark):
    row = list(base_row("d", actual=4.5, evu=30.0))
    got = classify(spark, [tuple(row)])
    assert got[("d", NOON)]["effective_actual_kw"] == 3.0
    assert got[("d", NOON)]["lost_kw"] == 2.0
    assert got[("d", NOON)]["lost_eur"] == pytest.approx(2.0 * 5 / 60 * 0.10)


@pytest.mark.parametrize("n, expected", [(8, 0), (9, 9)])
def test_persistence_needs_nine_of_thirteen(spark, n, expected):
    rows = [base_row("d", NOON + timedelta(minutes=5 * i), actual=1.0) for i in range(n)]
    # an unflagged interval in between neither helps nor hurts
    rows.append(base_row("d", NOON + timedelta(minutes=5 * n), actual=4.5))
    got = classify(spark, rows)
    hits = [r for r in got.values() if r["bucket"] == "UNDERPERFORMANCE_LOCAL"]
    # with nine in a row only the inner ones see all nine
    span = [i for i in range(n) if sum(abs(i - j) <= 6 for j in range(n)) >= 9]
    assert len(hits) == len(span) and (len(hits) > 0) == (expected > 0)


def test_small_losses_are_dropped_and_tariff_is_used(spark):
    small = list(base_row("small", dv=60.0))
    small[4] = 4.98  # loses exactly 0.02 kW
    got = classify(spark, [tuple(small), base_row("t", dv=60.0)], tariffs=[("t", date(2020, 6, 1), 20.0)])
    assert set(d for d, _ in got) == {"t"}
    assert got[("t", NOON)]["lost_eur"] == pytest.approx(4.0 * 5 / 60 * 0.20)


def ledger_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "inverter string, year int, month date, module_type string, bucket string, error_code long, "
        "error_code_base long, error_description string, lost_kwh double, lost_eur double, "
        "n_intervals long, avg_ct_per_kwh double",
    )


def row(device, bucket, kwh=10.0, month=date(2020, 6, 1)):
    return (device, 2020, month, "M", bucket, None, None, None, kwh, kwh / 10, 1, 10.0)


def test_ticket_window_edges(spark):
    rows = ledger_rows(
        spark, [row(d, b) for d in ("first", "before", "last", "after", "none") for b in ("FAULT", "CURTAILMENT_GRID")]
    )
    starts = {
        "first": datetime(2020, 5, 18),
        "before": datetime(2020, 5, 17, 23, 59),
        "last": datetime(2020, 7, 14, 23, 59),
        "after": datetime(2020, 7, 15),
    }
    own = [(d, s, "x") for d, s in starts.items()] + [("none", None, "x")]

    def flags(more):
        t = spark.createDataFrame(own + more, "inverter string, start_ts timestamp_ntz, text string")
        out = ledger.validate_by_ticket(rows, t, DEFAULT).collect()
        return {(r["inverter"], r["bucket"]): r["validated_by_ticket"] for r in out}

    plain = flags([])
    assert {d for (d, _), v in plain.items() if v} == {"first", "last"}
    site = flags([(None, datetime(2020, 6, 5), "NETZ-Ausfall | x")])
    assert all(v for (_, b), v in site.items() if b == "CURTAILMENT_GRID")
    assert {d for (d, b), v in site.items() if v and b == "FAULT"} == {"first", "last"}


def test_overlap_removed_once_and_accounting_holds(spark):
    raw = ledger_rows(
        spark,
        [row("a", "UNDERPERFORMANCE_LOCAL", 10.0), row("b", "UNDERPERFORMANCE_LOCAL", 2.0), row("a", "OUTAGE", 5.0)],
    )
    degradation = spark.createDataFrame(
        [(d, 2020, date(2020, 6, 1), "M", 3.0, 0.3, 10.0) for d in ("a", "b")],
        "inverter string, year int, month date, module_type string, lost_kwh double, lost_eur double, ct_per_kwh double",
    )
    adjusted = ledger.remove_overlap(raw, degradation, DEFAULT)
    assert sorted((r["inverter"], r["bucket"], r["lost_kwh"]) for r in adjusted.collect()) == [
        ("a", "OUTAGE", 5.0), ("a", "UNDERPERFORMANCE_LOCAL", 7.0)
    ]
    full = ledger.unvalidated_ledger(adjusted, degradation, DEFAULT)
    check = ledger.accounting(raw, adjusted, degradation, full, DEFAULT).first()
    assert check["ledger_total_kwh"] == pytest.approx(check["adjusted_kwh"] + check["degradation_kwh"]) == 18.0
    assert check["overlap_removed_kwh"] == pytest.approx(5.0)


def test_theil_sen_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    months = [date(2018 + i // 12, i % 12 + 1, 1) for i in range(40)]
    rows = []
    for device, n in (("a", 40), ("ties", 30), ("short", 11)):
        for m in months[:n]:
            y = round(1 - 0.01 * (m - months[0]).days / 365.25 + rng.normal(0, 0.05), 1 if device == "ties" else 6)
            rows.append((device, m, "M", float(y)))
    health = spark.createDataFrame(rows, "inverter string, month date, module_type string, median_ratio double")
    got = {r["inverter"]: r for r in trend.theil_sen(health, DEFAULT).collect()}
    assert set(got) == {"a", "ties"}
    for device in got:
        points = [((m - months[0]).days / 365.25, y) for d, m, _, y in rows if d == device]
        x, y = np.array(points).T
        slopes = np.sort([(y[j] - y[i]) / (x[j] - x[i]) for j in range(len(x)) for i in range(j)])
        n = len(x)
        _, counts = np.unique(y, return_counts=True)
        sigma = np.sqrt((n * (n - 1) * (2 * n + 5) - sum(k * (k - 1) * (2 * k + 5) for k in counts)) / 18.0)
        z = -1.6448536269514729
        upper = min(int(np.round((len(slopes) - z * sigma) / 2)), len(slopes) - 1)
        lower = max(int(np.round((len(slopes) + z * sigma) / 2)) - 1, 0)
        r = got[device]
        assert r["slope_ratio_per_year"] == pytest.approx(np.median(slopes))
        assert r["intercept_ratio"] == pytest.approx(np.median(y) - np.median(slopes) * np.median(x))
        assert (r["ci_low_pct_per_year"], r["ci_high_pct_per_year"]) == pytest.approx(
            (slopes[lower] * 100, slopes[upper] * 100)
        )


def intervals_for(spark, rows):
    return spark.createDataFrame(
        [(ts, d, "FAULT", c, "text", eur * 2, eur) for ts, d, c, eur in rows],
        "ts timestamp_ntz, inverter string, bucket string, error_code long, error_description string, "
        "lost_kwh double, lost_eur double",
    )


def ticket_table(spark, rows):
    return spark.createDataFrame(
        [(d, s, None, "cat", t) for d, s, t in rows],
        "inverter string, start_ts timestamp_ntz, end_ts timestamp_ntz, category string, text string",
    )


def test_nearest_and_lead_tickets(spark):
    losses = intervals_for(
        spark, [(datetime(2020, 6, 10, 9), "a", 5, 10.0), (datetime(2020, 6, 10, 12), "a", 5, 1.0), (datetime(2020, 6, 10), "b", None, 3.0)]
    )
    found = ticket_table(
        spark,
        [
            ("a", datetime(2020, 6, 5), "five days before"),
            ("a", datetime(2020, 6, 13), "three days after"),
            ("a", datetime(2020, 7, 10, 9), "thirty days after"),
            (None, datetime(2020, 6, 10), "site"),
            ("b", datetime(2020, 5, 27), "exactly slack before"),
            ("b", datetime(2020, 7, 9, 23), "almost thirty days"),
        ],
    )
    near = {
        r["inverter"]: r
        for r in tickets.nearest_ticket(tickets.top_events(losses, DEFAULT), found, DEFAULT).collect()
    }
    assert near["a"]["ticket_text"] == "three days after" and near["a"]["ticket_lag_days"] == 3
    assert near["a"]["event_id"] == 1 and near["a"]["n_intervals"] == 2
    assert near["b"]["ticket_text"] == "exactly slack before" and near["b"]["ticket_lag_days"] == -14
    lead = {r["inverter"]: r for r in tickets.lead_events(losses, found, DEFAULT).collect()}
    assert lead["a"]["ticket_text"] == "three days after"
    assert lead["b"]["ticket_text"] == "almost thirty days" and lead["b"]["ticket_lag_days"] == 29


def test_error_dilation(spark):
    errors = spark.createDataFrame(
        [(NOON, "a", 65536 * 2 + 9, 1), (NOON + timedelta(minutes=10), "a", 7, 1)],
        "ts timestamp_ntz, inverter string, error_code long, n_error_rows long",
    )
    known = spark.createDataFrame([(NOON + timedelta(minutes=5 * k),) for k in range(-3, 3)], "ts timestamp_ntz")
    catalog = spark.createDataFrame([(9, "nine", "fault")], "code long, description string, severity_class string")
    got = {r["ts"]: r for r in attribution.error_context(errors, known, catalog, DEFAULT).collect()}
    assert len(got) == 6
    assert got[NOON]["error_code"] == 7 and got[NOON]["error_description"] is None
    first = got[NOON - timedelta(minutes=15)]
    assert (first["error_code_base"], first["error_description"], first["n_error_rows"]) == (9, "nine", 1)


def test_single_code_lookup(spark):
    catalog = spark.createDataFrame(
        [(9, "nine", "fault"), (10, "ten", "fault")], "code long, description string, severity_class string"
    )
    assert [r["description"] for r in attribution.lookup_code(catalog, 65536 * 4 + 10, DEFAULT).collect()] == ["ten"]


def test_month_partitioned_run_gives_the_same_ledger(spark):
    d = driver_tables.tables(spark, "/root/testdata/sf0.001")
    other = LedgerRun(d.run.inputs, driver_tables.DAILY, Staging(spark))
    rounded = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in d.run.ledger.dtypes]
    assert sorted(map(str, other.ledger.select(*rounded).collect())) == sorted(
        map(str, d.run.ledger.select(*rounded).collect())
    )


def test_duplicate_timestamps_and_null_telemetry(spark):
    rows = [(NOON, 100.0, True), (NOON, 300.0, None), (NOON + timedelta(days=1), None, None)]
    plant = spark.createDataFrame(rows, "ts timestamp_ntz, irradiation_w_m2 double, is_curtailed boolean")
    for name in ("altitude_deg", "ambient_temp_c", "module_temp_c", "dv_pct", "evu_pct", "janitza_p_ac_kw", "cosphi", "s_ac_kva"):
        plant = plant.withColumn(name, F.lit(None).cast("double"))
    plant = plant.withColumn("is_day", F.lit(True))
    assert context.canonical_plant(plant).count() == 2
    features = {r["ts"]: r for r in twin.twin_features(plant, DEFAULT).collect()}
    assert features[NOON]["irradiation_w_m2"] == 200.0 and features[NOON]["is_curtailed"]
    assert features[NOON + timedelta(days=1)]["irradiation_w_m2"] == 0.0
    controls = {r["ts"]: r for r in context.plant_controls(plant).collect()}
    assert controls[NOON]["evu_pct"] == 100.0 and controls[NOON]["plant_feed_in_kw"] is None


def test_expected_monthly_equals_grid_sum(spark):
    moments = spark.createDataFrame(
        [(datetime(2020, 1 + i % 3, 1 + i % 28, i % 24), i % 7, (i % 5) / 10 if i % 7 else None, i % 4 != 0) for i in range(300)],
        "ts timestamp_ntz, bin int, fleet_p50_per_kwp double, is_model_day boolean",
    )
    fleet = moments.groupBy("bin").agg(F.first("fleet_p50_per_kwp", ignorenulls=True).alias("f"))
    moments = moments.join(fleet, "bin").withColumn("fleet_p50_per_kwp", F.col("f")).drop("f")
    models = spark.sql(
        "select * from values ('a', 10D, 'M', cast(null as double), array(0.1D, null, 0.5D, null, 2D)), "
        "('b', 20D, 'N', 0.5D, null) t(inverter, kwp, module_type, eta_system, curve)"
    )
    got = {(r["month"], r["inverter"]): r["expected_daylight_kwh"] for r in twin.expected_monthly(moments, models, DEFAULT).collect()}
    grid = (
        moments.where("is_model_day").join(models)
        .withColumn("p50", twin.curve_p50(DEFAULT))
        .groupBy(F.trunc(F.col("ts").cast("date"), "month").alias("month"), "inverter")
        .agg((F.sum("p50") * DEFAULT.step_hours).alias("e"))
    )
    want = {(r["month"], r["inverter"]): r["e"] for r in grid.collect()}
    assert got == pytest.approx(want)


def test_split_falls_back_to_share(spark):
    params = replace(DEFAULT, min_rows_per_device=10, min_fit_rows=10, min_valid_rows=5, min_holdout_rows=3, holdout_tail_rows=4)
    rows = [("date", datetime(2017, 11, 1) + timedelta(days=i), 1.0) for i in range(45)]
    rows += [("share", datetime(2017, 3, 1) + timedelta(days=i), 1.0) for i in range(40)]
    rows += [("tail", datetime(2017, 3, 1) + timedelta(days=i), 1.0) for i in range(12)]
    rows += [("few", datetime(2017, 3, 1) + timedelta(days=i), 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "inverter string, ts timestamp_ntz, p_ac_kw double")
    out = twin.split_rows(df, params).groupBy("inverter").agg(
        F.count_if("is_fit").alias("f"), F.count_if("is_valid").alias("v")
    )
    assert {r["inverter"]: (r["f"], r["v"]) for r in out.collect()} == {
        "date": (30, 15), "share": (32, 8), "tail": (10, 4)
    }


def test_continuation_rows(spark):
    rows = [
        (1, 1, "WR 01 .01 .001", "A", "10,5"),
        (1, 2, None, "B", "4"),
        (1, 3, None, None, "9"),
        (1, 4, "Summe", "A", "99"),
        (1, 5, "ACC 01", "A", "7"),
        (1, 6, None, "B", "3"),
        (1, 7, "INV 01.01.002", None, "n/a"),
        (1, 8, None, "C", "2"),
    ]
    sheet = spark.createDataFrame(rows, "sheet int, row_no int, description string, module_type string, kwp string")
    for name in ("manufacturer", "module_wp", "modules", "strings", "modules_per_string", "location_a", "location_b"):
        sheet = sheet.withColumn(name, F.lit(None).cast("string"))
    got = [(r["row_no"], r["inverter"], r["kwp"]) for r in reshape.fill_continuation(sheet).orderBy("row_no").collect()]
    assert got == [(1, "INV 01.01.001", 10.5), (2, "INV 01.01.001", 4.0), (8, "INV 01.01.002", 2.0)]
