"""From delivered files to inputs; layouts that vary from device to device."""

import pytest
from pyspark.sql import functions as F

from lossledger.operators import marts, reshape, twin
from lossledger.plans import driver_tables
from lossledger.sources import Staging


def wide(spark, suffix, values):
    """One row; column types differ by device."""
    cells = [F.lit("2020.01.01 00:00").alias("timestamp")]
    cells += [v.alias(f"INV 01.01.{i:03d} / {suffix}") for i, v in enumerate(values)]
    return spark.range(1).select(*cells)


def test_power_columns_of_mixed_types(spark):
    values = [F.lit("1,5"), F.lit(2.5), F.lit(" 3.5"), F.lit(4), F.lit("n/a"), F.lit(None).cast("double")]
    got = {r["inverter"][-1]: r["p_ac_kw"] for r in reshape.unpivot_readings(wide(spark, "P_AC (kW)", values)).collect()}
    assert got == {"0": 1.5, "1": 2.5, "2": 3.5, "3": 4.0, "4": None, "5": None}


def test_error_codes_are_read_as_numbers(spark):
    values = [F.lit("70000.0"), F.lit(70001.0), F.lit("70002"), F.lit(70003), F.lit("0"), F.lit("0.0"), F.lit("n/a"), F.lit("1e30"), F.lit("70004,0")]
    got = sorted(r["error_code"] for r in reshape.unpivot_errors(wide(spark, "Error", values)).collect())
    assert got == [70000, 70001, 70002, 70003, 70004]


def test_a_loss_in_an_unlisted_month_is_not_dropped(spark):
    losses = spark.createDataFrame([("a", "2020-01", 1.0), ("a", "2031-05", 2.0)], "inverter string, month_label string, lost_eur double")
    derived = reshape.pivot_months(losses).first().asDict()
    assert derived == {"inverter": "a", "2020-01": 1.0, "2031-05": 2.0}
    with pytest.raises(Exception, match="not listed"):
        reshape.pivot_months(losses, ["2020-01"]).collect()


def test_a_device_with_gaps_only_keeps_its_gap_energy(spark):
    rows = [("a", "2020-01-01", "OUTAGE", 1.0, 2.0, False), ("a", "2020-02-01", "DATA_GAP", 5.0, 0.0, False), ("b", "2020-01-01", "DATA_GAP", 7.0, 0.0, False)]
    ledger = spark.createDataFrame(rows, "inverter string, month string, bucket string, lost_kwh double, lost_eur double, validated_by_ticket boolean")
    got = {r["inverter"]: (r["month"], r["gap_kwh"]) for r in marts.worst_months(ledger).collect()}
    assert got == {"a": ("2020-01-01", 5.0), "b": (None, 7.0)}


def test_asking_without_a_limit_returns_all_rows(spark):
    spark.range(500).createOrReplaceTempView("many_rows")
    assert marts.ask(spark, "select * from many_rows").count() == 500


def test_curve_values_beyond_three_units_stay_apart(spark):
    params = driver_tables.DAILY
    rows = spark.createDataFrame([(2.9,), (3.5,), (9.0,)], "physics_base_kw_per_kwp double")
    assert rows.select(twin.physics_bin(params).alias("b")).distinct().count() == 3


def test_early_stop_waits(spark):
    assert twin.best_rounds([5, 4, 6, 3, 7, 7], 2) == 4
    assert twin.best_rounds([5, 4, 6, 6, 3], 2) == 2
    assert twin.best_rounds([5], 15) == 1


def test_staging_takes_a_root_and_clears_it(spark, tmp_path):
    staging = Staging(spark, str(tmp_path))
    staging.table("x", lambda: spark.range(3).toDF("id"))
    assert staging.root.startswith(str(tmp_path)) and any(tmp_path.rglob("*.parquet"))
    staging.clear()
    assert not any(tmp_path.rglob("*.parquet"))
