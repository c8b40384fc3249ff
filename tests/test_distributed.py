"""Operators that replace a single-task plan, against brute force."""

import datetime as dt
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from lossledger.operators import windows
from lossledger.operators.quantiles import exact_quantiles
from lossledger.operators.windows import count_within_reach, rolling_neighbours


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_quantiles(spark, seed):
    rng = random.Random(seed)
    rows = [("hot", rng.gauss(0, 100)) for _ in range(3000)]
    rows += [(rng.choice("abcde"), rng.choice([-1.5, 0.0, 2.0, 1e6, rng.random()])) for _ in range(400)]
    rows += [(None, float(v)) for v in range(4)] + [("one", 7.0), ("a", None), ("nan", float("nan"))]
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: [r[p] for p in probs] for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    groups = {}
    for k, v in rows:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx([np.quantile(vs, p) for p in probs.values()], rel=1e-12, abs=1e-12)


def test_exact_quantile_of_whole_table_and_of_equal_values(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("v"), F.lit(3.0).alias("c"))
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 4.5
    assert exact_quantiles(df, [], "c", {"m": 0.5}).first()["m"] == 3.0
    assert exact_quantiles(df.where("v > 100"), [], "v", {"m": 0.5}).collect() == []


def test_rolling_equals_global_window(spark):
    rng = random.Random(4)
    start = datetime(2020, 1, 1)
    minutes = sorted(rng.sample([m for m in range(0, 20 * 1440, 5) if not 5 * 1440 < m < 9 * 1440], 600))
    rows = [(start + timedelta(minutes=m), rng.random() * 1000) for m in minutes]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = {r["ts"]: r for r in rolling_neighbours(df, "ts", "v").collect()}
    assert len(got) == len(rows)
    for i, (ts, _) in enumerate(rows):
        near = [v for _, v in rows[max(0, i - 1): i + 2]]
        assert got[ts]["v_roll_mean"] == pytest.approx(np.mean(near))
        assert got[ts]["v_roll_std"] == pytest.approx(np.std(near), abs=1e-9)


def test_count_within_reach_across_pieces(spark):
    rng = random.Random(5)
    start = datetime(2020, 1, 1)
    rows = []
    for device, number in (("hot", 1500), ("b", 200)):
        for m in rng.sample(range(0, 60 * 24 * 10, 5), number):
            rows.append((device, start + timedelta(minutes=m), rng.random() < 0.4))
    df = spark.createDataFrame(rows, "d string, ts timestamp_ntz, f boolean")
    got = {(r["d"], r["ts"]): r["n"] for r in count_within_reach(df, ["d"], "ts", F.col("f"), 1800, "n").collect()}
    assert len(got) == len(rows)
    for device, ts, _ in rows:
        expected = sum(f for d, t, f in rows if d == device and abs((t - ts).total_seconds()) <= 1800)
        assert got[(device, ts)] == expected


def test_a_busy_day_is_cut_into_pieces(spark):
    rows = spark.range(3000).select(
        F.expr("timestamp_ntz'2020-01-02 00:00:00' + id * interval 7 second").alias("ts"), ((F.col("id") * 37) % 101).cast("double").alias("v")
    )
    rows = rows.unionByName(rows.limit(1).select(F.expr("timestamp_ntz'2019-12-30 10:00:00'").alias("ts"), F.lit(5.0).alias("v")))
    assert rows.select(windows._piece("ts")).distinct().count() > 30
    whole = Window.orderBy("ts").rowsBetween(-1, 1)
    expected = {r["ts"]: (r["m"], r["p"]) for r in rows.select("ts", F.avg("v").over(whole).alias("m"), F.lag("ts").over(Window.orderBy("ts")).alias("p")).collect()}
    got = {r["ts"]: r["v_roll_mean"] for r in windows.rolling_neighbours(rows, "ts", "v").collect()}
    before = {r["ts"]: r["prev_ts"] for r in windows.previous_in_series(rows, "ts", []).collect()}
    assert got == {k: v[0] for k, v in expected.items()} and before == {k: v[1] for k, v in expected.items()}


def test_expected_energy_is_dealt_and_not_broadcast(spark, tmp_path):
    """A small file of models expands to devices x months in many tasks; the rows are not broadcast."""
    from lossledger.operators import ledger, twin
    from lossledger.params import Params

    spark.range(300).coalesce(1).selectExpr(
        "format_string('INV 01.01.%03d', id) as inverter", "'t' as module_type", "50.0D as kwp", "0.8D as eta_system", "array(0.5D) as curve"
    ).write.parquet(f"{tmp_path}/models")
    moments = spark.range(24).selectExpr(
        "timestamp_ntz'2018-01-01 12:00:00' + make_interval(0, int(id)) as ts", "true as is_model_day", "0 as bin", "0.4D as fleet_p50_per_kwp"
    )
    expected = twin.expected_monthly(moments, spark.read.parquet(f"{tmp_path}/models"), Params())
    tasks = expected.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 300 * 24 and len(tasks) > 1
    spark.range(300).selectExpr(
        "format_string('INV 01.01.%03d', id) as inverter", "date'2018-01-01' as first_month", "-0.05D as slope_ratio_per_year"
    ).write.parquet(f"{tmp_path}/slopes")
    raw = "inverter string, month date, bucket string, lost_kwh double, avg_ct_per_kwh double"
    tariffs = "inverter string, month date, ct_per_kwh double"
    lost = ledger.degradation_loss(
        expected,
        spark.read.parquet(f"{tmp_path}/slopes"),
        spark.createDataFrame([("INV 01.01.001", dt.date(2018, 2, 1), "UNDERPERFORMANCE_LOCAL", 1.0, 9.0)], raw),
        spark.createDataFrame([("INV 01.01.001", dt.date(2018, 3, 1), 8.0)], tariffs),
        Params(),
    )
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[inverter#\d+\], \[inverter#\d+\]", plan)
    assert lost.count() == 300 * 23  # the first month has lost nothing
