import pytest
from pyspark.sql import functions as F

from lossledger import sources
from lossledger.functions import month_of, within
from lossledger.operators import context, marts, reshape
from lossledger.params import Params


def wide(spark):
    return spark.createDataFrame(
        [("2020.01.01 00:00", "1,5", 2.0, "x", "0", "4"), ("2020.01.01 00:05", "", 3.0, "7", "70000", "5")],
        "`timestamp` string, `INV 01.01.001 / P_AC (kW)` string, `INV 01.01.001 / I_DC_SUM (A)` double, "
        "`INV 01.01.001 / U_DC (V)` string, `INV 01.01.001 / Error` string, `INV 01.01.001 / Operational State` string",
    )


def test_unpivot_is_one_scan(spark, tmp_path):
    path = str(tmp_path / "wide")
    wide(spark).write.parquet(path)
    df = reshape.unpivot_readings(sources.read_wide(spark, path))
    assert [tuple(r)[1:] for r in df.orderBy("ts").collect()] == [
        ("INV 01.01.001", 1.5, 2.0, None), ("INV 01.01.001", None, 3.0, 7.0)
    ]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Error" not in plan.split("ReadSchema")[-1]
    errors = reshape.unpivot_errors(wide(spark)).collect()
    assert [(r["error_code"], r["operational_state"]) for r in errors] == [(70000, 5)]


def test_timestamp_saved_as_index(spark):
    saved = wide(spark).withColumnRenamed("timestamp", "__index_level_0__")
    assert "timestamp" in sources.recover_timestamp(saved).columns
    with pytest.raises(ValueError):
        sources.recover_timestamp(saved.drop("__index_level_0__"))


def test_missing_plant_columns_become_null(spark):
    row = context.plant_from_wide(wide(spark), Params()).first()
    assert row["irradiation_w_m2"] is None and row["is_curtailed"] is None


def test_tariff_matrix(spark):
    matrix = spark.createDataFrame(
        [("WR 01.01.001", "8,5", "", "9"), ("total", "1", "1", "1")],
        "device string, `2020-01-06` string, `2020-01-13` string, `no date` string",
    )
    rows = reshape.unpivot_tariffs(matrix).collect()
    assert [(r["inverter"], str(r["effective_date"]), r["ct_per_kwh"], str(r["month"])) for r in rows] == [
        ("INV 01.01.001", "2020-01-06", 8.5, "2020-01-01")
    ]


def test_tariff_matrix_of_one_file_unfolds_in_many_tasks(spark):
    names = F.format_string("WR 01.%02d.%03d", F.col("id") % 7, F.col("id"))
    matrix = spark.range(400).coalesce(1).select(names.alias("device"), *[F.lit("8,5").alias(f"2020-{m:02d}-06") for m in range(1, 13)])
    rows = reshape.unpivot_tariffs(matrix).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in rows) == 400 * 12
    assert len(rows) > 1 and max(r["count"] for r in rows) < 0.5 * 400 * 12


def test_catalog_keeps_first_listed(spark):
    extract = spark.createDataFrame(
        [(2, "c", "0x5", "5", "later"), (1, "c", "0x5", "5", "Temperatur"), (3, "c", "-", "n/a", "bad")],
        "row_no int, component_type string, hex string, code string, description string",
    )
    rows = reshape.error_catalog(extract).collect()
    assert [(r["code"], r["description"], r["severity_class"]) for r in rows] == [(5, "Temperatur", "warning")]


def test_tables_views_and_exports(spark, tmp_path):
    df = spark.range(20).select(F.col("id"), (F.col("id") % 2).alias("month"))
    table = sources.write_table(df, str(tmp_path / "t"), ["month"])
    assert table.where("month = 1").count() == 10
    sources.append_table(df, str(tmp_path / "t"), ["month"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 40
    sources.export_csv(df, str(tmp_path / "csv"), [F.desc("id")])
    back = sources.read_extract(spark, str(tmp_path / "csv") + "/part-00000*.csv")
    assert back.first()["id"] == "19"
    sources.register_views({"numbers": df})
    assert marts.ask(spark, "select * from numbers where id >= ?", [5], max_rows=3).count() == 3


def test_staging_writes_once(spark):
    staging = sources.Staging(spark)
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).toDF("id")

    assert staging.table("x", build).count() == staging.table("x", build).count() == 3
    assert len(calls) == 1


def test_month_partitions_are_pruned(spark):
    rows = spark.range(200).select(
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + id * interval 1 day").alias("ts"), F.lit("d").alias("inverter")
    )
    table = sources.Staging(spark).table("r", lambda: rows.withColumn("month", month_of(F.col("ts"))), ["month"])
    window = within(table, "2020-02-01", "2020-03-01")
    assert window.count() == 29
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
