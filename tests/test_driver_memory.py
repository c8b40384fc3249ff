"""Rows that grow with the fleet are dealt by key: Spark's size guess, a small packed file, must not broadcast them."""

import re

import pytest

from lossledger.operators.quantiles import exact_quantiles
from lossledger.plans import driver_tables
from lossledger.sources import Staging

#: Keys that are one row per device, ticket, part or order; calendar keys (ts, month, bin) may be broadcast.
GROWING = re.compile(r"\b(inverter|_device|l_partkey|_k0)#")


class Recorded(Staging):
    """Keeps the plan of every staged table as it was before adaptive execution."""

    def __init__(self, spark, root):
        super().__init__(spark, root)
        self.broadcast = {}

    def table(self, name, build, partition_by=None):
        if name in self._tables:
            return self._tables[name]
        df = build()
        self.broadcast[name] = broadcast_keys(df)
        return super().table(name, lambda: df, partition_by)


def broadcast_keys(df):
    """Keys of the broadcast joins whose keys grow with the fleet."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [k for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan) if GROWING.search(k)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Eight devices with a reading a day from 1995 to 1997, in files far below the broadcast threshold."""
    folder = tmp_path_factory.mktemp("fleet")
    spark.range(8).selectExpr("id as s_suppkey", "cast(id % 5 as int) as s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    spark.range(40).selectExpr(
        "id as p_partkey", "cast(id % 9 + 1 as int) as p_size", "concat('T', id % 3) as p_type", "concat('B', id % 4) as p_brand"
    ).write.parquet(f"{folder}/part.parquet")
    day = "timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast({} as int))"
    spark.range(1000).selectExpr(
        "id as o_orderkey", "id * 7 % 61 as o_custkey", f"{day.format('id')} as o_orderdate", "60000.0D + id * 7919 % 200000 as o_totalprice",
        "if(id % 5 = 0, '1-URGENT', '5-LOW') as o_orderpriority", "if(id % 3 = 0, 'P', 'F') as o_orderstatus",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(8000).selectExpr(
        "id as l_orderkey", "cast(id % 7 + 1 as int) as l_linenumber", "id % 40 as l_partkey", "id % 8 as l_suppkey",
        f"{day.format('id div 8')} as l_shipdate", "cast(1 + id * 31 % 49 as double) as l_quantity", "1000.0D + id as l_extendedprice",
        "id % 11 / 100.0D as l_discount", "id % 9 / 100.0D as l_tax", "if(id % 4 = 0, 'R', 'N') as l_returnflag", "'F' as l_linestatus",
    ).write.parquet(f"{folder}/lineitem.parquet")
    tables = driver_tables.DriverTables(spark, str(folder))
    tables.__dict__["staging"] = Recorded(spark, f"{folder}/staged")
    return tables


def test_devices_of_the_health_chain_are_not_broadcast(small):
    """q_theil_sen, from the readings to the slopes."""
    assert broadcast_keys(small.run.build_slopes()) == []
    assert small.run.health.count() > 0
    steps = "eta fleet error_intervals split_rows holdout metrics models health".split()
    assert {s: small.staging.broadcast[s] for s in steps} == {s: [] for s in steps}


def test_bands_errors_and_tariffs_of_intervals_are_not_broadcast(small):
    """q_inverter_timeseries: the bands and the priced intervals behind it."""
    assert broadcast_keys(small.run.predictions) == []
    assert small.run.intervals.count() > 0
    assert {s: small.staging.broadcast[s] for s in ("tariffs_monthly", "loss_intervals")} == {"tariffs_monthly": [], "loss_intervals": []}


def test_devices_and_months_of_the_ledger_are_not_broadcast(small):
    """q_plant_facts, q_ledger_filtered, q_heatmap: trend, overlap and tickets on the way to the ledger."""
    assert broadcast_keys(small.run.adjusted) == []
    assert small.run.ledger.count() > 0
    steps = "slopes ledger_raw degradation_loss ledger".split()
    assert {s: small.staging.broadcast[s] for s in steps} == {s: [] for s in steps}


def test_tickets_are_not_broadcast(small):
    """q_cumulative_loss: events meet tickets by device and span; tickets get their names by device."""
    assert broadcast_keys(small.run.lead_events) == []
    assert small.run.tickets.count() > 0
    assert small.staging.broadcast["tickets"] == []


def test_devices_of_the_tree_ledger_are_not_broadcast(small):
    """q_by_year_cause_trees: held-out rows, models and bands of the trees."""
    assert small.tree_run.ledger.count() > 0
    steps = "tree_fit tree_metrics models_trees loss_intervals_trees degradation_loss_trees ledger_trees".split()
    assert {s: small.staging.broadcast[s] for s in steps} == {s: [] for s in steps}


def test_rows_of_quantiles_are_not_broadcast(spark, tmp_path):
    """q_by_year_cause_trees: the fleet's curve; only the wanted slices of a few bins may travel whole."""
    spark.range(3000).selectExpr("cast(id % 4 as int) as bin", "id * 7919 % 3001 / 7.0D as v").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    for keys, many, join in ((["bin"], False, "BroadcastHashJoin"), ([], False, "BroadcastHashJoin"), (["bin"], True, "SortMergeJoin")):
        found = exact_quantiles(rows, keys, "v", {"m": 0.5}, many_groups=many)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert re.findall(r"(?:BroadcastHash|SortMerge)Join", plan) == [join]
        assert "BuildLeft" not in plan
        assert found.count() == (4 if keys else 1)
