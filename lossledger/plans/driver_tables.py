"""Maps the star-schema test tables onto telemetry inputs (see FIXTURES.md).

A supplier is a device, its line items are daily readings, orders are plant
signals with repeated timestamps, parts are the error catalog, urgent orders are
tickets. Every mapping is a DataFrame over the whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lossledger.operators import context, dims, reshape
from lossledger.params import Params
from lossledger.plans.ingest import ingest
from lossledger.plans.ledger_run import Inputs, LedgerRun
from lossledger.plans.publish import publish
from lossledger.sources import Staging

# One reading per device and day; 1995 is the reference year of the test tables.
DAILY = Params(
    step_hours=24.0,
    train_from="1995-01-01",
    train_to="1996-01-01",
    holdout_from="1995-10-01",
    min_rows_per_device=20,
    min_fit_rows=35,
    min_valid_rows=10,
    min_holdout_rows=5,
    holdout_tail_rows=30,
    gbt_min_instances=10,
    health_min_points=3,
    trend_from="1996-01-01",
    persistence_reach_minutes=6 * 1440,
    persistence_min_count=2,
    dilation_offsets_minutes=(-1440, 0, 1440),
    meter_check_from="1998-06-01",
    meter_check_to="1998-09-01",
    capacity_tolerance=0.9,
)
# Events come at any second of 2024; cut to five minutes they form an error series.
FIVE_MINUTES = Params(peak_from="2024-01-01", peak_to="2024-02-01")

DEVICE_GROUPS = range(1, 10)
TARIFF_DATES = [
    f"{year}-{month:02d}-{day:02d}"
    for year in range(1995, 2002)
    for month in range(1, 13)
    for day in ((1, 15) if month == 1 else (1,))
]


def device_name(suppkey: str, nation: str, prefix: str = "INV %02d.%02d.%03d") -> Column:
    key = F.col(suppkey)
    return F.format_string(
        prefix,
        F.floor(key / 1000).cast("bigint") + 1,
        F.col(nation).cast("bigint"),
        F.pmod(key, F.lit(1000)),
    )


def comma(value: Column, digits: int = 2) -> Column:
    return F.replace(F.format_string(f"%.{digits}f", value), F.lit("."), F.lit(","))


class DriverTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # devices -------------------------------------------------------------------
    @cached_property
    def inverters(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            "s_suppkey",
            device_name("s_suppkey", "s_nationkey").alias("inverter"),
            (F.lit(50.0) + F.pmod(key, F.lit(3)) * 5).alias("kwp"),
            F.when(F.pmod("s_nationkey", F.lit(4)) < 3, F.concat(
                F.lit("Type "), F.pmod("s_nationkey", F.lit(4)).cast("string")
            )).alias("module_type"),
            F.concat(F.lit("Maker "), F.pmod(key, F.lit(5)).cast("string")).alias("manufacturer"),
            F.format_string("%02d", F.col("s_nationkey")).alias("combiner_group"),
        )

    @property
    def keys(self) -> DataFrame:
        return self.inverters.select(F.col("s_suppkey").alias("l_suppkey"), "inverter")

    # main telemetry ------------------------------------------------------------
    @cached_property
    def plant_raw(self) -> DataFrame:
        """One row per order, so most timestamps repeat."""
        ts = F.col("o_orderdate")
        day, doy = F.dayofmonth(ts), F.dayofyear(ts)
        capacity = self.inverters.agg(F.sum("kwp")).scalar()
        odd = F.pmod("o_orderkey", F.lit(97)) == 0
        rows = self.read("orders").select(
            ts.alias("ts"),
            F.when(~odd, F.col("o_totalprice") / 300.0).alias("irradiation_w_m2"),
            F.when(day == 31, 0.0).otherwise(10.0 + F.month(ts) % 7 * 5).alias("altitude_deg"),
            (5.0 + F.pmod("o_custkey", F.lit(30))).cast("double").alias("ambient_temp_c"),
            F.when(day % 9 != 0, (10.0 + F.pmod("o_custkey", F.lit(40))).cast("double")).alias(
                "module_temp_c"
            ),
            F.when(day == 13, None).when(doy % 29 == 0, 60.0).otherwise(100.0).alias("dv_pct"),
            F.when(doy % 53 == 0, 30.0).otherwise(100.0).alias("evu_pct"),
            (-F.col("o_totalprice") / 250000.0 * capacity * 0.33).alias("janitza_p_ac_kw"),
            (F.pmod("o_custkey", F.lit(100)) / 100.0).alias("cosphi"),
            (F.col("o_totalprice") / 1000.0).alias("s_ac_kva"),
        )
        return context.plant_flags(rows, DAILY)

    @cached_property
    def plant_wide(self) -> DataFrame:
        """The plant signals of each order as text with decimal commas, some unreadable."""
        ts = F.col("o_orderdate")
        key = F.col("o_orderkey")
        names = context.PLANT_COLUMNS
        cells = {
            "irradiation_w_m2": F.when(F.pmod(key, F.lit(97)) == 0, "").otherwise(
                comma(F.floor(F.col("o_totalprice") / 3.0) / 100.0)
            ),
            "altitude_deg": comma(F.month(ts) * 1.5 - 3.0, 1),
            "ambient_temp_c": F.when(F.pmod(key, F.lit(31)) == 0, "Fehler").otherwise(
                F.format_string("%d", F.pmod("o_custkey", F.lit(30)))
            ),
            "module_temp_c": F.format_string("%d.5", F.pmod("o_custkey", F.lit(40))),
            "dv_pct": F.when(F.dayofmonth(ts) != 13, F.when(F.dayofyear(ts) % 29 == 0, "60,0").otherwise("100")),
            "evu_pct": F.when(F.dayofyear(ts) % 53 == 0, "30,0").otherwise("100"),
            "janitza_p_ac_kw": -F.col("o_totalprice"),
            "cosphi": comma(F.pmod("o_custkey", F.lit(100)) / 100.0),
        }
        return self.read("orders").select(
            "o_orderkey",
            F.date_format(ts, "yyyy.MM.dd HH:mm").alias("timestamp"),
            *[cell.alias(names[name]) for name, cell in cells.items()],
        )

    @cached_property
    def readings_raw(self) -> DataFrame:
        lost = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7)
        quantity = F.col("l_quantity")
        return self.read("lineitem").join(self.keys, "l_suppkey").select(
            F.col("l_shipdate").alias("ts"),
            "inverter",
            F.when(lost, None).when(quantity <= 2, 0.0).otherwise(quantity).alias("p_ac_kw"),
            (F.col("l_extendedprice") / 1000.0).alias("i_dc_a"),
            (600.0 + F.col("l_tax") * 1000.0).alias("u_dc_v"),
        )

    @cached_property
    def error_events(self) -> DataFrame:
        failed = (
            (F.col("l_returnflag") == "R")
            & (F.col("l_linestatus") == "F")
            & (F.col("l_discount") > 0.09)
        )
        parts = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
        return (
            self.read("lineitem")
            .where(failed)
            .join(parts.hint("merge"), "l_partkey")
            .join(self.keys.hint("merge"), "l_suppkey")
            .select(
                F.col("l_shipdate").alias("ts"),
                "inverter",
                (F.lit(65536) * F.col("l_linenumber") + F.col("p_size"))
                .cast("bigint")
                .alias("error_code"),
            )
        )

    @cached_property
    def catalog_extract(self) -> DataFrame:
        size = F.col("p_size")
        kind = F.pmod("p_partkey", F.lit(4))
        word = (
            F.when(kind == 0, F.concat(F.lit("Temperatur "), F.col("p_type")))
            .when(kind == 1, F.concat(F.lit("Netzspannung "), F.col("p_type")))
            .when(kind == 2, F.concat(F.lit("Fan "), F.col("p_type")))
        )
        unreadable = F.pmod("p_partkey", F.lit(50)) == 7
        return self.read("part").where(size != 5).select(
            F.col("p_partkey").alias("row_no"),
            F.col("p_brand").alias("component_type"),
            F.format_string("0x%04X", size).alias("hex"),
            F.when(unreadable, "n/a").otherwise(size.cast("string")).alias("code"),
            word.alias("description"),
        )

    @cached_property
    def error_catalog(self) -> DataFrame:
        return reshape.error_catalog(self.catalog_extract)

    # tickets -------------------------------------------------------------------
    def _ticket_orders(self, odd: bool) -> DataFrame:
        suppliers = self.inverters.agg(F.count(F.lit(1))).scalar()
        urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.pmod("o_orderkey", F.lit(5)) == 0)
        names = self.inverters.select(
            F.col("s_suppkey").alias("_device"),
            F.concat(F.lit("Anlage "), F.regexp_replace("inverter", r"INV (\d+)\.(\d+)\.", "WR $1 .$2 .")).alias(
                "_name"
            ),
        )
        site = F.pmod("o_custkey", F.lit(10)) == 0
        return (
            self.read("orders")
            .where(urgent & (F.pmod("o_orderkey", F.lit(2)) == int(odd)))
            .withColumn("_device", F.pmod("o_custkey", suppliers))
            .join(names.hint("merge"), "_device", "left")
            .withColumn("_component", F.when(site, "Netzanschluss").otherwise(F.col("_name")))
        )

    @cached_property
    def tickets_modern(self) -> DataFrame:
        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        later = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 3), "yyyy-MM-dd")
        return self._ticket_orders(False).select(
            F.col("_component").alias("component"),
            F.concat(day, F.lit("T08:30:00+02:00")).alias("startdate"),
            F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "open")
            .otherwise(F.concat(later, F.lit("T17:00:00Z")))
            .alias("enddate"),
            F.col("o_orderstatus").alias("category"),
        )

    @cached_property
    def tickets_old(self) -> DataFrame:
        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        later = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 2), "yyyy-MM-dd")
        bad = F.pmod("o_orderkey", F.lit(7)) == 0
        return self._ticket_orders(True).select(
            F.col("_component").alias("Komponente"),
            day.alias("Start Date"),
            F.when(bad, "unbekannt").otherwise("07:15:00").alias("Uhrzeit Beginn"),
            later.alias("Datum Ende"),
            F.lit("18:00:00").alias("Uhrzeit Ende"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("category"),
        )

    @cached_property
    def tickets(self) -> DataFrame:
        return reshape.union_tickets(self.tickets_modern, self.tickets_old)

    # tariffs -------------------------------------------------------------------
    @cached_property
    def tariff_matrix(self) -> DataFrame:
        key = F.col("s_suppkey")
        cells = []
        for date in TARIFF_DATES:
            number = int(date[:4]) * 12 + int(date[5:7])
            rate = 8.0 + F.pmod(key, F.lit(7)) + (number % 12) * 0.1 + int(date[8:]) * 0.01
            blank = F.pmod(key + number, F.lit(11)) == 0
            cells.append(F.when(blank, "").otherwise(comma(rate)).alias(date))
        # one small file gives 85 cells of text a device: dealt before they are made
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.inverters.repartition(tasks, "s_suppkey").select(
            F.concat(F.lit("Feed-in "), F.col("inverter")).alias("device"),
            *cells,
            F.lit("7,0").alias("n/a"),
        )

    @cached_property
    def tariffs(self) -> DataFrame:
        return reshape.unpivot_tariffs(self.tariff_matrix)

    # sheets --------------------------------------------------------------------
    @cached_property
    def overview_extract(self) -> DataFrame:
        """Each order is one overview sheet, its lines are the rows."""
        line = (
            self.read("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min("l_suppkey").alias("l_suppkey"),
                F.min("l_quantity").alias("q"),
                F.min("l_tax").alias("tax"),
                F.max("l_discount").alias("discount"),
            )
        )
        devices = self.inverters.select(
            F.col("s_suppkey").alias("l_suppkey"), "inverter", "module_type", "manufacturer"
        )
        number = F.col("l_linenumber")
        spaced = F.regexp_replace("inverter", r"INV (\d+)\.(\d+)\.", "WR $1 .$2 .")
        return line.join(devices, "l_suppkey").select(
            F.col("l_orderkey").alias("sheet"),
            number.alias("row_no"),
            F.when(number == 1, spaced).when(number == 5, "ACC 05").alias("description"),
            F.when(F.pmod(F.col("q"), F.lit(6)) != 0, F.col("module_type")).alias("module_type"),
            "manufacturer",
            comma(F.lit(200.0) + F.col("q"), 1).alias("module_wp"),
            F.format_string("%d", F.col("q").cast("int")).alias("modules"),
            F.when(F.col("discount") < 0.02, " ").otherwise(comma(F.col("q") / 4.0)).alias("kwp"),
            F.when(F.col("tax") < 0.01, "k.A.").otherwise(comma(F.col("tax") * 100, 0)).alias("strings"),
            comma(F.lit(18.0) + number, 1).alias("modules_per_string"),
            F.when(F.col("tax") > 0.04, F.concat(F.lit("Hall "), number.cast("string"))).alias("location_a"),
            F.concat(F.lit("Row "), number.cast("string")).alias("location_b"),
        )

    # wide telemetry --------------------------------------------------------------
    @cached_property
    def _grouped_lines(self) -> DataFrame:
        group = (F.pmod("s_nationkey", F.lit(9)) + 1).alias("g")
        suppliers = self.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), group)
        return (
            self.read("lineitem")
            .join(suppliers, "l_suppkey")
            .withColumn("timestamp", F.date_format("l_shipdate", "yyyy.MM.dd HH:mm"))
        )

    @cached_property
    def wide_main(self) -> DataFrame:
        """One row per day; device group 9 has no voltage column.

        Power is a double for group 1, text with a point for group 2, with a comma for the rest.
        """
        aggs = []
        for g in DEVICE_GROUPS:
            mine = F.col("g") == g
            name = f"INV 01.{g:02d}.000"
            quantity = F.sum(F.when(mine, F.col("l_quantity")).cast("bigint"))
            power = {1: quantity / 4.0, 2: (quantity / 4.0).cast("string")}.get(g, comma(quantity / 4.0))
            aggs.append(power.alias(f"{name} / P_AC (kW)"))
            aggs.append(
                F.max(F.when(mine, F.col("l_quantity")) / 2.0).alias(f"{name} / I_DC_SUM (A)")
            )
            if g != 9:
                volts = F.when(mine, F.col("l_linenumber") + 600).cast("string")
                aggs.append(F.max(volts).alias(f"{name} / U_DC (V)"))
        return self._grouped_lines.groupBy("timestamp").agg(*aggs)

    @cached_property
    def wide_errors(self) -> DataFrame:
        """Error code as text ('0', a number, or unreadable), as "70000.0" (group 1) or double (2)."""
        parts = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
        rows = self._grouped_lines.join(parts, "l_partkey")
        failed = (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)
        code = F.col("l_linenumber").cast("bigint") * 65536 + F.col("p_size")
        aggs = []
        for g in DEVICE_GROUPS:
            mine = F.col("g") == g
            name = f"INV 01.{g:02d}.000"
            worst = F.max(F.when(mine & failed, code))
            text = F.when(worst % 50 == 7, "n/a").otherwise(F.coalesce(worst, F.lit(0)).cast("string"))
            number = F.when(worst % 50 != 7, worst).otherwise(0)
            text = {1: F.concat(F.coalesce(number, F.lit(0)).cast("string"), F.lit(".0")), 2: number.cast("double")}.get(g, text)
            aggs.append(text.alias(f"{name} / Error"))
            aggs.append(
                F.max(F.when(mine, F.col("l_linenumber"))).cast("string").alias(f"{name} / Operational State")
            )
        return rows.groupBy("timestamp").agg(*aggs)

    @cached_property
    def column_names(self) -> DataFrame:
        """Names of the delivered (device, signal) columns, derived from the rows themselves."""
        kind = F.element_at(
            F.array(F.lit("P_AC (kW)"), F.lit("I_DC_SUM (A)"), F.lit("U_DC (V)")),
            (F.pmod("l_linenumber", F.lit(3)) + 1).cast("int"),
        )
        return self.read("lineitem").where("l_tax > 0.05").join(self.keys, "l_suppkey").select(
            F.concat_ws(" / ", "inverter", kind).alias("column_name")
        )

    # irregular series ----------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").select("event_id", "ts", "user_id", "event_type", "value")

    @cached_property
    def event_plant(self) -> DataFrame:
        """Events as an irregular plant series: value is both irradiation and altitude."""
        missing = F.lit(None).cast("double")
        value = F.col("value")
        rows = self.events.select(
            "ts",
            value.alias("irradiation_w_m2"),
            (value / 10.0).alias("altitude_deg"),
            missing.alias("ambient_temp_c"),
            F.when(F.col("event_type") != "view", F.pmod("user_id", F.lit(50)).cast("double")).alias(
                "module_temp_c"
            ),
            F.lit(100.0).alias("dv_pct"),
            F.when(F.col("event_type") == "click", 50.0).alias("evu_pct"),
            missing.alias("janitza_p_ac_kw"),
            missing.alias("cosphi"),
            missing.alias("s_ac_kva"),
        )
        return context.plant_flags(rows, FIVE_MINUTES)

    @cached_property
    def event_slots(self) -> DataFrame:
        """Events cut to five minutes, one device per user."""
        minute = F.minute("ts")
        cut = F.timestamp_add(
            "SECOND",
            F.lit(0) - (minute % 5 * 60 + F.second("ts")),
            F.expr("cast(date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp_ntz)"),
        )
        user = F.col("user_id")
        return self.events.select(
            cut.alias("ts"),
            F.format_string(
                "INV 01.%02d.%03d", F.pmod(user, F.lit(100)), F.pmod(user, F.lit(1000))
            ).alias("inverter"),
            "event_type",
            F.col("value"),
        )

    @cached_property
    def event_errors(self) -> DataFrame:
        errors = self.event_slots.where("event_type = 'error'").select(
            "ts",
            "inverter",
            (F.lit(65536) * 3 + F.floor(F.col("value")) % 60 + 1).cast("bigint").alias("error_code"),
        )
        return context.error_intervals(errors)

    # files to inputs -------------------------------------------------------------
    @cached_property
    def ingested(self) -> Inputs:
        """All inputs from wide tables and sheet extracts; plant signals are rows of their own."""
        return ingest(
            self.wide_main.unionByName(self.plant_wide.drop("o_orderkey"), allowMissingColumns=True),
            self.wide_errors,
            self.overview_extract,
            self.tariff_matrix,
            self.tickets_modern,
            self.tickets_old,
            self.catalog_extract,
            DAILY,
        )

    @cached_property
    def published(self) -> dict[str, DataFrame]:
        return publish(self.run, f"{self.staging.root}/published")

    # the run -------------------------------------------------------------------
    @cached_property
    def staging(self) -> Staging:
        return Staging(self.spark)

    @cached_property
    def run(self) -> LedgerRun:
        return LedgerRun(self.inputs, DAILY, self.staging)

    @cached_property
    def tree_run(self) -> LedgerRun:
        """The same run with boosted trees per device as the twin; it shares all other tables."""
        return LedgerRun(self.inputs, DAILY, self.staging, learner="trees")

    @cached_property
    def inputs(self) -> Inputs:
        return Inputs(
            plant=self.plant_raw,
            readings=self.readings_raw,
            error_events=self.error_events,
            inverters=self.inverters,
            tariffs_monthly=dims.monthly_tariffs(self.tariffs),
            tickets=self.tickets,
            error_catalog=self.error_catalog,
        )


_open: dict[tuple[str, str, str], DriverTables] = {}


def tables(spark: SparkSession, sf_dir: str) -> DriverTables:
    """The mapping of one data folder; written tables are shared until its files change."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(sf_dir)
        .select("path", "length", "modificationTime")
    )
    state = listing.agg(
        F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("string")
    ).first()
    key = (spark.sparkContext.applicationId, sf_dir, str(tuple(state)))
    if key not in _open:
        for old in [k for k in _open if k[:2] == key[:2]]:  # tables of files that have changed
            _open.pop(old).staging.clear()
        _open[key] = DriverTables(spark, sf_dir)
    return _open[key]
