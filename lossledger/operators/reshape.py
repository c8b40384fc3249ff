"""Wide to long, long to wide, and sheet layouts to plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lossledger.functions import (
    clean_number,
    device_id,
    month_of,
    parse_minute,
    severity_class,
    ticket_text,
    utc_naive,
)
from lossledger.sources.wide import ERROR_PATTERN, device_signals


def _long(
    wide: DataFrame, timestamp: str, devices: dict[str, dict[str, str]], signals: dict[str, str]
) -> DataFrame:
    """(ts, inverter, a double for each signal): every device's columns as a row.

    Cells are cleaned in a projection of their own before one generator stacks them, so a
    signal may be text for one device and a number for another.
    """
    cells, places = [], []
    for device, columns in devices.items():
        places.append(F.lit(device))
        for signal in signals:
            cells.append(_cell(wide, columns.get(signal)).alias(f"_{len(cells)}"))
            places.append(F.col(f"_{len(cells) - 1}"))
    rows = F.stack(F.lit(len(devices)), *places).alias("inverter", *signals.values())
    return wide.select(parse_minute(F.col(timestamp)).alias("ts"), *cells).select("ts", rows)


def _cell(wide: DataFrame, column: str | None) -> Column:
    if column is None:
        return F.lit(None).cast("double")
    col = F.col(f"`{column}`")
    numeric = isinstance(wide.schema[column].dataType, T.NumericType)
    return col.cast("double") if numeric else clean_number(col)


def _whole(col: Column) -> Column:
    """A number as a code: rounded, NULL outside the integer range."""
    return F.round(col).try_cast("bigint")


def unpivot_readings(wide: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """(ts, inverter, p_ac_kw, i_dc_a, u_dc_v) from one scan of the wide table.

    Devices are those with a power column. No shuffle: each input row expands in place.
    """
    devices = {d: s for d, s in device_signals(wide.columns).items() if "P_AC" in s}
    return _long(wide, timestamp, devices, {"P_AC": "p_ac_kw", "I_DC_SUM": "i_dc_a", "U_DC": "u_dc_v"})


def unpivot_errors(wide: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Sparse (ts, inverter, error_code, operational_state): only non-zero codes.

    Codes are read as numbers: columns with gaps are often saved as "70000.0" or as doubles.
    """
    devices = device_signals(wide.columns, ERROR_PATTERN)
    return (
        _long(wide, timestamp, devices, {"Error": "_e", "Operational State": "_s"})
        .select(
            "ts",
            "inverter",
            _whole(F.col("_e")).alias("error_code"),
            _whole(F.col("_s")).alias("operational_state"),
        )
        .where(F.col("error_code") != 0)
    )


def track_completeness(columns: DataFrame) -> DataFrame:
    """Which signals each device delivers, from a table of wide column names.

    ``columns`` has one row per delivered column, ``column_name`` only. The signal
    set of a device is at most the three known signals.
    """
    pattern = r"^(INV \d{2}\.\d{2}\.\d{3}) / (P_AC|I_DC_SUM|U_DC)"
    name = F.col("column_name")
    return (
        columns.where(name.rlike(pattern))
        .select(
            F.regexp_extract(name, pattern, 1).alias("inverter"),
            F.regexp_extract(name, pattern, 2).alias("signal"),
        )
        .distinct()
        .groupBy("inverter")
        .agg(
            F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"),
            F.count(F.lit(1)).alias("n_signals"),
        )
        .withColumn("is_complete", F.col("n_signals") == 3)
    )


def unpivot_tariffs(matrix: DataFrame, device: str = "device") -> DataFrame:
    """Rows = devices, one column per date, to (inverter, effective_date, ct_per_kwh, month).

    Columns whose name is no date and cells without a number are left out. A matrix is a small file
    that unfolds to a row for each device and date, so its rows are dealt to many tasks first.
    """
    dates = [c for c in matrix.columns if c not in (device, "row_no")]
    tasks = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        matrix.repartition(tasks, F.col(device))
        .withColumn("inverter", device_id(F.col(device)))
        .where(F.col("inverter").isNotNull())
        .unpivot(["inverter"], [F.col(f"`{c}`") for c in dates], "_date", "_ct")
        .select(
            "inverter",
            F.col("_date").try_cast("date").alias("effective_date"),
            clean_number(F.col("_ct")).alias("ct_per_kwh"),
        )
        .where(F.col("effective_date").isNotNull() & F.col("ct_per_kwh").isNotNull())
        .withColumn("month", month_of(F.col("effective_date")))
    )


def fill_continuation(overview: DataFrame, sheet: str = "sheet", row_no: str = "row_no") -> DataFrame:
    """Give continuation rows the device named above them and keep rows with a capacity.

    A description naming a device starts its block, one starting with ``ACC`` ends
    it. A row counts when it names the device, or has no description but a module
    type. The window runs within one sheet, a document of a few hundred rows.
    """
    named = device_id(F.col("description"))
    reset = named.isNull() & F.trim("description").startswith("ACC")
    in_order = Window.partitionBy(sheet).orderBy(row_no)
    in_block = Window.partitionBy(sheet, "_block").orderBy(row_no)
    continuation = F.col("description").isNull() & F.col("module_type").isNotNull()
    return (
        overview.withColumn("_named", named)
        .withColumn("_block", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(in_order))
        .withColumn("inverter", F.last("_named", ignorenulls=True).over(in_block))
        .where(F.col("inverter").isNotNull() & (F.col("_named").isNotNull() | continuation))
        .select(
            sheet,
            row_no,
            "inverter",
            "module_type",
            "manufacturer",
            *[
                clean_number(F.col(c)).alias(c)
                for c in ("module_wp", "modules", "kwp", "strings", "modules_per_string")
            ],
            "location_a",
            "location_b",
        )
        .where(F.col("kwp").isNotNull())
    )


def union_tickets(modern: DataFrame, old: DataFrame) -> DataFrame:
    """Two ticket layouts under one schema; unreadable times become NULL."""
    new_layout = modern.select(
        F.lit("modern").alias("source_sheet"),
        "component",
        utc_naive(F.col("startdate")).alias("start_ts"),
        utc_naive(F.col("enddate")).alias("end_ts"),
        "category",
    )

    def joined(day: str, time: str) -> Column:
        return F.concat_ws(" ", F.col(day), F.col(time)).try_cast("timestamp_ntz")

    old_layout = old.select(
        F.lit("old").alias("source_sheet"),
        F.col("Komponente").alias("component"),
        joined("Start Date", "Uhrzeit Beginn").alias("start_ts"),
        joined("Datum Ende", "Uhrzeit Ende").alias("end_ts"),
        "category",
    )
    return new_layout.unionByName(old_layout).withColumns(
        {
            "inverter": device_id(F.col("component")),
            "text": ticket_text(F.col("component"), F.col("category")),
        }
    )


def error_catalog(extract: DataFrame) -> DataFrame:
    """One row per numeric code, the first one listed, with its severity class.

    The first row is an aggregate (combined map-side), not a window over a code's rows.
    """
    return (
        extract.withColumn("code", clean_number(F.col("code")).cast("bigint"))
        .where(F.col("code").isNotNull())
        .groupBy("code")
        .agg(F.min(F.struct("row_no", "component_type", "hex", "description")).alias("_first"))
        .select(
            "_first.component_type",
            "_first.hex",
            "code",
            "_first.description",
            severity_class(F.col("code"), F.col("_first.description")).alias("severity_class"),
        )
    )


def pivot_months(
    losses: DataFrame, months: list[str] | None = None, key: str = "inverter", month: str = "month_label"
) -> DataFrame:
    """One column per month, 0 where a device lost nothing.

    Without a list the months are those of the losses (a calendar-sized look-up). With a
    list, a loss in any other month fails the query, so that no loss vanishes.
    """
    if months is None:
        months = [r[0] for r in losses.select(month).where(F.col(month).isNotNull()).distinct().orderBy(month).collect()]
    else:
        known = F.col(month).isin(*months) | F.col(month).isNull()
        unlisted = F.raise_error(F.concat(F.lit("a loss in a month that is not listed: "), F.col(month)))
        losses = losses.withColumn(month, F.when(known, F.col(month)).otherwise(unlisted))
    return losses.groupBy(key).pivot(month, months).sum("lost_eur").na.fill(0.0)
