"""Column expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from lossledger.params import BUCKET_LABELS

# Spelling of device ids in free text, e.g. "WR 01 .02 .003".
DEVICE_PATTERN = r"(?:INV|WR)\s*(\d{2})\s*[\.\s]\s*(\d{2})\s*[\.\s]\s*(\d{3})"
# A catalog text holding one of these words is only a warning.
WARNING_WORDS = ("warn", "temperatur", "spannung", "strom")
MINUTE_FORMAT = "yyyy.MM.dd HH:mm"


def clean_number(col: Column) -> Column:
    """Text with decimal comma or point to double; blanks and bad text give NULL."""
    text = F.trim(F.replace(col.cast("string"), F.lit(","), F.lit(".")))
    # "1.5d" is a number to the JVM parser only, so it is kept out.
    suffixed = F.substring(text, -1, 1).isin("d", "D", "f", "F")
    return F.when(~suffixed, text).try_cast("double")


def parse_minute(col: Column) -> Column:
    """Strict ``yyyy.MM.dd HH:mm``; bad text fails the query."""
    return F.to_timestamp_ntz(col.cast("string"), F.lit(MINUTE_FORMAT))


def try_parse_minute(col: Column) -> Column:
    """As :func:`parse_minute`, but bad text gives NULL."""
    text = col.cast("string")
    iso = F.when(text.rlike(r"^\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}$"), F.translate(text, ".", "-"))
    return iso.try_cast("timestamp_ntz")


def utc_naive(col: Column) -> Column:
    """ISO text with an optional zone offset to a zone-free UTC timestamp, NULL if unreadable."""
    text = F.trim(col.cast("string"))
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    instant = zoned.try_cast("timestamp")
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_add("SECOND", F.unix_seconds(instant), start)


def device_id(col: Column) -> Column:
    """Free text to the canonical ``INV dd.dd.ddd`` or NULL."""
    part = [F.regexp_extract(col, DEVICE_PATTERN, i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.format_string("INV %s.%s.%s", *part))


def severity_class(code: Column, description: Column) -> Column:
    text = F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(code.isNull() | (code == 0), "none")
        .when(text.rlike("|".join(WARNING_WORDS)), "warning")
        .otherwise("fault")
    )


def code_base(code: Column, modulus: int = 65536) -> Column:
    return code % F.lit(modulus).cast("long")


def ticket_text(component: Column, category: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(
        " | ",
        F.coalesce(component.cast("string"), blank),
        F.coalesce(category.cast("string"), blank),
    )


def clip_to_capacity(value: Column, capacity: Column) -> Column:
    """Clip to [0, capacity]; unlike a bare least/greatest an unknown value stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(capacity, value)))


def energy_kwh(power_kw: Column, step_hours: float) -> Column:
    """Energy of one interval; negative power counts as zero."""
    return F.greatest(power_kw, F.lit(0.0)) * F.lit(step_hours)


def month_of(ts: Column) -> Column:
    """First day of the month as DATE (no time zone is involved)."""
    return F.trunc(ts.cast("date"), "month")


def within(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows with start <= ts < stop; a month-partitioned table reads only the months in range."""
    first, end = (F.lit(t).cast("timestamp_ntz") for t in (start, stop))
    rows = df.where((F.col("ts") >= first) & (F.col("ts") < end))
    if "month" in df.columns:
        rows = rows.where((F.col("month") >= month_of(first)) & (F.col("month") <= month_of(end)))
    return rows


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp, whatever the session zone is."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def cyclic_features(ts: Column) -> dict[str, Column]:
    """Sine and cosine of the time of day and of the day of year."""
    minute_angle = 2.0 * F.pi() * (F.hour(ts) * 60 + F.minute(ts)) / F.lit(1440.0)
    day_angle = 2.0 * F.pi() * F.dayofyear(ts) / F.lit(366.0)
    return {
        "hour_sin": F.sin(minute_angle),
        "hour_cos": F.cos(minute_angle),
        "doy_sin": F.sin(day_angle),
        "doy_cos": F.cos(day_angle),
    }


def bucket_label(bucket: Column) -> Column:
    """Display name of a cause; an unknown code passes through."""
    names = F.create_map(*[F.lit(x) for x in chain(*BUCKET_LABELS.items())])
    return F.coalesce(F.try_element_at(names, bucket), bucket)
