from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lossledger import functions as L


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("t")).alias("v")).collect()]


def test_clean_number(spark):
    texts = ["1,5", " 2.25 ", "", " ", None, "n/a", "-3", "1.5d", "7f", "1,2,3"]
    assert values(spark, texts, L.clean_number) == [1.5, 2.25, None, None, None, None, -3.0, None, None, None]


def test_parse_minute(spark):
    assert values(spark, ["2018.03.25 02:30"], L.parse_minute) == [datetime(2018, 3, 25, 2, 30)]
    texts = ["2018.03.25 02:30", "2018.13.01 00:00", "2018/03/25 02:30", None, "2018.03.11 02:30"]
    assert values(spark, texts, L.try_parse_minute) == [
        datetime(2018, 3, 25, 2, 30), None, None, None, datetime(2018, 3, 11, 2, 30)
    ]
    with pytest.raises(Exception):
        values(spark, ["not a time"], L.parse_minute)


def test_utc_naive(spark):
    texts = ["2020-06-01T08:30:00+02:00", "2020-06-01T08:30:00Z", "2020-06-01 08:30:00", "open", None]
    assert values(spark, texts, L.utc_naive) == [
        datetime(2020, 6, 1, 6, 30), datetime(2020, 6, 1, 8, 30), datetime(2020, 6, 1, 8, 30), None, None
    ]


def test_device_id(spark):
    texts = ["WR 01 .02 .003", "INV01.02.003", "x WR 01 02. 003 y", "wr 01.02.003", "WR 1.2.3", None]
    assert values(spark, texts, L.device_id) == ["INV 01.02.003"] * 3 + [None] * 3


def test_severity_and_codes(spark):
    rows = [(None, "x"), (0, "Strom"), (5, "DC Strom hoch"), (6, "Warnung"), (7, None), (8, "Fan")]
    df = spark.createDataFrame(rows, "c long, d string").coalesce(1)
    got = [r[0] for r in df.select(L.severity_class(F.col("c"), F.col("d"))).collect()]
    assert got == ["none", "none", "warning", "warning", "fault", "fault"]
    assert spark.range(1).select(L.code_base(F.lit(65536 * 3 + 36).cast("long"))).first()[0] == 36


def test_epoch_seconds_ignores_zone(spark):
    df = spark.sql("select timestamp_ntz'2021-03-14 02:30:05' as t")  # inside a zone gap
    expected = int((datetime(2021, 3, 14, 2, 30, 5) - datetime(1970, 1, 1)).total_seconds())
    assert df.select(L.epoch_seconds(F.col("t"))).first()[0] == expected


def test_clip_and_energy(spark):
    df = spark.sql("select * from values (1D, 2D), (3D, 2D), (-1D, 2D), (cast(null as double), 2D) t(v, k)")
    got = [tuple(r) for r in df.select(L.clip_to_capacity(F.col("v"), F.col("k")), L.energy_kwh(F.col("v"), 0.5)).collect()]
    assert got == [(1.0, 0.5), (2.0, 1.5), (0.0, 0.0), (None, 0.0)]


def test_unknown_bucket_label_passes_through(spark):
    assert values(spark, ["FAULT", "NEW_CAUSE"], L.bucket_label) == ["Fault", "NEW_CAUSE"]
