"""Exact ranks of all rows by a number, without a single-task sort.

Rows are dealt to buckets that are ranges of their order; a bucket's rows are ranked in a window of their
own and the number of rows in earlier buckets of the group is added. The number of buckets follows the
group's size up to ``BUCKETS``, so a group that holds most rows spreads over as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group at most; the one window over a group's buckets never has more rows.
BUCKETS = 16_384
#: Rows of a bucket, about, while there are fewer buckets than that.
ROWS = 64


def bucket(part: Column, rows: Column) -> Column:
    """The bucket of a row whose order, scaled to 0..1, is ``part``, in a group of ``rows`` rows."""
    most = F.least(F.lit(BUCKETS), F.greatest(F.lit(1), F.ceil(rows / ROWS)))
    return F.least(F.floor(part * most), most - 1).cast("long")


def earlier(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, bucket, rows before the bucket) from (group, bucket, n)."""
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` (with a column bucket) and ``name``, the rank from 0 within the group by ``order``.

    ``order`` must agree with the buckets. ``rows`` is read twice, so it should be settled or cheap.
    """
    keys = [*group, "bucket"]
    before = earlier(rows.groupBy(*keys).agg(F.count("*").alias("n")), group)
    own = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn(name, F.row_number().over(own) - 1)
        .join(before, keys)
        .withColumn(name, F.col(name).cast("long") + F.col("before"))
        .drop("before", "bucket")
    )
