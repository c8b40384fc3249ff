"""Exact quantiles for groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so it is used only where the data model bounds the group
(one device within one training window or one calendar month). For groups that grow with the
fleet, e.g. all devices at one timestamp, :func:`exact_quantiles` is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_RESOLUTION = 4096.0


def _slice_of(value: Column) -> Column:
    """A monotone slice number: equal steps near zero, equal ratios further out."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * _RESOLUTION)).cast("long")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    many_groups: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys``, NULL and NaN left out.

    Pass one counts values per (key, slice); the counts combine map-side, so even
    a key that holds most rows shuffles only one row per slice and task. Running
    counts over those few slices tell which slices hold the wanted ranks. Pass two
    shuffles only the rows of these slices, partitioned by (key, slice), and ranks
    their distinct values. No task ever sees a whole group. The rows of ``df`` are never
    broadcast, however small their files: the wanted slices are, where groups are a handful.
    ``many_groups``: they grow with the fleet, each of bounded size; neither side is broadcast.
    """
    key_names = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, key_names)] or [F.lit(1).alias("_k0")]
    number = F.col(value).cast("double")
    data = df.select(*key_cols, number.alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    ).withColumn("_slice", _slice_of(F.col("_v")))

    by_key = Window.partitionBy(*key_names)
    sliced = (
        data.groupBy(*key_names, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(by_key.orderBy("_slice")))
        .withColumn("_total", F.sum("_n").over(by_key))
    )
    ranks: dict[str, tuple[Column, Column, Column]] = {}
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        ranks[name] = (position, F.floor(position), F.ceil(position))
    inside = F.lit(False)
    for _, low, high in ranks.values():
        for rank in (low, high):
            inside = inside | ((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")))
    wanted = sliced.where(inside).select(
        *[F.col(k).alias("w" + k) for k in key_names],
        F.col("_slice").alias("w_slice"),
        (F.col("_end") - F.col("_n")).alias("_before"),
        "_total",
    )
    on = F.col("_slice") == F.col("w_slice")
    for k in key_names:
        on = on & F.col(k).eqNullSafe(F.col("w" + k))
    by_slice = Window.partitionBy(*key_names, "_slice").orderBy("_v")
    ranked = (
        data.join(wanted.hint("merge") if many_groups else F.broadcast(wanted), on)
        .groupBy(*key_names, "_slice", "_before", "_total", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_stop", F.col("_before") + F.sum("_c").over(by_slice))
    )
    aggs = []
    for name, (_, low, high) in ranks.items():
        for side, rank in (("lo", low), ("hi", high)):
            here = (rank >= F.col("_stop") - F.col("_c")) & (rank < F.col("_stop"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}_{side}"))
    picked = ranked.groupBy(*key_names).agg(F.max("_total").alias("_total"), *aggs)
    out = [F.col(n).alias(k) for k, n in zip(keys, key_names)]
    for name, (position, low, _) in ranks.items():
        low_value, high_value = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low_value + (position - low) * (high_value - low_value)).alias(name))
    return picked.select(*out)
