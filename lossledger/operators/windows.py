"""Windows over time that never put a whole series into one task.

A series is cut into pieces and each piece gets the few rows ("halo") of its
neighbours that the window frame can reach, so pieces are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lossledger.functions import epoch_seconds


#: A day is cut into pieces of this length, so a busy day spreads over up to 144 tasks.
PIECE_SECONDS = 600


def _edges(df: DataFrame, ts: str) -> DataFrame:
    """Of each piece, the last row before it and the first row after it.

    Pieces are put in order within their day (at most 144 rows a window). Across days the
    first and last rows of the days are (one row per calendar day of the history, so the
    unpartitioned window sorts a few thousand rows).
    """
    row = F.struct(*df.columns)
    pieces = df.groupBy(F.col(ts).cast("date").alias("_day"), _piece(ts)).agg(
        F.min_by(row, F.col(ts)).alias("_first"), F.max_by(row, F.col(ts)).alias("_last")
    )
    days = pieces.groupBy(F.col("_day").alias("_of_day")).agg(
        F.min_by("_first", "_piece").alias("_first"), F.max_by("_last", "_piece").alias("_last")
    )
    by_day = Window.orderBy("_of_day")
    around = days.select(
        "_of_day", F.lag("_last").over(by_day).alias("_day_before"), F.lead("_first").over(by_day).alias("_day_after")
    )
    in_day = Window.partitionBy("_day").orderBy("_piece")
    return (
        pieces.withColumns({"_before": F.lag("_last").over(in_day), "_after": F.lead("_first").over(in_day)})
        .join(around, F.col("_day").eqNullSafe(F.col("_of_day")))
        .select(
            "_piece",
            F.coalesce("_before", "_day_before").alias("_before"),
            F.coalesce("_after", "_day_after").alias("_after"),
        )
    )


def _piece(ts: str) -> Column:
    return F.floor(epoch_seconds(F.col(ts)) / PIECE_SECONDS).alias("_piece")


def _with_halo(df: DataFrame, ts: str, sides: tuple[str, ...]) -> DataFrame:
    """Rows tagged with their piece and ``_own``; halo rows come from the neighbour pieces."""
    own = df.withColumns({"_piece": _piece(ts), "_own": F.lit(True)})
    edges = _edges(df, ts)
    halo = None
    for side in sides:
        part = edges.where(F.col(side).isNotNull()).select(
            *[F.col(f"{side}.`{c}`").alias(c) for c in df.columns],
            "_piece",
            F.lit(False).alias("_own"),
        )
        halo = part if halo is None else halo.unionByName(part)
    return own.unionByName(halo)


def rolling_neighbours(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean and population deviation of a value over the row before, itself and the row after.

    ``df`` has unique timestamps. Equal to an unpartitioned
    ``ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING`` window, whatever gaps exist.
    """
    frame = Window.partitionBy("_piece").orderBy(ts).rowsBetween(-1, 1)
    return (
        _with_halo(df, ts, ("_before", "_after"))
        .withColumns(
            {
                f"{value}_roll_mean": F.avg(value).over(frame),
                f"{value}_roll_std": F.stddev_pop(value).over(frame),
            }
        )
        .where("_own")
        .drop("_piece", "_own")
    )


def previous_in_series(df: DataFrame, ts: str, keep: list[str]) -> DataFrame:
    """Each row with the timestamp before it as ``prev_ts`` (NULL for the first row)."""
    frame = Window.partitionBy("_piece").orderBy(ts)
    return (
        _with_halo(df.select(ts, *keep), ts, ("_before",))
        .withColumn("prev_ts", F.lag(ts).over(frame))
        .where("_own")
        .drop("_piece", "_own")
    )


def count_within_reach(
    df: DataFrame, keys: list[str], ts: str, flag: Column, reach_seconds: int, out: str
) -> DataFrame:
    """Number of flagged rows of the same key within ``reach_seconds`` before or after.

    A key is cut into pieces of 24 reaches. Only a flagged row can count
    elsewhere, so only flagged rows near a cut are copied to the piece next to
    it; even a key holding most of all rows spreads over as many tasks as it has
    pieces.
    """
    piece = 24 * reach_seconds
    at = F.col("_at")
    home = F.floor(at / piece).cast("bigint")
    here = F.pmod(at, F.lit(piece))
    hit = F.col("_hit")

    def placed(number: Column, own: bool) -> Column:
        return F.struct(number.alias("_piece"), F.lit(own).alias("_own"))

    places = F.array(
        placed(home, True),
        F.when(hit & (here < reach_seconds), placed(home - 1, False)),
        F.when(hit & (here >= piece - reach_seconds), placed(home + 1, False)),
    )
    frame = (
        Window.partitionBy(*keys, "_piece").orderBy("_at").rangeBetween(-reach_seconds, reach_seconds)
    )
    return (
        df.withColumns({"_at": epoch_seconds(F.col(ts)), "_hit": F.coalesce(flag, F.lit(False))})
        .select("*", F.inline(F.array_compact(places)))
        .withColumn(out, F.sum(F.col("_hit").cast("bigint")).over(frame))
        .where("_own")
        .drop("_at", "_hit", "_piece", "_own")
    )
