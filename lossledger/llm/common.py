"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a folder beside the session's warehouse, on a local master only (tests): on a
    cluster the default warehouse may be a local path that executors do not share, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    ``df`` must be settled or cheap: its rows are counted (up to the bound).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remainder(doc_id: Column, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row: its id, or its text's hash where the id is null."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string")))


def seeded_order(doc_id: Column, seed: int) -> Column:
    """A pseudo-random 60-bit number of an id, equal in every engine that has MD5."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def hash_bar(rows: int, wanted: int) -> int:
    """A bar on a 64-bit hash that about three times ``wanted`` of ``rows`` rows stay under.

    Put before a top-k by hash, it keeps what each task sends small however many tasks there are.
    """
    share = min(1.0, 3 * (wanted + 50) / max(1, rows))
    return min(2**63 - 1, int(-(2**63) + share * 2**64))
