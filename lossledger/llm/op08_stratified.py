"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are shuffled by a seeded hash of their id and ranked within their source. A row at rank r of n has
the fractional rank (2r + 1) / 2n. Rows sorted by it are an interleaving in which every stretch holds each
source in its share, and cutting that order into equal runs gives shards that match the mixture. Row
counts differ by one at most (law ``rows``). Ranks are exact and found in buckets (``ranks``), so that a
hot source spreads over many tasks; texts are read once and not shuffled.

Cases: a null text has size 1 and the checksum of no bytes; a null source and an empty one are one source;
rows that repeat an id are placed by checksum and size, equal rows in either order; an empty table gives
an empty result.

In the pipeline the mixing stage has dealt the rows to turns (its slots). The same method then runs in each
turn: ranks and fractional ranks are those within the turn and source, and turns follow each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm import op03_pfair
from lossledger.llm.common import seeded_order, settled, small_side, table
from lossledger.llm.ranks import bucket, ranked

SHARDS = 16
SEED = 8


def shards(docs: DataFrame, count: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return cut(
        docs.select(
            "doc_id",
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("stratum"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            seeded_order(F.col("doc_id"), seed).alias("h"),
        ),
        count,
    )


def cut(rows: DataFrame, count: int = SHARDS, span: int = 1 << 60) -> DataFrame:
    """Shards of (doc_id, stratum, size, text_crc32, h): rows ranked by ``h`` within their stratum.

    ``h`` is from 0 to less than ``span``. Rows may have a long ``turn`` (from 0): turns are laid one after
    the other, and the strata of each are interleaved by their fractional ranks in it.
    """
    rows = settled(rows if "turn" in rows.columns else rows.withColumn("turn", F.lit(0).cast("long")))
    turns = (rows.agg(F.max("turn")).first()[0] or 0) + 1
    strata = settled(rows.groupBy("turn", "stratum").agg(F.count("*").alias("stratum_rows")))
    total = strata.agg(F.sum("stratum_rows")).first()[0] or 0
    sized = rows.join(small_side(strata), ["turn", "stratum"]).withColumn("bucket", bucket(F.col("h") / float(span), F.col("stratum_rows")))
    ties = [F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    within = ranked(sized, ["turn", "stratum"], ties, "rank")
    placed = settled(
        within.withColumn("part", (2 * F.col("rank") + 1) / (2.0 * F.col("stratum_rows")))
        .withColumn("total", F.lit(total).cast("long"))
        .withColumn("bucket", bucket((F.col("turn") + F.col("part")) / float(turns), F.col("total")))
    )
    order = [F.col("turn"), F.col("part"), F.col("stratum"), *ties]
    line = ranked(placed.withColumn("all", F.lit(0)), ["all"], order, "place")
    shard = F.expr(f"place * {count} div total")
    first = F.expr(f"((place * {count} div total) * total + {count - 1}) div {count}")
    return line.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the mixture cut into shards of equal row counts.

    DataFrame functions only. The mixing stage kept its rows with their slot and place there under
    ``op03_pfair.order_folder`` of these very rows. Slots are the turns of ``cut`` and places the order
    within a stratum, so each shard is a stretch of the mixture. A slot that holds rows of several
    sources (those without a line of their own) has them interleaved by their fractional ranks. Without
    the mixture (the stage run on its own) all rows are one turn, ordered by the seeded hash, as in ``shards``.
    """
    folder = op03_pfair.order_folder(spark, docs)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return shards(docs)
    placed = spark.read.parquet(folder).select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("stratum"),
        "size",
        "text_crc32",
        F.col("slot").alias("turn"),
        F.col("place").alias("h"),
    )
    span = placed.agg(F.max("h")).first()[0]
    return cut(placed, SHARDS, (span or 0) + 1)


#: The same rows from plain windows. DuckDB has no CRC-32: it is folded over each text's bytes.
SQL = f"""
WITH step0 AS (SELECT i, i AS c FROM range(256) t(i)),
steps AS (
  SELECT i, list_reduce(list_prepend(c, [1, 1, 1, 1, 1, 1, 1, 1]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM step0),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps),
d AS (
  SELECT doc_id, coalesce(source, '') AS stratum, hex(encode(coalesce(text, ''))) AS x,
    ('0x' || md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:15])::BIGINT AS h FROM documents),
r AS (
  SELECT doc_id, stratum, h, length(x) // 2 + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(x, '..'),
      lambda k: ('0x' || k)::BIGINT)),
      lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INTEGER) + 1])), 4294967295) AS text_crc32
  FROM d, crc),
f AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32, size) - 1) + 1)
    / (2.0 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS part FROM r),
p AS (
  SELECT *, row_number() OVER (ORDER BY part, stratum, h, doc_id, text_crc32, size) - 1 AS place,
    count(*) OVER () AS total FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(place * {SHARDS} // total AS INTEGER) AS shard,
  CAST(place - (place * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM p
"""
