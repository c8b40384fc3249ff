"""Merkle manifest of a table as a persistent tree whose tampered versions copy only their paths.

Every row is a leaf: the SHA-256 (lowercase hex) of its fields, each written as ``-`` for null or as its
UTF-8 byte count, ``:`` and its value. Per language, leaves ascend by id; every two consecutive nodes of a
level become the hash of their concatenated hex digests, a last lone node the hash of itself, until one
node, the language's subroot, remains. Subroots, ordered by language (null first, bytewise), give the
root in the same way.

The tree is built in aligned blocks of ``2 ** block_levels`` nodes: one task reduces a block over that
many levels (a group with fewer nodes: to its one node), and the block roots are the next round's nodes,
so a tree of n leaves needs about log(n) / block_levels rounds, not log2(n) shuffles. Every node keeps its
path inside its block (sibling digest and side per level); a leaf's whole path is its own block path
followed by its block's, found by joins from the top down.

A tampered leaf is a new version of the tree that shares every untouched node: only its ancestors are
copied, and the copy of each is the hash of the copied child with the original sibling, so its root (the
folded root) comes from folding the tampered leaf along the original path, with no other node rebuilt. A
leaf that is not tampered is folded along its path in the same way: its proof is checked, not assumed.

Positions inside a language come from a range partition on (language, id, leaf): each task numbers its
rows, and the rows of earlier tasks of the same language (a small table of counts) are added, so a
language that holds most rows spreads over many tasks.

Cases: null fields are ``-``; a null language is a language of its own and comes first; a null id comes
first in its language and is never tampered; a null n_chars stays null (the leaf is unchanged, verified);
repeated rows are separate leaves with equal digests, in either order; ties of id are broken by the leaf
digest; an empty or whitespace text is hashed as it is; a language with one leaf has that leaf as
subroot; a table with one leaf has it as root; an empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossledger.llm.common import settled, small_side, table

#: A task reduces a block of 2 ** BLOCK_LEVELS nodes over that many levels.
BLOCK_LEVELS = 10
#: Rows of a language whose crc32 of the decimal id this number divides have n_chars + 1.
TAMPER_EVERY = 7

PATH = "array<struct<sib:string,side:int>>"
#: Side of a node in its pair: left, right, or lone (hashed alone).
LEFT, RIGHT, LONE = 0, 1, 2


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text (integers decimal)."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)), 256)


def group_key(lang: Column) -> Column:
    """A non-null key that sorts as the language does, null first and bytewise."""
    return F.when(lang.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), lang.cast("string")))


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (with a key ``g``) and ``idx``, the position from 0 within ``g`` by ``order``.

    Rows are range partitioned on (g, order) and numbered within each task; counts of (task, g) give the
    rows of earlier tasks. The result is settled, so that positions survive a lost executor.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    tagged = settled(
        rows.repartitionByRange(parts, F.col("g"), *order)
        .sortWithinPartitions(F.col("g"), *order)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_local", local)
    )
    counts = tagged.groupBy("_task", "g").agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    earlier = Window.partitionBy("g").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = settled(counts.select("_task", "g", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")))
    return tagged.join(small_side(starts), ["_task", "g"]).withColumn("idx", F.col("_local") + F.col("_shift")).drop("_task", "_local", "_shift")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduce_block(block_levels: int):
    """The function that reduces one aligned block: a path row per node and a row for the block root."""
    size = 1 << block_levels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        hashes = list(pdf["hash"])
        m = int(pdf["m"].iloc[0])
        levels = block_levels if m > size else math.ceil(math.log2(m))
        paths: list[list[dict]] = [[] for _ in hashes]
        below = [[i] for i in range(len(hashes))]
        level = hashes
        for _ in range(levels):
            upper, members = [], []
            for j in range(0, len(level), 2):
                if j + 1 < len(level):
                    a, b = level[j], level[j + 1]
                    for i in below[j]:
                        paths[i].append({"sib": b, "side": LEFT})
                    for i in below[j + 1]:
                        paths[i].append({"sib": a, "side": RIGHT})
                    upper.append(_digest(a + b))
                    members.append(below[j] + below[j + 1])
                else:
                    for i in below[j]:
                        paths[i].append({"sib": None, "side": LONE})
                    upper.append(_digest(level[j]))
                    members.append(below[j])
            level, below = upper, members
        g = pdf["g"].iloc[0]
        block = int(pdf["idx"].iloc[0]) >> block_levels
        parent = block if m > size else None
        nodes = pd.DataFrame({"kind": "path", "g": g, "idx": pdf["idx"].to_numpy(), "parent": parent, "hash": None, "path": paths})
        root = pd.DataFrame({"kind": ["root"], "g": [g], "idx": [block], "parent": [None], "hash": [level[0]], "path": [[]]})
        return pd.concat([nodes, root], ignore_index=True)

    return run


def reduce_tree(nodes: DataFrame, block_levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame]:
    """From nodes (g, idx, hash): (g, idx, path) of every node up to its group's top, and (g, top).

    Rounds go on while a group has more than one node; a group of one node is its own top.
    """
    size = 1 << block_levels
    schema = f"kind string, g string, idx long, parent long, hash string, path {PATH}"
    counts = settled(nodes.groupBy("g").agg(F.count("*").alias("m")))
    level = nodes
    rounds, tops = [], []
    while True:
        level = level.join(small_side(counts), "g")
        single = level.filter("m = 1")
        tops.append(single.select("g", F.col("hash").alias("top")))
        alone = single.select("g", "idx", F.lit(None).cast("long").alias("parent"), F.array().cast(PATH).alias("path"))
        if counts.agg(F.max("m")).first()[0] in (None, 1):
            rounds.append(alone)
            break
        done = settled(level.filter("m > 1").groupBy("g", F.expr(f"idx div {size}")).applyInPandas(reduce_block(block_levels), schema))
        rounds.append(done.filter("kind = 'path'").select("g", "idx", "parent", "path").unionByName(alone))
        level = done.filter("kind = 'root'").select("g", "idx", "hash")
        counts = settled(counts.filter("m > 1").select("g", F.when(F.col("m") > size, F.ceil(F.col("m") / size)).otherwise(F.lit(1)).cast("long").alias("m")))
    full = rounds[-1].select("g", "idx", "path")
    for below in reversed(rounds[:-1]):
        upper = full.select("g", F.col("idx").alias("parent"), F.col("path").alias("upper"))
        full = settled(
            below.join(upper, ["g", "parent"], "left").select("g", "idx", F.concat("path", F.coalesce("upper", F.array().cast(PATH))).alias("path"))
        )
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return full, settled(top)


def fold(start: Column, path: Column) -> Column:
    """The digest reached from ``start`` along ``path`` (sibling digests and sides)."""
    return F.aggregate(
        path,
        start,
        lambda acc, p: F.when(p["side"] == LONE, F.sha2(acc, 256))
        .when(p["side"] == LEFT, F.sha2(F.concat(acc, p["sib"]), 256))
        .otherwise(F.sha2(F.concat(p["sib"], acc), 256)),
    )


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """(doc_id, lang, idx, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    tampered = (
        F.col("doc_id").isNotNull()
        & F.col("n_chars").isNotNull()
        & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0)
    )
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        group_key(F.col("lang")).alias("g"),
        leaf(*cols).alias("leaf"),
        F.when(tampered, leaf(cols[0], cols[1], cols[2], cols[3] + 1, cols[4])).alias("changed"),
    )
    leaves = positions(base, [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    low, subroots = reduce_tree(leaves.select("g", "idx", F.col("leaf").alias("hash")), block_levels)
    upper = positions(subroots.select("g", F.col("top").alias("subroot")).withColumn("lang_key", F.col("g")).withColumn("g", F.lit("all")), [F.col("lang_key")])
    high, root_row = reduce_tree(upper.select("g", "idx", F.col("subroot").alias("hash")), block_levels)
    top = root_row.first()
    root = F.lit(top["top"] if top else None).cast("string")
    lang_paths = upper.join(high, ["g", "idx"]).select(F.col("lang_key").alias("g"), "subroot", F.col("path").alias("upper"))
    whole = F.concat("path", "upper")
    return (
        leaves.join(low, ["g", "idx"])
        .join(small_side(settled(lang_paths)), "g")
        .select(
            "doc_id",
            "lang",
            F.col("idx").alias("position"),
            "leaf",
            "subroot",
            root.alias("root"),
            F.sha2(F.array_join(F.transform(whole, lambda p: p["sib"]), ""), 256).alias("proof_sha256"),
            fold(F.coalesce("changed", "leaf"), whole).alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def op11_merkle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all ``documents`` with a tampered version per row whose n_chars gets one more."""
    return manifest(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB's SQL: levels by a recursive query, paths by joins on the sibling index, folds by
#: ``list_reduce``. DuckDB has no CRC-32, so it is folded over the id's bytes from a table of 256 values.
SQL = """
WITH RECURSIVE
step0 AS (SELECT i, i AS c FROM range(256) t(i)),
steps AS (
  SELECT i, list_reduce(list_prepend(c, [1, 1, 1, 1, 1, 1, 1, 1]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM step0),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps),
rows0 AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) END AS e_id,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS e_src,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS e_lang,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR) END AS e_n,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR) END AS e_n1,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS e_text,
    CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g
  FROM documents),
crcs AS (
  SELECT rid, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'),
      lambda k: ('0x' || k)::BIGINT)),
      lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INTEGER) + 1])), 4294967295) AS c
  FROM rows0, crc WHERE doc_id IS NOT NULL),
leaves AS (
  SELECT r.rid, r.doc_id, r.lang, r.g, sha256(e_id || e_src || e_lang || e_n || e_text) AS leaf,
    CASE WHEN r.n_chars IS NOT NULL AND c.c % 7 = 0 THEN sha256(e_id || e_src || e_lang || e_n1 || e_text) END AS changed
  FROM rows0 r LEFT JOIN crcs c USING (rid)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
low(g, lvl, idx, h, n) AS (
  SELECT g, 0, idx, leaf, count(*) OVER (PARTITION BY g) FROM placed
  UNION ALL
  SELECT g, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2
  FROM low WHERE n > 1 GROUP BY g, lvl, idx // 2),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx FROM low WHERE n = 1),
high(lvl, idx, h, n) AS (
  SELECT 0, idx, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2
  FROM high WHERE n > 1 GROUP BY lvl, idx // 2),
root AS (SELECT h AS root FROM high WHERE n = 1),
lowpath AS (
  SELECT p.rid, t.lvl, s.h AS sib, (p.idx >> t.lvl) % 2 AS side
  FROM placed p JOIN (SELECT DISTINCT g, lvl FROM low WHERE n > 1) t ON t.g = p.g
  LEFT JOIN low s ON s.g = p.g AND s.lvl = t.lvl AND s.idx = xor(p.idx >> t.lvl, 1)),
highpath AS (
  SELECT r.g, t.lvl, s.h AS sib, (r.idx >> t.lvl) % 2 AS side
  FROM subroots r JOIN (SELECT DISTINCT lvl FROM high WHERE n > 1) t ON true
  LEFT JOIN high s ON s.lvl = t.lvl AND s.idx = xor(r.idx >> t.lvl, 1)),
paths AS (
  SELECT p.rid, list(struct_pack(sib := q.sib, side := q.side) ORDER BY q.k) AS steps
  FROM placed p JOIN (
    SELECT rid, NULL AS g, lvl AS k, sib, side FROM lowpath
    UNION ALL SELECT p2.rid, h.g, 1000 + h.lvl, h.sib, h.side FROM placed p2 JOIN highpath h ON h.g = p2.g) q ON q.rid = p.rid
  GROUP BY p.rid),
whole AS (
  SELECT p.rid, p.doc_id, p.lang, p.idx, p.leaf, p.changed, s.subroot, coalesce(x.steps, []) AS steps
  FROM placed p JOIN subroots s ON s.g = p.g LEFT JOIN paths x ON x.rid = p.rid)
SELECT doc_id, lang, CAST(idx AS BIGINT) AS position, leaf, subroot, root,
  sha256(coalesce(list_aggregate(list_transform(list_filter(steps, lambda z: z.sib IS NOT NULL), lambda z: z.sib), 'string_agg', ''), '')) AS proof_sha256,
  CASE WHEN changed IS NULL OR changed = leaf THEN root ELSE
    list_reduce(list_prepend(changed, list_transform(steps, lambda z: CASE WHEN z.sib IS NULL THEN '~' ELSE CAST(z.side AS VARCHAR) || z.sib END)),
      lambda acc, z: CASE WHEN z = '~' THEN sha256(acc) WHEN z[1] = '0' THEN sha256(acc || z[2:]) ELSE sha256(z[2:] || acc) END) END AS folded_root,
  (CASE WHEN changed IS NULL OR changed = leaf THEN root ELSE
    list_reduce(list_prepend(changed, list_transform(steps, lambda z: CASE WHEN z.sib IS NULL THEN '~' ELSE CAST(z.side AS VARCHAR) || z.sib END)),
      lambda acc, z: CASE WHEN z = '~' THEN sha256(acc) WHEN z[1] = '0' THEN sha256(acc || z[2:]) ELSE sha256(z[2:] || acc) END) END) = root AS verified
FROM whole, root
"""
