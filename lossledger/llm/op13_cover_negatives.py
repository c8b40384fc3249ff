"""Hard-negative mining with cover trees over norm-augmented candidates.

Components become integers (floor of 256 x) and a row's score is its integer inner product with the
anchor. Each candidate x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of its tree,
so that all candidates lie on one sphere and the anchor (with 0 there) has the same inner product with
them; distances on that sphere follow inner products. A tree is built level by level: a node covers its
points within its radius (the largest distance from its center, stored exactly), and its children are
centers picked farthest first until each point lies within half the node's radius (the level's covering
radius), the node's center first, so centers nest across levels. For an anchor q and a node of center c
and radius R, every score lies in q.c -+ |q| R.

A search is best-first and runs for a block of queries at once: nodes wait in one heap by the best
upper bound (at most the window's top) of the queries still alive in them; a query leaves a node whose
bounds fall outside its window or cannot beat its k-th row; leaves are verified exactly for all their
live queries in one matrix product (integer scores, exact in float64 since they are small integers). Positives search the anchor's own label with no window; negatives search the
other labels with the window 80 p <= 100 s <= 100 p of each positive's score p.

Spark deals candidates into trees of about ``SHARD_ROWS`` rows (a label with more rows has more trees),
and anchors into blocks of about ``QUERY_ROWS`` queries; each (tree, block) pair is one task, which holds
one tree and one block, and a query meets every tree it needs (the stated query set against all rows, in
blocks). The k best of each tree are merged per query in a window of at most k rows per tree.

Cases: rows with a null label, a null vector, or a null, NaN or infinite component take no part; a
vector of other length than the anchor's counts missing components as 0; a null vec_id takes part as a
candidate, is never an anchor or relabelled, and sorts after every id on ties; repeated rows are separate
candidates (a positive is another vec_id than its anchor), and a repeated anchor row gives its rows
again; an anchor with no positive, or a positive with no negative in its window, gives no rows; an empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossledger.llm.common import settled, small_side, table

K = 5
ANCHOR_EVERY = 100
RELABEL_EVERY = 7
SCALE = 256
#: A negative's score s against a positive's p: LOW * p <= HIGH * s <= HIGH * p.
LOW, HIGH = 80, 100
#: Candidates of a tree, about; queries of a block, about.
SHARD_ROWS = 20_000
QUERY_ROWS = 20_000
#: Points of a leaf at most, unless they cannot be told apart; centers of a node at most (radii stay exact).
LEAF = 512
FANOUT = 8
NO_ID = np.iinfo(np.int64).max

HITS = "qkey long, pos_rank int, cand_id long, cand_key long, score long"


class CoverTree:
    """A cover tree over the rows of ``vectors`` (integer components) on the norm-augmented sphere."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.x = vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", self.x, self.x)
        lift = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        self.points = np.hstack([self.x, lift[:, None]])
        self.center, self.radius, self.children, self.members = [], [], [], []
        if len(vectors):
            self._build(leaf, fanout)

    def _node(self, center: int, pts: np.ndarray) -> int:
        d = np.sqrt(((self.points[pts] - self.points[center]) ** 2).sum(axis=1))
        self.center.append(center)
        self.radius.append(float(d.max(initial=0.0)))
        self.children.append([])
        self.members.append(None)
        return len(self.center) - 1

    def _build(self, leaf: int, fanout: int) -> None:
        stack = [(self._node(0, np.arange(len(self.points))), np.arange(len(self.points)))]
        while stack:
            node, pts = stack.pop()
            radius = self.radius[node]
            if len(pts) <= leaf or radius == 0.0:
                self.members[node] = pts
                continue
            cover = radius / 2  # the covering radius of the next level
            sub = self.points[pts]
            centers = [self.center[node]]
            nearest = np.sqrt(((sub - self.points[centers[0]]) ** 2).sum(axis=1))
            owner = np.zeros(len(pts), dtype=np.int64)
            while nearest.max() > cover and len(centers) < fanout:
                far = int(np.argmax(nearest))
                d = np.sqrt(((sub - sub[far]) ** 2).sum(axis=1))
                closer = d < nearest
                owner[closer] = len(centers)
                nearest = np.minimum(nearest, d)
                centers.append(int(pts[far]))
            if len(centers) == 1:
                self.members[node] = pts
                continue
            for j, c in enumerate(centers):
                own = pts[owner == j]
                child = self._node(c, own)
                self.children[node].append(child)
                stack.append((child, own))
        self.center = np.asarray(self.center)
        self.radius = np.asarray(self.radius)
        self.kids = [np.asarray(k, dtype=np.int64) for k in self.children]

    def search(self, q: np.ndarray, lo: float, hi: float, skip: int | None, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """The k best (score, id, row) with lo <= score <= hi and id != skip (if given), best first, ties by id then row."""
        got = self.search_block(q[None, :], np.array([lo]), np.array([hi]), np.array([skip or 0]), np.array([skip is not None]), ids, k)
        return got[0]

    def search_block(
        self, qs: np.ndarray, lo: np.ndarray, hi: np.ndarray, skip: np.ndarray, skips: np.ndarray, ids: np.ndarray, k: int
    ) -> list[list[tuple[int, int, int]]]:
        """``search`` for a block of queries at once.

        Nodes wait in one heap by the best bound of their live queries; a node keeps, per query, the
        bound min(upper, hi), and a query leaves a node once that is below its own k-th score (ties stay,
        for the smaller id) or its window lies outside the node's bounds. A leaf scores all its live
        queries in one product and merges them into each query's k best.
        """
        n, m = len(qs), len(ids)
        # One exact number per (score, row): higher score first, then smaller id, then smaller row.
        tie = np.empty(m, dtype=np.int64)
        tie[np.lexsort((np.arange(m), ids))] = np.arange(m)[::-1]
        worst = -np.inf
        best = np.full((n, k), worst)
        if m and n:
            qn = np.sqrt(np.einsum("ij,ij->i", qs, qs)) * (1 + 1e-9) + 1e-9
            order = count()
            cs = qs @ self.x[self.center[0]]
            reach = qn * self.radius[0] + 1e-6
            live = (cs + reach >= lo) & (cs - reach <= hi)
            cap = np.minimum(cs + reach, hi)
            heap = [(-cap[live].max(), next(order), 0, np.flatnonzero(live), cap[live])] if live.any() else []
            while heap:
                _, _, node, act, cap = heapq.heappop(heap)
                alive = cap >= np.floor(best[act, k - 1] / m)
                act, cap = act[alive], cap[alive]
                if not len(act):
                    continue
                pts = self.members[node]
                if pts is not None:
                    sc = np.rint(qs[act] @ self.x[pts].T)
                    ok = (sc >= lo[act, None]) & (sc <= hi[act, None]) & ~(skips[act, None] & (ids[pts][None, :] == skip[act, None]))
                    key = np.where(ok, sc * m + tie[pts][None, :], worst)
                    both = np.concatenate([best[act], key], axis=1)
                    top = np.argpartition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else np.arange(both.shape[1])[None, :].repeat(len(act), 0)
                    chosen = np.take_along_axis(both, top, axis=1)
                    best[act] = -np.sort(-chosen, axis=1)
                    continue
                kids = self.kids[node]
                cs = qs[act] @ self.x[self.center[kids]].T
                reach = qn[act, None] * self.radius[kids][None, :] + 1e-6
                caps = np.minimum(cs + reach, hi[act, None])
                keep = (cs + reach >= lo[act, None]) & (cs - reach <= hi[act, None]) & (caps >= np.floor(best[act, k - 1] / m)[:, None])
                for j, child in enumerate(kids):
                    if keep[:, j].any():
                        heapq.heappush(heap, (-caps[keep[:, j], j].max(), next(order), int(child), act[keep[:, j]], caps[keep[:, j], j]))
        row_of = np.empty(m, dtype=np.int64)
        row_of[tie] = np.arange(m)
        out = []
        for q in range(n):
            hits = []
            for key in best[q]:
                if key == worst:
                    continue
                score = int(np.floor(key / m))
                row = int(row_of[int(key - score * m)])
                hits.append((score, int(ids[row]), row))
            out.append(hits)
        return out


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        n = min(len(v), width)
        out[i, :n] = np.asarray(v[:n], dtype=np.int64)
    return out


def searcher(k: int):
    def run(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qkey": [], "pos_rank": [], "cand_id": [], "cand_key": [], "score": []})
        if cands.empty or queries.empty:
            return empty
        width = max(max((len(v) for v in cands["cvec"]), default=0), max((len(v) for v in queries["qvec"]), default=0))
        tree = CoverTree(_matrix(cands["cvec"], width))
        ids = cands["cid"].astype(np.int64).to_numpy()
        keys = cands["ckey"].to_numpy()
        qvecs = _matrix(queries["qvec"], width).astype(np.float64)
        found = tree.search_block(
            qvecs,
            queries["lo"].to_numpy(float),
            queries["hi"].to_numpy(float),
            queries["skip"].to_numpy(np.int64),
            queries["skips"].to_numpy(bool),
            ids,
            k,
        )
        rows = [
            (qkey, rank, cid, keys[row], score)
            for qkey, rank, hits in zip(queries["qkey"], queries["pos_rank"], found)
            for score, cid, row in hits
        ]
        if not rows:
            return empty
        return pd.DataFrame(rows, columns=["qkey", "pos_rank", "cand_id", "cand_key", "score"])

    return run


def mine(emb: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, ...) of every anchor."""
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) != double('infinity'))"
    vec_id = F.col("vec_id").cast("long")
    label = F.when(vec_id % RELABEL_EVERY == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = settled(
        emb.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.expr(finite))
        .select(
            vec_id.alias("vec_id"),
            label.alias("label"),
            F.expr(f"transform(embedding, x -> CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT))").alias("vec"),
        )
        .withColumn("key", F.monotonically_increasing_id())
    )
    # Trees: a label of n rows has ceil(n / shard_rows) of them, numbered label after label.
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("trees", F.ceil(F.col("n") / shard_rows).cast("int"))
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    trees = settled(counts.select("label", "trees", F.coalesce(F.sum("trees").over(before), F.lit(0)).cast("int").alias("first")))
    total = trees.agg(F.sum("trees")).first()[0] or 0
    placed = rows.join(small_side(trees), "label").withColumn("tree", F.col("first") + F.pmod(F.xxhash64("key"), F.col("trees")).cast("int"))

    def search(queries: DataFrame, own_label: bool) -> DataFrame:
        """Top k per (query, positive rank) of every tree the queries need, merged."""
        if own_label:
            spread = F.sequence(F.col("first"), F.col("first") + F.col("trees") - 1)
        else:
            spread = F.filter(F.sequence(F.lit(0), F.lit(max(total - 1, 0))), lambda t: (t < F.col("first")) | (t >= F.col("first") + F.col("trees")))
        asked = queries.join(small_side(trees), "label").select("*", F.explode(spread).alias("tree"))
        n_asked = asked.count()
        blocks = max(1, math.ceil(n_asked / query_rows))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("qkey", "pos_rank"), F.lit(blocks)).cast("int"))
        held = placed.select("tree", F.col("key").alias("ckey"), F.coalesce("vec_id", F.lit(NO_ID)).alias("cid"), F.col("vec").alias("cvec")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        hits = held.groupBy("tree", "block").cogroup(asked.select("tree", "block", "qkey", "pos_rank", F.col("vec").alias("qvec"), "lo", "hi", "skip", "skips").groupBy("tree", "block"))
        found = hits.applyInPandas(searcher(k), HITS)
        order = Window.partitionBy("qkey", "pos_rank").orderBy(F.col("score").desc(), F.col("cand_id").asc_nulls_last(), "cand_key")
        top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return settled(top.withColumn("cand_id", F.when(F.col("cand_id") != NO_ID, F.col("cand_id"))))

    anchors = settled(rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0).withColumnRenamed("key", "qkey"))
    unbounded = anchors.select(
        "qkey", "label", "vec", F.lit(0).alias("pos_rank"), F.lit(-1e18).alias("lo"), F.lit(1e18).alias("hi"), F.col("vec_id").alias("skip"), F.lit(True).alias("skips")
    )
    positives = search(unbounded, own_label=True).select(
        "qkey", F.col("rank").alias("pos_rank"), F.col("cand_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    pairs = settled(anchors.join(positives, "qkey"))
    window = pairs.select(
        "qkey",
        "label",
        "vec",
        "pos_rank",
        F.ceil(F.col("positive_score") * LOW / HIGH).cast("double").alias("lo"),
        F.col("positive_score").cast("double").alias("hi"),
        F.lit(0).cast("long").alias("skip"),
        F.lit(False).alias("skips"),
    )
    negatives = search(window, own_label=False)
    return pairs.join(negatives.drop("cand_key"), ["qkey", "pos_rank"]).select(
        F.col("vec_id").alias("anchor_id"),
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("cand_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
        F.col("label").alias("anchor_label"),
        "pos_rank",
    )


def op13_cover_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings`` (vec_id divisible by 100) against all rows."""
    return mine(table(spark, sf_dir, "embeddings"))


#: The same rows in DuckDB's SQL, by exhaustive joins (for the correctness check on small tables).
SQL = """
WITH ok AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
),
scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label AS anchor_label, o.vec_id AS other_id, o.label AS other_label,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(o.v)) + 1), lambda i: a.v[i] * o.v[i])), 0) AS BIGINT) AS score
  FROM ok a JOIN ok o ON a.vec_id % 100 = 0
),
pos AS (
  SELECT * FROM (
    SELECT rid, anchor_id, anchor_label, other_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY rid ORDER BY score DESC, other_id ASC NULLS LAST) AS pos_rank
    FROM scored WHERE other_label = anchor_label AND other_id IS DISTINCT FROM anchor_id
  ) WHERE pos_rank <= 5
),
neg AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, p.anchor_label, p.pos_rank, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.rid, p.pos_rank ORDER BY s.score DESC, s.other_id ASC NULLS LAST) AS rank
  FROM pos p JOIN scored s ON s.rid = p.rid AND s.other_label <> p.anchor_label
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, anchor_label,
       CAST(pos_rank AS INTEGER) AS pos_rank
FROM neg WHERE rank <= 5
"""
