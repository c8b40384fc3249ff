"""Boosted trees per device: histogram boosting for the whole fleet in one job, replayed as a column.

* Bins: one pass over the fit rows of the fleet finds ``gbt_bins - 1`` quantiles of every feature
  (an approximate percentile sketch); a value's bin is the number of edges below it, so a split
  "bin <= s" is the same as "value <= edge s" on raw values.
* Fit: rows are dealt by device; each device grows level-wise trees of depth ``gbt_depth`` on its
  gradient histograms (sums and counts per node, feature and bin), with ``gbt_min_instances`` rows a side
  at least and L2 shrinkage ``gbt_l2``. Squared loss, step ``gbt_step``, up to ``gbt_iterations`` rounds;
  rows picked by a seeded hash (``gbt_validation_share``) stop the rounds after ``gbt_patience`` rounds
  without a better error, and the trees up to the best round are kept. Devices of about ``TOGETHER`` rows
  grow side by side in the same numpy calls. A task holds so many rows, or one device's fit rows: a training
  year, bounded by the calendar and the cadence, never by the size of the fleet.
* Trees are complete binary trees stored as arrays (feature, threshold, leaf value); a node that does
  not split sends every row left. Prediction deals rows and trees by device and walks a batch of rows
  through the trees of its device at once (``with_trees``); ``tree_p50`` is the same as a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lossledger.functions import clip_to_capacity
from lossledger.params import Params

#: The learner's inputs: the twin's features and the physics expectation (fixed values: they must
#: equal the reference's feature list).
TREE_FEATURES = (
    "irradiation_w_m2",
    "altitude_deg",
    "module_temp_c",
    "ambient_temp_c",
    "irradiation_roll15_mean",
    "irradiation_roll15_std",
    "hour_sin",
    "hour_cos",
    "doy_sin",
    "doy_cos",
    "p50_physics_kw",
)
#: L2 shrinkage of leaf values (fixed value of the reference's learner).
L2 = 0.02
#: Rows of devices that a task grows at once (a device with more is grown alone).
TOGETHER = 20_000
#: (row, tree) walks that a replay holds at once.
WALKS = 1 << 18

TREES = "array<struct<feat:array<int>,thr:array<double>,leaf:array<double>>>"
MODEL = f"inverter string, base double, rounds_run int, trees_kept int, trees {TREES}"


def bin_edges(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Sorted distinct quantile edges of every feature over ``rows`` (one aggregate)."""
    probs = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(c) for c in TREE_FEATURES]).first()
    return {c: sorted({float(v) for v in (found[c] or []) if v is not None}) for c in TREE_FEATURES}


def bins_of(values: np.ndarray, known: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of each value: the number of edges below it; an unknown value is in bin 0."""
    return np.where(known, np.searchsorted(edges, values, side="left"), 0)


def grow(x: np.ndarray, y: np.ndarray, stop: np.ndarray, edges: list[np.ndarray], params: Params) -> tuple[float, list[dict], int]:
    """(base, trees, rounds run) of one device, from bins ``x`` (rows x features) and targets ``y``."""
    grown = grow_fleet(x, y, stop, np.zeros(len(y), np.int64), 1, edges, params)
    feat, thr, leaf = (part[0] for part in grown[2:])
    trees = [{"feat": f.tolist(), "thr": t.tolist(), "leaf": v.tolist()} for f, t, v in zip(feat, thr, leaf)]
    return float(grown[0][0]), trees, int(grown[1][0])


def _ranks(bins: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each row's bin among its device's bins, all (device, bin) in order, and where each device's begin."""
    pairs, place = np.unique(owner * (width + 1) + bins, return_inverse=True)
    first = np.searchsorted(pairs, np.arange(int(owner.max(initial=-1)) + 2) * (width + 1))
    return place - first[owner], pairs % (width + 1), first


def grow_fleet(
    x: np.ndarray, y: np.ndarray, stop: np.ndarray, owner: np.ndarray, devices: int, edges: list[np.ndarray], params: Params
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Bases, rounds run and kept trees (feat, thr, leaf: trees x nodes) of each of ``devices`` devices.

    ``owner`` is the device of each row, ascending. The devices grow side by side, one tree each a round: the histograms
    of all nodes that may still split are filled by one ``bincount`` a feature, over the bins that the node's device
    has. A device that has stopped, and a node that found no split (its left child would find none either) or has too
    few rows for one, take no further part.
    """
    depth, lr, least = params.gbt_depth, params.gbt_step, params.gbt_min_instances
    width = max(len(e) for e in edges) + 1
    inner = (1 << depth) - 1
    cuts = np.full((len(edges), width + 1), np.inf)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
    fit = ~stop
    xf, yf, df = x[fit], y[fit], owner[fit]
    xs, ys, ds = x[stop], y[stop], owner[stop]
    edge_of = np.searchsorted(df, np.arange(devices + 1))
    base = np.array([yf[a:b].mean() if b > a else 0.0 for a, b in zip(edge_of[:-1], edge_of[1:])])
    ranked = [_ranks(xf[:, f], df, width) for f in range(x.shape[1])]
    codes, values, begins = ([r[i] for r in ranked] for i in range(3))
    widths = [int(c.max(initial=0)) + 1 for c in codes]
    pf, ps = base[df], base[ds]
    alive = np.arange(devices)
    rounds, best, best_at = np.zeros(devices, np.int64), np.full(devices, np.nan), np.zeros(devices, np.int64)
    has_stop = np.bincount(ds, minlength=devices) > 0
    grown: list[tuple[np.ndarray, ...]] = []
    for turn in range(params.gbt_iterations):
        d = len(alive)
        g = yf - pf
        node = np.zeros(len(yf), np.int64)
        feat, cut = np.zeros((d, inner), np.int64), np.full((d, inner), width)  # bin <= width: every row goes left
        may = np.bincount(df, minlength=d) >= 2 * least
        slot_device, slot_node = np.flatnonzero(may), np.zeros(int(may.sum()), np.int64)
        rows = np.flatnonzero(may[df])
        slot = (np.cumsum(may) - 1)[df[rows]]
        for level in range(depth):
            count = len(slot_device)
            if count == 0:
                node = 2 * node + 1
                continue
            best_gain, left_rows = np.zeros(count), np.zeros(count, np.int64)
            gr_rows = g[rows]
            totals = np.zeros(count, np.int64)
            for f, w in enumerate(widths):
                key = slot * w + codes[f][rows]
                sums = np.bincount(key, weights=gr_rows, minlength=count * w).reshape(count, w)
                ns = np.bincount(key, minlength=count * w).reshape(count, w)
                gl, nl = np.cumsum(sums, axis=1), np.cumsum(ns, axis=1)
                gt, nt = gl[:, -1:], nl[:, -1:]
                gr, nr = gt - gl, nt - nl
                gain = gl**2 / (nl + L2) + gr**2 / (nr + L2) - gt**2 / (nt + L2)
                gain[(nl < least) | (nr < least)] = 0.0
                s = np.argmax(gain, axis=1)
                top = gain[np.arange(count), s]
                better = np.flatnonzero(top > best_gain + 1e-12)
                best_gain[better] = top[better]
                who = slot_device[better]
                feat[who, slot_node[better]] = f
                cut[who, slot_node[better]] = values[f][begins[f][alive[who]] + s[better]]
                left_rows[better] = nl[better, s[better]]
                totals = nt[:, 0]
            split = best_gain > 0.0
            node = 2 * node + 1
            moved = split[slot]
            rows, slot = rows[moved], slot[moved]
            right = xf[rows, feat[slot_device, slot_node][slot]] > cut[slot_device, slot_node][slot]
            node[rows] += right
            sizes = np.stack([left_rows, totals - left_rows], axis=1)
            open_ = (split[:, None] & (sizes >= 2 * least)).ravel()
            child = 2 * slot + right
            go = open_[child]
            rows, slot = rows[go], (np.cumsum(open_) - 1)[child[go]]
            slot_device = np.repeat(slot_device, 2)[open_]
            slot_node = (2 * slot_node[:, None] + np.array([1, 2])).ravel()[open_]
        at = df * (inner + 1) + node - inner
        sums = np.bincount(at, weights=g, minlength=d * (inner + 1))
        ns = np.bincount(at, minlength=d * (inner + 1))
        leaf = lr * sums / (ns + L2)
        pf = pf + leaf[at]
        ps = ps + leaf[ds * (inner + 1) + route(xs, feat, cut, depth, ds)]
        grown.append((alive, feat, cuts[feat, cut], leaf.reshape(d, inner + 1)))
        rounds[alive] = turn + 1
        error, bounds = (ys - ps) ** 2, np.searchsorted(ds, np.arange(d + 1))
        for i in np.flatnonzero(has_stop[alive]):
            now, who = np.add.reduce(error[bounds[i] : bounds[i + 1]]) / (bounds[i + 1] - bounds[i]), alive[i]
            if turn == 0 or now < best[who] or (np.isnan(now) and not np.isnan(best[who])):
                best[who], best_at[who] = now, turn
        keep = ~(has_stop[alive] & (turn - best_at[alive] >= params.gbt_patience))
        if not keep.all():
            place = np.cumsum(keep) - 1
            kf, ks = keep[df], keep[ds]
            xf, yf, pf, df, codes = xf[kf], yf[kf], pf[kf], place[df[kf]], [c[kf] for c in codes]
            xs, ys, ps, ds = xs[ks], ys[ks], ps[ks], place[ds[ks]]
            alive = alive[keep]
            if len(alive) == 0:
                break
    kept = np.where(has_stop, best_at + 1, rounds)
    trees: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(devices)]
    for turn, (who, *parts) in enumerate(grown):
        for i, device in enumerate(who):
            if turn < kept[device]:
                trees[device].append(tuple(part[i] for part in parts))
    shapes = (inner, inner, inner + 1)
    stacked = [[np.array([t[k] for t in one]).reshape(-1, shapes[k]) for one in trees] for k in range(3)]
    return base, rounds, *stacked


def route(x: np.ndarray, feat: np.ndarray, cut: np.ndarray, depth: int, owner: np.ndarray) -> np.ndarray:
    """Leaf of each row of bins ``x`` in its owner's tree."""
    node, at = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[at, feat[owner, node]] > cut[owner, node])
    return node - ((1 << depth) - 1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each row of ``rows``."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def fit_devices(split: DataFrame, params: Params) -> DataFrame:
    """(inverter, base, rounds_run, trees_kept, trees) of every device with fit rows.

    A task gets whole devices, sorted by device and time, and grows those of about ``TOGETHER`` rows at once.
    """
    fit = split.where("is_fit")
    edges = bin_edges(fit, params.gbt_bins)
    share = int(params.gbt_validation_share * 1000)
    rows = (
        fit.select(
            "inverter",
            "ts",
            *[F.col(c).cast("double").alias(c) for c in TREE_FEATURES],
            F.col("p_ac_kw").cast("double").alias("y"),
            (F.pmod(F.xxhash64("ts", "inverter", F.lit(params.seed)), F.lit(1000)) < share).alias("stop"),
        )
        .repartition("inverter")
        # rows of a device in a fixed order, so that a fit does not depend on partitioning
        .sortWithinPartitions("inverter", "ts")
    )
    arrays = [np.asarray(edges[c], dtype=float) for c in TREE_FEATURES]

    def grown(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        codes = part.column("inverter").to_numpy()
        starts = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1]
        owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
        columns = [part.column(c) for c in TREE_FEATURES]
        x = np.stack(
            [bins_of(c.fill_null(0.0).to_numpy(), c.is_valid().to_numpy(), e) for c, e in zip(columns, arrays)], axis=1
        )
        y, stop = part.column("y").to_numpy(), part.column("stop").to_numpy()
        base, rounds, feat, thr, leaf = grow_fleet(x, y, stop, owner, len(starts), arrays, params)
        kept = [len(t) for t in feat]
        nodes = [_lists(np.concatenate(t), k) for t, k in ((feat, pa.int32()), (thr, pa.float64()), (leaf, pa.float64()))]
        trees = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(kept)], pa.int32()), pa.StructArray.from_arrays(nodes, ["feat", "thr", "leaf"])
        )
        names = part.column("inverter").take(pa.array(starts)).combine_chunks()
        out = [names, pa.array(base), pa.array(rounds, pa.int32()), pa.array(kept, pa.int32()), trees]
        return pa.RecordBatch.from_arrays(out, ["inverter", "base", "rounds_run", "trees_kept", "trees"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < TOGETHER:
                continue
            rows = pa.Table.from_batches(held)
            names = rows.column("inverter").to_numpy()
            whole = int(np.argmax(names == names[-1]))  # the last device may go on in the next batch
            if whole:
                yield grown(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield grown(pa.Table.from_batches(held))

    return rows.mapInArrow(fitted, MODEL)


def tree_sum(trees: Column, x: Column, depth: int) -> Column:
    """Sum of the leaf values that the rows' features ``x`` reach in ``trees``."""
    inner = (1 << depth) - 1

    def leaf_of(t: Column) -> Column:
        step = lambda n, _: 2 * n + 1 + F.when(F.element_at(x, F.element_at(t["feat"], n + 1) + 1) > F.element_at(t["thr"], n + 1), 1).otherwise(0)
        return F.element_at(t["leaf"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) - inner + 1)

    return F.aggregate(trees, F.lit(0.0), lambda acc, t: acc + leaf_of(t))


def tree_p50(params: Params) -> Column:
    """Expected power of a row holding the features, kwp, base and trees."""
    x = F.array(*[F.col(c).cast("double") for c in TREE_FEATURES])
    return clip_to_capacity(F.col("base") + tree_sum(F.col("trees"), x, params.gbt_depth), F.col("kwp"))


def replay(x: np.ndarray, feat: np.ndarray, thr: np.ndarray, leaf: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the leaf values that the rows of ``x`` (features x rows) reach in the trees, in their order."""
    inner, trees = (1 << depth) - 1, np.arange(len(feat))[:, None]
    out = np.zeros(x.shape[1])
    step = max(1, WALKS // max(1, len(feat)))
    for a in range(0, len(out), step):
        part = x[:, a : a + step]
        at, node = np.arange(part.shape[1]), np.zeros((len(feat), part.shape[1]), np.int64)
        for _ in range(depth):
            place = trees * inner + node
            node = 2 * node + 1 + ~(part[feat.take(place), at] <= thr.take(place))  # NaN is above every value
        for row in leaf.take(trees * (inner + 1) + node - inner):
            out[a : a + step] += row
    return out


def with_trees(rows: DataFrame, fitted: DataFrame, params: Params) -> DataFrame:
    """``rows`` (with the features) and ``p50``: what the trees of the row's device give, null without trees.

    Equal to ``tree_p50`` over a join, but a device's trees travel once and not with each of its rows: trees
    and rows are dealt by device, the trees sorted before the rows, and a task holds one device's trees and a
    batch of its rows.
    """
    names = rows.columns
    models = fitted.where("trees is not null").select("inverter", "base", "trees").select(
        "inverter", F.lit(0).alias("_row"), F.col("base").alias("_base"), F.col("trees").alias("_trees")
    )
    features = [F.col(c).cast("double").alias(f"_{c}") for c in TREE_FEATURES]
    dealt = (
        rows.select("*", *features, F.lit(1).alias("_row"))
        .unionByName(models, allowMissingColumns=True)
        .repartition("inverter")
        .sortWithinPartitions("inverter", "_row")
    )
    depth = params.gbt_depth

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, model = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            owners, is_row = batch.column("inverter").to_numpy(zero_copy_only=False), batch.column("_row").to_numpy() == 1
            starts = np.r_[0, np.flatnonzero(owners[1:] != owners[:-1]) + 1, len(owners)]
            sums, known = np.zeros(len(owners)), np.zeros(len(owners), bool)
            x = np.stack([batch.column(f"_{c}").fill_null(-np.inf).to_numpy() for c in TREE_FEATURES])
            for a, b in zip(starts[:-1], starts[1:]):
                if owners[a] != name:
                    name, model = owners[a], None
                first = a + int(np.argmax(is_row[a:b])) if is_row[a:b].any() else b
                if first > a:
                    feat, thr, leaf = (p.flatten().to_numpy() for p in batch.column("_trees")[first - 1].values.flatten())
                    inner = (1 << depth) - 1
                    model = batch.column("_base")[first - 1].as_py(), feat.reshape(-1, inner), thr.reshape(-1, inner), leaf.reshape(-1, inner + 1)
                if model is not None and b > first:
                    sums[first:b] = model[0] + replay(x[:, first:b], *model[1:], depth)
                    known[first:b] = True
            keep = pa.array(is_row)
            columns = [batch.column(c).filter(keep) for c in names] + [pa.array(sums[is_row], mask=~known[is_row])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_sum"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_sum", T.DoubleType())])
    return dealt.mapInArrow(walked, schema).withColumn("p50", clip_to_capacity(F.col("_sum"), F.col("kwp"))).drop("_sum")


def tree_holdout(split: DataFrame, models: DataFrame, params: Params) -> DataFrame:
    """Held-out rows with the trees' p50, in the shape ``validation_metrics`` reads."""
    rows = split.where("is_valid").select("inverter", "kwp", "p_ac_kw", "n_clean", *TREE_FEATURES)
    known = rows.join(models.select("inverter").hint("merge"), "inverter", "left_semi")
    return with_trees(known, models, params).select("inverter", "kwp", "p_ac_kw", "n_clean", "p50")


def tree_models(inverters: DataFrame, eta: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per device with capacity, efficiency and band quantiles (null where unfitted)."""
    return (
        inverters.where("kwp > 0")
        .select("inverter", "kwp", "module_type")
        .join(eta.select("inverter", "eta_system").hint("merge"), "inverter", "left")
        .join(metrics.select("inverter", "residual_q10_kw", "residual_q90_kw").hint("merge"), "inverter", "left")
    )


def predict_trees(rows: DataFrame, moments: DataFrame, models: DataFrame, params: Params, fitted: DataFrame) -> DataFrame:
    """Bands of the trees for the (ts, inverter) pairs of ``rows``; zero outside model daylight.

    ``models`` holds band lines (``with_band_lines``), ``fitted`` the trees. A device without trees is served by physics.
    """
    eta = F.coalesce("eta_system", F.lit(params.default_eta))
    physics = clip_to_capacity(F.col("kwp") * F.col("physics_base_kw_per_kwp") * eta, F.col("kwp"))
    p50 = F.col("p50_twin_kw")
    low, high = p50 * F.col("low_factor") + F.col("low_shift"), p50 * F.col("high_factor") + F.col("high_shift")
    p10, p90 = F.greatest(F.lit(0.0), F.least(p50, low)), F.greatest(p50, F.least(F.col("kwp"), high))
    day = F.col("is_model_day")
    known = rows.join(moments, "ts").join(models.hint("merge"), "inverter").withColumn("p50_physics_kw", physics)
    return (
        with_trees(known, fitted, params)
        .withColumn("p50_twin_kw", F.when(day, F.coalesce("p50", "p50_physics_kw")).otherwise(0.0))
        .withColumns({"p10_twin_kw": F.when(day, p10).otherwise(0.0), "p90_twin_kw": F.when(day, p90).otherwise(0.0)})
        .drop("p50")
    )
