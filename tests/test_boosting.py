"""Boosted trees per device: the histogram fit against a plain split search, and the column replay."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossledger.operators import boosting
from lossledger.params import Params

SMALL = Params(gbt_iterations=4, gbt_depth=3, gbt_min_instances=5, gbt_patience=2)


def plain_tree(x, g, least, depth, width):
    """Level-wise tree by trying every (feature, bin) of every node with masks."""
    inner = (1 << depth) - 1
    feat, cut = np.zeros(inner, dtype=int), np.full(inner, width)
    node = np.zeros(len(g), dtype=int)
    for level in range(depth):
        for v in range((1 << level) - 1, (1 << (level + 1)) - 1):
            here = node == v
            gt, nt = g[here].sum(), here.sum()
            best = 0.0
            for f in range(x.shape[1]):
                for s in range(width):
                    left = here & (x[:, f] <= s)
                    gl, nl = g[left].sum(), left.sum()
                    if nl < least or nt - nl < least:
                        continue
                    gain = gl**2 / (nl + boosting.L2) + (gt - gl) ** 2 / (nt - nl + boosting.L2) - gt**2 / (nt + boosting.L2)
                    if gain > best + 1e-12:
                        best, feat[v], cut[v] = gain, f, s
        node = 2 * node + 1 + (x[np.arange(len(g)), feat[node]] > cut[node])
    return feat, cut, node - inner


def test_histogram_fit_equals_plain_split_search():
    chance = np.random.default_rng(3)
    x = chance.integers(0, 6, size=(300, 3))
    y = 2.0 * (x[:, 0] > 2) + x[:, 1] * 0.5 + chance.normal(0, 0.1, 300)
    edges = [np.arange(5, dtype=float) + 0.5] * 3  # bin b holds values in (b - 0.5, b + 0.5]
    stop = np.zeros(300, dtype=bool)
    base, trees, _ = boosting.grow(x, y, stop, edges, SMALL)
    pred = np.full(300, y.mean())
    assert base == pytest.approx(y.mean())
    for tree in trees:
        feat, cut, leaf_of = plain_tree(x, y - pred, SMALL.gbt_min_instances, SMALL.gbt_depth, 6)
        thr = [np.inf if c >= 5 else edges[f][c] for f, c in zip(feat, cut)]
        assert list(np.where(np.isinf(thr), 0, feat)) == list(np.where(np.isinf(tree["thr"]), 0, tree["feat"]))
        assert np.allclose(np.nan_to_num(thr, posinf=1e9), np.nan_to_num(tree["thr"], posinf=1e9))
        sums = np.bincount(leaf_of, weights=y - pred, minlength=8)
        counts = np.bincount(leaf_of, minlength=8)
        assert np.allclose(tree["leaf"], SMALL.gbt_step * sums / (counts + boosting.L2))
        pred = pred + np.asarray(tree["leaf"])[leaf_of]


def test_early_stop_keeps_the_best_rounds():
    chance = np.random.default_rng(0)
    x = chance.integers(0, 4, size=(400, 2))
    y = chance.normal(0, 1, 400)  # nothing to learn: error on stop rows rises soon
    stop = chance.random(400) < 0.3
    params = Params(gbt_iterations=60, gbt_depth=3, gbt_min_instances=5, gbt_patience=5)
    _, trees, run = boosting.grow(x, y, stop, [np.arange(3) + 0.5] * 2, params)
    assert run < 60 and len(trees) == run - 5


@pytest.fixture(scope="module")
def split(spark):
    chance = np.random.default_rng(7)
    rows = []
    start = dt.datetime(2017, 1, 1)
    for device, gain in (("A", 1.0), ("B", 0.6)):
        for i in range(600):
            irr = float(chance.uniform(0, 1000))
            temp = float(chance.uniform(-5, 35))
            p = gain * 0.05 * irr * (1 - 0.004 * max(0.0, temp - 25)) + float(chance.normal(0, 0.5))
            values = [irr, 30.0, temp, temp - 5, irr, 10.0, 0.1, 0.2, 0.3, 0.4, irr * 0.05]
            rows.append((start + dt.timedelta(hours=i), device, *values, p, 50.0, i < 480, i >= 480, 600))
    names = ", ".join(f"{c} double" for c in boosting.TREE_FEATURES)
    schema = f"ts timestamp_ntz, inverter string, {names}, p_ac_kw double, kwp double, is_fit boolean, is_valid boolean, n_clean long"
    return spark.createDataFrame(rows, schema)


def test_fit_learns_and_the_column_replay_equals_the_trees(spark, split):
    params = Params(gbt_iterations=80, gbt_min_instances=10)
    fitted = boosting.fit_devices(split, params).collect()
    assert {r["inverter"] for r in fitted} == {"A", "B"}
    models = spark.createDataFrame(fitted, boosting.MODEL)
    held = boosting.tree_holdout(split, models, params).collect()
    error = np.mean([(r["p50"] - r["p_ac_kw"]) ** 2 for r in held])
    spread = np.var([r["p_ac_kw"] for r in held])
    assert error < 0.1 * spread  # the trees learn the signal
    # the column expression reaches the same leaves as a plain walk over the stored trees
    rows = split.where("is_valid").join(models, "inverter").select("*", boosting.tree_p50(params).alias("p50")).collect()
    for r in rows:
        x = [r[c] for c in boosting.TREE_FEATURES]
        total = r["base"]
        for t in r["trees"]:
            n = 0
            for _ in range(params.gbt_depth):
                n = 2 * n + 1 + (x[t["feat"][n]] > t["thr"][n])
            total += t["leaf"][n - (1 << params.gbt_depth) + 1]
        assert r["p50"] == pytest.approx(min(max(total, 0.0), r["kwp"]), abs=1e-9)


def test_ledger_run_with_trees(spark):
    from pyspark.sql import functions as F

    from lossledger.plans.driver_tables import tables
    from lossledger.plans.ledger_run import LedgerRun

    d = tables(spark, "/root/testdata/sf0.001")
    base = d.tree_run.interval_base
    assert not {"trees", "base", "p50_physics_kw", "hour_sin"} & set(base.columns)
    assert set(d.run.interval_base.columns) == set(base.columns)
    bad = base.where(~((F.col("p10_twin_kw") <= F.col("p50_twin_kw")) & (F.col("p50_twin_kw") <= F.col("p90_twin_kw")) & (F.col("p90_twin_kw") <= F.col("kwp"))))
    assert bad.count() == 0
    assert d.tree_run.ledger.count() > 0 and d.tree_run.readings is d.run.readings  # shared tables
    with pytest.raises(ValueError):
        LedgerRun(d.inputs, d.run.params, d.staging, learner="forest")


def test_devices_grown_together_equal_each_grown_alone():
    chance = np.random.default_rng(5)
    edges = [np.arange(k, dtype=float) + 0.5 for k in (40, 5, 0)]
    parts = []
    for device in range(30):
        n = int(chance.integers(1, 90))
        x = np.stack([chance.integers(0, len(e) + 1, n) for e in edges], axis=1)
        stop = chance.random(n) < (0.2 if device % 5 else 0.0)
        parts.append((x, x[:, 0] * 0.1 + chance.normal(0, 1.0, n), stop))
    x, y, stop = (np.concatenate([p[k] for p in parts]) for k in range(3))
    owner = np.repeat(np.arange(30), [len(p[1]) for p in parts])
    base, rounds, *trees = boosting.grow_fleet(x, y, stop, owner, 30, edges, SMALL)
    for i, part in enumerate(parts):
        alone = boosting.grow(*part, edges, SMALL)
        assert (base[i], rounds[i]) == (alone[0], alone[2])
        for k, name in enumerate(("feat", "thr", "leaf")):
            assert trees[k][i].tolist() == [t[name] for t in alone[1]]


def test_tasks_of_many_devices_and_replay_over_batches(spark, split, monkeypatch):
    from pyspark.sql import functions as F

    params = Params(gbt_iterations=10, gbt_min_instances=10)
    devices = spark.range(12).select(F.format_string("D%02d", "id").alias("device"))
    many = split.crossJoin(devices).withColumn("inverter", F.concat("inverter", "device")).drop("device")
    alone = {r["inverter"]: r for r in boosting.fit_devices(split, params).collect()}
    monkeypatch.setattr(boosting, "TOGETHER", 700)  # a device goes on over the end of a batch
    fitted = spark.createDataFrame(boosting.fit_devices(many, params).collect(), boosting.MODEL)
    rows = {r["inverter"]: r for r in fitted.collect()}
    assert len(rows) == 24
    for r in rows.values():  # other stop rows (the hash holds the name), the same base and learning
        assert r["trees_kept"] >= 1 and r["base"] == pytest.approx(alone[r["inverter"][0]]["base"], rel=0.2)
    # the replay gives null without trees, infinity as a value, a null feature to the left
    odd = many.where("is_valid and hour(ts) < 3").withColumn("altitude_deg", F.when(F.hour("ts") == 1, F.col("altitude_deg")))
    some = fitted.where("inverter <> 'AD00'")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = boosting.with_trees(odd, some, params).select("ts", "inverter", "p50").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = odd.join(some, "inverter", "left").select("ts", "inverter", boosting.tree_p50(params).alias("p50"))
    want = {(r["ts"], r["inverter"]): r["p50"] for r in plain.collect()}
    assert len(got) == len(want) and {r["inverter"] for r in got if r["p50"] is None} == {"AD00"}
    for r in got:
        assert r["p50"] == want[r["ts"], r["inverter"]]
    plan = boosting.with_trees(odd, some, params)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan  # trees are not repeated on every row


def test_pooled_trees_stop_as_after_all_rounds(spark, monkeypatch):
    """Growing in stages keeps the very trees of a fit of all rounds, and never grows all where it need not."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from lossledger.operators import twin

    columns = [F.rand(seed).alias(name) for seed, name in enumerate(twin.FEATURES)]
    rows = spark.range(0, 600, 1, 3).select(
        (F.lit("2017-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id"))).alias("ts"),
        F.lit("a").alias("inverter"), *columns, F.rand(91).alias("p50_physics_kw"), F.lit(0.9).alias("eta_system"), F.lit(2.0).alias("kwp"),
        (F.rand(92) + 0.4 * F.rand(0)).alias("p_ac_kw"), F.lit(True).alias("is_fit"),
    )
    split = rows.persist()
    fit, asked = GBTRegressor._fit, []
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, rows: asked.append(self.getMaxIter()) or fit(self, rows))
    params = Params(gbt_iterations=30, gbt_depth=2, gbt_min_instances=5, gbt_patience=2, gbt_validation_share=0.3)
    model = twin.fit_gbt(split, params)
    kept = model.stages[-1]
    assert asked[0] == 4 and sum(asked) < 30
    ready = VectorAssembler(inputCols=[*twin.FEATURES, "p50_physics_kw", "eta_system", "kwp"], outputCol="features").transform(split)
    ready = ready.withColumn("label", F.col("p_ac_kw") / F.col("kwp")).withColumn(
        "held", F.pmod(F.xxhash64("ts", "inverter", F.lit(params.seed)), F.lit(1000)) < 300
    )
    whole = GBTRegressor(maxIter=30, stepSize=params.gbt_step, maxDepth=2, minInstancesPerNode=5, maxBins=params.gbt_bins, seed=params.seed)
    whole = whole.fit(ready.where("not held").select("features", "label"))
    rounds = twin.best_rounds(whole.evaluateEachIteration(ready.where("held").select("features", "label"), "squared"), 2)
    body = lambda tree: tree.toDebugString.split("\n", 1)[1]  # noqa: E731 - after the line that holds the uid
    assert kept.getNumTrees == rounds and [body(t) for t in kept.trees] == [body(t) for t in whole.trees[:rounds]]
    assert kept.treeWeights == whole.treeWeights[:rounds]
    total = sum(w * t.predict(ready.first()["features"]) for w, t in zip(kept.treeWeights, kept.trees))
    assert np.isclose(model.transform(split).first()["prediction"], total)
