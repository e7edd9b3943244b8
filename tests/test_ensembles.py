"""Nested forests and leaf-wise boosting against brute-force split searches."""

import json
import uuid
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_models import FEATURES, synthetic
from voltpanel.operators import boosting, forest, splits
from voltpanel.session import stored
from voltpanel.sinks import models as artefacts


@pytest.fixture(scope="module")
def train(spark):
    rows = pd.concat([synthetic("p", 1), synthetic("q", 2)])
    return splits.expanding_blocks(spark.createDataFrame(rows)).cache()


def brute_tree(x, y, w, depth, min_leaf):
    """Predictions on x of the tree grown by trying every split of every node."""
    out, mean = np.zeros(len(y)), np.average(y, weights=w)
    best = (1e-9, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for limit in (values[:-1] + values[1:]) / 2:
                right = x[:, f] > limit
                if min(right.sum(), (~right).sum()) < min_leaf:
                    continue
                gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (right, ~right)) - (w * y).sum() ** 2 / w.sum()
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, right)
    if best[1] is None:
        return np.full(len(y), mean)
    for side in (best[1], ~best[1]):
        out[side] = brute_tree(x[side], y[side], w[side], depth - 1, min_leaf)
    return out


@pytest.mark.parametrize("min_leaf", [1, 2, 5])
def test_trees_equal_brute_force_at_every_depth(min_leaf):
    rng = np.random.default_rng(min_leaf)
    x = np.round(rng.normal(size=(60, 4)), 1)  # ties
    x[:, 3] = x[:, 3] > 0
    y = x[:, 0] * 3 + np.abs(x[:, 1]) + rng.normal(size=60)
    codes, values = forest.ranked(x)
    counts = forest.drawn(60, 3, rng)
    grown = forest.grow(codes, values, y, counts, 30, min_leaf, "all", rng)
    cut = grown.predictions(codes, [0, 1, 3, 30])
    for i, depth in enumerate([0, 1, 3, 30]):
        for tree in range(3):
            used = counts[tree] > 0
            want = brute_tree(x[used], y[used], counts[tree][used].astype(float), depth, min_leaf)
            assert np.allclose(cut[i, tree][used], want)


def test_smaller_forests_are_inside_larger_ones(train):
    """A point read out of a large fit equals a fit of its own trees and depth."""
    grid = {"numTrees": [25, 50], "maxDepth": [2, 9], "minInstancesPerNode": [2], "featureSubsetStrategy": ["sqrt", "all"]}
    whole = {tuple(r)[:6]: r.mae for r in forest.nested_search(train, FEATURES, grid).collect()}
    assert len(whole) == 2 * 5 * 8
    alone = forest.nested_search(train, FEATURES, grid | {"numTrees": [25]}).collect()
    assert all(r.mae == pytest.approx(whole[tuple(r)[:6]]) for r in alone) and len(alone) == 40
    points = forest.by_point(forest.nested_search(train, FEATURES, grid)).cache()
    assert points.count() == 2 * 8 and points.filter("folds_used <> 5").count() == 0
    best = {r.zone: r.cv_mae for r in forest.winners(points).collect()}
    assert best == {r.zone: r.m for r in points.groupBy("zone").agg(F.min("cv_mae").alias("m")).collect()}
    spread = train.agg(F.mean(F.abs(F.col("target") - F.lit(-190.0)))).first()[0]
    assert max(best.values()) < spread


def test_forest_table_predicts_what_the_forest_does(spark, train, tmp_path):
    chosen = spark.createDataFrame([("p", 30, 9, 1, "0.5"), ("q", 26, 3, 5, "all")], "zone string, num_trees int, max_depth int, min_leaf int, share string")
    known = train.filter("block < 5")
    trees = forest.fit_forests(known, chosen, FEATURES).cache()
    assert {r.zone: r["count"] for r in trees.groupBy("zone").count().collect()} == {"p": 30, "q": 26}
    asked = train.unionByName(train.filter("zone = 'p'").withColumn("zone", F.lit("unknown")))
    got = forest.predict_rows(trees, asked.select("zone", "period", *FEATURES), FEATURES, ["zone", "period"]).toPandas()
    assert got[got.zone == "unknown"].predicted_demand.isna().all() and (got.zone == "unknown").sum() == 131
    part = known.filter("zone = 'q'").toPandas().sort_values("period")
    x, y = part[FEATURES].to_numpy(), part["target"].to_numpy()
    want = np.concatenate([e.predictions(e.codes, [30])[0] for e in forest.chunks(x, y, 26, 3, 5, "all", zlib.crc32(b"q"))]).mean(axis=0)
    ours = got[got.zone == "q"].set_index("period").loc[part["period"], "predicted_demand"]
    assert np.allclose(ours, want)
    weights = forest.importance(trees, FEATURES).collect()
    assert len(weights) == 8 and weights[0].importance == max(r.importance for r in weights if r.zone == "p")
    assert sum(r.importance for r in weights) == pytest.approx(2)
    artefacts.save_model(spark, trees, str(tmp_path / "m"), FEATURES, {}, {}, 1, "a", "b", forest.importance(trees, FEATURES))
    again = forest.predict_forests(artefacts.load_trees(spark, str(tmp_path / "m")), asked, FEATURES, ["zone", "period"])
    assert again.count() == len(got)
    with pytest.raises(ValueError, match="feature mismatch"):
        forest.predict_rows(trees, asked.select("zone", "period", *FEATURES[::-1]), FEATURES, ["zone", "period"])


def brute_boosted(x, y, cuts, point):
    """Leaf-wise boosting by trying every cut of every leaf with plain sums."""
    worth = lambda e: max(abs(e.sum()) - point.l1, 0) ** 2 / (len(e) + point.l2)
    predicted = np.full(len(y), y.mean())
    for _ in range(point.rounds):
        error, leaf, depth = predicted - y, np.zeros(len(y), int), {0: 0}
        while len(depth) < point.most_leaves():
            best = (1e-6, None)
            for k, d in depth.items():
                if 0 <= point.max_depth <= d:
                    continue
                own = leaf == k
                for f, limits in enumerate(cuts):
                    for limit in limits:
                        right = own & (x[:, f] > limit)
                        left = own & ~right
                        if min(right.sum(), left.sum()) >= max(1, point.min_rows):
                            gain = worth(error[left]) + worth(error[right]) - worth(error[own])
                            if gain > best[0] * (1 + 1e-6):
                                best = (gain, (k, right))
            if best[1] is None:
                break
            k, right = best[1]
            depth[len(depth)] = depth[k] = depth[k] + 1
            leaf[right] = len(depth) - 1
        for k in depth:
            e = error[leaf == k]
            predicted[leaf == k] -= point.rate * np.sign(e.sum()) * max(abs(e.sum()) - point.l1, 0) / (len(e) + point.l2)
    return predicted


@pytest.mark.parametrize(
    "point",
    [
        boosting.Point(rounds=4, rate=0.3, leaves=6, min_rows=3),
        boosting.Point(rounds=4, rate=0.3, leaves=9, max_depth=3, min_rows=2, l1=1.5, l2=2.0),
        boosting.Point(rounds=3, rate=0.5, leaves=None, max_depth=2, min_rows=1),
    ],
)
def test_boosting_equals_brute_force(point):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 3))
    y = 3 * x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=90)
    cuts = boosting.edges(x)
    other = boosting.Point(rounds=9, rate=0.1, leaves=4, min_rows=7)
    fits = boosting.Fits(boosting.binned(x, cuts), y, np.ones((2, 90), bool), [point, other], 1)
    for _ in range(point.rounds):
        fits.grow()
    assert all(len(c) < boosting.BINS for c in cuts)
    assert np.allclose(fits.predicted[0], brute_boosted(x, y, cuts, point), atol=1e-3)


def test_staged_search_reads_every_number_of_rounds(train):
    points = [boosting.Point(rounds=n, rate=r, leaves=5, min_rows=5) for r in (0.1, 0.3) for n in (3, 8)]
    assert [rounds for _, rounds in boosting.nested(points)] == [[3, 8], [3, 8]]
    errors = boosting.staged_search(train, FEATURES, points).cache()
    assert errors.count() == 2 * 5 * 4
    scores = boosting.search_points(errors)
    best = boosting.winners(scores, points).collect()
    least = {r.zone: r.m for r in scores.groupBy("zone").agg(F.min("cv_mae").alias("m")).collect()}
    assert {r.zone: r.cv_mae for r in best} == least and all(boosting.Point(**json.loads(r.params)) == points[r.point] for r in best)


def test_boosted_table_predicts_what_the_fit_does(spark, train):
    point = boosting.Point(rounds=6, rate=0.3, leaves=7, min_rows=4, l2=0.5)
    chosen = spark.createDataFrame([("p", point.text())], "zone string, params string")
    trees = boosting.fit_boosted(train, chosen, FEATURES).cache()
    assert trees.count() == 7
    got = boosting.predict_boosted(trees, train, FEATURES, ["zone", "period"]).toPandas()
    part = train.filter("zone = 'p'").toPandas().sort_values("period")
    x, y = part[FEATURES].to_numpy(), part["target"].to_numpy()
    want = brute_boosted(x, y, boosting.edges(x), point)
    assert np.allclose(got[got.zone == "p"].sort_values("period")["predicted_demand"], want, atol=1e-3)
    assert got[got.zone == "q"].predicted_demand.isna().all()
    gains = boosting.gain_importance(trees, FEATURES).collect()
    assert len(gains) == 4 and gains[0].importance >= gains[-1].importance >= 0


def test_early_stop(spark, train):
    curve = [("z", r, 0.0, e) for r, e in enumerate([5.0, 4.0, 3.0, 3.5, 3.4, 2.0, 2.5], 1)]
    frame = spark.createDataFrame(curve, "zone string, rounds int, mae double, rmse double")
    assert tuple(boosting.early_stop(frame, 2).first()) == ("z", 5, 3, 3.0)
    assert tuple(boosting.early_stop(frame, 3).first()) == ("z", 7, 6, 2.0)
    noise = train.withColumn("target", F.rand(1))
    point = boosting.Point(rounds=40, leaves=4, min_rows=5)
    whole = boosting.learning_curve(noise.filter("block < 4"), noise.filter("block >= 4"), FEATURES, point)
    short = boosting.learning_curve(noise.filter("block < 4"), noise.filter("block >= 4"), FEATURES, point, patience=3)
    stopped = lambda c: sorted(map(tuple, boosting.early_stop(c, 3).collect()))
    assert whole.count() == 80 and stopped(whole) == stopped(short) and all(r[1] < 40 for r in stopped(short))


def test_stored_tables_are_kept_per_content(spark):
    rows, made = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a int, b double"), []

    def build(r):
        made.append(r)
        return r.groupBy().sum("b")

    label = f"kept-{uuid.uuid4().hex}"
    assert stored(rows, label, build).first()[0] == stored(rows.orderBy(F.desc("a")), label, build).first()[0] == 5.0
    assert len(made) == 1
    assert stored(rows.filter("a = 1"), label, build).first()[0] == 2.0 and len(made) == 2
