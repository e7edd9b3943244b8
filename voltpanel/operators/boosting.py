"""Leaf-wise histogram boosting per zone: staged errors, L1/L2, early stopping.

Features are binned once. A tree grows by splitting, again and again, the leaf with the
greatest gain, until it has its number of leaves (or, without such a limit, all leaves that gain); a leaf's histograms are its parent's minus
its sibling's. Many fits of one zone (points of a search, folds) grow side by side, one split
of each at a time, so the work is done on whole arrays.

The error after every round is kept, so one fit answers every smaller number of rounds of its
point and says where early stopping ends. Spark deals the work out as (zone, points); a zone
has at most one row per day, which bounds a task. A fitted model is a table, one row per tree.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 32
SEED = 42
N_FOLDS = 5
#: Points whose fits grow side by side in a task.
POINTS_AT_ONCE = 15

#: Times this matrix, a row of bins becomes its running sums.
UP_TO = np.triu(np.ones((BINS, BINS), np.float32))

STAGES = "zone string, point int, fold int, rounds int, mae double, rmse double"
TREES = "zone string, tree int, leaf array<int>, feature array<int>, threshold array<double>, gain array<double>, value array<double>"


# The leaf-wise learner's searched grid; -1 leaves the depth open.
LEAF_GRID = {
    "rounds": [300, 500, 800],
    "rate": [0.01, 0.03, 0.05, 0.1],
    "leaves": [15, 31, 63, 127],
    "max_depth": [-1, 4, 6, 8],
    "min_rows": [5, 10, 20, 30],
    "row_share": [0.7, 0.8, 1.0],
    "column_share": [0.7, 0.8, 1.0],
    "l1": [0.0, 0.1, 0.5],
    "l2": [0.0, 0.1, 0.5],
}


@dataclass(frozen=True)
class Point:
    """What a fit is made of; ``leaves`` None and ``max_depth`` -1 mean no limit."""

    rounds: int = 100
    rate: float = 0.1
    leaves: int | None = 31
    max_depth: int = -1
    min_rows: int = 20
    row_share: float = 1.0
    column_share: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0

    def most_leaves(self) -> int:
        by_depth = 1 << self.max_depth if 0 <= self.max_depth < 16 else 1 << 16
        return min(self.leaves or 1 << 16, by_depth)

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def depth_points(points: list[dict]) -> list[Point]:
    """Search points of depth-limited boosting (see ``trees``) as points here, leaves open."""
    names = {
        "maxIter": "rounds", "stepSize": "rate", "maxDepth": "max_depth", "minInstancesPerNode": "min_rows",
        "minInfoGain": "min_gain", "subsamplingRate": "row_share", "featureSubsetStrategy": "column_share",
    }
    read = lambda k, v: (1.0 if v == "all" else float(v)) if k == "featureSubsetStrategy" else v
    return [Point(**{"leaves": None, "min_rows": 1, **{names[k]: read(k, v) for k, v in p.items()}}) for p in points]


def leaf_points(points: list[dict]) -> list[Point]:
    return [Point(**p) for p in points]


def edges(x: np.ndarray) -> list[np.ndarray]:
    """Cut points of every feature: half-way between neighbouring values at even shares of the rows."""
    out = []
    for f in range(x.shape[1]):
        values, counts = np.unique(x[:, f], return_counts=True)
        share = np.cumsum(counts)[:-1] * BINS // len(x)
        last = np.flatnonzero(np.diff(share, prepend=0))
        if len(values) <= BINS:
            last = np.arange(len(values) - 1)
        out.append((values[last] + values[last + 1]) / 2 if len(last) else np.empty(0))
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)


class Fits:
    """Fits over the rows of one zone; ``train`` (fit, row) says which rows each learns from."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, train: np.ndarray, points: list[Point], seed: int):
        self.codes, self.y, self.train, self.points = codes, y, train, points
        self.rng, (self.n_rows, self.n_features) = np.random.default_rng([SEED, seed]), codes.shape
        column = lambda name: np.array([getattr(p, name) for p in points], float)
        self.rate, self.min_rows, self.l1, self.l2 = map(column, ("rate", "min_rows", "l1", "l2"))
        self.min_gain, self.row_share, self.column_share = map(column, ("min_gain", "row_share", "column_share"))
        self.max_depth = np.array([p.max_depth if p.max_depth >= 0 else 1 << 30 for p in points])
        self.leaves = np.array([p.most_leaves() for p in points])
        self.free = np.array([[p.leaves is None] for p in points])
        self.base = (train * y).sum(axis=1) / train.sum(axis=1)
        self.predicted = np.repeat(self.base[:, None], self.n_rows, axis=1)
        self.scale = max(1e-9, float(np.abs(y - y.mean()).mean()))  # sums stay small enough for single precision
        self.cells = codes + np.arange(self.n_features) * BINS
        self.l1, self.l2 = (a.astype(np.float32)[:, None, None] for a in (self.l1 / self.scale, self.l2))
        self.least, self.min_gain = np.maximum(self.min_rows, 1).astype(np.float32)[:, None, None], self.min_gain / self.scale**2

    def _histograms(self, fit: np.ndarray, row: np.ndarray, n: int, error: np.ndarray) -> np.ndarray:
        """(n, 2, feature, bin): sums of errors and counts of the items."""
        cells = self.n_features * BINS
        key = (fit[:, None] * cells + self.cells[row]).ravel()
        out = np.empty((n, 2, cells), np.float32)
        out[:, 0] = np.bincount(key, np.repeat(error, self.n_features), n * cells).reshape(n, cells)
        out[:, 1] = np.bincount(key, minlength=n * cells).reshape(n, cells)
        return out.reshape(n, 2, self.n_features, BINS)

    def _worth(self, s: np.ndarray, n: np.ndarray, fit: np.ndarray) -> np.ndarray:
        """What a leaf with this sum and count takes off the error, on arrays that are used up."""
        if self.l1.any():
            np.abs(s, out=s)
            s -= self.l1[fit]
            np.maximum(s, 0, out=s)
        n += self.l2[fit]
        np.maximum(n, 1e-6, out=n)
        s *= s
        s /= n
        return s

    def _best(self, held: np.ndarray, fit: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gain, feature and cut of the best split of each histogram; ``fit`` owns it."""
        left = held @ UP_TO
        whole = left[:, :, :1, -1:]
        right = whole - left
        least = self.least[fit]
        bad = (left[:, 1] < least) | (right[:, 1] < least) | ~columns[fit][:, :, None]
        own = self._worth(whole[:, 0].copy(), whole[:, 1].copy(), fit)
        gain = self._worth(left[:, 0], left[:, 1], fit)
        gain += self._worth(right[:, 0], right[:, 1], fit)
        gain[bad] = -np.inf
        flat = gain.reshape(len(fit), -1)
        at = flat.argmax(axis=1)
        best = flat[np.arange(len(fit)), at] - own[:, 0, 0]
        return np.where(best > np.maximum(self.min_gain[fit], 1e-6), best, -np.inf), at // BINS, at % BINS

    def grow(self) -> list[tuple[np.ndarray, ...]]:
        """One more tree for every fit; gives per split the fits, leaves, features, cuts and gains."""
        n = len(self.points)
        error = (self.predicted - self.y) / self.scale
        bag = self.train & (self.rng.random(self.train.shape) < self.row_share[:, None])
        columns = np.ones((n, self.n_features), bool)
        if (self.column_share < 1).any():
            take = np.maximum(1, (self.column_share * self.n_features).astype(int))
            place = self.rng.random((n, self.n_features)).argsort(axis=1).argsort(axis=1)
            columns = place < take[:, None]
        most = int(self.leaves.max())
        leaf = np.zeros((n, self.n_rows), np.int32)
        room = min(most, 64)
        held = np.zeros((n, room, 2, self.n_features, BINS), np.float32)
        gain, feature, cut = np.full((n, room), -np.inf), np.zeros((n, room), int), np.zeros((n, room), int)
        depth, every = np.zeros((n, room), int), np.arange(n)
        fit, row = bag.nonzero()
        held[:, 0] = self._histograms(fit, row, n, error[fit, row])
        gain[:, 0], feature[:, 0], cut[:, 0] = self._best(held[:, 0], every, columns)
        splits, used = [], np.ones(n, int)
        while True:
            # Without a limit on leaves every good split is made in the end, so all are made at
            # once; with one it is the leaf with the greatest gain, one after another.
            good = (gain > -np.inf) & (self.free | (gain == gain.max(axis=1, keepdims=True)))
            good[used >= self.leaves] = False
            fit, old = good.nonzero()
            first = np.concatenate([[True], fit[1:] != fit[:-1]]) if len(fit) else np.empty(0, bool)
            lead = self.free[fit, 0] | first  # of equal gains the first leaf
            fit, old, first = fit[lead], old[lead], first[lead]
            if not len(fit):
                break
            new = used[fit] + np.arange(len(fit)) - np.maximum.accumulate(np.where(first, np.arange(len(fit)), 0))
            used += np.bincount(fit, minlength=n)
            if used.max() > room:  # larger trees than expected
                more = min(most, max(2 * room, int(used.max()))) - room
                grown = lambda a, fill: np.concatenate([a, np.full((n, more), fill, a.dtype)], axis=1)
                held = np.concatenate([held, np.zeros((n, more, 2, self.n_features, BINS), np.float32)], axis=1)
                gain, feature, cut, depth, room = grown(gain, -np.inf), grown(feature, 0), grown(cut, 0), grown(depth, 0), room + more
            f, c = feature[fit, old], cut[fit, old]
            splits.append((fit, old, f, c, gain[fit, old]))
            pair = np.full((n, room), -1)
            pair[fit, old] = np.arange(len(fit))
            which = pair[every[:, None], leaf]
            at, row = (which >= 0).nonzero()
            which = which[at, row]
            right = self.codes[row, f[which]] > c[which]
            leaf[at[right], row[right]] = new[which[right]]
            depth[fit, new] = depth[fit, old] = depth[fit, old] + 1
            gain[fit, old] = -np.inf
            # Only children that may be split again are counted.
            k, count = np.arange(len(fit)), held[fit, old, 1, f]
            total, lefts = count.sum(axis=1), (count @ UP_TO)[k, c]
            may = (used < self.leaves)[fit] & (depth[fit, old] < self.max_depth[fit])
            may &= np.maximum(lefts, total - lefts) >= 2 * self.least[fit, 0, 0]
            # The smaller side is counted; the other is what remains of the parent.
            smaller_right = 2 * lefts > total
            counted = may[which] & (right == smaller_right[which]) & bag[at, row]
            order, which, at, row = np.cumsum(may) - 1, which[counted], at[counted], row[counted]
            owner, old, new, smaller_right = fit[may], old[may], new[may], smaller_right[may]
            if not len(owner):
                continue
            small = self._histograms(order[which], row, len(owner), error[at, row])
            k, both = np.arange(len(owner)), np.empty((2 * len(owner), *small.shape[1:]), np.float32)
            both[k + len(owner) * smaller_right] = small
            both[k + len(owner) * ~smaller_right] = held[owner, old] - small
            held[owner, old], held[owner, new] = both[: len(owner)], both[len(owner) :]
            found = self._best(both, np.concatenate([owner, owner]), columns)
            for values, part in zip((gain, feature, cut), found):
                values[owner, old], values[owner, new] = part[: len(owner)], part[len(owner) :]
        fit, row = bag.nonzero()
        place = fit * most + leaf[fit, row]
        total = np.bincount(place, error[fit, row], n * most).reshape(n, most)
        count = np.bincount(place, minlength=n * most).reshape(n, most)
        l1, l2 = self.l1[:, :, 0], self.l2[:, :, 0]
        self.value = -self.rate[:, None] * np.sign(total) * np.maximum(np.abs(total) - l1, 0) * self.scale
        self.value /= np.maximum(count + l2, 1e-6)
        self.predicted += self.value[every[:, None], leaf]
        return splits


def _arrays(part: pd.DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    return part[features].to_numpy(dtype=float), part[target].to_numpy(dtype=float)


def nested(points: list[Point]) -> list[tuple[Point, list[int]]]:
    """Points that differ in rounds only, as one fit with the rounds to read out of it."""
    rounds: dict[Point, list[int]] = {}
    for p in points:
        rounds.setdefault(replace(p, rounds=0), []).append(p.rounds)
    return [(replace(p, rounds=max(n)), sorted(set(n))) for p, n in rounds.items()]


def stages(part: pd.DataFrame, features: list[str], target: str, fits: list[tuple[int, Point, list[int]]], fold: int, learn: np.ndarray, judge: np.ndarray, patience: int | None = None):
    """Rows of STAGES of one zone and fold: each fit learns from some rows, which alone set the
    bins, and is judged on others. With ``patience`` growing ends once no fit has improved on
    its best for so many rounds."""
    if not learn.any() or not judge.any():
        return
    x, y = _arrays(part, features, target)
    zone, rows, points = part["zone"].iloc[0], learn | judge, [p for _, p, _ in fits]
    codes = binned(x[rows], edges(x[learn]))
    run = Fits(codes, y[rows], np.repeat(learn[rows][None], len(points), axis=0), points, zlib.crc32(f"{zone} {fold}".encode()))
    judged, told = judge[rows], y[judge]
    best = [(float("inf"), 0)] * len(points)
    for done in range(1, max(p.rounds for p in points) + 1):
        run.grow()
        for i, (number, _, rounds) in enumerate(fits):
            if done in rounds:
                error = run.predicted[i, judged] - told
                rmse = float(np.sqrt((error**2).mean()))
                best[i] = min(best[i], (rmse, done))
                yield zone, number, fold, done, float(np.abs(error).mean()), rmse
        if patience and all(done - at >= patience for _, at in best):
            return


# --- the DataFrame operators -------------------------------------------------------------


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """Every row once per group of points, a task for each zone and group."""
    zones = max(1, rows.select("zone").distinct().count())
    dealt = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.repartition(min(4096, n * zones), "zone", "_group")


def staged_search(train: DataFrame, features: list[str], points: list[Point], target: str = "target", n_folds: int = N_FOLDS) -> DataFrame:
    """zone, point (its place in ``points``), fold, rounds, mae and rmse.

    ``train`` carries ``block`` (see ``expanding_blocks``).
    """
    alone = nested(points)
    numbered = [(n, p, rounds) for n, (p, rounds) in enumerate(sorted(alone, key=lambda a: (a[0].rounds, a[0].most_leaves())))]
    groups = [numbered[i : i + POINTS_AT_ONCE] for i in range(0, len(numbered), POINTS_AT_ONCE)]
    tasks = [(fold, some) for some in reversed(groups) for fold in range(n_folds, 0, -1)]  # the largest first

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, (fold, some) = part.sort_values("period"), tasks[int(key[1])]
        block = part["block"].to_numpy()
        out = list(stages(part, features, target, some, fold, block < fold, block == fold))
        return pd.DataFrame(out, columns=["zone", "point", "fold", "rounds", "mae", "rmse"])

    rows = _spread(train.select("zone", "period", "block", target, *features), len(tasks))
    read = rows.groupBy("zone", "_group").applyInPandas(run, STAGES)
    # Back from fits to points: the same fit answers every number of rounds asked for.
    places = [
        (n, p.rounds, places)
        for n, fit, _ in numbered
        for places, p in enumerate(points)
        if replace(p, rounds=fit.rounds) == fit
    ]
    names = train.sparkSession.createDataFrame(places, "point int, rounds int, place int")
    told = read.join(F.broadcast(names), ["point", "rounds"])
    return told.select("zone", F.col("place").alias("point"), "fold", "rounds", "mae", "rmse")


def search_points(errors: DataFrame) -> DataFrame:
    """Per zone and point the mean of the folds' MAE and their number."""
    return errors.groupBy("zone", "point").agg(F.avg("mae").alias("cv_mae"), F.count("mae").cast("int").alias("folds_used"))


def winners(scores: DataFrame, points: list[Point]) -> DataFrame:
    """Per zone the point with the least error, written as JSON; ties go to the first."""
    best = scores.groupBy("zone").agg(F.min(F.struct("cv_mae", "point")).alias("_b"))
    texts = F.array(*[F.lit(p.text()) for p in points])
    return best.select("zone", F.col("_b.point").alias("point"), F.col("_b.cv_mae").alias("cv_mae"), texts[F.col("_b.point")].alias("params"))


def learning_curve(train: DataFrame, val: DataFrame, features: list[str], point: Point, target: str = "target", patience: int | None = None) -> DataFrame:
    """zone, rounds, mae and rmse on the validation rows after every round of one fit, which
    ends early if ``patience`` rounds bring nothing."""
    rows = train.select("zone", "period", target, *features).withColumn("_learn", F.lit(True))
    rows = rows.unionByName(val.select("zone", "period", target, *features).withColumn("_learn", F.lit(False)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("period")
        learn = part["_learn"].to_numpy()
        fits = [(0, point, range(1, point.rounds + 1))]
        out = [(z, r, mae, rmse) for z, _, _, r, mae, rmse in stages(part, features, target, fits, 0, learn, ~learn, patience)]
        return pd.DataFrame(out, columns=["zone", "rounds", "mae", "rmse"])

    return _spread(rows, 1).groupBy("zone", "_group").applyInPandas(run, "zone string, rounds int, mae double, rmse double")


def early_stop(curve: DataFrame, patience: int = 30) -> DataFrame:
    """zone, stopped (the last round that is run), best_rounds and best_rmse: a fit ends once
    ``patience`` rounds in a row have not improved on the best so far."""
    order = Window.partitionBy("zone").orderBy("rounds")
    best = F.min(F.struct("rmse", "rounds")).over(order)
    run = curve.withColumn("_best", best).withColumn("_idle", F.col("rounds") - F.col("_best.rounds"))
    ends = run.groupBy("zone").agg(F.coalesce(F.min(F.when(F.col("_idle") >= patience, F.col("rounds"))), F.max("rounds")).alias("stopped"))
    there = run.join(ends, "zone").filter(F.col("rounds") == F.col("stopped"))
    return there.select("zone", "stopped", F.col("_best.rounds").alias("best_rounds"), F.col("_best.rmse").alias("best_rmse"))


def fit_boosted(rows: DataFrame, chosen: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Each zone's trees at its chosen params, grown on all its rows; tree 0 is the mean.

    A tree is its splits in order: the rows of ``leaf`` beyond ``threshold`` move to a new leaf.
    """
    ready = rows.select("zone", "period", target, *features)

    def run(part: pd.DataFrame, point: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(part) and len(point):
            zone, p = part["zone"].iloc[0], Point(**json.loads(point["params"].iloc[0]))
            x, y = _arrays(part.sort_values("period"), features, target)
            cuts = edges(x)
            fit = Fits(binned(x, cuts), y, np.ones((1, len(y)), bool), [p], zlib.crc32(zone.encode()))
            out.append((zone, 0, [], [], [], [], [float(fit.base[0])]))
            for tree in range(1, p.rounds + 1):
                splits = [tuple(map(float, one)) for _, *columns in fit.grow() for one in zip(*columns)]
                leaf, feature, cut, gain = zip(*splits) if splits else ((),) * 4
                feature = [int(f) for f in feature]
                limit = [float(cuts[f][int(c)]) for f, c in zip(feature, cut)]
                out.append((zone, tree, [int(x) for x in leaf], feature, limit, list(gain), fit.value[0, : len(splits) + 1].tolist()))
        return pd.DataFrame(out, columns=["zone", "tree", "leaf", "feature", "threshold", "gain", "value"])

    return ready.groupBy("zone").cogroup(chosen.groupBy("zone")).applyInPandas(run, TREES)


def predict_boosted(trees: DataFrame, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """``keys`` (the zone first) and predicted_demand; null where the zone has no trees."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", predicted_demand double"

    def run(model: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        x = part[features].to_numpy(dtype=float)
        total = np.zeros(len(part))
        for tree in model.itertuples():
            leaf = np.zeros(len(part), int)
            for new, (old, f, limit) in enumerate(zip(tree.leaf, tree.feature, tree.threshold), 1):
                leaf[(leaf == old) & (x[:, f] > limit)] = new
            total += np.asarray(tree.value)[leaf]
        out = part[keys].copy()
        out["predicted_demand"] = total if len(model) else None
        return out

    return trees.groupBy("zone").cogroup(rows.select(*keys, *features).groupBy(keys[0])).applyInPandas(run, schema)


def gain_importance(trees: DataFrame, features: list[str]) -> DataFrame:
    """zone, feature, importance: the gain of all splits on the feature; the greatest first."""
    names = F.array(*map(F.lit, features))
    nodes = trees.select("zone", F.inline(F.arrays_zip("feature", "gain")))
    every = trees.select("zone").distinct().select("zone", F.posexplode(names).alias("feature", "name"))
    summed = nodes.groupBy("zone", "feature").agg(F.sum("gain").alias("gain"))
    told = every.join(summed, ["zone", "feature"], "left")
    told = told.select("zone", F.col("name").alias("feature"), F.coalesce("gain", F.lit(0.0)).alias("importance"))
    return told.orderBy("zone", F.desc("importance"), "feature")
