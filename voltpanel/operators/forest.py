"""Regression forests per zone, with a whole search grid read out of few fits.

A forest holds the smaller forests of its grid: its first 100 trees are a forest of 100, and
a tree that stops at depth 5 is the same tree cut there (every node keeps its mean). So one
fit per leaf size and feature share, at the most trees and the greatest depth, answers all
other points, fold by fold.

Spark deals the work out as (zone, fit); a zone has at most one row per day, so a task's rows
are bounded by the calendar. Inside a task many trees grow together, one level at a time.
A fitted forest is a table with one row per tree.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpanel.operators.validate import require_columns, require_feature_order

N_FOLDS = 5
SEED = 42
#: Trees that grow together in one task; bounds its memory.
TREES_AT_ONCE = 25
#: Items (row and feature) whose splits are weighed in one pass.
ITEMS_AT_ONCE = 1 << 16

POINT = "num_trees int, max_depth int, min_leaf int, share string"
FIT_SCHEMA = f"zone string, {POINT}, fold int, mae double"
TREES = "zone string, tree int, feature array<int>, threshold array<double>, left array<int>, value array<double>, gain array<double>"


def features_per_node(share: str, n: int) -> int:
    """How many of ``n`` features a node may choose from."""
    if share == "all":
        return n
    return max(1, int(np.sqrt(n)) if share == "sqrt" else int(float(share) * n))


class Ensemble:
    """Trees in flat arrays: node ids run over all trees, the right child follows the left."""

    def __init__(self, n_trees: int, codes: np.ndarray, values: list[np.ndarray]):
        self.roots, self.codes, self.values = np.arange(n_trees), codes, values
        self.feature, self.cut, self.left = (np.full(n_trees, -1) for _ in range(3))
        self.mean, self.gain, self.tree = np.zeros(n_trees), np.zeros(n_trees), np.arange(n_trees)

    def extend(self, trees: np.ndarray) -> np.ndarray:
        """Two new nodes per given tree; gives the left ones."""
        first, k = len(self.mean), 2 * len(trees)
        for name in ("feature", "cut", "left"):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(k, -1)]))
        self.mean, self.gain = np.concatenate([self.mean, np.zeros(k)]), np.concatenate([self.gain, np.zeros(k)])
        self.tree = np.concatenate([self.tree, np.repeat(trees, 2)])
        return first + 2 * np.arange(len(trees))

    def predictions(self, codes: np.ndarray, depths: list[int]) -> np.ndarray:
        """(depth, tree, row) means of the nodes where the rows are at each depth."""
        at = np.repeat(self.roots[:, None], len(codes), axis=1)
        rows, out = np.arange(len(codes))[None, :], []
        for depth in range(max(depths) + 1):
            if depth in depths:
                out.append(self.mean[at])
            inner = self.left[at] >= 0
            if not inner.any():
                out += [self.mean[at]] * (len(depths) - len(out))
                break
            right = codes[rows, self.feature[at]] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)
        return np.stack(out)


def ranked(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Every column as places in its sorted distinct values, and these values."""
    both = [np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])]
    return np.stack([inverse for _, inverse in both], axis=1).astype(np.int32), [v for v, _ in both]


class Level:
    """The items (node, row, weight) of one level that may still be split, in node order."""

    def __init__(self, codes, y, node, row, w, n_nodes: int, min_leaf: int):
        self.weight, self.total = np.bincount(node, w, n_nodes), np.bincount(node, w * y[row], n_nodes)
        sizes = np.bincount(node, minlength=n_nodes)
        large = sizes[node] >= max(2, 2 * min_leaf)
        node, row, w = node[large], row[large], w[large]
        order = np.argsort(node, kind="stable")
        self.codes, self.node, self.row, self.w = codes, node[order], row[order], w[order]
        self.wy = self.w * y[self.row]
        self.open = np.unique(self.node)
        self.sizes = sizes[self.open]
        self.starts = np.cumsum(self.sizes) - self.sizes
        ends = self.starts + self.sizes - 1
        # No split so near a node's first or last row that a side has too few rows.
        self.room = np.ones(len(self.node), bool)
        for near in range(max(1, min_leaf)):
            self.room[ends - near] = False
            if near:
                self.room[self.starts + near - 1] = False
        self.all_w, self.all_s = self.weight[self.node], self.total[self.node]

    def sums(self, values: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Running sums along the last axis that begin anew at every node."""
        values[..., self.starts[1:]] -= totals[self.open[:-1]]
        return np.cumsum(values, axis=-1)

    def scores(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a (node, k) choice of features, (k, item) arrays in value order: the score of a
        split after each item, -inf where none may lie, and the codes."""
        code = self.codes[self.row, features[self.node].T]
        order = np.argsort((self.node * (len(self.codes) + 1)).astype(np.int32 if self.small else np.int64) + code, axis=1)
        code = np.take_along_axis(code, order, axis=1)
        lw, ls = self.sums(self.w[order], self.weight), self.sums(self.wy[order], self.total)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = ls * ls / lw
            np.subtract(self.all_s, ls, out=ls)
            np.subtract(self.all_w, lw, out=lw)
            score += ls * ls / lw
        fits = np.zeros(code.shape, bool)
        np.not_equal(code[:, 1:], code[:, :-1], out=fits[:, :-1])
        score[~(fits & self.room)] = -np.inf
        return score, code

    def best(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per node the gain, feature (-1: no split) and cut of its best split."""
        gain, chosen, cut = np.zeros(len(self.weight)), np.full(len(self.weight), -1), np.full(len(self.weight), -1)
        if not len(self.open):
            return gain, chosen, cut
        self.small = len(self.weight) * (len(self.codes) + 1) < 2**31
        top, feature, step = np.full(len(self.open), -np.inf), np.zeros(len(self.weight), int), max(1, ITEMS_AT_ONCE // len(self.node))
        for at in range(0, features.shape[1], step):
            some = features[:, at : at + step]
            by_feature = np.maximum.reduceat(self.scores(some)[0], self.starts, axis=1)
            first = by_feature.argmax(axis=0)
            here = by_feature[first, np.arange(len(first))]
            better = here > top
            top[better] = here[better]
            feature[self.open[better]] = some[self.open[better], first[better]]
        score, code = self.scores(feature[:, None])
        top = np.maximum.reduceat(score[0], self.starts)
        hit = np.flatnonzero((score[0] == np.repeat(top, self.sizes)) & (score[0] > -np.inf))
        own, lead = np.unique(self.node[hit], return_index=True)
        cut[own] = code[0][hit[lead]]
        parent = self.total**2 / self.weight
        gain[self.open] = np.where(top > -np.inf, top, 0) - parent[self.open]
        good = (cut >= 0) & (gain > 1e-9 * (1e-9 + parent))
        return np.where(good, gain, 0.0), np.where(good, feature, -1), cut


def grow(codes: np.ndarray, values: list, y: np.ndarray, counts: np.ndarray, max_depth: int, min_leaf: int, share: str, rng) -> Ensemble:
    """One tree per row of ``counts`` (how often each training row was drawn)."""
    forest = Ensemble(len(counts), codes, values)
    node, row = counts.nonzero()
    w, level = counts[node, row].astype(float), y.mean()
    y = y - level  # small sums keep their digits
    draw, n_features = features_per_node(share, codes.shape[1]), codes.shape[1]
    ids = forest.roots
    for depth in range(max_depth + 1):
        # ``node`` counts the level's nodes; ``ids`` are their places in the forest.
        items = Level(codes, y, node, row, w, len(ids), min_leaf)
        forest.mean[ids] = level + items.total / items.weight
        if depth == max_depth or not len(items.open):
            break
        chosen = np.broadcast_to(np.arange(n_features), (len(ids), n_features))
        if draw < n_features:
            chosen = np.argpartition(rng.random(chosen.shape), draw - 1, axis=1)[:, :draw]
        gain, feature, cut = items.best(chosen)
        split = feature >= 0
        if not split.any():
            break
        lefts = forest.extend(forest.tree[ids[split]])
        here = ids[split]
        forest.feature[here], forest.cut[here], forest.left[here], forest.gain[here] = feature[split], cut[split], lefts, gain[split]
        going = split[node]
        node, row, w = node[going], row[going], w[going]
        right = codes[row, feature[node]] > cut[node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        ids = np.stack([lefts, lefts + 1], axis=1).ravel()
    return forest


def drawn(n_rows: int, n_trees: int, rng) -> np.ndarray:
    """How often each row is in each tree's bootstrap sample."""
    return np.stack([np.bincount(rng.integers(0, n_rows, n_rows), minlength=n_rows) for _ in range(n_trees)])


def chunks(x: np.ndarray, y: np.ndarray, n_trees: int, max_depth: int, min_leaf: int, share: str, seed: int) -> Iterator[Ensemble]:
    codes, values = ranked(x)
    for at in range(0, n_trees, TREES_AT_ONCE):
        rng = np.random.default_rng([SEED, seed, at])
        counts = drawn(len(y), min(TREES_AT_ONCE, n_trees - at), rng)
        yield grow(codes, values, y, counts, max_depth, min_leaf, share, rng)


def _arrays(part: pd.DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    part = part.sort_values("period")
    return part[features].to_numpy(dtype=float), part[target].to_numpy(dtype=float)


def fold_errors(part: pd.DataFrame, features: list[str], target: str, numbers: list[int], depths: list[int], fold: int, min_leaf: int, share: str):
    """Rows of FIT_SCHEMA of one zone and fold: one fit, read at every cut."""
    zone = part["zone"].iloc[0]
    x, y = _arrays(part[part["block"] < fold], features, target)
    xt, yt = _arrays(part[part["block"] == fold], features, target)
    if not len(y) or not len(yt):
        return
    summed, grown = np.zeros((len(depths), len(yt))), 0
    for ensemble in chunks(x, y, max(numbers), max(depths), min_leaf, share, zlib.crc32(f"{zone} {fold}".encode())):
        by_tree = np.cumsum(ensemble.predictions(nearest(xt, ensemble.values), depths), axis=1)
        for n in numbers:
            if grown < n <= grown + by_tree.shape[1]:
                maes = np.abs((summed + by_tree[:, n - grown - 1]) / n - yt).mean(axis=1)
                yield from ((zone, n, d, min_leaf, share, fold, float(m)) for d, m in zip(depths, maes))
        summed, grown = summed + by_tree[:, -1], grown + by_tree.shape[1]


def nearest(x: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Codes of new rows: a value between two known ones goes to the nearer side, as a
    threshold half-way between them sends it."""
    return np.stack([np.searchsorted((v[:-1] + v[1:]) / 2, x[:, f], side="left") for f, v in enumerate(values)], axis=1)


# --- the DataFrame operators -------------------------------------------------------------


def nested_search(train: DataFrame, features: list[str], grid: dict[str, list], target: str = "target", n_folds: int = N_FOLDS) -> DataFrame:
    """zone, the point's columns, fold and mae, for every point of the grid and every fold.

    ``train`` carries ``block`` (see ``expanding_blocks``). Fits differ in leaf size and
    share only; numbers of trees and depths are read out of them.
    """
    folds = range(n_folds, 0, -1)  # the largest first
    fits = list(itertools.product(folds, grid["minInstancesPerNode"], grid["featureSubsetStrategy"]))
    numbers, depths = sorted(grid["numTrees"]), sorted(grid["maxDepth"])
    tasks = F.explode(F.sequence(F.lit(0), F.lit(len(fits) - 1)))
    rows = train.select("zone", "period", "block", target, *features).withColumn("_fit", tasks)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = list(fold_errors(part, features, target, numbers, depths, *fits[int(key[1])]))
        return pd.DataFrame(out, columns=["zone", "num_trees", "max_depth", "min_leaf", "share", "fold", "mae"])

    # A task for each group: fits take far longer than their rows' size suggests.
    spread = rows.repartition(max(1, min(4096, len(fits) * max(1, train.select("zone").distinct().count()))), "zone", "_fit")
    return spread.groupBy("zone", "_fit").applyInPandas(run, FIT_SCHEMA)


def by_point(errors: DataFrame) -> DataFrame:
    """Per zone and point the mean of the folds' MAE and their number."""
    keys = ["zone", "num_trees", "max_depth", "min_leaf", "share"]
    return errors.groupBy(*keys).agg(F.avg("mae").alias("cv_mae"), F.count("mae").cast("int").alias("folds_used"))


def winners(points: DataFrame) -> DataFrame:
    """Per zone the point with the least error; ties go to the smaller forest."""
    names = ["num_trees", "max_depth", "min_leaf", "share"]
    best = F.min(F.struct("cv_mae", *names)).alias("_b")
    return points.groupBy("zone").agg(best).select("zone", *[F.col(f"_b.{c}") for c in [*names, "cv_mae"]])


def fit_forests(rows: DataFrame, chosen: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Each zone's forest at its chosen point, grown on all its rows: one row per tree."""
    ready = rows.select("zone", "period", target, *features)

    def run(part: pd.DataFrame, point: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(part) and len(point):
            p, zone = point.iloc[0], part["zone"].iloc[0]
            x, y = _arrays(part, features, target)
            for ensemble in chunks(x, y, int(p["num_trees"]), int(p["max_depth"]), int(p["min_leaf"]), p["share"], zlib.crc32(zone.encode())):
                halves = [(v[:-1] + v[1:]) / 2 for v in ensemble.values]
                for tree in range(len(ensemble.roots)):
                    nodes = np.flatnonzero(ensemble.tree == tree)
                    at = np.zeros(len(ensemble.tree), int)
                    at[nodes] = np.arange(len(nodes))
                    feature, left = ensemble.feature[nodes], ensemble.left[nodes]
                    edge = [halves[f][c] if f >= 0 else 0.0 for f, c in zip(feature, ensemble.cut[nodes])]
                    out.append(
                        (zone, len(out), feature, np.array(edge), np.where(left >= 0, at[left], -1), ensemble.mean[nodes], ensemble.gain[nodes])
                    )
        return pd.DataFrame(out, columns=["zone", "tree", "feature", "threshold", "left", "value", "gain"])

    return ready.groupBy("zone").cogroup(chosen.groupBy("zone")).applyInPandas(run, TREES)


def walk(feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf that each row of ``x`` reaches in one tree."""
    at = np.zeros(len(x), int)
    while True:
        inner = left[at] >= 0
        if not inner.any():
            return at
        right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
        at = np.where(inner, left[at] + right, at)


def predict_rows(trees: DataFrame, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Batch prediction after the feature-order check."""
    require_columns(rows, keys + features, "model")
    require_feature_order(rows, features, keys)
    return predict_forests(trees, rows, features, keys)


def predict_forests(trees: DataFrame, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """``keys`` and predicted_demand: the mean over the zone's trees; null without a forest.

    ``keys`` name the zone first. Every row meets only its own zone's trees.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", predicted_demand double"

    def run(model: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        x = part[features].to_numpy(dtype=float)
        total = np.zeros(len(part))
        for tree in model.itertuples():
            total += np.asarray(tree.value)[walk(np.asarray(tree.feature), np.asarray(tree.threshold), np.asarray(tree.left), x)]
        out = part[keys].copy()
        out["predicted_demand"] = total / len(model) if len(model) else None
        return out

    asked = rows.select(*keys, *features)
    return trees.groupBy("zone").cogroup(asked.groupBy(keys[0])).applyInPandas(run, schema)


def importance(trees: DataFrame, features: list[str]) -> DataFrame:
    """zone, feature, importance: each tree's share of the error that splits on the feature
    took away, averaged over the trees; the greatest first."""
    names = F.array(*map(F.lit, features))
    nodes = trees.select("zone", "tree", F.inline(F.arrays_zip("feature", "gain")))
    every = trees.select("zone", "tree", F.posexplode(names).alias("feature", "name"))
    summed = nodes.filter("feature >= 0").groupBy("zone", "tree", "feature").agg(F.sum("gain").alias("gain"))
    whole = summed.groupBy("zone", "tree").agg(F.sum("gain").alias("total"))
    shares = every.join(summed, ["zone", "tree", "feature"], "left").join(whole, ["zone", "tree"], "left")
    share = F.coalesce(F.try_divide("gain", "total"), F.lit(0.0))
    told = shares.groupBy("zone", F.col("name").alias("feature")).agg(F.avg(share).alias("importance"))
    return told.orderBy("zone", F.desc("importance"), "feature")
