import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltpanel.operators import boosting, linear, moments, scoring, splits, trees
from voltpanel.plans import catalog
from voltpanel.sinks import models as artefacts

FEATURES = ["a", "b", "c", "d"]
N = 131


def synthetic(zone: str, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(N, 4)) * [1, 50, 0.1, 3] + [5, 1000, 0, -2]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + 10 * x[:, 2] + rng.normal(size=N)
    frame = pd.DataFrame(x, columns=FEATURES).assign(target=y, zone=zone)
    frame["period"] = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(N)]
    return frame


@pytest.fixture(scope="module")
def zones():
    return {"p": synthetic("p", 1), "q": synthetic("q", 2)}


@pytest.fixture(scope="module")
def train(spark, zones):
    return splits.expanding_blocks(spark.createDataFrame(pd.concat(zones.values()))).cache()


def time_series_folds(n, k=5):
    size = n // (k + 1)
    return [(range(0, start), range(start, start + size)) for start in range(n - k * size, n, size)]


def linear_blocks(n):
    return np.repeat(np.arange(6), [n - 5 * (n // 6)] + 5 * [n // 6])


def ridge(x, y, alpha):
    xm, ym = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


def test_blocks_are_expanding_windows_over_dates(train):
    got = train.select("period", "block").distinct().orderBy("period").toPandas()["block"].tolist()
    folds = time_series_folds(N)
    want = [0] * len(folds[0][0]) + [k + 1 for k, (_, test) in enumerate(folds) for _ in test]
    assert got == want


def test_blocks_do_not_mix_dates_of_uneven_zones(make_panel):
    panel = make_panel({"a": list(range(60)), "b": [None] * 30 + list(range(30))})
    assert splits.expanding_blocks(panel).groupBy("period").agg(F.countDistinct("block").alias("n")).filter("n > 1").count() == 0


def test_fold_report(train):
    rows = {r.fold: r for r in splits.fold_report(train).collect()}
    assert [rows[k].train_rows for k in range(1, 6)] == [2 * len(t) for t, _ in time_series_folds(N)]
    assert all(rows[k].train_last < rows[k].test_first for k in rows)


@pytest.mark.parametrize("fold_scaling", [False, True])
def test_ridge_path_equals_direct_solution(train, zones, fold_scaling):
    alphas = np.logspace(-4, 4, 50)
    models = {r.zone: r for r in linear.ridge_cv(train, FEATURES, fold_scaling=fold_scaling).collect()}
    for zone, frame in zones.items():
        x, y = frame[FEATURES].to_numpy(), frame["target"].to_numpy()
        x = (x - x.mean(axis=0)) / x.std(axis=0)
        scores = []
        for alpha in alphas:
            r2 = []
            for tr, te in time_series_folds(N):
                scale = x[list(tr)].std(axis=0) if fold_scaling else 1.0
                w, c = ridge(x[list(tr)] / scale, y[list(tr)], alpha)
                residual = y[list(te)] - x[list(te)] / scale @ w - c
                r2.append(1 - (residual**2).sum() / ((y[list(te)] - y[list(te)].mean()) ** 2).sum())
            scores.append(np.mean(r2))
        best = int(np.argmax(scores))
        w, c = ridge(x, y, alphas[best])
        assert models[zone].alpha == pytest.approx(alphas[best])
        assert models[zone].r2 == pytest.approx(scores[best])
        assert np.allclose(models[zone].coefficients, w) and models[zone].intercept == pytest.approx(c)


def test_ridge_prediction_uses_training_scale(spark, train, zones):
    fresh = pd.concat([synthetic("p", 11), synthetic("q", 12)])
    models = linear.ridge_cv(train, FEATURES)
    got = linear.ridge_predict(spark.createDataFrame(fresh), models, FEATURES, train).toPandas()
    assert len(got) == len(fresh)
    for zone, frame in zones.items():
        m = models.filter(F.col("zone") == zone).first()
        x = frame[FEATURES]
        z = (fresh[fresh.zone == zone][FEATURES] - x.mean()) / x.std(ddof=0)
        want = z.to_numpy() @ np.array(m.coefficients) + m.intercept
        assert np.allclose(np.sort(got[got.zone == zone]["predicted"]), np.sort(want))
    importance = linear.coefficient_importance(models, FEATURES).filter("zone = 'p'").orderBy(F.desc("importance")).first()
    assert importance.feature == "b" and importance.importance == abs(importance.coefficient)


def test_spark_regression_agrees_with_the_ridge_solution(spark, zones):
    """Same penalty through the built-in solver: alpha / n times the label's deviation."""
    from pyspark.ml.regression import LinearRegression

    frame, alpha = zones["p"], 5.0
    x, y = frame[FEATURES].to_numpy(), frame["target"].to_numpy()
    w, _ = ridge((x - x.mean(axis=0)) / x.std(axis=0), y, alpha)
    rows = trees.assembled(spark.createDataFrame(frame), FEATURES)
    fit = LinearRegression(labelCol="target", regParam=alpha / N * y.std(), elasticNetParam=0.0, solver="normal").fit(rows)
    # The built-in solver scales by sample deviations, hence the factor.
    ours = w / x.std(axis=0)
    assert np.allclose(fit.coefficients.toArray(), ours, rtol=2e-3)


def test_forward_selection_by_fold_mae(train, zones):
    got = linear.forward_selection(train, FEATURES, steps=3).toPandas()
    for zone, frame in zones.items():
        x, y = frame[FEATURES].to_numpy(), frame["target"].to_numpy()
        x = (x - x.mean(axis=0)) / x.std(axis=0)
        chosen = []
        for step in range(1, 4):
            trials = []
            for j in [j for j in range(4) if j not in chosen]:
                use, maes = chosen + [j], []
                for tr, te in time_series_folds(N):
                    w, c = ridge(x[list(tr)][:, use], y[list(tr)], 0.0)
                    maes.append(np.abs(y[list(te)] - x[list(te)][:, use] @ w - c).mean())
                trials.append((np.mean(maes), j))
            mae, j = min(trials)
            chosen.append(j)
            row = got[(got.zone == zone) & (got.step == step)].iloc[0]
            assert row.feature == FEATURES[j] and row.cv_mae == pytest.approx(mae)


def test_variance_inflation(spark, zones):
    frame = zones["p"].assign(e=lambda f: (f["a"] + f["d"]) / 2, k=1.0)
    columns = FEATURES + ["e", "k"]
    got = {r.feature: r.vif for r in linear.variance_inflation(spark.createDataFrame(frame), columns).collect()}
    assert np.isinf([got["a"], got["d"], got["e"]]).all() and (got["k"] is None or np.isnan(got["k"]))
    b = frame["b"].to_numpy()
    others = np.c_[np.ones(N), frame[["a", "c", "d"]]]
    residual = b - others @ np.linalg.lstsq(others, b, rcond=None)[0]
    assert got["b"] == pytest.approx(b.var() / residual.var())


def test_base_scan_finds_the_kink(spark):
    rng = np.random.default_rng(3)
    t = rng.uniform(10, 90, 800)
    frame = pd.DataFrame({"zone": "z", "tavg": t, "is_weekend": rng.integers(0, 2, 800), "is_holiday": rng.integers(0, 2, 800)})
    frame["value"] = 1000 * np.maximum(50 - t, 0) + 4000 * np.maximum(t - 65, 0) - 5000 * frame.is_weekend + rng.normal(size=800) * 100
    got = linear.base_scan(spark.createDataFrame(frame)).toPandas()
    best = {side: part.loc[part.r2.idxmax(), "base"] for side, part in got.groupby("side")}
    assert best == {"heating": 50.0, "cooling": 65.0}
    x = np.c_[np.ones(800), np.maximum(60 - t, 0), np.maximum(t - 65, 0), frame.is_weekend, frame.is_holiday]
    residual = frame.value - x @ np.linalg.lstsq(x, frame.value, rcond=None)[0]
    at_60 = got[(got.side == "heating") & (got.base == 60)].r2.iloc[0]
    assert at_60 == pytest.approx(1 - (residual**2).sum() / ((frame.value - frame.value.mean()) ** 2).sum())


def test_pairwise_correlation_with_holes_and_constants(spark, zones):
    frame = zones["p"].copy()
    frame.loc[frame.index[::5], "a"] = np.nan
    frame["k"] = 1e6 + 0.1
    columns = ["a", "b", "c", "k"]
    got = moments.pairwise_correlation(spark.createDataFrame(frame).replace(float("nan"), None), columns, ["zone"]).collect()
    want = frame[columns].corr()
    assert len(got) == 6
    for r in got:
        if "k" in (r.feature_a, r.feature_b):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(want.loc[r.feature_a, r.feature_b])
    assert moments.correlated_pairs(moments.pairwise_correlation(spark.createDataFrame(zones["p"]), FEATURES, ["zone"])).count() == 0


def test_forward_selection_stops_when_the_mae_does(train, zones):
    every = linear.forward_selection(train, FEATURES, steps=4).toPandas()
    got = linear.forward_selection(train, FEATURES).toPandas()
    for zone in zones:
        mae = every[every.zone == zone].sort_values("step")["cv_mae"].tolist()
        stop = next((i for i in range(1, 4) if not mae[i] < mae[i - 1]), 4)
        assert got[got.zone == zone].sort_values("step")["cv_mae"].tolist() == pytest.approx(mae[:stop])


def test_forward_selection_with_columns_that_add_nothing(spark, zones):
    frame = zones["p"].assign(block=linear_blocks(N), e=lambda f: f["a"] + f["b"], f=lambda f: f["a"], k=7.0)
    frame.loc[frame.index[3], "c"] = np.nan
    rows = spark.createDataFrame(frame).replace(float("nan"), None)
    names = FEATURES + ["e", "f", "k"]
    got = linear.forward_selection(rows, names, steps=len(names)).orderBy("step").toPandas()
    assert sorted(got["feature"]) == sorted(names) and got["step"].tolist() == list(range(1, 8))
    chosen = got["feature"].tolist()
    full = frame.dropna()
    x, y, block = full[names], full["target"].to_numpy(), full["block"].to_numpy()
    for step in range(1, 8):
        use, maes = chosen[:step], []
        for fold in range(1, 6):
            tr, te = block < fold, block == fold
            design = lambda m: np.c_[np.ones(m.sum()), x.loc[m, use]]  # noqa: B023, E731
            maes.append(np.abs(y[te] - design(te) @ np.linalg.lstsq(design(tr), y[tr], rcond=None)[0]).mean())
        assert got["cv_mae"][step - 1] == pytest.approx(np.mean(maes), rel=1e-6)
    assert chosen.index("a") < chosen.index("f")  # equal columns: the first name
    assert linear.forward_selection(rows.filter("block = 0"), names).count() == 0
    assert linear.forward_selection(rows.limit(0), names).count() == 0


def test_registered_searches_try_all_points(monkeypatch):
    tried = []
    monkeypatch.setattr(catalog, "_model_rows", lambda *_: None)
    monkeypatch.setattr(catalog, "_train", lambda rows: rows)
    monkeypatch.setattr(boosting, "staged_search", lambda train, features, points: tried.append(points) or 1 / 0)
    for name in ("gbt_grid", "gbt_search", "leaf_wise_search"):
        with pytest.raises(ZeroDivisionError):
            catalog.QUERIES[name](None, None)
    assert [len(points) for points in tried] == [48, 75, 75]
    assert tried[1] == boosting.depth_points(trees.random_points(trees.BOOSTED_RANDOM))
    assert len(trees.grid_points(boosting.LEAF_GRID)) == 62_208


def test_grids():
    assert len(trees.grid_points(trees.FOREST_GRID)) == 108
    assert len(trees.grid_points(trees.BOOSTED_GRID)) == 48
    assert len(trees.grid_points(trees.BOOSTED_RANDOM)) == 3888
    sample = trees.random_points(trees.BOOSTED_RANDOM)
    assert len(sample) == 75 and sample == trees.random_points(trees.BOOSTED_RANDOM)
    assert len({tuple(p.items()) for p in sample}) == 75


def test_search_beats_the_mean_and_repeats(train):
    points = [{"numTrees": n, "maxDepth": d} for n, d in itertools.product([3], [1, 5])]
    first = trees.search(train, FEATURES, "forest", points)
    assert first == trees.search(train, FEATURES, "forest", points)
    assert first[0]["params"]["maxDepth"] == 5 and all(r["folds_used"] == 5 for r in first)
    with pytest.raises(ValueError, match="cut for 5 folds"):
        trees.search(train, FEATURES, "forest", points, n_folds=2)
    spread = train.agg(F.mean(F.abs(F.col("target") - F.lit(-190.0)))).first()[0]
    assert first[0]["cv_mae"] < spread


def test_model_round_trip(spark, train, tmp_path):
    known = train.filter("block < 5")
    params = {"maxIter": 3, "maxDepth": 2}
    model = trees.fit_final(known, FEATURES, "boosted", params)
    importance = trees.feature_importance(spark, model, FEATURES)
    weights = [r.importance for r in importance.collect()]
    assert weights == sorted(weights, reverse=True) and sum(weights) == pytest.approx(1.0)
    inputs = train.filter("block = 5").select("zone", "period", *FEATURES)
    predicted = trees.predict_rows(model, inputs, FEATURES, ["zone", "period"])
    artefacts.save_model(
        spark, model, str(tmp_path / "v1"), FEATURES, {"MAE": 1}, params, known.count(), "2020-04-01", "2020-05-01", importance
    )
    again = trees.predict_rows(artefacts.load_model(str(tmp_path / "v1")), inputs, FEATURES, ["zone", "period"])
    assert sorted(map(tuple, predicted.collect())) == sorted(map(tuple, again.collect()))
    meta = artefacts.load_metadata(spark, str(tmp_path / "v1"))
    assert meta["features"] == FEATURES and meta["best_params"] == params and meta["final_fit_rows"] == known.count()
    with pytest.raises(ValueError, match="feature mismatch"):
        trees.predict_rows(model, inputs.select("zone", "period", *FEATURES[::-1]), FEATURES, ["zone", "period"])


def test_early_stopping_trains_fewer_trees(train):
    rows = train.withColumn("target", F.rand(1))
    fit = trees.early_stopped(rows.filter("block < 4"), rows.filter("block >= 4"), FEATURES, {"maxIter": 20, "maxDepth": 2})
    assert fit.getNumTrees < 20


def test_baselines_and_skill(make_panel):
    from voltpanel.operators.features import history_features

    history = history_features(make_panel({"z": [100 + (i % 7) for i in range(60)]}))
    metrics = scoring.offline_metrics(splits.persistence_predictions(history), ["zone", "model"])
    board = {r.model: r for r in scoring.leaderboard(metrics).collect()}
    assert board["persistence (lag_0)"].mape > 0 and board["persistence (lag_0)"].n == 59
    skill = {r.model: r.skill for r in scoring.skill_scores(metrics, "persistence (lag_0)").collect()}
    assert skill["persistence (lag_0)"] == 0.0
