"""One small case for each mended finding of the fourth round."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.linalg import Vectors

from riskpanel.operators import ensembles as E
from riskpanel.operators import newton as N

COLUMNS = {"weightCol": "weight", "seed": 3}


def _mixed(spark, copies: int = 3):
    """Rows of few and of many values, a constant, repeated rows, weights by label."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 3, 400), rng.normal(size=400), np.full(400, 7.0), rng.integers(-20, 20, 400) / 4])
    label = ((x[:, 0] + x[:, 1] ** 2 + rng.normal(size=400) / 2) > 2).astype(float)
    rows = [(Vectors.dense(v), y, 18.0 if y else 1.5) for v, y in zip(x.tolist(), label.tolist(), strict=True)]
    return spark.createDataFrame(rows * copies, ["features", "label", "weight"]).repartition(3).persist()


def _raw(model, rows):
    return sorted((tuple(r.features), round(r.rawPrediction[1], 7)) for r in model.transform(rows).select("features", "rawPrediction").distinct().collect())


def test_boosting_on_merged_rows_grows_the_trees_of_mllib(spark):
    """with nothing left to chance merged rows give MLlib's trees, in one task instead of several jobs a round."""
    rows = _mixed(spark)
    settings = {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3, **COLUMNS}
    plain, merged = GBTClassifier(**settings).fit(rows), E.MergedGBTClassifier(**settings).fit(rows)
    assert _raw(plain, rows) == _raw(merged, rows)
    assert [t.numNodes for t in plain.trees] == [t.numNodes for t in merged.trees]
    assert merged.treeWeights == plain.treeWeights and merged.getMaxIter() == 6
    assert np.allclose(plain.featureImportances.toArray(), merged.featureImportances.toArray())


def test_a_fit_of_trees_is_a_fixed_number_of_jobs(spark, monkeypatch):
    """rounds are no Spark jobs; tables that stay too large are MLlib's."""
    rows, settings = _mixed(spark), {"maxDepth": 3, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", **COLUMNS}

    def jobs(n_trees: int) -> int:
        spark.sparkContext.setJobGroup(f"fit-{n_trees}", "")
        model = E.MergedGBTClassifier(maxIter=n_trees, **settings).fit(rows)
        assert len(model.trees) == n_trees
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{n_trees}"))

    try:
        assert jobs(2) >= jobs(40)  # the first one also fills the cache
        monkeypatch.setattr(E, "TASK_BINS", 10)
        assert jobs(13) > jobs(3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_newton_steps_reach_the_optimum_of_mllib(spark, monkeypatch):
    """the same weights in a few passes; a constant weighs nothing, one label alone is left to MLlib."""
    rows, settings = _mixed(spark), {"maxIter": 2000, "regParam": 1 / 1200, "weightCol": "weight"}
    plain, passes, sums = LogisticRegression(tol=1e-14, **settings).fit(rows), [], N.over_blocks
    monkeypatch.setattr(N, "BLOCK_VALUES", 40)
    alone = N.NewtonLogisticRegression(**settings).fit(rows)
    monkeypatch.setattr(N, "over_blocks", lambda *a: passes.append(1) or sums(*a))
    monkeypatch.setattr(N, "TASK_BYTES", 0)
    newton = N.NewtonLogisticRegression(**settings).fit(rows)
    assert np.allclose(alone.coefficients.toArray(), newton.coefficients.toArray(), atol=1e-9)
    assert np.allclose(plain.coefficients.toArray(), newton.coefficients.toArray(), atol=1e-5) and newton.coefficients[2] == 0
    assert abs(plain.intercept - newton.intercept) < 1e-5 and len(passes) < 15
    one = N.NewtonLogisticRegression(**settings).fit(rows.where("label = 1"))
    assert not one.coefficients.toArray().any()


def test_only_columns_that_lack_values_are_filled(spark, monkeypatch):
    """No median is sought where nothing is missing, with the same matrix."""
    from riskpanel.operators import splits as S
    from riskpanel.plans import training as M

    rows = spark.createDataFrame(
        [(i, "2020-01" if i % 3 else "2020-05", i % 2, float(i), None if i % 4 == 0 else float(i), None if i % 5 == 0 else i) for i in range(40)],
        "entity LONG, month STRING, y INT, swh_a DOUBLE, swh_b DOUBLE, advisory_c LONG")
    columns, sought, plain = ["advisory_c", "swh_a", "swh_b"], [], S.train_medians
    monkeypatch.setattr(S, "train_medians", lambda matrix, names: sought.append(list(names)) or plain(matrix, names))
    got = M.prepare(rows, "y", columns, strategy="time", test_start="2020-04")
    whole, fills = M.prepare_with_fills(rows, "y", columns, strategy="time", test_start="2020-04")
    assert sought == [["swh_b"], ["swh_a", "swh_b"]] and fills["advisory_c"] == 0.0
    names = whole.columns
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, whole.collect()))


def test_forests_on_merged_rows_grow_the_trees_of_mllib(spark):
    """with nothing left to chance a tree of merged rows is MLlib's; a row that counts three times is sampled as three."""
    rows = _mixed(spark)
    settings = {"numTrees": 1, "maxDepth": 12, "minInstancesPerNode": 5, "bootstrap": False, "featureSubsetStrategy": "all", **COLUMNS}
    plain, merged = RandomForestClassifier(**settings).fit(rows), E.MergedForestClassifier(**settings).fit(rows)
    assert _raw(plain, rows) == _raw(merged, rows) and plain.trees[0].numNodes == merged.trees[0].numNodes
    one = E.Rows(np.zeros((1, 1), np.uint8), np.ones(1), np.ones(1), np.array([900]))
    taken = [E.forest_tree(one, one.bins.T, 1, 1, 3, 1, 0.0, 1.0, True, [7, i]).raw[0] for i in range(50)]
    assert 880 < np.mean(taken) < 920 and 20 < np.std(taken) < 42
