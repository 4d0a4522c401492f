"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from riskpanel import catalogue

SF_DIR = "/root/testdata/sf0.001"
catalogue.load_all()
CHECKED = sorted(catalogue.ORACLES)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, name, SF_DIR, catalogue.QUERIES, catalogue.ORACLES)
    assert problem is None, problem


def test_fitted_model_has_rows_and_metrics(spark):
    row = catalogue.QUERIES["train_logistic"](spark, SF_DIR).first()
    assert row["train_row_count"] > 0 and row["test_row_count"] > 0 and row["feature_count"] > 0
    both_classes = 0 < row["test_positive_count"] < row["test_row_count"]
    assert (row["average_precision"] is not None) == both_classes


def test_comparisons_fit_every_model(spark, monkeypatch):
    from riskpanel.plans import training as M

    asked, cells = {}, []
    monkeypatch.setattr(M, "compare_models", lambda _, prepared, columns, models: asked.update(compared=models))
    monkeypatch.setattr(M, "ablation_grid", lambda _, panel, models, families, splits, start: cells.extend(
        (m, f, s) for m in models for f in families for s in splits))
    catalogue.QUERIES["compare_ecosystems"](spark, SF_DIR)
    for model in M.MODEL_DEFAULTS:
        catalogue.QUERIES[f"ablation_{model}"](spark, SF_DIR)
    assert sorted(asked["compared"]) == sorted(M.MODEL_DEFAULTS) and len(set(cells)) == len(cells) == 64


def test_grid_cells_are_fitted_together(spark):
    """All cells of a small grid, each with both classes and its own pool, in the order of the grid."""
    from riskpanel.plans import training as M

    rows = [(f"e{i % 20}", f"2025-{i % 12 + 1:02d}", float(i % 7), float(i % 5), float(i % 3), int(i % 7 > 3)) for i in range(480)]
    panel = spark.createDataFrame(
        rows, "entity STRING, month STRING, advisory_a DOUBLE, gharchive_b DOUBLE, swh_c DOUBLE, label_advisory_within_6m INT")
    settings = {"logistic": {"maxIter": 20}, "xgboost": {"maxIter": 2, "maxDepth": 2}}
    got = M.ablation_grid(spark, panel, ["logistic", "xgboost"], ["advisory_only", "swh_only"], ["time", "group"], "2025-09", settings=settings)
    runs = [r.run for r in got.collect()]
    assert runs == [f"{m}_{f}_{s}" for f in ("advisory_only", "swh_only") for s in ("time", "group") for m in ("logistic", "xgboost")]
    assert all(0 < r.average_precision <= 1 and r.train_rows > 0 for r in got.collect())


def test_jobs_together_inherit_the_job_group(spark):
    from riskpanel.plans import training as M

    spark.sparkContext.setJobGroup("grid", "cells of a grid")
    seen = M.run_together(spark, [lambda k=k: (k, spark.sparkContext.getLocalProperty("spark.jobGroup.id")) for k in range(5)], 2)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen == [(k, "grid") for k in range(5)]
    with pytest.raises(ZeroDivisionError):
        M.run_together(spark, [lambda: 1 / 0])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
