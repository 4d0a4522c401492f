"""Training, scoring and study jobs on MLlib."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions.numbers import risk_tier
from riskpanel.operators import ranking as R
from riskpanel.operators import permutation as I
from riskpanel.operators import splits as S
from riskpanel.operators import trees as T
from riskpanel.operators.bundle import align_to_model
from riskpanel.operators.ensembles import MergedForestClassifier, MergedGBTClassifier
from riskpanel.operators.newton import NewtonLogisticRegression
from riskpanel.session import materialize, shared_dir

# --- fixed values: model settings; 30 is the deepest tree that MLlib grows ---
MODEL_DEFAULTS = {
    "logistic": {"maxIter": 2000},
    "random_forest": {
        "numTrees": 500, "minInstancesPerNode": 5, "maxDepth": 30, "seed": 42,
    },
    "xgboost": {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
                "featureSubsetStrategy": "0.8", "seed": 42},
    "lightgbm": {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
                 "featureSubsetStrategy": "0.8", "seed": 42},
}
BOOST_POSITIVE_WEIGHT = 18.0
#: Feature values worth a task of their own in each iteration, and how many a task reads at most. A task of a tree fit sends
#: counts of all bins of a level to the next stage, so many small tasks cost more than they earn.
PART_VALUES, TASK_VALUES = 2_000_000, 20_000_000
#: Feature values that take as long as what a row takes beside its values.
ROW_VALUES = 10
#: Node ids of rows (one per tree) that a forest keeps between levels; beyond it each level walks its trees from their roots.
NODE_IDS = 1_000_000_000
#: Models whose fit reads its rows twice and then keeps blocks of its own; kept rows would take the memory a second time.
CACHED_BY_FIT = ("logistic",)
#: Models whose fit is one task, unless their rows are too many for it.
ONE_TASK = ("logistic", "xgboost", "lightgbm")
#: Models that are fitted at a time if each of them fills all tasks.
FITS_TOGETHER = 4
FAMILIES = {
    "advisory_only": (("advisory_",), True),
    "gharchive_only": (("gharchive_",), True),
    "swh_only": (("swh_",), True),
    "advisory_gharchive": (("advisory_", "gharchive_"), True),
    "advisory_swh": (("advisory_", "swh_"), True),
    "gharchive_swh": (("gharchive_", "swh_"), True),
    "full_no_time": (("advisory_", "gharchive_", "swh_"), False),
    "full_cleaned": (None, True),
}


def get_model(name: str, **settings):
    """Estimator by name; the two boosted families run on gradient-boosted trees."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if name not in MODEL_DEFAULTS:
        raise ValueError(f"unknown model {name!r}; available: {sorted(MODEL_DEFAULTS)}")
    params = {**common, **MODEL_DEFAULTS[name], **settings}
    if name == "logistic":
        return NewtonLogisticRegression(**params)
    if name == "random_forest":
        return MergedForestClassifier(**params)
    return MergedGBTClassifier(**params)


def weight_column(name: str, weights: dict) -> Column:
    """Row weights: a fixed positive weight for the first boosted family, else balanced."""
    positive = F.col("label") == 1
    if name == "xgboost":
        return F.when(positive, BOOST_POSITIVE_WEIGHT).otherwise(1.0)
    return F.when(positive, weights["weight_pos"] or 1.0).otherwise(weights["weight_neg"] or 1.0)


@dataclass
class Trained:
    name: str
    model: Model
    columns: list[str]
    predictions: DataFrame
    metrics: dict = field(default_factory=dict)
    settings: dict = field(default_factory=dict)


@dataclass
class Scorer:
    """A loaded model that scores rows of the feature contract, missing values included."""

    name: str
    pipeline: PipelineModel
    columns: list[str]
    settings: dict
    metrics: dict


def prepare(
    labelled: DataFrame, target: str, columns: Sequence[str], **split
) -> DataFrame:
    """Split and imputed training table, written once so that every fit reads it back."""
    matrix = _split_matrix(labelled, target, columns, **split)
    return _filled(matrix, S.fill_values(matrix, S.missing_columns(matrix, columns)))


def prepare_with_fills(
    labelled: DataFrame, target: str, columns: Sequence[str], **split
) -> tuple[DataFrame, dict[str, float]]:
    """The table of :func:`prepare` and what stands in it for missing values, which a scorer must repeat."""
    matrix = _split_matrix(labelled, target, columns, **split)
    fills = S.fill_values(matrix, columns)
    return _filled(matrix, fills), fills


def _split_matrix(labelled: DataFrame, target: str, columns: Sequence[str], **split) -> DataFrame:
    sided = S.split_rows(labelled.where(F.col(target).isNotNull()), **split)
    return S.as_matrix(sided, columns, ["entity", "month", "split", F.col(target).cast("double").alias("label")])


def _filled(matrix: DataFrame, fills: dict[str, float]) -> DataFrame:
    kept = [c for c in matrix.columns if c not in fills]
    return materialize(matrix.select(*kept, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fills.items()]), "matrix")


def _features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features",
                                handleInvalid="keep")
    return assembler.transform(df)


def run_together(spark: SparkSession, jobs: Sequence[Callable[[], object]], parallelism: int = FITS_TOGETHER) -> list:
    """Results of independent jobs in their order, some at a time; each has a scheduler pool of its own.

    Fits are many short Spark jobs, so several of them fill the tasks that one leaves idle. Threads inherit the
    caller's job group, tags and description, so cancelling the group cancels all of them.
    """
    def in_pool(at: int) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{at % parallelism}")
        return jobs[at]()

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(in_pool), at) for at in range(len(jobs))]
        return [w.result() for w in waiting]


def task_count(values: int, share: int, trees: int = 1) -> int:
    """Tasks of a fit over so many feature values that has ``share`` of the cluster's tasks; a forest reads them per tree."""
    return max(1, -(-values // TASK_VALUES), min(share, -(-values * trees // PART_VALUES)))


def fits_at_once(spark: SparkSession, values: int, jobs: int) -> int:
    """Fits at a time: as many as there are tasks to run them, if each gets by with one or few."""
    return max(FITS_TOGETHER, min(jobs, spark.sparkContext.defaultParallelism // task_count(values, 1)))


def keep_lineage_short(spark: SparkSession) -> None:
    """Boosting checkpoints its residuals only if the context has a folder for it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def fit_and_score(
    prepared: DataFrame, columns: Sequence[str], name: str, share: int | None = None, **settings
) -> Trained:
    """Fit one model on the training side and score the test side.

    ``share`` is the number of tasks left to this fit by others that run at the same time; all by default.
    """
    train = prepared.where(F.col("split") == "train")
    weights = S.class_weights(train, "label").first().asDict()
    if name == "logistic":
        total = weights["n_pos"] + weights["n_neg"]
        settings.setdefault("regParam", 1.0 / max(1, total))
    rows = _features(train, columns).select(
        "features", "label", weight_column(name, weights).alias("weight"))
    keep_lineage_short(train.sparkSession)
    n_rows = weights["n_pos"] + weights["n_neg"]
    trees = 1
    if name == "random_forest":
        trees = settings.get("numTrees", MODEL_DEFAULTS[name]["numTrees"])
        settings.setdefault("cacheNodeIds", n_rows * trees <= NODE_IDS)
    cores = train.sparkSession.sparkContext.defaultParallelism
    parts = task_count(n_rows * (len(columns) + ROW_VALUES), share or cores, trees)
    rows = rows.repartition(parts) if trees > 1 else rows.coalesce(parts)
    if name in CACHED_BY_FIT:
        model = get_model(name, **settings).fit(rows)
    else:
        rows.persist(StorageLevel.MEMORY_AND_DISK)
        model = get_model(name, **settings).fit(rows)
        rows.unpersist()
    scored = model.transform(_features(prepared.where(F.col("split") == "test"), columns))
    predictions = materialize(scored.select(
        "entity", "month", F.col("label").cast("int").alias("y_true"),
        vector_to_array("probability")[1].alias("y_prob")), "predictions")
    return Trained(name, model, list(columns), predictions, settings={**MODEL_DEFAULTS[name], **settings})


def evaluate(trained: Trained, prepared: DataFrame) -> dict:
    """Metrics document: a few fixed-size results of aggregations."""
    preds = trained.predictions
    sides = {r["split"]: r.asDict() for r in S.split_summary(
        prepared.withColumnRenamed("label", "y"), "y").collect()}
    quality = R.ranking_quality(preds).first()
    cells = R.confusion(preds).first()
    train, test = sides.get("train", {}), sides.get("test", {})
    trained.metrics = {
        "model_name": trained.name, "feature_count": len(trained.columns),
        "feature_columns": trained.columns,
        "train_row_count": train.get("n_rows", 0), "test_row_count": test.get("n_rows", 0),
        "train_positive_count": train.get("n_positive", 0),
        "test_positive_count": test.get("n_positive", 0),
        "train_unique_plugin_count": train.get("n_entities", 0),
        "test_unique_plugin_count": test.get("n_entities", 0),
        "train_start_month": train.get("first_month"),
        "roc_auc": quality["roc_auc"], "average_precision": quality["average_precision"],
        "confusion_matrix": [[cells["tn"], cells["fp"]], [cells["fn"], cells["tp"]]],
        "classification_report": {
            r["label"]: {k: r[k] for k in ("precision", "recall", "f1", "support")}
            for r in R.classification_report(preds).collect()},
        "ranking_metrics": {
            f"precision_at_{r['k']}": r["precision"] for r in R.precision_at(preds).collect()},
        "operational_scenarios": {
            "precision_at_k": [r.asDict() for r in R.operational_table(preds).collect()],
            "recall_targets": [r.asDict() for r in R.recall_targets(preds).collect()],
            "scenarios": [r.asDict() for r in R.scenarios(preds).collect()]},
    }
    positive, negative = top_features(trained)
    trained.metrics |= {"top_positive_features": positive, "top_negative_features": negative}
    return trained.metrics


def train_model(
    labelled: DataFrame, name: str, target: str = "label_advisory_within_6m",
    strategy: str = "time", test_start: str = "2025-05", prefixes: Sequence[str] | None = None,
    include_window: bool = False, exclude: Sequence[str] = (), test_fraction: float = 0.2,
    seed: int = 42, **settings,
) -> Trained:
    """Select columns, split, impute, fit, score and measure one model."""
    usable = labelled.where(F.col(target).isNotNull())
    columns = S.select_feature_columns(usable, target, prefixes, include_window, exclude)
    if not columns:
        raise ValueError("no usable numeric feature columns")
    prepared = prepare(labelled, target, columns, strategy=strategy, test_start=test_start,
                       test_fraction=test_fraction, seed=seed)
    trained = fit_and_score(prepared, columns, name, **settings)
    evaluate(trained, prepared)
    return trained


def coefficients(trained: Trained) -> dict[str, float] | None:
    """Signed weights of a linear model, else None."""
    if not hasattr(trained.model, "coefficients"):
        return None
    return dict(zip(trained.columns, map(float, trained.model.coefficients), strict=True))


def top_features(trained: Trained, n: int = 20) -> tuple[list[dict], list[dict]]:
    """The features with the largest weight per sign; tree models only have importances."""
    signed = coefficients(trained)
    if signed is None:
        pairs = zip(trained.columns, map(float, trained.model.featureImportances), strict=True)
        ranked = sorted((p for p in pairs if p[1] > 0), key=lambda p: -p[1])[:n]
        return [{"feature": f, "importance": v} for f, v in ranked], []
    ranked = sorted(signed.items(), key=lambda p: -abs(p[1]))
    up = [{"feature": f, "coefficient": v} for f, v in ranked if v > 0][:n]
    down = [{"feature": f, "coefficient": v} for f, v in ranked if v < 0][:n]
    return up, down


def global_importance(trained: Trained, test: DataFrame, by: str = "model") -> list[tuple[str, float]]:
    """Features by importance: mean absolute contribution, or the trees' own importances.

    ``by="permutation"`` takes the fall of average precision on ``test`` when a feature's values are permuted.
    """
    signed = coefficients(trained)
    if by == "permutation":
        found = I.permutation_importance(test, trained.columns, "label", I.model_score(trained.model))
        scores = {r["feature"]: r["importance"] for r in found.collect()}  # one row per feature
    elif signed is None:
        scores = dict(zip(trained.columns, map(float, trained.model.featureImportances),
                          strict=True))
    else:
        scores = test.agg(*[
            F.avg(F.abs(F.col(c) * v)).alias(c) for c, v in signed.items()]).first().asDict()
    ranked = [(c, float(v or 0.0)) for c, v in scores.items() if c not in K.WINDOW_COLUMNS]
    return sorted(ranked, key=lambda p: (-p[1], p[0]))


def subset_study(
    spark: SparkSession, prepared: DataFrame, full: Trained, sizes: Sequence[int] = K.SUBSET_SIZES,
    parallelism: int = FITS_TOGETHER, rank_only: bool = False, **settings,
) -> DataFrame:
    """Average precision of the top-n feature subsets against the full model.

    The full model is not fitted again. With ``rank_only`` subsets are not fitted either.
    """
    if not full.metrics:
        evaluate(full, prepared)
    ranked = [c for c, _ in global_importance(full, prepared.where(F.col("split") == "test"))]
    wanted = [] if rank_only else [s for s in sizes if s <= len(ranked)]
    full_ap = full.metrics["average_precision"]

    def run(size: int) -> tuple:
        kept = set(ranked[:size])
        columns = [c for c in full.columns if c in kept]
        q = R.ranking_quality(
            fit_and_score(prepared, columns, full.name, **settings).predictions).first()
        ap = q["average_precision"]
        retention = ap / full_ap if ap is not None and full_ap else None
        return (f"top_{size}", len(columns), ap, q["roc_auc"], retention,
                retention is not None and retention >= 0.90)

    rows = run_together(spark, [partial(run, size) for size in wanted], parallelism)
    rows.append(("full", len(full.columns), full_ap, full.metrics["roc_auc"], 1.0, True))
    return spark.createDataFrame(
        rows, "subset STRING, n_features INT, average_precision DOUBLE, roc_auc DOUBLE, "
              "ap_retention DOUBLE, meets_threshold BOOLEAN")


def ablation_grid(
    spark: SparkSession, labelled: DataFrame, models: Sequence[str], families: Sequence[str],
    strategies: Sequence[str], test_start: str, target: str = "label_advisory_within_6m",
    settings: dict[str, dict] | None = None,
) -> DataFrame:
    """One row of metrics per model, feature family and split.

    Splits and fillings do not depend on the family, so the matrix of a split is prepared once with all columns; families are
    columns of it. The cells of most features begin first.
    """
    cores = spark.sparkContext.defaultParallelism
    values = labelled.count() * (len(labelled.columns) + ROW_VALUES)
    n_jobs = len(models) * len(families) * len(strategies)
    together = fits_at_once(spark, values, n_jobs)
    if set(models) <= set(ONE_TASK):
        together = max(together, min(n_jobs, cores))

    def cell(prepared: DataFrame, columns: list[str], model: str, family: str, strategy: str) -> tuple:
        trained = fit_and_score(
            prepared, columns, model, share=max(1, cores // together), **(settings or {}).get(model, {}))
        m = evaluate(trained, prepared)
        return (f"{model}_{family}_{strategy}", model, family, strategy, m["feature_count"], m["train_row_count"],
                m["test_row_count"], m["roc_auc"], m["average_precision"])

    usable = labelled.where(F.col(target).isNotNull())
    trainable = S.select_feature_columns(usable, target, None, True)
    columns = {}
    for family in families:
        prefixes, keep_time = FAMILIES[family]
        table = labelled if prefixes is None else S.family_projection(labelled, prefixes, keep_time)
        own = set(S.candidate_columns(table, target, None, family == "full_cleaned"))
        columns[family] = [c for c in trainable if c in own]
    needed = [c for c in trainable if any(c in own for own in columns.values())]
    matrices = dict(zip(strategies, run_together(spark, [
        partial(prepare, labelled, target, needed, strategy=strategy, test_start=test_start) for strategy in strategies]), strict=True))
    jobs = []
    for family in families:
        for strategy in strategies:
            prepared = matrices[strategy].select("entity", "month", "split", "label", *columns[family])
            jobs += [(len(columns[family]), partial(cell, prepared, columns[family], model, family, strategy)) for model in models]
    order = sorted(range(len(jobs)), key=lambda at: -jobs[at][0])
    found = dict(zip(order, run_together(spark, [jobs[at][1] for at in order], together), strict=True))
    rows = [found[at] for at in range(len(jobs))]
    return spark.createDataFrame(
        rows, "run STRING, model STRING, family STRING, split STRING, n_features INT, "
              "train_rows LONG, test_rows LONG, roc_auc DOUBLE, average_precision DOUBLE")


def embargo_backtest(
    spark: SparkSession, labelled: DataFrame, columns: Sequence[str], name: str, test_start: str,
    cutoffs: Sequence[str], target: str = "label_advisory_within_6m", **settings,
) -> DataFrame:
    """The same test rows, scored by models whose training rows end ever earlier."""
    usable = labelled.where(F.col(target).isNotNull())
    rows = []
    for cutoff in (None, *sorted(cutoffs, reverse=True)):
        sided = S.embargo_split(usable, test_start, cutoff)
        matrix = S.as_matrix(sided, columns, ["entity", "month", "split",
                                              F.col(target).cast("double").alias("label")])
        prepared = materialize(S.impute(matrix, columns), "embargo")
        trained = fit_and_score(prepared, columns, name, **settings)
        q = R.ranking_quality(trained.predictions).first()
        n = prepared.where(F.col("split") == "train").count()
        rows.append((f"cutoff_{cutoff}" if cutoff else "full", n, q["n"], q["roc_auc"],
                     q["average_precision"]))
    return spark.createDataFrame(rows, "run STRING, train_rows LONG, test_rows LONG, "
                                       "roc_auc DOUBLE, average_precision DOUBLE")


def contributions(trained: Trained, rows: DataFrame) -> DataFrame:
    """``entity, month, feature, value, contribution`` of every feature that moves a row's raw score."""
    keys = [c for c in ("entity", "month") if c in rows.columns]
    values = F.array(*[F.col(c).cast("double") for c in trained.columns])
    wide = rows.select(*keys, values.alias("features"))
    names = F.array(*map(F.lit, trained.columns))
    signed = coefficients(trained)
    if signed is not None:
        weights = F.array(*[F.lit(signed[c]) for c in trained.columns])
        parts = wide.select(*keys, F.posexplode("features").alias("feature", "value"))
        parts = parts.withColumn("contribution", F.col("value") * F.get(weights, F.col("feature")))
    else:
        walked = T.path_contributions(wide, T.model_nodes(trained.model), keys)
        parts = walked.join(wide, keys).withColumn("value", F.get("features", F.col("feature")))
    return parts.select(*keys, F.get(names, F.col("feature")).alias("feature"), "value", "contribution")


def row_drivers(trained: Trained, rows: DataFrame, n: int = 10) -> DataFrame:
    """The n strongest contributions per row, with direction and rank; ties by name.

    Linear models contribute weight times value, trees the changes of value along their paths. Calendar columns
    contribute but are not shown. Each row has as many contributions as features at most.
    """
    keys = [c for c in ("entity", "month") if c in rows.columns]
    shown = contributions(trained, rows).where(~F.col("feature").isin(*K.WINDOW_COLUMNS))
    entry = F.struct((-F.abs("contribution")).alias("order"), "feature", "contribution", "value")
    strongest = F.slice(F.array_sort(F.collect_list(entry)), 1, n)
    contribution = F.col("d.contribution")
    return shown.groupBy(*keys).agg(strongest.alias("all")).select(
        *keys, F.posexplode("all").alias("pos", "d")).select(
        *keys, (F.col("pos") + 1).alias("rank"), F.col("d.feature").alias("feature"),
        F.col("d.value").alias("value"), contribution.alias("contribution"),
        F.when(contribution > 0, "increases_risk").when(contribution < 0, "decreases_risk")
        .otherwise("neutral").alias("direction"))


def scoring_pipeline(trained: Trained, fills: dict[str, float]) -> PipelineModel:
    """Imputation, assembly and model as one pipeline that MLlib can save and load."""
    quoted = [f"`{c}`" for c in trained.columns]
    filled = ", ".join(f"coalesce({c}, {fills[n]!r}D) AS {c}" for n, c in zip(trained.columns, quoted, strict=True))
    impute = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(quoted)}), {filled} FROM __THIS__")
    assemble = VectorAssembler(inputCols=list(trained.columns), outputCol="features", handleInvalid="keep")
    return PipelineModel([impute, assemble, trained.model])


def score_with(pipeline: PipelineModel, columns: Sequence[str], bundle: DataFrame, as_of: str) -> DataFrame:
    """Probability, tier and missing fraction of every entity of the current-point bundle."""
    scored = pipeline.transform(align_to_model(bundle, columns, as_of))
    probability = vector_to_array("probability")[1]
    return scored.select(
        "entity", probability.alias("probability"), risk_tier(probability).alias("risk_tier"),
        "missing_features", "missing_fraction",
        (F.col("missing_fraction") >= 0.5).alias("mostly_missing"))


def score_bundle(trained: Trained, fills: dict[str, float], bundle: DataFrame, as_of: str) -> DataFrame:
    """Scores of the bundle by a model that was just trained."""
    return score_with(scoring_pipeline(trained, fills), trained.columns, bundle, as_of)


def save_artifacts(trained: Trained, path: str, fills: dict[str, float] | None = None) -> None:
    """Pipeline, ordered feature contract, settings, metrics and curves below one folder.

    Without ``fills`` missing values of every feature are scored as 0.
    """
    spark = trained.predictions.sparkSession
    fills = {c: float((fills or {}).get(c, 0.0)) for c in trained.columns}
    scoring_pipeline(trained, fills).write().overwrite().save(f"{path}/pipeline")
    documents = {
        "feature_columns": trained.columns, "metrics": trained.metrics,
        "model": {"name": trained.name, "settings": trained.settings, "fills": fills},
    }
    for name, payload in documents.items():
        text = spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "value STRING")
        text.write.mode("overwrite").text(f"{path}/{name}")
    R.pr_curve(trained.predictions).write.mode("overwrite").json(f"{path}/pr_curve")
    R.operational_table(trained.predictions).write.mode("overwrite").json(f"{path}/precision_at_k")
    trained.predictions.withColumnRenamed("entity", "plugin_id").write.mode("overwrite").option(
        "header", True).csv(f"{path}/test_predictions")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    """What :func:`save_artifacts` wrote, ready to score; the folder's path is all that is needed."""
    columns, metrics, model = (
        json.loads(spark.read.text(f"{path}/{name}", wholetext=True).first()[0])
        for name in ("feature_columns", "metrics", "model"))
    return Scorer(model["name"], PipelineModel.load(f"{path}/pipeline"), columns, model["settings"], metrics)


def reproduced(scorer: Scorer, saved: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: saved test predictions met again, and the greatest difference between then and now.

    ``saved`` is the prediction table as read back, ``rows`` the feature rows it was made of.
    """
    now = scorer.pipeline.transform(rows).select(
        F.col("entity").cast("string").alias("entity"), "month", vector_to_array("probability")[1].alias("now"))
    then = saved.select(F.col("entity").cast("string").alias("entity"), "month", F.col("y_prob").alias("then"))
    return then.join(now, ["entity", "month"]).agg(
        F.count(F.lit(1)).alias("rows_compared"), F.max(F.abs(F.col("now") - F.col("then"))).alias("max_difference"))


def compare_models(
    spark: SparkSession, prepared: DataFrame, columns: Sequence[str], models: Sequence[str],
    settings: dict[str, dict] | None = None,
) -> DataFrame:
    """Ranking quality of several models on one prepared table."""
    def one(name: str) -> tuple:
        preds = fit_and_score(prepared, columns, name, **(settings or {}).get(name, {})).predictions
        q = R.ranking_quality(preds).first()
        at = {r["k"]: r["precision"] for r in R.precision_at(preds, (10, 25, 50)).collect()}
        return (name, q["average_precision"], q["roc_auc"], at.get(10), at.get(25), at.get(50),
                q["pos"], q["n"], q["pos"] / q["n"] if q["n"] else 0.0)

    rows = run_together(spark, [partial(one, name) for name in models])
    return spark.createDataFrame(
        rows, "model STRING, average_precision DOUBLE, roc_auc DOUBLE, precision_at_10 DOUBLE, "
              "precision_at_25 DOUBLE, precision_at_50 DOUBLE, n_positive_test LONG, "
              "n_total_test LONG, base_rate DOUBLE")
