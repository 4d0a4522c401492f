"""Split, imputation, training and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import ORACLES, register
from riskpanel.catalogue.activity import PX
from riskpanel.catalogue.cohort import _PANEL_SQL
from riskpanel.catalogue.panel import _LABELS, _labelled
from riskpanel.operators import activity as A
from riskpanel.operators import cohort as C
from riskpanel.operators import splits as S
from riskpanel.plans import training as M
from riskpanel.plans.panel_build import labelled_panel
from riskpanel.session import materialize, scratch_path

LABEL = "label_advisory_within_6m"


def _rows(spark, sf_dir):
    return _labelled(spark, sf_dir).where(F.col(LABEL).isNotNull())


_SIDE = """SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE y = 1) AS n_positive,
  count(DISTINCT entity) AS n_entities, min(month) AS first_month, max(month) AS last_month
FROM s WHERE split IS NOT NULL GROUP BY split"""
_HELD = "substr(sha256('42:' || CAST(entity AS VARCHAR)), 1, 16) < '3333333333333333'"


@register("split_time", f"""{_PANEL_SQL}, s AS (SELECT *, CASE WHEN month >= '{B.TEST_START}' THEN 'test'
  ELSE 'train' END AS split FROM panel WHERE y IS NOT NULL) {_SIDE}""")
def split_time(spark, sf_dir):
    return S.split_summary(S.split_rows(_rows(spark, sf_dir), "time", B.TEST_START), LABEL)


@register("split_group", f"""{_PANEL_SQL}, s AS (SELECT *, CASE WHEN {_HELD} THEN 'test' ELSE 'train' END
  AS split FROM panel WHERE y IS NOT NULL) {_SIDE}""")
def split_group(spark, sf_dir):
    return S.split_summary(S.split_rows(_rows(spark, sf_dir), "group", B.TEST_START), LABEL)


@register("split_group_time", f"""{_PANEL_SQL}, s AS (SELECT *, CASE
  WHEN {_HELD} AND month >= '{B.TEST_START}' THEN 'test'
  WHEN NOT {_HELD} AND month < '{B.TEST_START}' THEN 'train' END AS split
  FROM panel WHERE y IS NOT NULL) {_SIDE}""")
def split_group_time(spark, sf_dir):
    return S.split_summary(S.split_rows(_rows(spark, sf_dir), "group_time", B.TEST_START), LABEL)


@register("split_embargo", f"""{_PANEL_SQL}, s AS (SELECT *, CASE WHEN month >= '{B.TEST_START}' THEN 'test'
  WHEN month <= '1999-12' THEN 'train' END AS split FROM panel WHERE y IS NOT NULL),
m AS ({_SIDE})
SELECT m.*, CASE split WHEN 'train' THEN '2000-06' ELSE '2001-08' END AS matured FROM m""")
def split_embargo(spark, sf_dir):
    rows = S.embargo_split(_rows(spark, sf_dir), B.TEST_START, cutoff="1999-12")
    matured = rows.groupBy("split").agg(F.max("matured").alias("matured"))
    return S.split_summary(rows, LABEL).join(matured, "split")


@register("stable_bucket", """
SELECT c_custkey AS entity, substr(sha256('42:' || CAST(c_custkey AS VARCHAR)), 1, 16) AS bucket_hex,
  substr(sha256('42:' || CAST(c_custkey AS VARCHAR)), 1, 16) < '3333333333333333' AS held_out
FROM customer""")
def stable_bucket(spark, sf_dir):
    from riskpanel.functions.numbers import stable_bucket as bucket
    from riskpanel.functions.numbers import stable_bucket_hex

    return B.customers(spark, sf_dir).select(
        "entity", stable_bucket_hex(F.col("entity"), 42).alias("bucket_hex"),
        (bucket(F.col("entity"), 42) < 0.2).alias("held_out"))


@register("class_weights", f"""{_PANEL_SQL},
c AS (SELECT count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg
      FROM panel WHERE y IS NOT NULL AND month < '{B.TEST_START}')
SELECT n_pos, n_neg, round((n_pos + n_neg) / (2.0::DOUBLE * n_pos), 9) AS weight_pos,
  round((n_pos + n_neg) / (2.0::DOUBLE * n_neg), 9) AS weight_neg,
  round(n_neg / CAST(n_pos AS DOUBLE), 9) AS neg_pos_ratio FROM c""")
def class_weights(spark, sf_dir):
    train = _rows(spark, sf_dir).where(F.col("month") < B.TEST_START)
    return B.rounded(S.class_weights(train, LABEL))


@register("impute_family", f"""{_PANEL_SQL},
s AS (SELECT entity, month, mean_cvss, CASE WHEN (entity + window_index) % 3 > 0 THEN
  CAST(days AS DOUBLE) END AS d, month < '{B.TEST_START}' AS train FROM panel WHERE y IS NOT NULL)
SELECT entity, month, round(COALESCE(mean_cvss, 0), 9) AS advisory_mean_cvss_to_date,
  COALESCE(d, (SELECT quantile_cont(d, 0.5) FROM s WHERE train)) AS swh_days FROM s""")
def impute_family(spark, sf_dir):
    observed = (F.col("entity") + F.col("window_index")) % 3 > 0
    rows = S.split_rows(_rows(spark, sf_dir), "time", B.TEST_START).withColumn(
        "swh_days", F.when(observed, F.col("advisory_days_since_latest_to_date")))
    columns = ["advisory_mean_cvss_to_date", "swh_days"]
    matrix = S.as_matrix(rows, columns, ["entity", "month", "split"])
    return B.rounded(S.impute(matrix, columns).drop("split"))


@register("ml_columns", f"""{_PANEL_SQL}
SELECT 'advisory_count_to_date' AS "column", count(*) AS n_rows, count(cnt) AS n_observed
  FROM panel WHERE y IS NOT NULL
UNION ALL SELECT 'advisory_mean_cvss_to_date', count(*), count(mean_cvss) FROM panel WHERE y IS NOT NULL
UNION ALL SELECT 'advisory_days_since_latest_to_date', count(*), count(days) FROM panel WHERE y IS NOT NULL
UNION ALL SELECT 'advisories_last_365d', count(*), count(last365) FROM panel WHERE y IS NOT NULL""")
def ml_columns(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    columns = [c for c in S.candidate_columns(rows, LABEL) if c in (
        "advisory_count_to_date", "advisory_mean_cvss_to_date",
        "advisory_days_since_latest_to_date", "advisories_last_365d")]
    return S.column_counts(rows, columns)


@register("family_projection", f"""{_PANEL_SQL}
SELECT entity, month, cnt AS advisory_count_to_date, y AS label_advisory_within_6m FROM panel""")
def family_projection(spark, sf_dir):
    kept = S.family_projection(_labelled(spark, sf_dir), ["advisory_"], keep_time_fields=False)
    return B.rounded(kept.select("entity", "month", "advisory_count_to_date", LABEL))


def _full(spark, sf_dir):
    """The complete supplier panel with labels, written once per query."""
    panel = labelled_panel(
        B.suppliers(spark, sf_dir), B.START, B.END, B.supplier_incidents(spark, sf_dir),
        A.activity_months(B.activity_events(spark, sf_dir)), B.supplier_visits(spark, sf_dir))
    return materialize(panel, "panel", many_columns=True)


def _train(spark, sf_dir, name):
    return M.train_model(_full(spark, sf_dir), name, test_start=B.TEST_START)


def _metrics(spark, trained):
    keys = ("model_name", "feature_count", "train_row_count", "test_row_count",
            "test_positive_count", "roc_auc", "average_precision")
    m = trained.metrics
    return spark.createDataFrame(
        [tuple(m[k] for k in keys)], "model_name STRING, feature_count INT, train_row_count LONG, "
        "test_row_count LONG, test_positive_count LONG, roc_auc DOUBLE, average_precision DOUBLE")


@register("train_logistic")
def train_logistic(spark, sf_dir):
    return _metrics(spark, _train(spark, sf_dir, "logistic"))


@register("train_forest")
def train_forest(spark, sf_dir):
    return _metrics(spark, _train(spark, sf_dir, "random_forest"))


@register("train_gbt")
def train_gbt(spark, sf_dir):
    return _metrics(spark, _train(spark, sf_dir, "xgboost"))


@register("drivers")
def drivers(spark, sf_dir):
    panel = _full(spark, sf_dir)
    columns = S.select_feature_columns(panel, LABEL)
    prepared = M.prepare(panel, LABEL, columns, strategy="time", test_start=B.TEST_START)
    trained = M.fit_and_score(prepared, columns, "logistic")
    return M.row_drivers(trained, prepared.where(F.col("split") == "test"))


@register("subset_study")
def subset_study(spark, sf_dir):
    panel = _full(spark, sf_dir)
    columns = S.select_feature_columns(panel, LABEL)
    prepared = M.prepare(panel, LABEL, columns, strategy="time", test_start=B.TEST_START)
    trained = M.fit_and_score(prepared, columns, "logistic")
    return M.subset_study(spark, prepared, trained)


def _ablation(model):
    def cells(spark, sf_dir):
        return M.ablation_grid(
            spark, _full(spark, sf_dir), [model], list(M.FAMILIES), ["time", "group_time"], B.TEST_START)

    cells.__name__ = f"ablation_{model}"
    cells.__doc__ = f"The 16 cells of one model of the 64-cell grid, with its full settings: {model}."
    return cells


for _model in M.MODEL_DEFAULTS:
    register(f"ablation_{_model}")(_ablation(_model))


@register("embargo_backtest")
def embargo_backtest(spark, sf_dir):
    panel = _full(spark, sf_dir)
    columns = S.select_feature_columns(panel, LABEL, prefixes=["advisory_"])
    return M.embargo_backtest(spark, panel, columns, "logistic", B.TEST_START,
                              ["1999-12", "1999-06", "1998-12"])


@register("compare_ecosystems")
def compare_ecosystems(spark, sf_dir):
    """The calendar-labelled customer panel as the second ecosystem, three incident features."""
    from riskpanel.operators.labels import calendar_panel
    from riskpanel.operators.panel import dense_grid

    grid = dense_grid(B.customers(spark, sf_dir), B.START, B.END)
    panel = materialize(calendar_panel(grid, B.customer_incidents(spark, sf_dir)), "calendar")
    columns = ["advisory_count_to_date", "advisory_cve_count_to_date", "advisory_max_cvss_to_date"]
    prepared = M.prepare(panel, LABEL, columns, strategy="time", test_start=B.TEST_START)
    return M.compare_models(spark, prepared, columns, list(M.MODEL_DEFAULTS))


@register("score_bundle")
def score_bundle(spark, sf_dir):
    from riskpanel.catalogue.bundle import _bundle

    panel = _full(spark, sf_dir)
    columns = S.select_feature_columns(panel, LABEL, prefixes=["advisory_", "advisories_", "swh_"])
    prepared, fills = M.prepare_with_fills(panel, LABEL, columns, strategy="time", test_start=B.TEST_START)
    trained = M.fit_and_score(prepared, columns, "logistic")
    path = scratch_path(spark, "artifacts")
    M.save_artifacts(trained, path, fills)
    scorer = M.load_scorer(spark, path)
    return M.score_with(scorer.pipeline, scorer.columns, _bundle(spark, sf_dir), "2001-08-31")


_COHORTS = ("releases", "team", "either", "commits")
_ODDS_TAIL = ORACLES["odds_ratios"].split("u AS (", 1)[1].replace(
    "['stale', 'busy', 'either', 'many']", str(list(_COHORTS))).replace(
    "[stale, busy, either, many]", f"[{', '.join(_COHORTS)}]")


@register("cohort_factors", f"""WITH {B.SUPPLIER_GRID_SQL}, {B.SUPPLIER_INCIDENTS_SQL}, {B.SUPPLIER_VISITS_SQL},
had AS (
  SELECT g.entity, g.month, g.window_index, count(i.incident_key) > 0 AS had FROM grid g LEFT JOIN incidents i
    ON i.entity = g.entity AND i.published BETWEEN g.window_start AND g.window_end GROUP BY ALL),
lab AS (SELECT entity, month, {_LABELS} FROM had),
rel AS (SELECT entity, month, {PX}months_since_release_tag AS m FROM ({ORACLES['staleness']})),
people AS (SELECT entity, month, {PX}unique_human_actors_trailing_6m AS n FROM ({ORACLES['rolling_sums']})),
best AS (SELECT g.entity, g.month, arg_max(v, (v.visit_day, v.visit)) AS v, any_value(g.window_end) AS window_end
  FROM grid g JOIN visits v ON v.entity = g.entity AND v.visit_day <= g.window_end GROUP BY g.entity, g.month),
days AS (SELECT entity, month, CASE WHEN v.days_since_last_commit IS NOT NULL THEN
  greatest(0, date_diff('day', v.visit_day, window_end) + CAST(floor(v.days_since_last_commit) AS BIGINT)) END AS d FROM best),
x AS (SELECT CASE WHEN l.month < '{B.TEST_START}' THEN 'train' ELSE 'test' END AS win,
    COALESCE(label_advisory_within_6m = 1, FALSE) AS pos, m >= 12 AS releases, n <= 2 AS team,
    CASE WHEN m IS NOT NULL AND n IS NOT NULL THEN m >= 12 OR n <= 2 END AS either, d >= 365 AS commits
  FROM lab l JOIN rel ON rel.entity = l.entity AND rel.month = l.month
  JOIN people p ON p.entity = l.entity AND p.month = l.month LEFT JOIN days ON days.entity = l.entity AND days.month = l.month),
u AS ({_ODDS_TAIL}
UNION ALL SELECT win, factor, n_rows, a, b, c, d, missing, NULL, NULL, NULL, NULL, NULL, NULL FROM o
WHERE a + b = 0 OR c + d = 0""")
def cohort_factors(spark, sf_dir):
    """Odds of the published cohorts: stale releases, small teams, either, and stale commits."""
    return C.odds_ratios(_full(spark, sf_dir), C.default_factors(), LABEL, B.TEST_START).drop("rate_ratio")
