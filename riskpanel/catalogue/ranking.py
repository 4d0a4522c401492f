"""Ranking evaluation queries over labelled documents as a prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import ORACLES, register
from riskpanel.catalogue.panel import _TO_DATE, _labelled
from riskpanel.operators import ranking as R
from riskpanel.session import materialize

_P = f"""WITH {B.PREDICTIONS_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY y_prob DESC, month, entity) AS rank,
        CAST(sum(y_true) OVER (ORDER BY y_prob DESC, month, entity) AS BIGINT) AS cum_tp FROM preds),
t AS (SELECT count(*) AS n, CAST(sum(y_true) AS BIGINT) AS p FROM preds),
best AS (SELECT entity, arg_min(month, (-y_prob, month)) AS month,
           arg_min(y_true, (-y_prob, month)) AS y_true, max(y_prob) AS y_prob FROM preds GROUP BY entity),
bt AS (SELECT count(*) AS n, CAST(sum(y_true) AS BIGINT) AS p FROM best)"""


def _ks(ks) -> str:
    return f"ks AS (SELECT CAST(unnest([{', '.join(map(str, ks))}]) AS BIGINT) AS k)"


def _top(k, y="y_true", source="r"):
    return f"(SELECT CAST(COALESCE(sum({y}), 0) AS BIGINT) FROM {source} WHERE rank <= {k})"


@register("precision_at_k", f"""{_P}, {_ks(K.PRECISION_KS)}
SELECT k, round({_top('k')} / CAST(k AS DOUBLE), 9) AS precision FROM ks, t WHERE k <= n""")
def precision_at_k(spark, sf_dir):
    return B.rounded(R.precision_at(B.predictions(spark, sf_dir)))


_OPER = f"""SELECT k, tp AS true_positives, k - tp AS false_positives,
  round_even(tp / CAST(k AS DOUBLE), 4) AS precision, round_even(tp / CAST(p AS DOUBLE), 4) AS recall,
  round_even((tp / CAST(k AS DOUBLE)) / (p / CAST(n AS DOUBLE)), 2) AS lift
FROM (SELECT k, {_top('k')} AS tp, n, p FROM ks, t WHERE k <= n)"""


@register("operational_table", f"{_P}, {_ks(K.OPERATIONAL_KS)} {_OPER}")
def operational_table(spark, sf_dir):
    return B.rounded(R.operational_table(B.predictions(spark, sf_dir)))


@register("scenarios", f"{_P}, {_ks([k for _, k in R.SCENARIOS])}, o AS ({_OPER}) SELECT CASE k "
          + " ".join(f"WHEN {k} THEN '{text}'" for text, k in R.SCENARIOS)
          + " END AS label, k, true_positives, precision, recall, lift FROM o")
def scenarios(spark, sf_dir):
    return B.rounded(R.scenarios(B.predictions(spark, sf_dir)))


@register("recall_targets", f"""{_P}, g AS (SELECT unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS target_recall),
f AS (SELECT target_recall, n, p, (SELECT min(rank) FROM r WHERE cum_tp >= ceil(target_recall * p)) AS k
      FROM g, t)
SELECT target_recall, k AS plugins_to_review, round_even(k / CAST(n AS DOUBLE) * 100, 1) AS pct_of_ecosystem,
  {_top('k')} AS true_positives, round_even({_top('k')} / CAST(k AS DOUBLE), 4) AS precision FROM f""")
def recall_targets(spark, sf_dir):
    return B.rounded(R.recall_targets(B.predictions(spark, sf_dir)))


@register("dedup_precision", f"""{_P}, {_ks(K.PRECISION_KS)},
br AS (SELECT *, row_number() OVER (ORDER BY y_prob DESC, month, entity) AS rank FROM best),
c AS (SELECT k, {_top('k', source='br')} AS tp, n, p FROM ks, bt WHERE k <= n)
SELECT ks.k, round({_top('ks.k')} / CAST(ks.k AS DOUBLE), 9) AS row_precision,
  (SELECT count(DISTINCT entity) FROM r WHERE rank <= ks.k) AS distinct_entities,
  c.tp AS true_positives, round_even(c.tp / CAST(c.k AS DOUBLE), 4) AS dedup_precision,
  round_even((c.tp / CAST(c.k AS DOUBLE)) / (c.p / CAST(c.n AS DOUBLE)), 2) AS lift,
  c.n AS n_components, c.p AS n_positive_components,
  round_even(c.p / CAST(c.n AS DOUBLE), 6) AS component_base_rate
FROM ks JOIN t ON ks.k <= t.n LEFT JOIN c ON c.k = ks.k""")
def dedup_precision(spark, sf_dir):
    return B.rounded(R.dedup_precision(B.predictions(spark, sf_dir)))


@register("precision_coverage", f"""{_P}
SELECT row_number() OVER w AS k, CAST(sum(y_true) OVER w AS BIGINT) AS cum_tp,
  round(sum(y_true) OVER w / CAST(row_number() OVER w AS DOUBLE), 9) AS precision,
  CASE WHEN p > 0 THEN round(sum(y_true) OVER w / CAST(p AS DOUBLE), 9) END AS coverage
FROM best, bt WINDOW w AS (ORDER BY y_prob DESC, entity)""")
def precision_coverage(spark, sf_dir):
    return B.rounded(R.precision_coverage(B.predictions(spark, sf_dir)))


_STEPS = f"""{_P}, h AS (SELECT y_prob, count(*) AS n, sum(y_true) AS pos FROM preds GROUP BY 1),
s AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos FROM h
      WINDOW w AS (ORDER BY y_prob DESC))"""


@register("roc_auc", f"""{_P}
SELECT round(avg(CASE WHEN a.y_prob > b.y_prob THEN 1.0 WHEN a.y_prob = b.y_prob THEN 0.5 ELSE 0 END), 9)
  AS roc_auc FROM preds a, preds b WHERE a.y_true = 1 AND b.y_true = 0""")
def roc_auc(spark, sf_dir):
    return B.rounded(R.ranking_quality(B.predictions(spark, sf_dir)).select("roc_auc"))


@register("average_precision", f"""{_STEPS}
SELECT round(sum(pos * (cum_pos / CAST(cum_n AS DOUBLE))) / CAST(any_value(t.p) AS DOUBLE), 9)
  AS average_precision FROM s, t""")
def average_precision(spark, sf_dir):
    return B.rounded(R.ranking_quality(B.predictions(spark, sf_dir)).select("average_precision"))


@register("pr_curve", f"""{_STEPS}
SELECT y_prob AS threshold, round(cum_pos / CAST(cum_n AS DOUBLE), 9) AS precision,
  round(cum_pos / CAST(t.p AS DOUBLE), 9) AS recall FROM s, t
UNION ALL SELECT NULL, 1.0, 0.0""")
def pr_curve(spark, sf_dir):
    return B.rounded(R.pr_curve(B.predictions(spark, sf_dir)))


@register("brier", f"""{_P}
SELECT count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positives, round(avg(y_true), 9) AS base_rate,
  round(avg(pow(y_prob - y_true, 2)), 9) AS brier_score,
  round(avg(pow((SELECT p / CAST(n AS DOUBLE) FROM t) - y_true, 2)), 9) AS brier_reference,
  round(1 - avg(pow(y_prob - y_true, 2))
    / avg(pow((SELECT p / CAST(n AS DOUBLE) FROM t) - y_true, 2)), 9) AS brier_skill_score
FROM preds""")
def brier(spark, sf_dir):
    return B.rounded(R.brier(B.predictions(spark, sf_dir)))


@register("reliability_bins", f"""{_P}
SELECT CAST(least(floor(y_prob * 10), 9) AS BIGINT) AS bin, count(*) AS n,
  round(avg(y_prob), 9) AS mean_probability, round(avg(y_true), 9) AS observed_rate
FROM preds GROUP BY 1""")
def reliability_bins(spark, sf_dir):
    return B.rounded(R.reliability_bins(B.predictions(spark, sf_dir)))


_CELLS = f"""{_P}, c AS (SELECT
  count(*) FILTER (WHERE y_true = 0 AND y_prob < 0.5) AS tn,
  count(*) FILTER (WHERE y_true = 0 AND y_prob >= 0.5) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_prob < 0.5) AS fn,
  count(*) FILTER (WHERE y_true = 1 AND y_prob >= 0.5) AS tp FROM preds)"""


@register("confusion", f"{_CELLS} SELECT tn, fp, fn, tp FROM c")
def confusion(spark, sf_dir):
    return R.confusion(B.predictions(spark, sf_dir))


@register("classification_report", f"""{_CELLS},
l AS (SELECT '0' AS label, tn AS a, fn AS w, fp AS m FROM c UNION ALL SELECT '1', tp, fp, fn FROM c),
q AS (SELECT label, CASE WHEN a + w > 0 THEN a / CAST(a + w AS DOUBLE) ELSE 0 END AS precision,
  CASE WHEN a + m > 0 THEN a / CAST(a + m AS DOUBLE) ELSE 0 END AS recall, a + m AS support FROM l),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0 END AS f1 FROM q)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support
FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
  CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
  round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
  CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark, sf_dir):
    return B.rounded(R.classification_report(B.predictions(spark, sf_dir)))


MONTH = "2000-06"


def _snapshot(spark, sf_dir):
    """One month of the customer panel, and a deterministic model score for it."""
    month = _labelled(spark, sf_dir).where(F.col("month") == MONTH)
    # written once: the comparisons read it several times, and each would build the panel of all months again
    snapshot = materialize(month.select(
        "entity", F.col("advisory_count_to_date").alias("advisory_count"),
        (F.col("label_advisory_within_6m") == 1).alias("positive")), "snapshot")
    preds = snapshot.select(
        "entity", F.lit(MONTH).alias("month"), F.col("positive").cast("int").alias("y_true"),
        (F.col("entity") * 7919 % 1000 / 1000).alias("y_prob"))
    return snapshot, preds


_MONTH_SQL = f"""{_TO_DATE},
snap AS (SELECT g.entity, count(i.incident_key) FILTER (WHERE i.published <= g.window_end) AS n,
  count(i.incident_key) FILTER (WHERE i.published > g.window_end AND i.published < g.window_start
    + INTERVAL 7 MONTH) > 0 AS positive
  FROM grid g LEFT JOIN incidents i ON i.entity = g.entity WHERE g.month = '{MONTH}' GROUP BY g.entity),
m AS (SELECT entity, positive, n, row_number() OVER (ORDER BY CAST(entity * 7919 % 1000 AS DOUBLE) / 1000
  DESC, entity) AS rank, row_number() OVER (ORDER BY n DESC, entity) AS hrank FROM snap),
f AS (SELECT count(*) AS e, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE n >= 1) AS b,
  count(*) FILTER (WHERE n >= 1 AND positive) AS rtp FROM snap)"""


@register("flag_rule_vs_rank", f"""{_MONTH_SQL},
s AS (SELECT 'rule' AS method, b AS n, rtp AS tp, e, p FROM f UNION ALL
  SELECT 'model', (SELECT count(*) FROM m WHERE rank <= b),
    (SELECT count(*) FROM m WHERE rank <= b AND positive), e, p FROM f)
SELECT method, n, tp AS true_positives, round_even(tp / CAST(n AS DOUBLE), 4) AS precision,
  round_even(tp / CAST(p AS DOUBLE), 4) AS coverage,
  round_even((tp / CAST(n AS DOUBLE)) / (p / CAST(e AS DOUBLE)), 1) AS lift FROM s""")
def flag_rule_vs_rank(spark, sf_dir):
    return B.rounded(R.flag_rule_comparison(*_snapshot(spark, sf_dir)))


@register("heuristic_vs_model", f"""{_MONTH_SQL}, {_ks(K.PRECISION_KS)},
h AS (SELECT k, p, (SELECT count(*) FROM m WHERE hrank <= k AND positive) AS a,
  (SELECT count(*) FROM m WHERE rank <= k AND positive) AS b FROM ks, f WHERE k <= e)
SELECT k, round_even(a / CAST(k AS DOUBLE), 4) AS heuristic_precision,
  round_even(a / CAST(p AS DOUBLE), 4) AS heuristic_coverage,
  round_even(b / CAST(k AS DOUBLE), 4) AS model_precision,
  round_even(b / CAST(p AS DOUBLE), 4) AS model_coverage FROM h""")
def heuristic_vs_model(spark, sf_dir):
    return B.rounded(R.heuristic_vs_model(*_snapshot(spark, sf_dir)))


@register("tie_groups", f"""{_MONTH_SQL}
SELECT n AS advisory_count, count(*) AS n_entities FROM snap WHERE n >= 1 GROUP BY n
ORDER BY n DESC LIMIT 5""")
def tie_groups(spark, sf_dir):
    return R.tie_groups(_snapshot(spark, sf_dir)[0])


@register("case_study", f"""{_MONTH_SQL},
w AS (SELECT entity, arg_min(published, (-cvss, published)) AS adv_date, max(cvss) AS adv_cvss
  FROM incidents WHERE strftime(published, '%Y-%m-%d') > '{MONTH}'
    AND published <= DATE '2000-12-31' GROUP BY entity)
SELECT rank, m.entity, CAST(m.entity * 7919 % 1000 AS DOUBLE) / 1000 AS score,
  positive OR w.entity IS NOT NULL AS confirmed, adv_date, adv_cvss,
  date_diff('day', DATE '{MONTH}-01', adv_date) AS days_to_adv
FROM m LEFT JOIN w ON w.entity = m.entity WHERE rank <= 25""")
def case_study(spark, sf_dir):
    preds = _snapshot(spark, sf_dir)[1]
    return B.rounded(R.case_study(preds, B.customer_incidents(spark, sf_dir), MONTH))


def _variants(spark, sf_dir):
    preds = B.predictions(spark, sf_dir)
    doc = F.col("month").cast("long")
    left = preds.where(doc % 10 != 1)
    right = preds.where(doc % 10 != 2).select(
        "entity", "month", F.when(doc % 7 == 0, 1 - F.col("y_true")).otherwise(F.col("y_true"))
        .alias("y_true"), (F.col("y_prob") * 0.5).alias("y_prob"))
    return left, right


@register("reconcile", f"""{_P},
a AS (SELECT * FROM preds WHERE CAST(month AS BIGINT) % 10 <> 1),
b AS (SELECT entity, month, CASE WHEN CAST(month AS BIGINT) % 7 = 0 THEN 1 - y_true ELSE y_true END AS y_true,
  y_prob * 0.5::DOUBLE AS y_prob FROM preds WHERE CAST(month AS BIGINT) % 10 <> 2)
SELECT count(*) FILTER (WHERE b.month IS NULL) AS only_left,
  count(*) FILTER (WHERE a.month IS NULL) AS only_right,
  count(*) FILTER (WHERE a.month IS NOT NULL AND b.month IS NOT NULL) AS in_both,
  count(*) FILTER (WHERE a.y_true <> b.y_true) AS label_disagreements,
  round(max(abs(a.y_prob - b.y_prob)), 9) AS max_abs_diff
FROM a FULL JOIN b ON a.entity = b.entity AND a.month = b.month""")
def reconcile(spark, sf_dir):
    return B.rounded(R.reconcile(*_variants(spark, sf_dir)))


@register("key_set_counts", f"""{_P},
a AS (SELECT DISTINCT entity, y_true FROM preds WHERE CAST(month AS BIGINT) % 10 <> 1),
b AS (SELECT DISTINCT entity, CASE WHEN CAST(month AS BIGINT) % 7 = 0 THEN 1 - y_true ELSE y_true END AS y_true
  FROM preds WHERE CAST(month AS BIGINT) % 10 <> 2)
SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_left,
  (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_right,
  (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS shared""")
def key_set_counts(spark, sf_dir):
    return R.key_set_counts(*_variants(spark, sf_dir), ["entity", "y_true"])


@register("duplicate_audit", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_duplicated_keys
FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, strftime(o_orderdate, '%Y-%m'))""")
def duplicate_audit(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").select(
        "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return R.duplicate_key_audit(orders, ["o_custkey", "month"])


def _runs(spark, sf_dir, shift):
    """Per-language metrics of the labelled documents, as the metrics of named runs."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = B.table(spark, sf_dir, "labels").join(docs, "doc_id")
    kept = rows if shift else rows.where(F.col("source") != "src1")
    return kept.groupBy(F.col("source").alias("model")).agg(
        (F.sum("quality") / F.count(F.lit(1))).alias("average_precision"),
        ((F.sum("toxic") + shift) / F.count(F.lit(1))).alias("roc_auc"))


_RUNS = """r AS (SELECT source AS model, sum(quality) AS q, sum(toxic) AS x, CAST(count(*) AS DOUBLE) AS n
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY source)"""


@register("metric_diff", f"""WITH {_RUNS}
SELECT model, CASE WHEN model <> 'src1' THEN round(q / n, 9) END AS average_precision_before,
  round(q / n, 9) AS average_precision_after,
  CASE WHEN model <> 'src1' THEN 0.0::DOUBLE END AS average_precision_delta,
  CASE WHEN model <> 'src1' THEN round(x / n, 9) END AS roc_auc_before,
  round((x + 1) / n, 9) AS roc_auc_after,
  CASE WHEN model <> 'src1' THEN round_even((x + 1) / n - x / n, 4) END AS roc_auc_delta
FROM r""")
def metric_diff(spark, sf_dir):
    return B.rounded(R.metric_diff(_runs(spark, sf_dir, 0), _runs(spark, sf_dir, 1)))


@register("largest_movers", f"""SELECT model, average_precision_delta FROM ({ORACLES['metric_diff']})
WHERE average_precision_delta IS NOT NULL ORDER BY abs(average_precision_delta) DESC, model LIMIT 5""")
def largest_movers(spark, sf_dir):
    return R.largest_movers(metric_diff(spark, sf_dir))


@register("metric_table", f"""WITH {_RUNS}
SELECT model AS run, CAST(n AS BIGINT) AS features, CAST(n AS BIGINT) AS train_rows,
  CASE WHEN x > 0 THEN CAST(x AS BIGINT) ELSE 0 END AS train_pos,
  round(q / n, 9) AS avg_prec, round(x / n, 9) AS p_at_10
FROM r""")
def metric_table(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = B.table(spark, sf_dir, "labels").join(docs, "doc_id")
    per = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("x"),
        (F.sum("quality") / F.count(F.lit(1))).alias("ap"))
    old = F.to_json(F.struct(
        F.col("n").alias("n_features"), F.col("n").alias("train_rows"),
        F.col("x").alias("train_positives"), F.col("ap").alias("avg_precision"),
        (F.col("x") / F.col("n")).alias("precision_at_10")))
    new = F.to_json(F.struct(
        F.col("n").alias("feature_count"), F.col("n").alias("train_row_count"),
        F.col("x").alias("train_positive_count"), F.col("ap").alias("average_precision"),
        F.struct((F.col("x") / F.col("n")).alias("precision_at_10")).alias("ranking_metrics")))
    documents = per.select(
        F.col("source").alias("run"), F.when(F.col("n") % 2 == 0, new).otherwise(old).alias("payload"))
    return B.rounded(R.metric_table(documents).select(
        "run", "features", "train_rows", "train_pos", "avg_prec", "p_at_10"))
