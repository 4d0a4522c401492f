"""Cohort queries over the customer panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import register
from riskpanel.catalogue.panel import _LABELS, _TO_DATE, _labelled
from riskpanel.operators import cohort as C

LABEL = "label_advisory_within_6m"


def _panel(spark, sf_dir):
    return _labelled(spark, sf_dir).select(
        "entity", "month", "window_index", LABEL, "advisory_count_to_date",
        "advisory_days_since_latest_to_date", "advisory_mean_cvss_to_date",
        "advisories_last_365d")


_PANEL_SQL = f"""{_TO_DATE},
lab AS (SELECT entity, month, window_index, {_LABELS} FROM had),
feat AS (SELECT entity, month, count(published) AS cnt,
  date_diff('day', max(published), max(window_end)) AS days, avg(cvss) AS mean_cvss,
  CASE WHEN count(published) > 0 THEN count(published) FILTER
    (WHERE date_diff('day', published, window_end) <= 365) END AS last365
  FROM todate GROUP BY entity, month),
panel AS (SELECT l.entity, l.month, l.window_index, label_advisory_within_6m AS y, cnt, days, mean_cvss,
  last365 FROM lab l JOIN feat f ON f.entity = l.entity AND f.month = l.month)"""


def _factors():
    stale = F.col("advisory_days_since_latest_to_date") >= 365
    busy = F.col("advisories_last_365d") >= 2
    return {"stale": stale, "busy": busy,
            "either": F.when(stale.isNotNull() & busy.isNotNull(), stale | busy),
            "many": F.col("advisory_count_to_date") >= 3}


_ODDS = """round_even(odds, 3) AS odds_ratio, round_even(exp(ln(odds) - se), 3) AS ci_low,
  round_even(exp(ln(odds) + se), 3) AS ci_high"""


@register("odds_ratios", f"""{_PANEL_SQL},
x AS (SELECT CASE WHEN month < '{B.TEST_START}' THEN 'train' ELSE 'test' END AS win,
  COALESCE(y = 1, FALSE) AS pos, days >= 365 AS stale, last365 >= 2 AS busy,
  CASE WHEN days IS NOT NULL AND last365 IS NOT NULL THEN days >= 365 OR last365 >= 2 END AS either,
  cnt >= 3 AS many FROM panel),
u AS (SELECT win, pos, unnest(['stale', 'busy', 'either', 'many']) AS factor,
        unnest([stale, busy, either, many]) AS e FROM x),
g AS (SELECT COALESCE(win, 'all') AS win, factor, count(*) AS n_rows,
  count(*) FILTER (WHERE e AND pos) AS a, count(*) FILTER (WHERE e AND NOT pos) AS b,
  count(*) FILTER (WHERE NOT e AND pos) AS c, count(*) FILTER (WHERE NOT e AND NOT pos) AS d,
  count(*) FILTER (WHERE e IS NULL) AS missing
  FROM u GROUP BY GROUPING SETS ((win, factor), (factor))),
o AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0 END AS z FROM g),
q AS (SELECT *, ((a + z) * (d + z)) / CAST((b + z) * (c + z) AS DOUBLE) AS odds,
  1.96 * sqrt(1 / CAST(a + z AS DOUBLE) + 1 / CAST(b + z AS DOUBLE) + 1 / CAST(c + z AS DOUBLE)
    + 1 / CAST(d + z AS DOUBLE)) AS se FROM o WHERE a + b > 0 AND c + d > 0)
SELECT win AS "window", factor, n_rows, a AS exposed_pos, b AS exposed_neg, c AS unexposed_pos,
  d AS unexposed_neg, missing AS rows_excluded_missing,
  round_even(a / CAST(a + b AS DOUBLE), 5) AS exposed_rate,
  round_even(c / CAST(c + d AS DOUBLE), 5) AS unexposed_rate, {_ODDS},
  exp(ln(odds) - se) >= 1 AND odds >= 1.5 AS criterion_met FROM q""")
def odds_ratios(spark, sf_dir):
    return C.odds_ratios(_panel(spark, sf_dir), _factors(), LABEL, B.TEST_START).drop("rate_ratio")


@register("stratified_rates", f"""{_PANEL_SQL},
x AS (SELECT days >= 365 AS e, COALESCE(y = 1, FALSE) AS pos, cnt AS att FROM panel
      WHERE days IS NOT NULL AND month < '{B.TEST_START}'),
nz AS (SELECT att, row_number() OVER (ORDER BY att) - 1 AS i, count(*) OVER () AS n FROM x WHERE att > 0),
med AS (SELECT max(att) AS m FROM nz WHERE i = n // 2),
s AS (SELECT CASE WHEN att <= 0 THEN 'none' WHEN att <= m THEN 'lower' ELSE 'higher' END AS stratum, *
      FROM x, med),
g AS (SELECT COALESCE(stratum, 'pooled') AS stratum, max(m) AS m, count(*) AS n,
  count(*) FILTER (WHERE e AND pos) AS a, count(*) FILTER (WHERE e AND NOT pos) AS b,
  count(*) FILTER (WHERE NOT e AND pos) AS c, count(*) FILTER (WHERE NOT e AND NOT pos) AS d
  FROM s GROUP BY GROUPING SETS ((stratum), ())),
q AS (SELECT *, (a * d) / CAST(b * c AS DOUBLE) AS odds, 1.96 * sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)
  AS se FROM g)
SELECT stratum, CAST(m AS DOUBLE) AS median_nonzero_attention, n, a AS exposed_pos, b AS exposed_neg,
  c AS unexposed_pos, d AS unexposed_neg, round_even(a / CAST(a + b AS DOUBLE), 5) AS exposed_rate,
  round_even(c / CAST(c + d AS DOUBLE), 5) AS unexposed_rate,
  round_even((a / CAST(a + b AS DOUBLE)) / (c / CAST(c + d AS DOUBLE)), 3) AS rate_ratio, {_ODDS}
FROM q""")
def stratified_rates(spark, sf_dir):
    train = _panel(spark, sf_dir).where(F.col("month") < B.TEST_START)
    stale = F.col("advisory_days_since_latest_to_date") >= 365
    return C.stratified_rates(train, stale, "advisory_count_to_date", LABEL)


FEATURES = {"advisory_count_to_date": "cnt", "days": "days", "flag": "flag"}


def _contributions(spark, sf_dir):
    """Linear-style contributions, with the days feature imputed where it was never observed."""
    p = _panel(spark, sf_dir)
    days = F.col("advisory_days_since_latest_to_date")
    noise = (F.col("entity") * 7 + F.col("window_index") * 3) % 11
    return p.select(
        F.col("advisory_count_to_date"), F.coalesce(days, F.lit(500)).alias("days"),
        days.isNull().alias("days_missing"), (F.col("window_index") % 3).alias("flag"),
        (F.col("advisory_count_to_date") * 2 + noise).cast("double")
        .alias("advisory_count_to_date_contrib"),
        (F.coalesce(days, F.lit(500)) * -1 + noise).cast("double").alias("days_contrib"),
        noise.cast("double").alias("flag_contrib"))


_LONG_SQL = f"""{_PANEL_SQL},
raw AS (SELECT cnt, COALESCE(days, 500) AS days, days IS NULL AS miss, window_index % 3 AS flag,
  (entity * 7 + window_index * 3) % 11 AS noise FROM panel),
long AS (
  SELECT 'advisory_count_to_date' AS feature, CAST(cnt AS DOUBLE) AS x,
    CAST(cnt * 2 + noise AS DOUBLE) AS s, FALSE AS miss FROM raw
  UNION ALL SELECT 'days', days, noise - days, miss FROM raw
  UNION ALL SELECT 'flag', flag, noise, FALSE FROM raw)"""


@register("value_corr", f"""{_LONG_SQL}
SELECT feature, CASE WHEN feature LIKE 'advisory%' THEN 'Advisory History' ELSE 'Other' END AS family,
  round_even(avg(abs(s)), 4) AS mean_abs_contribution, round_even(corr(x, s), 3) AS value_corr,
  CASE WHEN corr(x, s) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
  abs(corr(x, s)) < 0.2 AS direction_weak FROM long GROUP BY feature""")
def value_corr(spark, sf_dir):
    return C.value_correlations(_contributions(spark, sf_dir), list(FEATURES))


_PROFILE_SQL = f"""{_LONG_SQL},
st AS (SELECT feature, count(DISTINCT x) AS nd, min(x) AS mn, count(*) AS n, avg(CASE WHEN miss THEN 1.0 ELSE 0 END) AS ms
  FROM long GROUP BY feature),
st2 AS (SELECT st.*, (SELECT count(*) FROM long l WHERE l.feature = st.feature AND l.x = st.mn) AS nmin FROM st),
md AS (SELECT *, CASE WHEN nd <= 6 THEN 'each' WHEN nmin / CAST(n AS DOUBLE) > 0.5 THEN 'minimum' ELSE 'fifths' END
  AS mode FROM st2),
e0 AS (SELECT l.feature, 'fifths' AS k, quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q
  FROM long l JOIN md USING (feature) WHERE mode = 'fifths' GROUP BY l.feature
  UNION ALL SELECT l.feature, 'minimum', quantile_cont(x, [0, 1.0 / 3, 2.0 / 3, 1.0])
  FROM long l JOIN md USING (feature) WHERE mode = 'minimum' AND x <> mn GROUP BY l.feature
  UNION ALL SELECT l.feature, 'observed', quantile_cont(x, [0, 0.25, 0.5, 0.75, 1.0])
  FROM long l JOIN md USING (feature) WHERE ms > 0.1 AND NOT l.miss GROUP BY l.feature),
e AS (SELECT feature, k, list_sort(list_distinct(q)) AS q FROM e0),
pl AS (
  SELECT feature, 'all' AS scope, dense_rank() OVER (PARTITION BY feature ORDER BY x) - 1 AS bin, x AS lo, x AS hi, s
  FROM long JOIN md USING (feature) WHERE mode = 'each'
  UNION ALL SELECT feature, 'all', 0, x, x, s FROM long JOIN md USING (feature) WHERE mode = 'minimum' AND x = mn
  UNION ALL SELECT feature, 'all', b + 1, q[b + 1], q[b + 2], s FROM (SELECT l.feature, s, q,
    greatest(0, least(len(list_filter(q, lambda v: v <= x)) - 1, len(q) - 2)) AS b
    FROM long l JOIN md USING (feature) JOIN e ON e.feature = l.feature AND k = 'minimum'
    WHERE mode = 'minimum' AND x <> mn AND len(q) >= 2)
  UNION ALL SELECT feature, 'all', b, q[b + 1], q[b + 2], s FROM (SELECT l.feature, s, q,
    greatest(0, least(len(list_filter(q, lambda v: v <= x)) - 1, len(q) - 2)) AS b
    FROM long l JOIN e ON e.feature = l.feature AND k = 'fifths' WHERE len(q) >= 3)
  UNION ALL SELECT feature, 'observed', b, q[b + 1], q[b + 2], s FROM (SELECT l.feature, s, q,
    greatest(0, least(len(list_filter(q, lambda v: v <= x)) - 1, len(q) - 2)) AS b
    FROM long l JOIN e ON e.feature = l.feature AND k = 'observed' WHERE NOT l.miss AND len(q) >= 3))
SELECT feature, scope, CAST(bin AS BIGINT) AS bin, round(min(lo), 6) AS value_lo, round(max(hi), 6) AS value_hi,
  count(*) AS n, round_even(sum(s) / count(*), 4) AS mean_contribution
FROM pl GROUP BY feature, scope, bin HAVING count(*) >= 5"""


@register("binned_profile", _PROFILE_SQL)
def binned_profile(spark, sf_dir):
    profiles = C.binned_profiles(_contributions(spark, sf_dir), list(FEATURES))
    return B.rounded(profiles, 6)


@register("profile_shape", f"""WITH profiles AS ({_PROFILE_SQL}),
steps AS (SELECT feature, mean_contribution - lag(mean_contribution)
            OVER (PARTITION BY feature ORDER BY bin) AS step FROM profiles WHERE scope = 'all')
SELECT feature, CASE WHEN count(*) < 3 THEN NULL WHEN min(step) >= -1e-9 THEN 'increasing'
  WHEN max(step) <= 1e-9 THEN 'decreasing' ELSE 'non-monotone' END AS bin_shape
FROM steps GROUP BY feature""")
def profile_shape(spark, sf_dir):
    return C.profile_shapes(C.binned_profiles(_contributions(spark, sf_dir), list(FEATURES)))


@register("importance_consistency", """
WITH i AS (SELECT l_suppkey AS run, 'swh_f' || CAST(l_partkey % 9 AS VARCHAR) AS feature,
  CASE WHEN (l_suppkey + l_partkey) % 3 = 0 THEN 'decreasing' ELSE 'increasing' END AS direction,
  CAST(l_partkey % 100 AS DOUBLE) / 8 AS magnitude FROM lineitem),
p AS (SELECT feature, direction, count(*) AS models, round_even(avg(magnitude), 4) AS avg_magnitude
      FROM i GROUP BY ALL)
SELECT a.feature, 'Software Heritage' AS family, a.direction, a.models, a.avg_magnitude,
  COALESCE(b.models, 0) AS models_opposite_direction,
  COALESCE(b.models, 0) >= a.models AS direction_conflict
FROM p a LEFT JOIN p b ON b.feature = a.feature AND b.direction <> a.direction""")
def importance_consistency(spark, sf_dir):
    part = F.col("l_partkey")
    rows = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run"),
        F.concat(F.lit("swh_f"), (part % 9).cast("string")).alias("feature"),
        F.when((F.col("l_suppkey") + part) % 3 == 0, "decreasing").otherwise("increasing")
        .alias("direction"), (part % 100 / 8).alias("magnitude"))
    return C.importance_consistency(rows)
