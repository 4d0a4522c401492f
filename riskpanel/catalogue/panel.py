"""Panel, label and density queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import register
from riskpanel.operators import labels as L
from riskpanel.operators import panel as P

KEYS = ("entity", "month")


def _incident_panel(spark, sf_dir):
    grid = P.dense_grid(B.customers(spark, sf_dir), B.START, B.END)
    return P.incident_panel(grid, B.customer_incidents(spark, sf_dir))


def _labelled(spark, sf_dir):
    return L.attach_labels(_incident_panel(spark, sf_dir))


_WITH = f"WITH {B.CUSTOMER_GRID_SQL}, {B.CUSTOMER_INCIDENTS_SQL}"
# per grid row: everything a theta join of incidents published up to the month end gives
_TO_DATE = f"""{_WITH},
todate AS (
  SELECT g.entity, g.month, g.window_index, g.window_start, g.window_end, i.published, i.cvss,
         i.cve_ids, i.incident_key
  FROM grid g LEFT JOIN incidents i ON i.entity = g.entity AND i.published <= g.window_end),
had AS (
  SELECT g.entity, g.month, g.window_index,
         count(i.incident_key) AS n, count(i.incident_key) > 0 AS had
  FROM grid g LEFT JOIN incidents i
    ON i.entity = g.entity AND i.published BETWEEN g.window_start AND g.window_end
  GROUP BY ALL)"""


@register("panel_grid", f"""WITH {B.CUSTOMER_GRID_SQL}
SELECT entity, month, window_start, window_end, CAST(year(window_start) AS BIGINT) AS window_year,
       CAST(month(window_start) AS BIGINT) AS window_month, CAST(window_index AS BIGINT) AS window_index
FROM grid""")
def panel_grid(spark, sf_dir):
    grid = P.dense_grid(B.customers(spark, sf_dir), B.START, B.END)
    return B.rounded(grid.select("entity", *P.GRID_COLUMNS))


@register("panel_to_date", f"""{_TO_DATE}
SELECT entity, month, count(published) > 0 AS advisories_present_any,
  count(published) AS advisory_count_to_date,
  count(published) FILTER (WHERE published >= window_start) AS advisory_count_this_month,
  count(published) FILTER (WHERE published >= window_start) > 0 AS had_advisory_this_month,
  max(cvss) AS advisory_max_cvss_to_date,
  date_diff('day', min(published), max(window_end)) AS advisory_days_since_first_to_date,
  date_diff('day', max(published), max(window_end)) AS advisory_days_since_latest_to_date,
  date_diff('day', min(published), max(published)) AS advisory_span_days_to_date,
  CASE WHEN count(published) > 0 THEN count(published) FILTER (WHERE cvss >= 7) END
    AS advisory_cvss_ge_7_count_to_date,
  round(avg(cvss), 9) AS advisory_mean_cvss_to_date
FROM todate GROUP BY entity, month""")
def panel_to_date(spark, sf_dir):
    panel = _incident_panel(spark, sf_dir)
    kept = [c for c in P.incident_features() if c not in (
        "advisories_last_365d", "advisory_cve_count_to_date")]
    return B.rounded(panel.select(*KEYS, *kept))


@register("panel_cve_to_date", f"""{_TO_DATE}
SELECT g.entity, g.month, count(DISTINCT cve) AS advisory_cve_count_to_date
FROM grid g LEFT JOIN (SELECT entity, month, unnest(cve_ids) AS cve FROM todate) c
  ON c.entity = g.entity AND c.month = g.month
GROUP BY g.entity, g.month""")
def panel_cve_to_date(spark, sf_dir):
    return B.rounded(_incident_panel(spark, sf_dir).select(*KEYS, "advisory_cve_count_to_date"))


@register("panel_trailing_365d", f"""{_TO_DATE}
SELECT entity, month, CASE WHEN count(published) > 0 THEN
  count(published) FILTER (WHERE date_diff('day', published, window_end) <= 365) END
    AS advisories_last_365d
FROM todate GROUP BY entity, month""")
def panel_trailing_365d(spark, sf_dir):
    return B.rounded(_incident_panel(spark, sf_dir).select(*KEYS, "advisories_last_365d"))


_LABELS = ", ".join(
    f"CASE WHEN window_index + {h} > 79 THEN NULL ELSE max(CAST(had AS BIGINT)) OVER (PARTITION BY"
    f" entity ORDER BY window_index ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END"
    f" AS label_advisory_within_{h}m" for h in K.LABEL_HORIZONS
)


@register("panel_labels_1_3_6_12", f"{_TO_DATE} SELECT entity, month, {_LABELS} FROM had")
def panel_labels(spark, sf_dir):
    return B.rounded(_labelled(spark, sf_dir).select(
        *KEYS, *[f"label_advisory_within_{h}m" for h in K.LABEL_HORIZONS]
    ))


@register("panel_next_incident", f"""{_TO_DATE}
SELECT entity, month,
  CAST(min(CASE WHEN had THEN window_index END) OVER later - window_index AS BIGINT)
    AS months_until_next_advisory,
  count(*) FILTER (WHERE had) OVER later AS future_advisory_count
FROM had
WINDOW later AS (PARTITION BY entity ORDER BY window_index
                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def panel_next_incident(spark, sf_dir):
    return B.rounded(_labelled(spark, sf_dir).select(
        *KEYS, "months_until_next_advisory", "future_advisory_count"
    ))


@register("label_summary", f"""{_TO_DATE}, labelled AS (SELECT {_LABELS} FROM had)
""" + " UNION ALL ".join(
    f"SELECT CAST({h} AS BIGINT) AS horizon, count(label_advisory_within_{h}m) AS non_null,"
    f" count(*) FILTER (WHERE label_advisory_within_{h}m = 1) AS positive, count(*) AS n_rows"
    f" FROM labelled" for h in K.LABEL_HORIZONS
))
def label_summary(spark, sf_dir):
    return B.rounded(L.label_summary(_labelled(spark, sf_dir)))


@register("label_base_rate_by_month", f"""{_TO_DATE}, labelled AS (SELECT month, {_LABELS} FROM had)
SELECT month, count(label_advisory_within_6m) AS n_labelled,
  CAST(sum(label_advisory_within_6m) AS BIGINT) AS n_positive,
  round(avg(label_advisory_within_6m), 9) AS base_rate
FROM labelled GROUP BY month""")
def label_base_rate_by_month(spark, sf_dir):
    label = F.col("label_advisory_within_6m")
    return B.rounded(_labelled(spark, sf_dir).groupBy("month").agg(
        F.count(label).alias("n_labelled"), F.sum(label).alias("n_positive"),
        F.avg(label).alias("base_rate"),
    ))


@register("panel_summary", f"""{_TO_DATE}
SELECT count(*) AS rows_total, count(DISTINCT entity) AS entities_total,
  count(DISTINCT month) AS months_total,
  count(*) FILTER (WHERE had) AS rows_with_advisory_this_month
FROM had""")
def panel_summary(spark, sf_dir):
    from riskpanel.sources.writers import panel_summary as summary

    wanted = ("rows_total", "entities_total", "months_total", "rows_with_advisory_this_month")
    return summary(_incident_panel(spark, sf_dir)).select(*wanted)


@register("density_violations", """
WITH m AS (SELECT o_custkey AS entity, strftime(o_orderdate, '%Y-%m') AS month,
                  year(o_orderdate) * 12 + month(o_orderdate) AS n FROM orders),
     l AS (SELECT entity, month, n, lag(month) OVER w AS previous_month, lag(n) OVER w AS p
           FROM m WINDOW w AS (PARTITION BY entity ORDER BY n))
SELECT entity, previous_month, month,
  CASE WHEN n = p THEN 'duplicate' ELSE 'gap' END AS violation,
  CAST(n - p - 1 AS BIGINT) AS missing_months
FROM l WHERE p IS NOT NULL AND n - p <> 1""")
def density_violations(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.date_format("o_orderdate", "yyyy-MM").alias("month")
    )
    return B.rounded(L.density_violations(orders))


@register("calendar_label_variant", f"""{_WITH},
m AS (SELECT *, year(published) * 12 + month(published) - 1 AS no FROM incidents)
SELECT g.entity, g.month, count(b.incident_key) AS advisory_count_to_date,
  max(b.cvss) AS advisory_max_cvss_to_date,
  (SELECT count(DISTINCT c.cve) FROM (SELECT entity, no, unnest(cve_ids) AS cve FROM m) c
   WHERE c.entity = g.entity AND c.no < g.month_no) AS advisory_cve_count_to_date,
  CAST(EXISTS (SELECT 1 FROM m f WHERE f.entity = g.entity
               AND f.no BETWEEN g.month_no + 1 AND g.month_no + 6) AS BIGINT)
    AS label_advisory_within_6m
FROM grid g LEFT JOIN m b ON b.entity = g.entity AND b.no < g.month_no
GROUP BY g.entity, g.month, g.month_no""")
def calendar_label_variant(spark, sf_dir):
    grid = P.dense_grid(B.customers(spark, sf_dir), B.START, B.END)
    return B.rounded(L.calendar_panel(grid, B.customer_incidents(spark, sf_dir)).select(
        *KEYS, "advisory_count_to_date", "advisory_max_cvss_to_date",
        "advisory_cve_count_to_date", "label_advisory_within_6m",
    ))


_ASOF_COLUMNS = [
    "swh_present_any", "swh_origin_found", "swh_has_snapshot_to_date", "swh_visit_count_to_date",
    "swh_visits_this_month", "swh_visits_last_365d", "swh_latest_visit_date_to_date",
    "swh_archive_age_days_to_date", "swh_has_readme", "swh_has_security_md",
    "swh_has_github_actions", "swh_has_snyk_config", "swh_top_level_entry_count",
    "swh_commit_count", "swh_days_since_last_commit", "swh_weekend_commit_fraction",
]


@register("asof_visit", f"""WITH {B.CUSTOMER_GRID_SQL}, {B.CUSTOMER_VISITS_SQL},
seen AS (SELECT DISTINCT entity FROM visits),
best AS (
  SELECT g.entity, g.month, arg_max(v, (v.visit_day, v.visit)) AS v, count(v.visit) AS n,
    min(v.visit_day) AS first_day, max(v.visit_day) AS last_day,
    count(v.visit) FILTER (WHERE v.visit_day >= g.window_start) AS this_month,
    count(v.visit) FILTER (WHERE date_diff('day', v.visit_day, g.window_end) <= 365) AS last_365
  FROM grid g JOIN visits v ON v.entity = g.entity AND v.visit_day <= g.window_end
  GROUP BY g.entity, g.month)
SELECT g.entity, g.month, s.entity IS NOT NULL AS swh_present_any,
  s.entity IS NOT NULL AS swh_origin_found, COALESCE(b.n, 0) > 0 AS swh_has_snapshot_to_date,
  COALESCE(b.n, 0) AS swh_visit_count_to_date, COALESCE(this_month, 0) AS swh_visits_this_month,
  COALESCE(last_365, 0) AS swh_visits_last_365d, b.last_day AS swh_latest_visit_date_to_date,
  date_diff('day', b.first_day, b.last_day) AS swh_archive_age_days_to_date,
  COALESCE(b.v.has_readme, FALSE) AS swh_has_readme,
  COALESCE(b.v.has_security_md, FALSE) AS swh_has_security_md,
  COALESCE(b.v.has_github_actions, FALSE) AS swh_has_github_actions,
  FALSE AS swh_has_snyk_config,
  CAST(COALESCE(b.v.top_level_entry_count, 0) AS BIGINT) AS swh_top_level_entry_count,
  CAST(COALESCE(b.v.commit_count, 0) AS BIGINT) AS swh_commit_count,
  CASE WHEN b.v.days_since_last_commit IS NOT NULL THEN
    CAST(greatest(0, date_diff('day', b.v.visit_day, g.window_end)
      + CAST(floor(b.v.days_since_last_commit) AS BIGINT)) AS DOUBLE) END
    AS swh_days_since_last_commit,
  b.v.weekend_commit_fraction AS swh_weekend_commit_fraction
FROM grid g LEFT JOIN best b ON b.entity = g.entity AND b.month = g.month
LEFT JOIN seen s ON s.entity = g.entity""")
def asof_visit(spark, sf_dir):
    grid = P.dense_grid(B.customers(spark, sf_dir), B.START, B.END)
    panel = P.visit_panel(grid, B.customer_visits(spark, sf_dir))
    return B.rounded(panel.select(*KEYS, *_ASOF_COLUMNS))


@register("asof_api_visit", f"""WITH {B.CUSTOMER_GRID_SQL}, {B.CUSTOMER_VISITS_SQL},
archive AS (SELECT * FROM visits WHERE entity % 3 <> 0),
archive_index AS (SELECT c_custkey AS entity, c_custkey % 14 AS record_count FROM customer WHERE c_custkey % 7 = 0),
api AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS visit_day, o_orderkey AS visit FROM orders
        WHERE o_orderstatus = 'O'),
api_index AS (SELECT c_custkey AS entity, c_custkey % 5 = 0 AS origin, c_custkey % 2 = 0 AS snap FROM customer
              WHERE c_custkey % 4 <> 0),
known AS (SELECT entity FROM archive UNION SELECT entity FROM archive_index),
v AS (
  SELECT entity, visit_day, visit, has_readme, commit_count, days_since_last_commit FROM archive
  UNION ALL SELECT entity, visit_day, visit, NULL, NULL, NULL FROM api WHERE entity NOT IN (SELECT entity FROM known)),
whole AS (
  SELECT c_custkey AS entity, c_custkey IN (SELECT entity FROM known) AS is_archive,
    c_custkey IN (SELECT entity FROM v) AS visited, i.record_count, a.origin, a.snap,
    i.entity IS NOT NULL AS in_archive_index, a.entity IS NOT NULL AS in_api_index
  FROM customer LEFT JOIN archive_index i ON i.entity = c_custkey LEFT JOIN api_index a ON a.entity = c_custkey),
best AS (
  SELECT g.entity, g.month, arg_max(v, (v.visit_day, v.visit)) AS v, count(v.visit) AS n, max(v.visit_day) AS last_day
  FROM grid g JOIN v ON v.entity = g.entity AND v.visit_day <= g.window_end GROUP BY g.entity, g.month)
SELECT g.entity, g.month,
  visited OR in_archive_index OR (NOT is_archive AND in_api_index) AS swh_present_any,
  CASE WHEN is_archive THEN COALESCE(record_count > 0, FALSE) ELSE COALESCE(origin, FALSE) END AS swh_origin_found,
  COALESCE(b.n, 0) > 0 AND (is_archive OR COALESCE(snap, FALSE)) AS swh_has_snapshot_to_date,
  COALESCE(b.n, 0) AS swh_visit_count_to_date, b.last_day AS swh_latest_visit_date_to_date,
  COALESCE(b.v.has_readme, FALSE) AS swh_has_readme, CAST(COALESCE(b.v.commit_count, 0) AS BIGINT) AS swh_commit_count,
  CASE WHEN b.v.days_since_last_commit IS NOT NULL THEN CAST(greatest(0, date_diff('day', b.v.visit_day, g.window_end)
    + CAST(floor(b.v.days_since_last_commit) AS BIGINT)) AS DOUBLE) END AS swh_days_since_last_commit
FROM grid g JOIN whole w ON w.entity = g.entity LEFT JOIN best b ON b.entity = g.entity AND b.month = g.month""")
def asof_api_visit(spark, sf_dir):
    """As-of visits of an archive backend, with an API backend for the entities that it does not know."""
    customers = B.customers(spark, sf_dir)
    key = F.col("entity")
    orders = B.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "O")
    api = orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("visit_day"),
                        F.col("o_orderkey").alias("visit"))
    api_index = customers.where(key % 4 != 0).select(
        "entity", (key % 5 == 0).alias("origin_found"), (key % 2 == 0).alias("snapshot_found"))
    archive_index = customers.where(key % 7 == 0).select("entity", (key % 14).alias("record_count"))
    visits, index = P.visits_with_fallback(
        B.customer_visits(spark, sf_dir).where(key % 3 != 0), archive_index, api, api_index)
    panel = P.visit_panel(P.dense_grid(customers, B.START, B.END), visits, index=index, start=B.START)
    return B.rounded(panel.select(*KEYS, *[f"swh_{c}" for c in (
        "present_any", "origin_found", "has_snapshot_to_date", "visit_count_to_date", "latest_visit_date_to_date",
        "has_readme", "commit_count", "days_since_last_commit")]))
