"""Activity queries: monthly aggregation, trailing features, payloads and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import register
from riskpanel.functions import dates as D
from riskpanel.functions import text as T
from riskpanel.functions.quantiles import exact_quantiles
from riskpanel.operators import activity as A
from riskpanel.operators import panel as P

PX = K.ACTIVITY_PREFIX
_KINDS = {
    "push_events": "PushEvent", "pull_request_events": "PullRequestEvent",
    "pull_request_review_events": "PullRequestReviewEvent", "issues_events": "IssuesEvent",
    "release_events": "ReleaseEvent", "watch_events": "WatchEvent", "fork_events": "ForkEvent",
}


def _hit(words) -> str:
    return "(" + " OR ".join(f"contains(blob, '{w}')" for w in words) + ")"


def _count(condition: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {condition}) AS {PX}{name}"


_MONTH_COUNTS = ",\n".join([
    f"count(*) AS {PX}events_total",
    *[_count(f"kind = '{v}'", k) for k, v in _KINDS.items()],
    _count("kind = 'PullRequestEvent' AND closed", "pull_request_closed_events"),
    _count("kind = 'PullRequestEvent' AND merged", "pull_request_merged_events"),
    _count("kind = 'IssuesEvent' AND closed", "issues_closed_events"),
    _count("kind = 'CreateEvent' AND ref_type = 'branch'", "branch_create_events"),
    _count("kind = 'CreateEvent' AND ref_type = 'tag'", "tag_create_events"),
    _count("bot", "bot_events"), _count("NOT bot", "human_events"),
    _count(_hit(K.SECURITY_KEYWORDS), "security_keyword_events"),
    _count(_hit(K.HOTFIX_KEYWORDS), "hotfix_keyword_events"),
    _count(_hit(K.DEPENDENCY_KEYWORDS) + " OR (bot AND kind = 'PullRequestEvent')",
           "dependency_bump_events"),
    f"count(DISTINCT actor) AS {PX}unique_actors",
    f"count(DISTINCT actor) FILTER (WHERE NOT bot) AS {PX}unique_human_actors",
    f"count(DISTINCT day) AS {PX}days_active",
    f"count(DISTINCT win) AS {PX}source_window_count",
])
_MONTHS = f"am AS (SELECT entity, month, {_MONTH_COUNTS} FROM events_n GROUP BY entity, month)"


@register("activity_month", f"""WITH {B.ACTIVITY_SQL}, {_MONTHS}
SELECT am.*, TRUE AS {PX}present, 5.0::DOUBLE AS {PX}sample_percent FROM am""")
def activity_month(spark, sf_dir):
    months = A.counts_of_facts(A.event_facts(B.activity_events(spark, sf_dir)))
    return months.drop(PX + "owner_push_fraction")


@register("owner_share", f"""WITH {B.ACTIVITY_SQL},
pushes AS (SELECT entity, month, actor, count(*) AS n FROM events_n
           WHERE kind = 'PushEvent' AND actor IS NOT NULL AND NOT bot GROUP BY ALL)
SELECT entity, month, round(max(n) / CAST(sum(n) AS DOUBLE), 9) AS {PX}owner_push_fraction
FROM pushes GROUP BY entity, month""")
def owner_share(spark, sf_dir):
    months = A.activity_counts(B.activity_events(spark, sf_dir))
    share = F.col(PX + "owner_push_fraction")
    return B.rounded(months.where(share.isNotNull()).select("entity", "month", share))


@register("duration_percentiles", f"""WITH {B.ACTIVITY_SQL},
timed AS (
  SELECT entity, month, hours, CASE WHEN kind = 'PullRequestEvent' AND merged THEN 'pr_merge'
    WHEN kind = 'IssuesEvent' AND closed THEN 'issue_close' END AS k FROM events_n
  WHERE hours > 0)
SELECT entity, month,""" + ",".join(
    f"round(quantile_cont(CAST(hours AS DOUBLE), {p}) FILTER (WHERE k = '{k}'), 9)"
    f" AS {PX}{k}_time_{n}_hours"
    for k in ("pr_merge", "issue_close") for n, p in (("p50", 0.5), ("p90", 0.9))
) + " FROM timed WHERE k IS NOT NULL GROUP BY entity, month")
def duration_percentiles(spark, sf_dir):
    return B.rounded(A.resolution_times(B.activity_events(spark, sf_dir)))


def _panel(spark, sf_dir):
    grid = P.dense_grid(B.suppliers(spark, sf_dir), B.START, B.END)
    return P.activity_panel(grid, A.activity_months(B.activity_events(spark, sf_dir)))


def _zeroed(alias: str = "g") -> str:
    return ", ".join(f"COALESCE({PX}{m}, 0) AS {m}" for m in K.ACTIVITY_COUNT_COLUMNS)


_DENSE = f"""WITH {B.SUPPLIER_GRID_SQL}, {B.ACTIVITY_SQL}, {_MONTHS},
dense AS (SELECT g.entity, g.month, g.window_index, {_zeroed()}
          FROM grid g LEFT JOIN am ON am.entity = g.entity AND am.month = g.month)"""
_FRAMES = """WINDOW
  w3 AS (PARTITION BY entity ORDER BY window_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  w6 AS (PARTITION BY entity ORDER BY window_index ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
  p3 AS (PARTITION BY entity ORDER BY window_index ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING),
  wa AS (PARTITION BY entity ORDER BY window_index ROWS UNBOUNDED PRECEDING)"""


@register("rolling_sums", f"{_DENSE} SELECT entity, month," + ",".join(
    f"CAST(sum({m}) OVER w{n} AS DOUBLE) AS {PX}{m}_trailing_{n}m"
    for m in K.TRAILING_MEASURES for n in (3, 6)
) + f" FROM dense {_FRAMES}")
def rolling_sums(spark, sf_dir):
    names = [f"{PX}{m}_trailing_{n}m" for m in K.TRAILING_MEASURES for n in (3, 6)]
    return _panel(spark, sf_dir).select("entity", "month", *names)


@register("rolling_delta", f"{_DENSE} SELECT entity, month," + ",".join(
    f"CAST(sum({m}) OVER w3 - COALESCE(sum({m}) OVER p3, 0) AS DOUBLE)"
    f" AS {PX}{m}_trailing_3m_delta_prev_3m" for m in K.DELTA_MEASURES
) + f" FROM dense {_FRAMES}")
def rolling_delta(spark, sf_dir):
    names = [f"{PX}{m}_trailing_3m_delta_prev_3m" for m in K.DELTA_MEASURES]
    return _panel(spark, sf_dir).select("entity", "month", *names)


@register("staleness", f"{_DENSE} SELECT entity, month," + ",".join(
    f"CAST(window_index - max(CASE WHEN {m} > 0 THEN window_index END) OVER wa AS BIGINT)"
    f" AS {PX}months_since_{n}" for n, m in K.STALENESS_MEASURES.items()
) + f" FROM dense {_FRAMES}")
def staleness(spark, sf_dir):
    names = [f"{PX}months_since_{n}" for n in K.STALENESS_MEASURES]
    return B.rounded(_panel(spark, sf_dir).select("entity", "month", *names))


@register("active_ratio", f"""{_DENSE} SELECT entity, month,
  round(count(*) FILTER (WHERE events_total > 0) OVER w3 / CAST(count(*) OVER w3 AS DOUBLE), 9)
    AS {PX}active_month_ratio_3m,
  round(count(*) FILTER (WHERE events_total > 0) OVER w6 / CAST(count(*) OVER w6 AS DOUBLE), 9)
    AS {PX}active_month_ratio_6m FROM dense {_FRAMES}""")
def active_ratio(spark, sf_dir):
    return B.rounded(_panel(spark, sf_dir).select(
        "entity", "month", PX + "active_month_ratio_3m", PX + "active_month_ratio_6m"))


@register("burstiness", f"""{_DENSE} SELECT entity, month,
  CASE WHEN avg(events_total) OVER w6 >= 5 THEN
    round(least(max(events_total) OVER w6 / avg(events_total) OVER w6, 10), 9) END
    AS {PX}activity_burstiness_6m FROM dense {_FRAMES}""")
def burstiness(spark, sf_dir):
    return B.rounded(_panel(spark, sf_dir).select("entity", "month", PX + "activity_burstiness_6m"))


def _ratio(name, top, bottom, smooth, low, high, months, smallest):
    value = f"({top} + 1.0) / ({bottom} + 2.0)" if smooth else f"{top} / CAST({bottom} AS DOUBLE)"
    if low is not None:
        value = f"greatest({value}, {low})"
    return (f"CASE WHEN {bottom} >= {smallest} THEN round(CAST(least({value}, {high}) AS DOUBLE), 9)"
            f" END AS {PX}{name}")


def _ratios() -> str:
    def s(m, n):
        return f"sum({m}) OVER w{n}"

    out = [
        _ratio(f"{name}_{n}m", s(top, n), s(bottom, n), smooth, low, high, n, d)
        for name, (top, bottom, smooth, low, high) in K.GUARDED_RATIOS.items()
        for n, d in K.RATIO_MIN_DENOMINATOR.items()
    ]
    active = "count(*) FILTER (WHERE events_total > 0) OVER w6"
    out += [
        _ratio("releases_per_active_month_6m", s("release_events", 6), active, False, 0, 12, 6, 2),
        _ratio("events_per_active_month_6m", s("events_total", 6), active, False, 0, 500, 6, 2),
        _ratio("bot_event_ratio_3m", s("bot_events", 3), s("events_total", 3), True, 0, 1, 3, 5),
        _ratio("security_keyword_rate_3m", s("security_keyword_events", 3),
               f"({s('pull_request_events', 3)} + {s('issues_events', 3)})", True, 0, 1, 3, 5),
        f"CAST({s('watch_events', 6)} AS DOUBLE) AS {PX}stars_trailing_6m",
        f"CAST({s('fork_events', 6)} AS DOUBLE) AS {PX}forks_trailing_6m",
    ]
    return ",\n".join(out)


@register("guarded_ratios", f"{_DENSE} SELECT entity, month, {_ratios()} FROM dense {_FRAMES}")
def guarded_ratios(spark, sf_dir):
    names = [f"{PX}{n}_{m}m" for n in K.GUARDED_RATIOS for m in (3, 6)]
    names += [PX + n for n in (
        "releases_per_active_month_6m", "events_per_active_month_6m", "bot_event_ratio_3m",
        "security_keyword_rate_3m", "stars_trailing_6m", "forks_trailing_6m")]
    return B.rounded(_panel(spark, sf_dir).select("entity", "month", *names))


@register("event_fan_out", """
WITH repos AS (SELECT c_custkey AS entity, 'org/repo' || CAST(c_custkey % 100 AS VARCHAR) AS repo
               FROM customer),
ev AS (SELECT o_orderkey AS event_id, 'org/repo' || CAST(o_orderkey % 150 AS VARCHAR) AS repo,
              strftime(o_orderdate, '%Y-%m') AS month FROM orders)
SELECT r.entity, month, count(*) AS n_events, min(event_id) AS first_event
FROM ev JOIN repos r ON r.repo = ev.repo GROUP BY ALL""")
def event_fan_out(spark, sf_dir):
    repos = B.customers(spark, sf_dir).select(
        "entity", F.concat(F.lit("org/repo"), (F.col("entity") % 100).cast("string"))
        .alias("repo_full_name"))
    events = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.concat(F.lit("org/repo"), (F.col("o_orderkey") % 150).cast("string")).alias("repo"),
        D.month_key(F.col("o_orderdate")).alias("month"))
    return A.fan_out_months(events, repos)


# --- short-grid activity: the events table as raw payload events -----------------------------

_RAW_KINDS = {"view": "WatchEvent", "signup": "ForkEvent", "error": "IssuesEvent",
              "click": "PushEvent", "purchase": "PullRequestEvent"}


def _raw_events(spark, sf_dir):
    """Raw archive-shaped events: payload JSON text derived from the props of each event."""
    e = B.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    pairs = [F.lit(x) for item in _RAW_KINDS.items() for x in item]
    done = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    issue = F.struct(F.concat(F.lit("Issue CVE "), k.cast("string")).alias("title"),
                     done.alias("closed_at"))
    pull = F.struct((k % 2 == 0).alias("merged"), F.lit("Bump it").alias("title"))
    return e.select(
        F.concat(F.lit("org/u"), F.col("user_id").cast("string")).alias("repo"),
        F.concat(F.lit("actor"), (k % 7).cast("string")).alias("actor_login"),
        F.try_element_at(F.create_map(*pairs), F.col("event_type")).alias("event_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.date_format("ts", "yyyyMMdd").alias("day"), "event_id",
        F.to_json(F.struct(
            F.when(k % 3 == 0, "closed").otherwise("opened").alias("action"),
            F.when(F.col("event_type") == "error", issue).alias("issue"),
            F.when(F.col("event_type") == "purchase", pull).alias("pull_request"),
        )).alias("payload"))


_RAW_SQL = """
raw AS (
  SELECT user_id, event_id, ts, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-26')"""


@register("event_json", f"""WITH {_RAW_SQL}
SELECT 'org/u' || CAST(user_id AS VARCHAR) AS repo_full_name, 'org' AS repo_owner,
  'u' || CAST(user_id AS VARCHAR) AS repo_name, user_id AS entity,
  CASE t WHEN 'view' THEN 'WatchEvent' WHEN 'signup' THEN 'ForkEvent' WHEN 'error' THEN
    'IssuesEvent' WHEN 'click' THEN 'PushEvent' ELSE 'PullRequestEvent' END AS event_type,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_ts, CAST(ts AS DATE) AS event_date,
  CAST(2024 AS BIGINT) AS event_year, CAST(1 AS BIGINT) AS event_month, '2024-01' AS event_yyyymm,
  CASE WHEN k % 3 = 0 THEN 'closed' ELSE 'opened' END AS action,
  CASE WHEN t = 'purchase' THEN k % 2 = 0 END AS pr_merged,
  CASE WHEN t = 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS issue_closed_ts,
  CASE t WHEN 'error' THEN 'issue cve ' || CAST(k AS VARCHAR) WHEN 'purchase' THEN 'bump it' END
    AS text_blob,
  strftime(DATE '2024-01-01' + CAST(7 * CAST(floor(date_diff('day', DATE '2024-01-01',
    CAST(ts AS DATE)) / 7.0) AS INTEGER) AS INTEGER), '%Y%m%d') AS source_window_start_yyyymmdd,
  strftime(least(DATE '2024-01-01' + CAST(7 * CAST(floor(date_diff('day', DATE '2024-01-01',
    CAST(ts AS DATE)) / 7.0) AS INTEGER) + 6 AS INTEGER), DATE '2024-01-25'), '%Y%m%d')
    AS source_window_end_yyyymmdd,
  'actor' || CAST(k % 7 AS VARCHAR) AS actor_login
FROM raw""")
def event_json(spark, sf_dir):
    raw = _raw_events(spark, sf_dir)
    users = B.table(spark, sf_dir, "events").select(
        F.concat(F.lit("org/u"), F.col("user_id").cast("string")).alias("repo_full_name"),
        F.col("user_id").alias("entity")).distinct()
    events = A.scan_events(raw, users, "20240105", "20240125")
    rows = A.normalize_events(A.fan_out(events, users), "2024-02-01", "registry", "2024-01-01",
                              "2024-01-25", 7)
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("event_ts",
                                                                       "issue_closed_ts")]
    kept = ["repo_full_name", "repo_owner", "repo_name", "entity", "event_type", "event_date",
            "event_year", "event_month", "event_yyyymm", "action", "pr_merged", "text_blob",
            "source_window_start_yyyymmdd", "source_window_end_yyyymmdd", "actor_login"]
    return B.rounded(rows.select(*kept, *text))


@register("sharded_scan", """
SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n_events, min(event_id) AS first_event
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-16' GROUP BY ALL""")
def sharded_scan(spark, sf_dir):
    from riskpanel.session import scratch_path
    from riskpanel.sources import readers, writers

    path = scratch_path(spark, "day-shards")
    events = B.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    writers.write_partitioned(events, path, ["day"])
    shards = readers.read_day_shards(spark, path, "20240110", "20240116", "day")
    return shards.groupBy("day").agg(F.count(F.lit(1)).alias("n_events"),
                                     F.min("event_id").alias("first_event"))


_RAW_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RAW_KINDS.items())
_SCANNED = ", ".join(f"'{t}'" for t in K.EVENT_TYPES)


@register("sampled_scan", f"""
WITH e AS (SELECT CASE event_type {_RAW_CASE} END AS event_type FROM events
  WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'
    AND substr(sha256('7:' || CAST(event_id AS VARCHAR)), 1, 16) < '3333333333333333')
SELECT event_type, 20.0::DOUBLE AS sample_percent, count(*) AS n_events FROM e
WHERE event_type IN ({_SCANNED}) GROUP BY ALL""")
def sampled_scan(spark, sf_dir):
    raw = _raw_events(spark, sf_dir)
    users = raw.select(F.col("repo").alias("repo_full_name")).distinct()
    events = A.scan_events(raw, users, "20240101", "20240131", sample_percent=20.0, seed=7, sample_key="event_id")
    return events.groupBy("event_type", "sample_percent").agg(F.count(F.lit(1)).alias("n_events"))


@register("date_buckets", """
SELECT bucket_start, least(bucket_start + 6, DATE '2024-01-30') AS bucket_end, n_events, n_users
FROM (SELECT DATE '2024-01-01' + CAST(7 * (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7)
        AS INTEGER) AS bucket_start, count(*) AS n_events, count(DISTINCT user_id) AS n_users
      FROM events GROUP BY 1)""")
def date_buckets(spark, sf_dir):
    first, last = F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-30"))
    events = B.table(spark, sf_dir, "events")
    start = D.bucket_start(F.col("ts").cast("date"), first, 7)
    by_user = events.groupBy(start.alias("bucket_start"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by_user.groupBy("bucket_start").agg(
        F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_users")
    ).select("bucket_start", D.bucket_end(F.col("bucket_start"), last, 7).alias("bucket_end"),
             "n_events", "n_users")


@register("daily_active_users", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(DISTINCT user_id) AS n_users,
  round(quantile_cont(value, 0.5), 9) AS p50_value, round(quantile_cont(value, 0.9), 9) AS p90_value
FROM events GROUP BY ALL""")
def daily_active_users(spark, sf_dir):
    events = B.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    users = events.select("day", "event_type", "user_id").distinct().groupBy(
        "day", "event_type").agg(F.count(F.lit(1)).alias("n_users"))
    values = exact_quantiles(events, ["day", "event_type"], F.col("value"),
                             {"p50_value": 0.5, "p90_value": 0.9}).drop("n_values")
    return B.rounded(users.join(values, ["day", "event_type"]))


@register("keyword_flags", f"""
WITH d AS (SELECT doc_id, lower(text) AS blob FROM documents)
SELECT doc_id, {_hit(K.SECURITY_KEYWORDS)} AS security, {_hit(K.HOTFIX_KEYWORDS)} AS hotfix,
  {_hit(K.DEPENDENCY_KEYWORDS)} AS dependency, {_hit(K.SENSITIVE_NAME_WORDS)} AS sensitive
FROM d""")
def keyword_flags(spark, sf_dir):
    # lower-cased once per text in a projection of its own, then searched
    blob = F.col("blob")
    texts = B.table(spark, sf_dir, "documents").select(
        "doc_id", T.text_blob(F.col("text")).alias("blob"))
    return texts.select(
        "doc_id", T.mentions_any(blob, K.SECURITY_KEYWORDS).alias("security"),
        T.mentions_any(blob, K.HOTFIX_KEYWORDS).alias("hotfix"),
        T.mentions_any(blob, K.DEPENDENCY_KEYWORDS).alias("dependency"),
        T.mentions_any(blob, K.SENSITIVE_NAME_WORDS).alias("sensitive"))


@register("panel_full", f"""WITH {B.SUPPLIER_GRID_SQL}, {B.ACTIVITY_SQL}, {_MONTHS},
{B.SUPPLIER_INCIDENTS_SQL}, {B.SUPPLIER_VISITS_SQL},
inc AS (SELECT g.entity, g.month, count(i.incident_key) AS n, max(i.cvss) AS cv
        FROM grid g JOIN incidents i ON i.entity = g.entity AND i.published <= g.window_end
        GROUP BY ALL),
vis AS (SELECT g.entity, g.month, count(*) AS n, arg_max(v.commit_count, (v.visit_day, v.visit)) AS cc
        FROM grid g JOIN visits v ON v.entity = g.entity AND v.visit_day <= g.window_end
        GROUP BY ALL)
SELECT g.entity, g.month, COALESCE(inc.n, 0) AS advisory_count_to_date,
  inc.cv AS advisory_max_cvss_to_date, COALESCE(am.{PX}events_total, 0) AS {PX}events_total,
  CAST(sum(COALESCE(am.{PX}push_events, 0)) OVER (PARTITION BY g.entity ORDER BY g.window_index
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS {PX}push_events_trailing_3m,
  COALESCE(vis.n, 0) AS swh_visit_count_to_date,
  CAST(COALESCE(vis.cc, 0) AS BIGINT) AS swh_commit_count,
  CASE WHEN g.window_index + 6 > 79 THEN NULL ELSE CAST(EXISTS (
    SELECT 1 FROM incidents f WHERE f.entity = g.entity AND f.published > g.window_end
      AND f.published < g.window_start + INTERVAL 7 MONTH) AS BIGINT) END
    AS label_advisory_within_6m
FROM grid g LEFT JOIN inc ON inc.entity = g.entity AND inc.month = g.month
LEFT JOIN vis ON vis.entity = g.entity AND vis.month = g.month
LEFT JOIN am ON am.entity = g.entity AND am.month = g.month""")
def panel_full(spark, sf_dir):
    from riskpanel.plans.panel_build import labelled_panel

    panel = labelled_panel(
        B.suppliers(spark, sf_dir), B.START, B.END, B.supplier_incidents(spark, sf_dir),
        A.activity_months(B.activity_events(spark, sf_dir)), B.supplier_visits(spark, sf_dir))
    return B.rounded(panel.select(
        "entity", "month", "advisory_count_to_date", "advisory_max_cvss_to_date",
        PX + "events_total", PX + "push_events_trailing_3m", "swh_visit_count_to_date",
        "swh_commit_count", "label_advisory_within_6m"))
