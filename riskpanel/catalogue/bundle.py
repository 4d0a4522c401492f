"""Current-point queries: document projections, the bundle, rule score and dependency risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import register
from riskpanel.catalogue.incidents import AS_OF
from riskpanel.operators import archive as R
from riskpanel.operators import bundle as U
from riskpanel.operators import incidents as I
from riskpanel.operators import rulescore as S

_WORDS = ("auth", "git", "ldap-token", "build", "ui", "Saml")


def _entity(key):
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (key % 6 + 1).cast("int"))
    return F.concat(word, F.lit("-"), key.cast("string"))


def _entity_sql(key: str) -> str:
    words = ", ".join(f"'{w}'" for w in _WORDS)
    return f"[{words}][CAST(({key}) % 6 + 1 AS INT)] || '-' || CAST({key} AS VARCHAR)"


def _registry(spark, sf_dir):
    k = F.col("c_custkey")
    return B.table(spark, sf_dir, "customer").select(
        _entity(k).alias("entity"), F.col("c_name").alias("registry_title"))


def _snapshots(spark, sf_dir):
    """Customers as nested entity snapshots."""
    k = F.col("c_custkey")
    zero = F.lit(0).cast("long")
    step = F.sequence(zero, k % 7)
    deps = F.when(k % 4 != 0, F.transform(step, lambda j: F.struct(
        F.when(j == 5, F.lit("bad name!")).otherwise(_entity((k * 7 + j * 13) % 1600)).alias("name"))))
    warnings = F.transform(
        F.filter(F.sequence(zero, F.lit(3).cast("long")), lambda i: i < k % 4),
        lambda i: F.struct(F.concat(F.lit("W"), i.cast("string")).alias("id"),
                           ((k + i) % 3 == 0).alias("active")))
    released = F.date_add(F.to_date(F.lit("1996-01-01")), (k * 17 % 2000).cast("int"))
    null = F.lit(None).cast("string")
    api = F.struct(
        F.lit("1.0").alias("version"), F.concat(F.lit("2."), F.col("c_nationkey")).alias("requiredCore"),
        F.when(k % 9 > 0, F.date_format(released, "yyyy-MM-dd'T'00:00:00'Z'")).alias("releaseTimestamp"),
        null.alias("firstRelease"), null.alias("previousVersion"),
        F.array(F.col("c_mktsegment")).alias("labels"),
        F.array().cast("array<string>").alias("categories"),
        F.filter(F.array(F.lit("m1"), F.lit("m2")), lambda m: k % 3 > 0).alias("maintainers"),
        deps.alias("dependencies"), warnings.alias("securityWarnings"),
        F.struct(F.array(F.struct(k.alias("total")), F.struct((k * 2).alias("total")))
                 .alias("installations")).alias("stats"), null.alias("scm"))
    missing = {c: F.lit(None).cast("long") for c in (
        "github_stars", "github_forks", "github_watchers", "github_open_issues_only",
        "github_open_prs", "github_contributors_top_sampled", "github_ci_workflow_count")}
    return B.table(spark, sf_dir, "customer").where(k % 10 != 9).select(
        _entity(k).alias("entity"), F.lit("2001").alias("collected_at"),
        F.when(k % 2 == 0, "7.7").alias("current_version"), null.alias("latest_release_date"),
        F.when(k % 5 == 0, "https://github.com/a/b").alias("repo_url"), null.alias("scm_url"),
        F.lit(None).cast("double").alias("github_top_contributor_share"),
        F.lit(None).cast("boolean").alias("github_has_ci_workflows"),
        *[v.alias(c) for c, v in missing.items()], api.alias("plugin_api"))


_SNAPSHOT_SQL = f"""
snap AS (
  SELECT c_custkey AS k, {_entity_sql('c_custkey')} AS entity,
    CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 7 + 1 ELSE 0 END AS deps, c_custkey % 4 AS warns,
    (SELECT count(*) FROM range(0, 3) t(i) WHERE i < c_custkey % 4 AND (c_custkey + i) % 3 = 0) AS active,
    CASE WHEN c_custkey % 9 > 0 THEN CAST(DATE '1996-01-01' + CAST(c_custkey * 17 % 2000 AS INTEGER) AS DATE)
      END AS released
  FROM customer WHERE c_custkey % 10 <> 9)"""


@register("snapshot_features", f"""WITH {_SNAPSHOT_SQL}
SELECT entity, TRUE AS snapshot_present,
  CASE WHEN k % 2 = 0 THEN '7.7' ELSE '1.0' END AS snapshot_current_version,
  CASE WHEN k % 5 = 0 THEN 'https://github.com/a/b' END AS snapshot_repo_url,
  CAST(CASE WHEN k % 3 > 0 THEN 2 ELSE 0 END AS BIGINT) AS snapshot_maintainers_count,
  deps AS snapshot_dependencies_count, CAST(1 AS BIGINT) AS snapshot_labels_count,
  CAST(0 AS BIGINT) AS snapshot_categories_count, warns AS snapshot_security_warning_count,
  active AS snapshot_active_security_warning_count, 2 * k AS snapshot_installations_latest,
  strftime(released, '%Y-%m-%dT00:00:00Z') AS snapshot_latest_release_timestamp
FROM snap""")
def snapshot_features(spark, sf_dir):
    kept = ("entity snapshot_present snapshot_current_version snapshot_repo_url "
            "snapshot_maintainers_count snapshot_dependencies_count snapshot_labels_count "
            "snapshot_categories_count snapshot_security_warning_count "
            "snapshot_active_security_warning_count snapshot_installations_latest "
            "snapshot_latest_release_timestamp").split()
    return B.rounded(U.snapshot_features(_snapshots(spark, sf_dir)).select(*kept))


def _profiles(spark, sf_dir):
    """Suppliers as repository documents."""
    k = F.col("s_suppkey")
    zero = F.lit(0).cast("long")
    numbers = F.filter(F.sequence(zero, F.lit(5).cast("long")), lambda i: i < k % 6)
    day = F.lit("2000-01-")
    return B.table(spark, sf_dir, "supplier").select(
        k.alias("entity"),
        F.struct(F.lit("o/r").alias("repo_full_name"), F.lit("u").alias("repo_url"),
                 F.lit("2001").alias("collected_at")).alias("index"),
        F.struct(*[(k * n).alias(c) for n, c in enumerate(
            ("stargazers_count", "forks_count", "watchers_count", "open_issues_count",
             "subscribers_count"), 1)], (k % 13 == 0).alias("archived"),
            F.lit("main").alias("default_branch"),
            F.struct(F.lit("MIT").alias("spdx_id")).alias("license")).alias("repo"),
        F.transform(numbers, lambda i: F.struct(
            F.when(i % 2 == 0, F.concat(day, (i + 10).cast("string"))).alias("published_at"),
            F.concat(day, (i + 11).cast("string")).alias("created_at"))).alias("releases"),
        F.transform(numbers, lambda i: F.struct(i.cast("string").alias("name"))).alias("tags"),
        F.transform(numbers, lambda i: F.struct((i * k).alias("contributions"))).alias("contributors"),
        F.transform(numbers, lambda i: F.struct(
            i.alias("number"), F.when(i % 2 == 1, "pr").alias("pull_request"))).alias("open_issues"),
        F.transform(numbers, lambda i: F.struct(i.alias("number"))).alias("open_pulls"),
        F.transform(numbers, lambda i: F.struct(
            F.when((i == 3) & (k % 2 == 0), "Run CodeQL").otherwise("ci").alias("name")))
        .alias("workflows"),
        (k % 2 == 0).alias("has_codeowners"), F.lit(None).cast("boolean").alias("has_security_policy"),
        (k % 3 == 0).alias("has_dependabot"),
        F.array(F.struct(F.lit(365).alias("days"), (k + 2).alias("commits")),
                F.struct(F.lit(90).alias("days"), k.alias("commits"))).alias("commit_windows"))


@register("repo_features", """
SELECT s_suppkey AS entity, TRUE AS github_present, s_suppkey AS github_stargazers_count,
  s_suppkey % 13 = 0 AS github_archived, 'MIT' AS github_license_spdx,
  s_suppkey % 6 AS github_releases_count,
  CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '2000-01-10' WHEN 2 THEN '2000-01-12'
    WHEN 3 THEN '2000-01-12' WHEN 4 THEN '2000-01-14' ELSE '2000-01-14' END
    AS github_latest_release_published_at,
  CASE WHEN s_suppkey > 0 AND s_suppkey % 6 > 1 THEN round(CAST(s_suppkey % 6 - 1 AS DOUBLE)
    / CAST((s_suppkey % 6 - 1) * (s_suppkey % 6) / 2 AS DOUBLE), 9) END
    AS github_contributors_top_share,
  s_suppkey % 2 = 0 AS github_has_codeowners, FALSE AS github_has_security_policy,
  s_suppkey % 2 = 0 AND s_suppkey % 6 > 3 AS github_has_codeql_workflow,
  CAST(2 AS BIGINT) AS github_commit_windows_present,
  CAST(90 AS BIGINT) AS github_commits_latest_window_days,
  s_suppkey AS github_commits_latest_window_count,
  s_suppkey % 6 - (s_suppkey % 6) // 2 AS github_open_issues_only,
  s_suppkey % 6 AS github_open_prs, s_suppkey % 6 > 0 AS github_has_ci_workflows
FROM supplier""")
def repo_features(spark, sf_dir):
    profiles = _profiles(spark, sf_dir)
    kept = ("entity github_present github_stargazers_count github_archived github_license_spdx "
            "github_releases_count github_latest_release_published_at "
            "github_contributors_top_share github_has_codeowners github_has_security_policy "
            "github_has_codeql_workflow github_commit_windows_present "
            "github_commits_latest_window_days github_commits_latest_window_count").split()
    posture = U.issue_posture(profiles).select(
        "entity", "github_open_issues_only", "github_open_prs", "github_has_ci_workflows")
    return B.rounded(U.repo_features(profiles).select(*kept).join(posture, "entity"))


@register("commit_windows", """
SELECT l_suppkey AS entity,
  count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2001-08-31' - INTERVAL 30 DAY) AS commits_30d,
  count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2001-08-31' - INTERVAL 90 DAY) AS commits_90d,
  count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2001-08-31' - INTERVAL 365 DAY) AS commits_365d
FROM lineitem GROUP BY 1""")
def commit_windows(spark, sf_dir):
    commits = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("committed_at"))
    return U.commit_windows(commits, "2001-08-31 00:00:00")


def _windows(spark, sf_dir):
    """Orders as collection windows, one per customer and quarter."""
    quarter = F.trunc("o_orderdate", "quarter")
    per = B.table(spark, sf_dir, "orders").groupBy("o_custkey", quarter.alias("q")).agg(
        F.count(F.lit(1)).alias("events_total"), F.max(F.col("o_orderkey") % 10).alias("pushes"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1)).alias("releases"))
    return per.select(
        _entity(F.col("o_custkey")).alias("entity"), F.lit(5.0).alias("sample_percent"),
        F.date_format("q", "yyyyMMdd").alias("window_start_yyyymmdd"),
        F.date_format(F.date_sub(F.add_months("q", 3), 1), "yyyyMMdd").alias("window_end_yyyymmdd"),
        "events_total", "pushes", "releases")


@register("activity_rollup", f"""
WITH w AS (SELECT o_custkey, date_trunc('quarter', o_orderdate) AS q, count(*) AS events_total,
  max(o_orderkey % 10) AS pushes, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS releases
  FROM orders GROUP BY ALL)
SELECT {_entity_sql('o_custkey')} AS entity, count(*) AS gharchive_window_count,
  strftime(max(q) + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y%m%d') AS gharchive_latest_window_end,
  CAST(sum(events_total) AS DOUBLE) AS gharchive_events_total_sum,
  round(avg(pushes), 9) AS gharchive_pushes_mean, CAST(max(pushes) AS DOUBLE) AS gharchive_pushes_max,
  arg_max(events_total, q) AS gharchive_latest_events_total,
  CAST(sum(releases) AS DOUBLE) AS gharchive_releases_sum
FROM w GROUP BY o_custkey""")
def activity_rollup(spark, sf_dir):
    rollup = U.activity_rollup(_windows(spark, sf_dir))
    return B.rounded(rollup.select(
        "entity", "gharchive_window_count", "gharchive_latest_window_end",
        "gharchive_events_total_sum", "gharchive_pushes_mean", "gharchive_pushes_max",
        "gharchive_latest_events_total", "gharchive_releases_sum"))


def _health(spark, sf_dir):
    k = F.col("c_custkey")
    return B.table(spark, sf_dir, "customer").where(k % 5 != 0).select(
        _entity(k).alias("entity"), (k * 37 % 1000 / 10).alias("value"),
        F.lit("2001-08-01").alias("date"), F.lit("2001-08-02").alias("collected_at"))


def _incidents(spark, sf_dir):
    return B.customer_incidents(spark, sf_dir).withColumn("entity", _entity(F.col("entity")))


def _bundle(spark, sf_dir):
    visits = B.customer_visits(spark, sf_dir).withColumn("entity", _entity(F.col("entity")))
    return U.build_bundle(_registry(spark, sf_dir), [
        U.snapshot_features(_snapshots(spark, sf_dir)),
        I.incident_profile(_incidents(spark, sf_dir), AS_OF),
        U.health_features(_health(spark, sf_dir)),
        R.visit_profile(visits),
        U.activity_rollup(_windows(spark, sf_dir)),
    ])


_FACTS_SQL = f"""{_SNAPSHOT_SQL}, {B.CUSTOMER_INCIDENTS_SQL}, {B.CUSTOMER_VISITS_SQL},
inc AS (SELECT entity AS k, count(*) AS n, max(cvss) AS cv, max(published) AS latest,
  count(*) FILTER (WHERE date_diff('day', published, DATE '{AS_OF}') <= 90) AS n90,
  count(*) FILTER (WHERE date_diff('day', published, DATE '{AS_OF}') <= 365) AS n365,
  sum(CASE WHEN cvss = 0 THEN 0 WHEN cvss < 4 THEN 1 WHEN cvss < 7 THEN 3 WHEN cvss < 9 THEN 6
      ELSE 10 END) AS bonus FROM incidents GROUP BY 1),
vis AS (SELECT entity AS k, count(*) AS n, arg_max(visits, (visit_day, visit)) AS v
        FROM visits GROUP BY 1),
base AS (SELECT c.c_custkey AS k, {_entity_sql('c.c_custkey')} AS entity, s.k IS NOT NULL AS has_snapshot,
  COALESCE(s.active, 0) AS active, s.released, COALESCE(i.n, 0) AS n, i.cv, i.latest,
  COALESCE(i.n90, 0) AS n90, COALESCE(i.n365, 0) AS n365, COALESCE(i.bonus, 0) AS bonus,
  CASE WHEN c.c_custkey % 5 <> 0 THEN CAST(c.c_custkey * 37 % 1000 AS DOUBLE) / 10 END AS health,
  vis.n AS visits, vis.v AS v
  FROM customer c LEFT JOIN snap s ON s.k = c.c_custkey LEFT JOIN inc i ON i.k = c.c_custkey
  LEFT JOIN vis ON vis.k = c.c_custkey)"""


@register("current_bundle", f"""WITH {_FACTS_SQL}
SELECT entity, has_snapshot AS snapshot_present, n > 0 AS advisories_present, n AS advisory_count,
  cv AS advisory_max_cvss, n365 AS advisory_count_last_365d, health IS NOT NULL AS healthscore_present,
  health AS healthscore_value, visits IS NOT NULL AS swh_present, COALESCE(visits, 0) AS swh_visit_count,
  COALESCE(v.has_changelog, FALSE) AS swh_has_changelog,
  CAST(COALESCE(v.commit_count, 0) AS BIGINT) AS swh_commit_count,
  EXISTS (SELECT 1 FROM orders WHERE o_custkey = k) AS gharchive_present
FROM base""")
def current_bundle(spark, sf_dir):
    return B.rounded(_bundle(spark, sf_dir).select(
        "entity", "snapshot_present", "advisories_present", "advisory_count", "advisory_max_cvss",
        "advisory_count_last_365d", "healthscore_present", "healthscore_value", "swh_present",
        "swh_visit_count", "swh_has_changelog", "swh_commit_count", "gharchive_present"))


def _edges_and_risk(spark, sf_dir):
    bundle = _bundle(spark, sf_dir)
    risk = bundle.select(
        "entity", "advisory_count", "advisory_max_cvss", "advisory_days_since_latest",
        F.col("snapshot_active_security_warning_count").alias("active_warnings"),
        "healthscore_value", F.col("snapshot_present").alias("has_snapshot"),
        "advisory_latest_published_date")
    return bundle, S.dependency_risk(S.dependency_edges(_snapshots(spark, sf_dir)), risk)


_EDGE_SQL = f"""{_FACTS_SQL},
edges AS (SELECT DISTINCT s.entity AS parent, {_entity_sql('(s.k * 7 + j * 13) % 1600')} AS dependency
  FROM snap s, range(0, 7) t(j) WHERE s.k % 4 <> 0 AND j <= s.k % 7 AND j <> 5),
dep AS (SELECT e.parent, e.dependency, COALESCE(b.n, 0) AS advisory_count, b.cv AS max_cvss,
  COALESCE(date_diff('day', b.latest, DATE '{AS_OF}') <= 365, FALSE) AS recent,
  COALESCE(b.active, 0) AS active, b.health, COALESCE(b.has_snapshot, FALSE) AS has_snapshot
  FROM edges e LEFT JOIN base b ON b.entity = e.dependency),
risk AS (SELECT *, CAST(least(10, advisory_count * 2) + CASE WHEN max_cvss >= 9 THEN 6
  WHEN max_cvss >= 7 THEN 4 WHEN max_cvss >= 4 THEN 2 ELSE 0 END + CASE WHEN recent THEN 3 ELSE 0 END
  + least(10, active * 5) + CASE WHEN health IS NULL THEN 0 ELSE
    greatest(0, least(4, CAST(round_even((100 - health) / 25, 0) AS BIGINT))) END
  AS BIGINT) AS risk_points FROM dep),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent
  ORDER BY risk_points DESC, COALESCE(max_cvss, 0) DESC, dependency) AS place FROM risk),
roll AS (SELECT parent, count(*) AS dependency_total,
  count(*) FILTER (WHERE advisory_count > 0) AS deps_with_any_advisory,
  count(*) FILTER (WHERE recent) AS deps_with_recent_advisory_365d,
  count(*) FILTER (WHERE active > 0) AS deps_with_active_warning, max(max_cvss) AS worst_dep_max_cvss,
  arg_min(dependency, (-max_cvss, dependency)) FILTER (WHERE max_cvss IS NOT NULL) AS worst_dep_id,
  count(*) FILTER (WHERE NOT has_snapshot) AS snapshot_missing,
  count(*) FILTER (WHERE advisory_count = 0) AS advisories_missing,
  count(*) FILTER (WHERE health IS NULL) AS healthscore_missing,
  CAST(sum(risk_points) FILTER (WHERE place <= 5) AS BIGINT) AS dependency_risk_points
  FROM ranked GROUP BY parent)"""


@register("dependency_risk", f"""WITH {_EDGE_SQL}
SELECT parent, dependency, advisory_count, max_cvss, recent AS recent_advisory_365d, risk_points
FROM risk""")
def dependency_risk(spark, sf_dir):
    return B.rounded(_edges_and_risk(spark, sf_dir)[1].select(
        "parent", "dependency", "advisory_count", "max_cvss", "recent_advisory_365d",
        "risk_points"))


@register("dependency_rollup", f"""WITH {_EDGE_SQL}
SELECT parent AS entity, * EXCLUDE (parent) FROM roll""")
def dependency_rollup(spark, sf_dir):
    risks = _edges_and_risk(spark, sf_dir)[1]
    return B.rounded(S.dependency_rollup(risks).drop("dependency_details_top"))


_NAME_HITS = " OR ".join(f"contains(lower(b.entity), '{w}')" for w in K.SENSITIVE_NAME_WORDS)
_RULE_SQL = f"""WITH {_EDGE_SQL},
p AS (SELECT b.entity,
  CASE WHEN n > 0 THEN least(30, least(15, n * 2) + least(15, n90 * 10 + greatest(0, n365 - n90) * 5))
    ELSE 0 END AS points_advisory_history,
  least(15, bonus) AS points_advisory_severity,
  least(20, greatest(
    CASE WHEN floor(v.days_since_last_commit) > 1825 THEN 16 WHEN floor(v.days_since_last_commit) > 1095
      THEN 12 WHEN floor(v.days_since_last_commit) > 730 THEN 9 WHEN floor(v.days_since_last_commit) > 365
      THEN 6 WHEN floor(v.days_since_last_commit) > 180 THEN 3 ELSE 0 END,
    CASE WHEN date_diff('day', released, DATE '{AS_OF}') > 730 THEN
      least(8, date_diff('day', released, DATE '{AS_OF}') // 365 * 3) ELSE 0 END)) AS points_staleness,
  least(15, active * 8) AS points_active_warnings,
  CASE WHEN visits IS NULL THEN 0 ELSE CASE WHEN v.has_security_md THEN 0 ELSE 3 END
    + CASE WHEN v.has_dependabot OR v.has_github_actions THEN 0 ELSE 3 END
    + CASE WHEN v.has_tests_directory THEN 0 ELSE 2 END + CASE WHEN v.has_changelog THEN 0 ELSE 2 END
    END AS points_governance,
  least(5, COALESCE(r.dependency_risk_points, 0) // 4) AS points_dependency,
  CASE WHEN health IS NULL THEN 0 ELSE least(5, CAST(round_even((100 - health) / 5, 0) AS BIGINT) // 4)
    END AS points_health_score,
  CASE WHEN {_NAME_HITS} THEN 20 ELSE 0 END AS points_security_sensitivity
  FROM base b LEFT JOIN roll r ON r.parent = b.entity),
t AS (SELECT *, points_advisory_history + points_advisory_severity + points_staleness
  + points_active_warnings + points_governance + points_dependency + points_health_score
  + points_security_sensitivity AS total FROM p)"""
_POINTS = [f"points_{c}" for c in K.RULE_CAPS]


@register("rule_score", f"""{_RULE_SQL}
SELECT entity, CAST(CASE WHEN total = 0 THEN 5 ELSE least(100, total) END AS BIGINT) AS score,
  {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _POINTS)} FROM t""")
def rule_score(spark, sf_dir):
    return B.rounded(_scores(spark, sf_dir).select("entity", "score", *_POINTS))


_HELD = "[" + ", ".join(f"'{w}'" for w in K.SENSITIVE_NAME_WORDS) + "]"
_REASONS = {
    "advisory_history": "'advisories ' || n || ', in 90 days ' || n90 || ', in 365 days ' || n365",
    "advisory_severity": "'severity bonus ' || bonus",
    "staleness": "concat_ws(', ', 'days since commit ' || CAST(floor(v.days_since_last_commit) AS BIGINT), "
                 f"'days since release ' || date_diff('day', released, DATE '{AS_OF}'))",
    "active_warnings": "'active warnings ' || active",
    "governance": "'missing ' || concat_ws(', ', CASE WHEN NOT v.has_security_md THEN 'security policy' END, "
                  "CASE WHEN NOT (v.has_dependabot OR v.has_github_actions) THEN 'automation' END, "
                  "CASE WHEN NOT v.has_tests_directory THEN 'tests' END, CASE WHEN NOT v.has_changelog THEN 'changelog' END)",
    "dependency": "'dependency points ' || r.dependency_risk_points",
    "health_score": "'health ' || CAST(floor(health) AS BIGINT)",
    "security_sensitivity": f"'name holds ' || array_to_string(list_filter({_HELD}, lambda w: contains(lower(b.entity), w)), ', ')",
}


@register("rule_reasons", f"""{_RULE_SQL}, said AS (""" + " UNION ALL ".join(
    f"""SELECT t.entity, '{c} +' || CAST(points_{c} AS BIGINT) || ' of {K.RULE_CAPS[c]}: ' || {text} AS reason
  FROM t JOIN base b ON b.entity = t.entity LEFT JOIN roll r ON r.parent = t.entity WHERE points_{c} > 0"""
    for c, text in _REASONS.items()) + """)
SELECT * FROM said UNION ALL SELECT entity, 'no rule matched: default score' FROM t WHERE total = 0""")
def rule_reasons(spark, sf_dir):
    """Every reason of every entity: points, cap and the counts behind them."""
    return _scores(spark, sf_dir).select("entity", F.explode("reasons").alias("reason"))


def _scores(spark, sf_dir):
    bundle, risks = _edges_and_risk(spark, sf_dir)
    totals = S.dependency_rollup(risks).select("entity", "dependency_risk_points")
    return S.rule_score(bundle.join(totals, "entity", "left"), AS_OF)


@register("leaderboard", f"""{_RULE_SQL}
SELECT t.entity, CAST(CASE WHEN total = 0 THEN 5 ELSE least(100, total) END AS BIGINT) AS score,
  b.cv AS max_cvss FROM t JOIN base b ON b.entity = t.entity WHERE b.cv IS NOT NULL
ORDER BY score DESC, b.cv DESC, t.entity LIMIT 20""")
def leaderboard(spark, sf_dir):
    worst = _incidents(spark, sf_dir).groupBy("entity").agg(F.max("cvss").alias("max_cvss"))
    ranked = _scores(spark, sf_dir).select("entity", "score").join(worst, "entity")
    return B.rounded(ranked.orderBy(F.desc("score"), F.desc("max_cvss"), "entity").limit(20))


@register("contract_missing", f"""WITH {_FACTS_SQL}
SELECT entity, CAST(n AS DOUBLE) AS advisory_count_to_date,
  cv AS advisory_max_cvss_to_date, CAST(visits IS NOT NULL AS DOUBLE) AS swh_present_any,
  CAST(NULL AS DOUBLE) AS gharchive_unknown, CAST(19 AS DOUBLE) AS window_index,
  CAST((cv IS NULL)::INT + 1 AS BIGINT) AS missing_features,
  round(((cv IS NULL)::INT + 1) / 5.0::DOUBLE, 9) AS missing_fraction
FROM base""")
def contract_missing(spark, sf_dir):
    contract = ["advisory_count_to_date", "advisory_max_cvss_to_date", "swh_present_any",
                "gharchive_unknown", "window_index"]
    return B.rounded(U.align_to_model(_bundle(spark, sf_dir), contract, "2021-08-15"))
