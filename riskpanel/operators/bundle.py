"""Current-point bundle: one row per entity out of its latest documents and fact profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions import dates as D
from riskpanel.functions import numbers as N
from riskpanel.operators.identity import snapshot_repo_url


def _size(array: Column) -> Column:
    return F.coalesce(F.array_size(array), F.lit(0))


def snapshot_features(snapshots: DataFrame) -> DataFrame:
    """Flat columns of entity snapshots: list sizes, active warnings, installations, versions."""
    api = {c: F.col(f"plugin_api.{c}") for c in (
        "version", "requiredCore", "releaseTimestamp", "firstRelease", "previousVersion",
        "labels", "categories", "maintainers", "dependencies", "securityWarnings")}
    out: dict[str, Column] = {
        "snapshot_present": F.lit(True),
        "snapshot_collected_at": F.col("collected_at"),
        "snapshot_current_version": F.coalesce("current_version", api["version"]),
        "snapshot_required_core": api["requiredCore"],
        "snapshot_repo_url": snapshot_repo_url(
            F.col("repo_url"), F.col("scm_url"), F.col("plugin_api.scm")),
        "snapshot_maintainers_count": _size(api["maintainers"]),
        "snapshot_dependencies_count": _size(api["dependencies"]),
        "snapshot_labels_count": _size(api["labels"]),
        "snapshot_labels": api["labels"],
        "snapshot_categories_count": _size(api["categories"]),
        "snapshot_categories": api["categories"],
        "snapshot_security_warning_count": _size(api["securityWarnings"]),
        "snapshot_active_security_warning_count": _size(
            F.filter(api["securityWarnings"], lambda w: N.as_flag(w["active"]))),
        "snapshot_latest_release_timestamp": F.coalesce(
            api["releaseTimestamp"], F.col("latest_release_date")),
        "snapshot_first_release": api["firstRelease"],
        "snapshot_previous_version": api["previousVersion"],
        "snapshot_installations_latest": F.try_element_at(
            F.col("plugin_api.stats.installations"), F.lit(-1))["total"],
    }
    enriched = {
        "stars": "github_stars", "forks": "github_forks", "watchers": "github_watchers",
        "open_issues_only": "github_open_issues_only", "open_prs": "github_open_prs",
    }
    out |= {f"snapshot_github_{k}_enriched": F.col(c) for k, c in enriched.items()}
    out |= {f"snapshot_{c}": F.col(c) for c in (
        "github_contributors_top_sampled", "github_top_contributor_share",
        "github_has_ci_workflows", "github_ci_workflow_count")}
    return snapshots.select("entity", *[v.alias(k) for k, v in out.items()])


def top_share(contributions: Column) -> Column:
    """Share of the largest contributor; null when nothing was contributed."""
    counts = F.transform(contributions, lambda c: F.coalesce(c, F.lit(0)).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return N.safe_div(F.array_max(counts), total)


def mentions_codeql(workflows: Column) -> Column:
    return N.as_flag(F.exists(
        workflows, lambda w: F.contains(F.lower(F.coalesce(w["name"], F.lit(""))), F.lit("codeql"))))


def repo_features(profiles: DataFrame) -> DataFrame:
    """Flat columns of repository documents: list sizes, latest release, file presence."""
    repo = {c: F.col(f"repo.{c}") for c in (
        "stargazers_count", "forks_count", "watchers_count", "subscribers_count", "archived",
        "default_branch")}
    latest = F.array_max(F.transform("releases", lambda r: F.coalesce(
        r["published_at"], r["created_at"], F.lit(""))))
    window = F.array_max(F.transform("commit_windows", lambda w: F.struct(
        w["days"].cast("string").alias("text"), w["days"].alias("days"),
        w["commits"].alias("commits"))))
    present = F.col("index").isNotNull() | F.col("repo").isNotNull()
    for c in ("releases", "tags", "contributors"):
        present = present | F.col(c).isNotNull()
    out = {
        "github_present": present,
        "github_repo_full_name": F.col("index.repo_full_name"),
        "github_repo_url": F.col("index.repo_url"),
        "github_collected_at": F.col("index.collected_at"),
        **{f"github_{k}": v for k, v in repo.items()},
        "github_open_issues_count_repo": F.col("repo.open_issues_count"),
        "github_license_spdx": F.col("repo.license.spdx_id"),
        "github_releases_count": _size(F.col("releases")),
        "github_latest_release_published_at": latest,
        "github_tags_count": _size(F.col("tags")),
        "github_contributors_count": _size(F.col("contributors")),
        "github_contributors_top_share": top_share(
            F.transform("contributors", lambda c: c["contributions"])),
        "github_open_issues_count_api": _size(F.col("open_issues")),
        "github_open_pulls_count_api": _size(F.col("open_pulls")),
        "github_workflows_count": _size(F.col("workflows")),
        "github_has_codeowners": N.as_flag(F.col("has_codeowners")),
        "github_has_security_policy": N.as_flag(F.col("has_security_policy")),
        "github_has_dependabot_config": N.as_flag(F.col("has_dependabot")),
        "github_has_codeql_workflow": mentions_codeql(F.col("workflows")),
        "github_commit_windows_present": _size(F.col("commit_windows")),
        "github_commits_latest_window_days": window["days"],
        "github_commits_latest_window_count": window["commits"],
    }
    return profiles.select("entity", *[v.alias(k) for k, v in out.items()])


def commit_windows(commits: DataFrame, as_of: str, days: Sequence[int] = (30, 90, 365)) -> DataFrame:
    """Commits per entity in the last n days before an explicit moment."""
    now = F.lit(as_of).cast("timestamp")
    return commits.groupBy("entity").agg(*[
        F.count_if(F.col("committed_at") >= F.timestamp_add("DAY", F.lit(-n), now))
        .alias(f"commits_{n}d") for n in days])


def issue_posture(profiles: DataFrame) -> DataFrame:
    """Open issues without pull requests, open pull requests, and workflow posture."""
    issues = F.filter("open_issues", lambda i: i["pull_request"].isNull())
    return profiles.select(
        "entity", _size(issues).alias("github_open_issues_only"),
        _size(F.col("open_pulls")).alias("github_open_prs"),
        (_size(F.col("workflows")) > 0).alias("github_has_ci_workflows"),
        _size(F.col("workflows")).alias("github_ci_workflow_count"),
        mentions_codeql(F.col("workflows")).alias("github_has_codeql_workflow"))


def activity_rollup(windows: DataFrame, measures: Sequence[str] = K.ROLLUP_MEASURES) -> DataFrame:
    """Sum, mean, maximum and latest value of each measure over an entity's windows."""
    end = F.col("window_end_yyyymmdd")
    present = [m for m in measures if m in windows.columns]
    order = F.coalesce(end, F.lit(""))
    value = {m: N.finite_double(F.col(m)) for m in present}
    px = K.ACTIVITY_PREFIX
    return windows.groupBy("entity").agg(
        F.lit(True).alias(px + "present"), F.count(F.lit(1)).alias(px + "window_count"),
        F.max_by(N.finite_double(F.col("sample_percent")), order).alias(px + "sample_percent"),
        F.max_by("window_start_yyyymmdd", order).alias(px + "latest_window_start"),
        F.max(end).alias(px + "latest_window_end"),
        *[c for m in present for c in (
            F.sum(value[m]).alias(f"{px}{m}_sum"), F.avg(value[m]).alias(f"{px}{m}_mean"),
            F.max(value[m]).alias(f"{px}{m}_max"),
            F.max_by(F.col(m), order).alias(f"{px}latest_{m}"))],
    )


def health_features(scores: DataFrame) -> DataFrame:
    return scores.select(
        "entity", F.col("value").isNotNull().alias("healthscore_present"),
        F.col("value").alias("healthscore_value"), F.col("date").alias("healthscore_date"),
        F.col("collected_at").alias("healthscore_collected_at"))


# --- fixed values: zero defaults of absent families ---
BUNDLE_DEFAULTS = {
    "snapshot_present": False, "advisories_present": False, "advisory_count": 0,
    "advisory_cve_count": 0, "advisory_active_warning_count": 0, "advisory_count_last_365d": 0,
    "advisory_count_last_90d": 0, "advisory_severity_bonus": 0, "advisory_cvss_ge_7_count": 0,
    "healthscore_present": False, "swh_present": False, "swh_origin_found": False,
    "swh_has_snapshot": False, "swh_visit_count": 0, "swh_visits_last_365d": 0,
    "swh_snapshot_branch_count": 0, "github_present": False, "gharchive_present": False,
    "gharchive_window_count": 0,
    **{f"swh_{c}": False for c in K.VISIT_FLAGS}, **{f"swh_{c}": 0 for c in K.VISIT_INTS},
}


def build_bundle(registry: DataFrame, families: Sequence[DataFrame]) -> DataFrame:
    """Registry left-joined with one-row-per-entity families; absent families get defaults."""
    bundle = registry
    for family in families:
        bundle = bundle.join(family, "entity", "left")
    filled = {
        c: F.coalesce(F.col(c), F.lit(v).cast(bundle.schema[c].dataType))
        for c, v in BUNDLE_DEFAULTS.items() if c in bundle.columns
    }
    return bundle.withColumns(filled)


# --- fixed values: bundle column -> training column ---
BUNDLE_TO_MODEL = {
    "swh_present": "swh_present_any",
    "swh_has_snapshot": "swh_has_snapshot_to_date",
    "swh_visit_count": "swh_visit_count_to_date",
    "swh_archive_age_days": "swh_archive_age_days_to_date",
    "advisories_present": "advisories_present_any",
    "advisory_count": "advisory_count_to_date",
    "advisory_cve_count": "advisory_cve_count_to_date",
    "advisory_max_cvss": "advisory_max_cvss_to_date",
    "advisory_mean_cvss": "advisory_mean_cvss_to_date",
    "advisory_days_since_first": "advisory_days_since_first_to_date",
    "advisory_days_since_latest": "advisory_days_since_latest_to_date",
    "advisory_span_days": "advisory_span_days_to_date",
    "advisory_count_last_365d": "advisories_last_365d",
    "advisory_cvss_ge_7_count": "advisory_cvss_ge_7_count_to_date",
}


def align_to_model(bundle: DataFrame, feature_columns: Sequence[str], as_of: str) -> DataFrame:
    """Bundle rows in the training contract: renamed, ordered, double; plus missing fraction."""
    renamed = bundle.withColumnsRenamed(
        {k: v for k, v in BUNDLE_TO_MODEL.items() if k in bundle.columns})
    window = D.calendar_window(F.to_date(F.lit(as_of)))
    numeric = ("double", "float", "integer", "long", "short", "byte", "boolean", "string")

    def value(name: str) -> Column:
        if name in window:
            return window[name].cast("double")
        if name in renamed.columns and renamed.schema[name].dataType.typeName() in numeric:
            return F.col(name).try_cast("double")
        return F.lit(None).cast("double")

    aligned = renamed.select("entity", *[value(c).alias(c) for c in feature_columns])
    missing = sum((F.col(c).isNull().cast("int") for c in feature_columns), F.lit(0))
    return aligned.withColumns({
        "missing_features": missing,
        "missing_fraction": missing / F.lit(float(max(1, len(feature_columns)))),
    })
