"""Declared schemas of the landed files and archive tables (Spark DDL)."""

REGISTRY = (
    "plugin_id STRING, plugin_site_url STRING, plugin_api_url STRING, plugin_name STRING, "
    "plugin_title STRING, title STRING, plugin_excerpt STRING, plugin_labels ARRAY<STRING>, "
    "historical_plugin_ids ARRAY<STRING>, aliases ARRAY<STRING>, collected_at STRING"
)
_SEVERITY = "version STRING, vector STRING, base_score DOUBLE, url STRING"
INCIDENT = (
    "source STRING, type STRING, advisory_id STRING, plugin_id STRING, url STRING, "
    "published_date STRING, title STRING, security_warning_ids ARRAY<STRING>, "
    "active_security_warning BOOLEAN, cve_ids ARRAY<STRING>, cvss DOUBLE, "
    "vulnerabilities ARRAY<STRUCT<security_warning_id STRING, url_fragment STRING, "
    f"severity_label STRING, severity_source STRING, cvss STRUCT<{_SEVERITY}>>>, "
    "severity_summary STRUCT<max_severity_label STRING, max_cvss_base_score DOUBLE>"
)
EVENT = (
    "source STRING, collected_at STRING, sample_percent DOUBLE, registry_path STRING, "
    "source_window_start_yyyymmdd STRING, source_window_end_yyyymmdd STRING, plugin_id STRING, "
    "repo_full_name STRING, repo_owner STRING, repo_name STRING, event_type STRING, "
    "event_ts TIMESTAMP, event_date DATE, event_year INT, event_month INT, event_yyyymm STRING, "
    "actor_login STRING, action STRING, pr_merged BOOLEAN, pr_created_ts TIMESTAMP, "
    "pr_closed_ts TIMESTAMP, issue_created_ts TIMESTAMP, issue_closed_ts TIMESTAMP, "
    "ref_type STRING, text_blob STRING"
)
PREDICTIONS = "plugin_id STRING, month STRING, y_true INT, y_prob DOUBLE"
SNAPSHOT = (
    "plugin_id STRING, collected_at STRING, current_version STRING, latest_release_date STRING, "
    "repo_url STRING, scm_url STRING, github_stars LONG, github_forks LONG, github_watchers LONG, "
    "github_open_issues_only LONG, github_open_prs LONG, github_contributors_top_sampled LONG, "
    "github_top_contributor_share DOUBLE, github_has_ci_workflows BOOLEAN, "
    "github_ci_workflow_count LONG, "
    "plugin_api STRUCT<name: STRING, version: STRING, requiredCore: STRING, "
    "releaseTimestamp: STRING, firstRelease: STRING, previousVersion: STRING, "
    "labels: ARRAY<STRING>, categories: ARRAY<STRING>, maintainers: ARRAY<STRING>, "
    "dependencies: ARRAY<STRUCT<name: STRING, optional: BOOLEAN, version: STRING>>, "
    "securityWarnings: ARRAY<STRUCT<id: STRING, url: STRING, active: BOOLEAN>>, "
    "stats: STRUCT<installations: ARRAY<STRUCT<timestamp: LONG, total: LONG>>>, scm: STRING>"
)
REPO_PROFILE = (
    "entity STRING, index STRUCT<repo_full_name: STRING, repo_url: STRING, collected_at: STRING>, "
    "repo STRUCT<stargazers_count: LONG, forks_count: LONG, watchers_count: LONG, "
    "open_issues_count: LONG, subscribers_count: LONG, archived: BOOLEAN, "
    "default_branch: STRING, license: STRUCT<spdx_id: STRING>>, "
    "releases ARRAY<STRUCT<published_at: STRING, created_at: STRING>>, "
    "tags ARRAY<STRUCT<name: STRING>>, contributors ARRAY<STRUCT<contributions: LONG>>, "
    "open_issues ARRAY<STRUCT<number: LONG, pull_request: STRING>>, "
    "open_pulls ARRAY<STRUCT<number: LONG>>, workflows ARRAY<STRUCT<name: STRING>>, "
    "has_codeowners BOOLEAN, has_security_policy BOOLEAN, has_dependabot BOOLEAN, "
    "commit_windows ARRAY<STRUCT<days: INT, commits: LONG>>"
)
OSV = (
    "id STRING, published STRING, modified STRING, aliases ARRAY<STRING>, related ARRAY<STRING>, "
    "severity ARRAY<STRUCT<type: STRING, score: STRING>>, "
    "database_specific STRUCT<severity: STRING>, "
    "affected ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING>>>"
)

# --- fixed values: archive graph tables ---
ARCHIVE_TABLES = {
    "content": (
        "sha1 STRING, sha1_git STRING, sha256 STRING, blake2s256 STRING, length BIGINT, "
        "status STRING, data BINARY"
    ),
    "directory": "id STRING, raw_manifest BINARY",
    "directory_entry": (
        "directory_id STRING, name BINARY, type STRING, target STRING, perms INT"
    ),
    "origin": "id STRING, url STRING",
    "origin_visit": "origin STRING, visit BIGINT, date TIMESTAMP, type STRING",
    "origin_visit_status": (
        "origin STRING, visit BIGINT, date TIMESTAMP, status STRING, snapshot STRING, type STRING"
    ),
    "release": (
        "id STRING, name BINARY, message BINARY, target STRING, target_type STRING, "
        "author BINARY, date TIMESTAMP, date_offset SMALLINT, date_raw_offset_bytes BINARY, "
        "raw_manifest BINARY"
    ),
    "revision": (
        "id STRING, message BINARY, author BINARY, date TIMESTAMP, date_offset SMALLINT, "
        "date_raw_offset_bytes BINARY, committer BINARY, committer_date TIMESTAMP, "
        "committer_offset SMALLINT, committer_date_raw_offset_bytes BINARY, directory STRING, "
        "type STRING, raw_manifest BINARY"
    ),
    "revision_history": "id STRING, parent_id STRING, parent_rank INT",
    "skipped_content": (
        "sha1 STRING, sha1_git STRING, sha256 STRING, blake2s256 STRING, length BIGINT, "
        "status STRING, reason STRING"
    ),
    "snapshot": "id STRING",
    "snapshot_branch": "snapshot_id STRING, name BINARY, target STRING, target_type STRING",
}
