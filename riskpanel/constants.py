"""Word lists, weights, thresholds and column families.

Everything in this file is data that results depend on; nothing here is logic.
"""

# --- fixed values: keyword sets (substring match on lower-cased text) ---
SECURITY_KEYWORDS = (
    "cve", "vulnerability", "vulnerable", "vuln", "exploit", "exploitable", "security fix",
    "security patch", "security update", "security advisory", "rce", "remote code execution",
    "xss", "cross-site", "injection", "sql injection", "csrf", "ssrf", "xxe", "deserialization",
    "authentication bypass", "auth bypass", "privilege escalation", "path traversal",
    "directory traversal", "open redirect", "information disclosure", "data leak", "sanitize",
    "sanitise", "arbitrary code", "arbitrary file", "buffer overflow",
)
HOTFIX_KEYWORDS = (
    "hotfix", "hot fix", "hot-fix", "urgent fix", "critical fix", "emergency fix",
    "emergency patch", "emergency release", "critical patch", "critical update", "critical bug",
)
DEPENDENCY_KEYWORDS = (
    "bump ", "bumps ", "update dependency", "upgrade dependency", "dependabot", "renovate",
    "greenkeeper", "snyk",
)
COMMIT_SECURITY_KEYWORDS = (
    "cve", "vulnerability", "vuln", "exploit", "security fix", "security patch",
    "security update", "rce", "xss", "injection", "csrf", "ssrf", "privilege escalation",
    "path traversal", "authentication bypass", "arbitrary code", "buffer overflow", "sanitize",
    "sanitise", "information disclosure",
)
SENSITIVE_NAME_WORDS = (
    "credentials", "auth", "secret", "token", "password", "security", "saml", "oauth", "ldap",
    "openid", "kerberos", "ssh", "ssl", "tls", "jwt", "certificate", "signing",
)

# --- fixed values: automation accounts ---
BOT_LOGINS = (
    "dependabot", "dependabot-preview", "renovate-bot", "greenkeeper", "snyk-bot",
    "github-actions", "codecov-io", "coveralls", "sonarcloud", "mergify", "semantic-release-bot",
)
BOT_SUFFIX = "[bot]"

# --- fixed values: activity event types ---
EVENT_TYPES = (
    "PushEvent", "PullRequestEvent", "PullRequestReviewEvent", "IssuesEvent", "ReleaseEvent",
    "WatchEvent", "ForkEvent", "CreateEvent",
)

# --- fixed values: commit message patterns (Java regex, applied to trimmed text) ---
CONVENTIONAL_COMMIT_PATTERN = (
    r"(?i)^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(\(.+?\))?!?:"
)
MERGE_COMMIT_PATTERN = r"(?i)^merge\b"
ISSUE_REFERENCE_PATTERN = r"#\d+"
EMPTY_COMMIT_MESSAGES = ("", ".", "-", "wip")

# --- fixed values: top-level file names that switch a directory flag on ---
DIRECTORY_FLAG_NAMES = {
    "has_readme": ("readme", "readme.md", "readme.txt"),
    "has_dot_github": (".github",),
    "has_jenkinsfile": ("jenkinsfile",),
    "has_travis_yml": (".travis.yml",),
    "has_security_md": ("security.md", "security.txt", "security"),
    "has_changelog": (
        "changelog", "changelog.md", "changelog.txt", "changes", "changes.md", "history.md",
    ),
    "has_contributing_md": ("contributing", "contributing.md", "contributing.txt"),
    "has_dockerfile": ("dockerfile", "dockerfile.build"),
    "has_pom_xml": ("pom.xml",),
    "has_build_gradle": ("build.gradle", "build.gradle.kts"),
    "has_mvn_wrapper": (".mvn",),
    "has_tests_directory": ("tests", "test", "spec", "src"),
    "has_github_actions": ("workflows",),
    "has_dependabot": ("dependabot.yml",),
    "has_sonar_config": ("sonar-project.properties", ".sonarcloud.properties"),
    "has_snyk_config": (".snyk",),
}

# --- fixed values: CVSS v3 metric weights ---
CVSS_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"N": 0.0, "L": 0.22, "H": 0.56},
    "PR_UNCHANGED": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_CHANGED": {"N": 0.85, "L": 0.68, "H": 0.5},
}
SEVERITY_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_BONUS = {"none": 0, "low": 1, "medium": 3, "high": 6, "critical": 10}

# --- fixed values: rule-score ceilings ---
RULE_CAPS = {
    "advisory_history": 30,
    "advisory_severity": 15,
    "staleness": 20,
    "active_warnings": 15,
    "governance": 10,
    "dependency": 5,
    "health_score": 5,
    "security_sensitivity": 20,
}
RULE_DEFAULT_SCORE = 5

# --- fixed values: evaluation grids ---
PRECISION_KS = (10, 25, 50, 100)
OPERATIONAL_KS = (5, 10, 15, 20, 25, 30, 40, 50, 75, 100, 150, 200)
RECALL_TARGETS = (0.25, 0.5, 0.75, 0.9)
LABEL_HORIZONS = (1, 3, 6, 12)
SUBSET_SIZES = (5, 10, 15, 20, 30, 50)

# --- fixed values: panel measures ---
ACTIVITY_PREFIX = "gharchive_"
TRAILING_MEASURES = (
    "events_total", "push_events", "pull_request_events", "pull_request_closed_events",
    "pull_request_merged_events", "pull_request_review_events", "issues_events",
    "issues_closed_events", "release_events", "unique_actors", "days_active", "watch_events",
    "fork_events", "tag_create_events", "branch_create_events", "bot_events", "human_events",
    "unique_human_actors", "security_keyword_events", "hotfix_keyword_events",
    "dependency_bump_events",
)
STALENESS_MEASURES = {
    "push": "push_events",
    "pr": "pull_request_events",
    "issue": "issues_events",
    "release": "release_events",
    "any_activity": "events_total",
    "release_tag": "tag_create_events",
    "security_keyword": "security_keyword_events",
}
DELTA_MEASURES = (
    "push_events", "pull_request_events", "release_events", "security_keyword_events",
    "watch_events",
)
ACTIVITY_COUNT_COLUMNS = (
    "events_total", "push_events", "pull_request_events", "pull_request_closed_events",
    "pull_request_merged_events", "pull_request_review_events", "issues_events",
    "issues_closed_events", "release_events", "unique_actors", "days_active",
    "source_window_count", "watch_events", "fork_events", "branch_create_events",
    "tag_create_events", "bot_events", "human_events", "unique_human_actors",
    "security_keyword_events", "hotfix_keyword_events", "dependency_bump_events",
)
ACTIVITY_NULLABLE_COLUMNS = (
    "sample_percent", "owner_push_fraction", "pr_merge_time_p50_hours",
    "pr_merge_time_p90_hours", "issue_close_time_p50_hours", "issue_close_time_p90_hours",
)
# ratio name -> (numerator, denominator, smoothed, lowest value, highest value); both trailing
# windows exist, with smallest denominators 5 (3 months) and 8 (6 months).
GUARDED_RATIOS = {
    "prs_per_push": ("pull_request_events", "push_events", True, None, 10.0),
    "merge_rate": ("pull_request_merged_events", "pull_request_events", True, 0.0, 1.0),
    "pr_close_rate": ("pull_request_closed_events", "pull_request_events", True, 0.0, 1.5),
    "pr_review_intensity": (
        "pull_request_review_events", "pull_request_events", True, 0.0, 10.0,
    ),
    "issue_close_rate": ("issues_closed_events", "issues_events", True, 0.0, 1.5),
    "actors_per_active_day": ("unique_actors", "days_active", False, 0.0, 10.0),
}
RATIO_MIN_DENOMINATOR = {3: 5.0, 6: 8.0}

# --- fixed values: archive visit columns ---
VISIT_FLAGS = tuple(DIRECTORY_FLAG_NAMES)
VISIT_INTS = (
    "top_level_entry_count", "commit_count", "timezone_diversity", "security_fix_commit_count",
)
VISIT_DOUBLES = (
    "author_committer_lag_p50_hours", "author_committer_lag_p90_hours",
    "weekend_commit_fraction", "merge_commit_fraction", "conventional_commit_fraction",
    "issue_reference_rate", "empty_message_rate", "author_committer_mismatch_rate",
    "late_night_commit_fraction",
)

# --- fixed values: columns that never train ---
NEVER_TRAIN_COLUMNS = (
    "plugin_id", "package_id", "entity", "month", "month_id", "period", "yyyymm",
    "months_until_next_advisory", "future_advisory_count", "label_advisory_within_1m",
    "label_advisory_within_3m", "label_advisory_within_6m", "label_advisory_within_12m",
    "had_advisory_this_month", "has_advisory_this_month", "advisory_this_month",
    "advisory_count_this_month",
)
WINDOW_COLUMNS = ("window_index", "window_year", "window_month")

# --- fixed values: activity rollup measures of the current-point bundle ---
ROLLUP_MEASURES = (
    "events_total", "actors_unique", "pushes", "committers_unique", "push_days_active",
    "prs_opened", "prs_closed", "prs_merged", "prs_closed_unmerged", "pr_reviewed_ratio",
    "pr_merge_time_p50_hours", "pr_close_without_merge_ratio", "issues_opened", "issues_closed",
    "issues_reopened", "issue_reopen_rate", "issue_close_time_p50_hours", "releases",
    "days_since_last_release", "hotfix_proxy", "security_label_proxy", "churn_intensity",
    "owner_concentration",
)
