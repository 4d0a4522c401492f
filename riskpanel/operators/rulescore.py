"""Transparent rule score: eight capped components over the current-point bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions import dates as D
from riskpanel.functions import numbers as N
from riskpanel.functions import text as T

TOP_DEPENDENCIES = 5


def _cap(points: Column, name: str) -> Column:
    return F.least(points, F.lit(K.RULE_CAPS[name])).cast("int")


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def history_points(count: Column, within_90: Column, within_365: Column) -> Column:
    older = F.greatest(F.lit(0), within_365 - within_90)
    history = F.least(F.lit(15), count * 2)
    recency = F.least(F.lit(15), within_90 * 10 + older * 5)
    return F.when(count > 0, _cap(history + recency, "advisory_history")).otherwise(0)


def staleness_points(days_since_commit: Column, days_since_release: Column) -> Column:
    """Commit age brackets; a very old release counts only where it exceeds them."""
    commit = days_since_commit.try_cast("int")
    release = days_since_release.try_cast("int")
    by_commit = (
        F.when(commit > 1825, 16).when(commit > 1095, 12).when(commit > 730, 9)
        .when(commit > 365, 6).when(commit > 180, 3).otherwise(0)
    )
    by_release = F.when(
        release > 730, F.least(F.lit(8), F.floor(release / 365) * 3)).otherwise(0)
    return _cap(F.greatest(by_commit, by_release), "staleness")


def governance_points() -> Column:
    """Points for missing artefacts of an archived repository; none without archive data."""
    automated = F.col("swh_has_dependabot") | F.col("swh_has_github_actions")
    missing = (
        F.when(F.col("swh_has_security_md"), 0).otherwise(3)
        + F.when(automated, 0).otherwise(3)
        + F.when(F.col("swh_has_tests_directory"), 0).otherwise(2)
        + F.when(F.col("swh_has_changelog"), 0).otherwise(2)
    )
    return F.when(F.col("swh_present"), _cap(missing, "governance")).otherwise(0)


def health_points(value: Column, step: float, top: int) -> Column:
    """Distance from full health in steps, rounded half to even."""
    health = F.least(F.greatest(value.try_cast("double"), F.lit(0.0)), F.lit(100.0))
    points = N.half_even((100.0 - health) / step).cast("int")
    return F.when(value.try_cast("double").isNotNull(),
                  F.least(F.greatest(points, F.lit(0)), F.lit(top)))


def sensitive_words(name: Column) -> Column:
    """Security words that occur anywhere in a name."""
    low = F.lower(name)
    return F.filter(
        F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in K.SENSITIVE_NAME_WORDS]),
        lambda w: w.isNotNull())


def dependency_edges(snapshots: DataFrame) -> DataFrame:
    """Distinct (parent, dependency) pairs with valid dependency names."""
    names = F.explode(F.col("plugin_api.dependencies.name"))
    return (
        snapshots.select(F.col("entity").alias("parent"), names.alias("name"))
        .select("parent", T.valid_entity_id(F.col("name")).alias("dependency"))
        .where(F.col("dependency").isNotNull()).distinct()
    )


def dependency_risk(edges: DataFrame, risk: DataFrame) -> DataFrame:
    """Risk points of each dependency edge.

    ``risk`` has one row per entity: advisory_count, advisory_max_cvss,
    advisory_days_since_latest, active_warnings, healthscore_value, has_snapshot.
    """
    table = risk.withColumnRenamed("entity", "dependency")
    count, cvss = _zero(F.col("advisory_count")), F.col("advisory_max_cvss")
    active = _zero(F.col("active_warnings"))
    recent = N.as_flag(F.col("advisory_days_since_latest") <= 365)
    by_score = F.when(cvss >= 9.0, 6).when(cvss >= 7.0, 4).when(cvss >= 4.0, 2).otherwise(0)
    points = (
        F.least(F.lit(10), count * 2) + by_score + F.when(recent, 3).otherwise(0)
        + F.least(F.lit(10), active * 5)
        + _zero(health_points(F.col("healthscore_value"), 25.0, 4))
    )
    return edges.join(table, "dependency", "left").select(
        "parent", "dependency", count.alias("advisory_count"), cvss.alias("max_cvss"),
        recent.alias("recent_advisory_365d"), active.alias("active_warnings"),
        points.cast("int").alias("risk_points"),
        (~N.as_flag(F.col("has_snapshot"))).alias("snapshot_missing"),
        (count == 0).alias("advisories_missing"),
        F.col("healthscore_value").isNull().alias("healthscore_missing"),
        "advisory_latest_published_date")


def dependency_rollup(risks: DataFrame) -> DataFrame:
    """Parent totals: points of the five riskiest dependencies, the worst one, missing data."""
    order = Window.partitionBy("parent").orderBy(
        F.desc("risk_points"), F.desc(_zero(F.col("max_cvss"))), "dependency")
    top = (
        risks.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= TOP_DEPENDENCIES)
        .groupBy("parent").agg(
            F.sum("risk_points").alias("dependency_risk_points"),
            F.array_sort(F.collect_list(F.when(
                F.col("risk_points") > 0, F.struct("place", "dependency", "risk_points"))))
            .alias("dependency_details_top"))
    )
    worst = F.struct(F.col("max_cvss"), F.col("dependency"))
    totals = risks.groupBy("parent").agg(
        F.count(F.lit(1)).alias("dependency_total"),
        F.count_if(F.col("advisory_count") > 0).alias("deps_with_any_advisory"),
        F.count_if("recent_advisory_365d").alias("deps_with_recent_advisory_365d"),
        F.count_if(F.col("active_warnings") > 0).alias("deps_with_active_warning"),
        F.max("max_cvss").alias("worst_dep_max_cvss"),
        F.min_by(worst, F.when(F.col("max_cvss").isNotNull(),
                               F.struct(-F.col("max_cvss"), F.col("dependency")))).alias("worst"),
        *[F.count_if(c).alias(c) for c in
          ("snapshot_missing", "advisories_missing", "healthscore_missing")],
    )
    return totals.join(top, "parent").select(
        F.col("parent").alias("entity"), *[c for c in totals.columns if c not in ("parent", "worst")],
        F.col("worst.dependency").alias("worst_dep_id"), "dependency_risk_points",
        "dependency_details_top")


def _evidence(released: Column, words: Column, as_of: str) -> dict[str, Column]:
    """What each component's points rest on, in words and counts."""
    def told(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label} "), value.cast("long").cast("string"))

    missing = F.concat_ws(
        ", ", F.when(~_known("swh_has_security_md"), "security policy"),
        F.when(~(_known("swh_has_dependabot") | _known("swh_has_github_actions")), "automation"),
        F.when(~_known("swh_has_tests_directory"), "tests"), F.when(~_known("swh_has_changelog"), "changelog"))
    return {
        "advisory_history": F.concat_ws(
            ", ", told("advisories", _zero(F.col("advisory_count"))), told("in 90 days", _zero(F.col("advisory_count_last_90d"))),
            told("in 365 days", _zero(F.col("advisory_count_last_365d")))),
        "advisory_severity": told("severity bonus", F.col("advisory_severity_bonus")),
        "staleness": F.concat_ws(
            ", ", told("days since commit", F.floor(F.col("swh_days_since_last_commit").try_cast("double"))),
            told("days since release", F.datediff(F.to_date(F.lit(as_of)), released))),
        "active_warnings": told("active warnings", F.col("snapshot_active_security_warning_count")),
        "governance": F.concat(F.lit("missing "), missing),
        "dependency": told("dependency points", F.col("dependency_risk_points")),
        "health_score": told("health", F.floor(F.col("healthscore_value").try_cast("double"))),
        "security_sensitivity": F.concat(F.lit("name holds "), F.array_join(words, ", ")),
    }


def _known(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def rule_score(bundle: DataFrame, as_of: str, name: str = "entity") -> DataFrame:
    """Score of every bundle row; ``dependency_risk_points`` comes from the roll-up."""
    released = D.iso_date(F.col("snapshot_latest_release_timestamp"))
    release_age = F.datediff(F.to_date(F.lit(as_of)), released)
    words = sensitive_words(F.col(name).cast("string"))
    raw_health = health_points(F.col("healthscore_value"), 5.0, 20)
    components = {
        "advisory_history": history_points(
            F.col("advisory_count"), F.col("advisory_count_last_90d"),
            F.col("advisory_count_last_365d")),
        "advisory_severity": _cap(F.col("advisory_severity_bonus"), "advisory_severity"),
        "staleness": staleness_points(F.col("swh_days_since_last_commit"), release_age),
        "active_warnings": _cap(
            _zero(F.col("snapshot_active_security_warning_count")) * 8, "active_warnings"),
        "governance": governance_points(),
        "dependency": _cap(
            F.floor(_zero(F.col("dependency_risk_points")) / 4), "dependency"),
        "health_score": _cap(_zero(F.floor(raw_health / 4)), "health_score"),
        "security_sensitivity": F.when(
            F.size(words) > 0, K.RULE_CAPS["security_sensitivity"]).otherwise(0),
    }
    evidence = _evidence(released, words, as_of)
    scored = bundle.select(
        "*", *[v.cast("int").alias(f"points_{k}") for k, v in components.items()],
        *[v.alias(f"evidence_{k}") for k, v in evidence.items()], words.alias("sensitive_words"))
    total = sum((F.col(f"points_{k}") for k in components), F.lit(0))
    reasons = F.filter(
        F.array(*[
            F.when(F.col(f"points_{k}") > 0,
                   F.concat(F.lit(f"{k} +"), F.col(f"points_{k}").cast("string"), F.lit(f" of {K.RULE_CAPS[k]}: "),
                            F.col(f"evidence_{k}")))
            for k in components]),
        lambda r: r.isNotNull())
    final = F.when(total == 0, K.RULE_DEFAULT_SCORE).otherwise(F.least(total, F.lit(100)))
    return scored.select(
        "entity", final.cast("int").alias("score"), *[f"points_{k}" for k in components],
        "sensitive_words",
        F.when(total == 0, F.array(F.lit("no rule matched: default score")))
        .otherwise(reasons).alias("reasons"))
