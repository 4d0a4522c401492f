"""Activity events: payload extraction, normalisation, fan-out and monthly aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions import dates as D
from riskpanel.functions import numbers as N
from riskpanel.functions import text as T
from riskpanel.functions import urls as U
from riskpanel.functions.quantiles import exact_quantiles
from riskpanel.session import materialize

PAYLOAD_SCHEMA = (
    "action STRING, ref_type STRING, "
    "pull_request STRUCT<merged STRING, created_at STRING, closed_at STRING, "
    "title STRING, body STRING>, "
    "issue STRUCT<created_at STRING, closed_at STRING, title STRING, body STRING>"
)


def scan_events(
    raw: DataFrame,
    repos: DataFrame,
    first_day: str,
    last_day: str,
    day_column: str = "day",
    sample_percent: float = 100.0,
    seed: int | None = None,
    sample_key: str | None = None,
) -> DataFrame:
    """Events of the wanted repositories and types in a day range, payload fields extracted.

    ``raw`` is partitioned by day, so the range prunes partitions. ``repos`` holds one
    repo_full_name per row; Spark broadcasts it only while it is below the session threshold.
    A sample by ``sample_key`` is the same whatever the files and partitions; without it rows are drawn.
    """
    if not 0 < sample_percent <= 100:
        raise ValueError("sample_percent must be > 0 and <= 100")
    ranged = raw.where(F.col(day_column).between(first_day, last_day))
    if sample_percent < 100:
        share = sample_percent / 100.0
        if sample_key is None:
            ranged = ranged.sample(share, seed=seed)
        else:
            ranged = ranged.where(N.stable_bucket(F.col(sample_key), seed or 0) < share)
    wanted = repos.select(F.col("repo_full_name").alias("repo")).distinct()
    kept = ranged.where(F.col("event_type").isin(*K.EVENT_TYPES)).join(wanted, "repo", "left_semi")
    p = F.from_json("payload", PAYLOAD_SCHEMA)
    parsed = kept.withColumn("p", p)
    return parsed.select(
        "repo", "actor_login", "event_type", F.col("created_at").alias("event_ts"),
        F.col("p.action").alias("action"),
        F.col("p.pull_request.merged").alias("pr_merged"),
        F.col("p.pull_request.created_at").alias("pr_created_ts"),
        F.col("p.pull_request.closed_at").alias("pr_closed_ts"),
        F.col("p.issue.created_at").alias("issue_created_ts"),
        F.col("p.issue.closed_at").alias("issue_closed_ts"),
        F.col("p.ref_type").alias("ref_type"),
        T.text_blob(
            F.col("p.pull_request.title"), F.col("p.pull_request.body"),
            F.col("p.issue.title"), F.col("p.issue.body"),
        ).alias("text_blob"),
        F.lit(float(sample_percent)).alias("sample_percent"),
    )


def fan_out(events: DataFrame, repo_map: DataFrame) -> DataFrame:
    """One copy of an event per entity its repository belongs to.

    An equi-join on the repository name; a repository with a very large share of events is
    split by adaptive skew handling when the map is too large to broadcast.
    """
    targets = repo_map.select(F.col("repo_full_name").alias("repo"), "entity").distinct()
    return events.join(targets, "repo").where(
        T.blank_to_null(F.col("entity").cast("string")).isNotNull()
    )


def fan_out_months(events: DataFrame, repo_map: DataFrame) -> DataFrame:
    """``entity, month, n_events, first_event`` over all repositories of an entity (events: repo, month, event_id).

    A repository's events become one row that lists its months before they are copied, so its events are never multiplied by
    its entities. The lists are opened only after entities are dealt to a fixed number of partitions, which adaptive
    coalescing does not merge, and an entity's months are added up where they are opened.
    """
    months = events.groupBy("repo", "month").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    per_repo = months.groupBy("repo").agg(F.collect_list(F.struct("month", "n", "first")).alias("months"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fan_out(per_repo, repo_map.repartition(parts, "entity")).select("entity", "months").repartition(parts, "entity")
    return dealt.select("entity", F.inline("months")).groupBy("entity", "month").agg(
        F.sum("n").alias("n_events"), F.min("first").alias("first_event"))


def normalize_events(
    events: DataFrame,
    collected_at: str,
    registry_path: str,
    range_start: str,
    range_end: str,
    bucket_days: int,
    source: str = "gharchive_bigquery",
) -> DataFrame:
    """The 25 normalised event columns; events without a usable month are dropped."""
    stamp = events.schema["event_ts"].dataType.typeName()
    ts = F.col("event_ts") if stamp.startswith("timestamp") else D.iso_timestamp(F.col("event_ts"))
    day = ts.cast("date")
    first, last = F.to_date(F.lit(range_start)), F.to_date(F.lit(range_end))
    start = D.bucket_start(day, first, bucket_days)
    owner, name = U.split_repo(F.col("repo"))
    month = D.month_key(day)
    return events.select(
        F.lit(source).alias("source"), F.lit(collected_at).alias("collected_at"),
        "sample_percent", F.lit(registry_path).alias("registry_path"),
        F.date_format(start, "yyyyMMdd").alias("source_window_start_yyyymmdd"),
        F.date_format(D.bucket_end(start, last, bucket_days), "yyyyMMdd")
        .alias("source_window_end_yyyymmdd"),
        "entity", F.col("repo").alias("repo_full_name"), owner.alias("repo_owner"),
        name.alias("repo_name"), "event_type", ts.alias("event_ts"), day.alias("event_date"),
        F.year(day).alias("event_year"), F.month(day).alias("event_month"),
        month.alias("event_yyyymm"), "actor_login", "action",
        T.tri_state(F.col("pr_merged")).alias("pr_merged"),
        *[D.iso_timestamp(F.col(c).cast("string")).alias(c) for c in
          ("pr_created_ts", "pr_closed_ts", "issue_created_ts", "issue_closed_ts")],
        "ref_type", T.blank_to_null(F.col("text_blob")).alias("text_blob"),
    ).where(F.col("event_yyyymm").isNotNull())


def _flags() -> dict[str, Column]:
    """What is counted per actor and month, over the tested columns of an event."""
    kind, closed = F.col("kind"), F.coalesce(F.col("act") == "closed", F.lit(False))
    pull, issue, created = (kind == f"{k}Event" for k in ("PullRequest", "Issues", "Create"))
    return {
        "events_total": F.lit(True),
        "push_events": kind == "PushEvent",
        "pull_request_events": pull,
        "pull_request_closed_events": pull & closed,
        "pull_request_merged_events": pull & F.coalesce(F.col("pr_merged"), F.lit(False)),
        "pull_request_review_events": kind == "PullRequestReviewEvent",
        "issues_events": issue,
        "issues_closed_events": issue & closed,
        "release_events": kind == "ReleaseEvent",
        "watch_events": kind == "WatchEvent",
        "fork_events": kind == "ForkEvent",
        "branch_create_events": created & (F.col("ref") == "branch"),
        "tag_create_events": created & (F.col("ref") == "tag"),
        "security_keyword_events": F.col("security"),
        "hotfix_keyword_events": F.col("hotfix"),
        "bump_by_text": F.col("bump"),
        "bump_by_pull": pull & ~F.col("bump"),
    }


def tested_events(events: DataFrame, *more: Column) -> DataFrame:
    """Each test once per event with a usable key: what :func:`actor_measures` counts, and ``more`` columns."""
    keyed = events.where(
        T.blank_to_null(F.col("entity").cast("string")).isNotNull()
        & T.blank_to_null(F.col("event_yyyymm")).isNotNull()
    )
    sampled = F.when(F.col("sample_percent").isNotNull(), F.col("event_ts"))
    return keyed.select(
        "entity", F.trim(F.col("event_yyyymm")).alias("month"),
        F.coalesce(F.trim(F.col("actor_login")), F.lit("")).alias("actor"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth("event_date"))
        .alias("day_bit"), "sample_percent", sampled.alias("sampled_at"),
        T.mentions_any(F.col("text_blob"), K.DEPENDENCY_KEYWORDS).alias("bump"),
        F.trim(F.col("event_type")).alias("kind"), F.lower(F.trim("action")).alias("act"),
        F.lower(F.trim("ref_type")).alias("ref"), "pr_merged",
        T.mentions_any(F.col("text_blob"), K.SECURITY_KEYWORDS).alias("security"),
        T.mentions_any(F.col("text_blob"), K.HOTFIX_KEYWORDS).alias("hotfix"),
        F.coalesce("event_ts", F.col("event_date").cast("timestamp"), F.try_to_timestamp(F.trim("event_yyyymm"), F.lit("yyyy-MM")))
        .alias("event_time"), *more,
    )


def actor_measures() -> list[Column]:
    """Aggregates of tested events that can be merged again."""
    return [
        *[F.count_if(c).alias(k) for k, c in _flags().items()],
        F.bit_or("day_bit").alias("days"),
        F.max_by("sample_percent", "sampled_at").alias("sample_percent"),
        F.max("sampled_at").alias("sampled_at"),
    ]


def fact_columns() -> list[str]:
    return [*_flags(), "days", "sample_percent", "sampled_at"]


def merge_actor_facts(facts: DataFrame) -> DataFrame:
    """One row per (entity, month, actor) out of any number of partial ones."""
    return facts.groupBy("entity", "month", "actor").agg(
        *[F.sum(k).alias(k) for k in _flags()],
        F.bit_or("days").alias("days"),
        F.max_by("sample_percent", "sampled_at").alias("sample_percent"),
        F.max("sampled_at").alias("sampled_at"),
    )


def months_of_actors(by_actor: DataFrame) -> DataFrame:
    """Counts, distinct actors and active days per (entity, month), from one row per actor."""
    bot, named = T.is_bot(F.col("actor")), F.col("actor") != ""
    human_pushes = F.when(named & ~bot & (F.col("push_events") > 0), F.col("push_events"))
    summed = [k for k in _flags() if not k.startswith("bump_")]
    px = K.ACTIVITY_PREFIX
    totals = by_actor.groupBy("entity", "month").agg(
        *[F.sum(k).alias(px + k) for k in summed],
        F.sum(F.when(bot, F.col("events_total")).otherwise(0)).alias(px + "bot_events"),
        F.sum(F.when(bot, 0).otherwise(F.col("events_total"))).alias(px + "human_events"),
        F.sum(F.col("bump_by_text") + F.when(bot, F.col("bump_by_pull")).otherwise(0))
        .alias(px + "dependency_bump_events"),
        F.count_if(named).alias(px + "unique_actors"),
        F.count_if(named & ~bot).alias(px + "unique_human_actors"),
        F.bit_count(F.bit_or("days")).cast("long").alias("days_seen"),
        (F.max(human_pushes) / F.sum(human_pushes)).alias(px + "owner_push_fraction"),
        F.max_by("sample_percent", "sampled_at").alias(px + "sample_percent"),
    )
    return totals.select(
        "entity", "month", F.lit(True).alias(px + "present"),
        *[c for c in totals.columns if c.startswith(px)],
        F.coalesce("days_seen", F.lit(0).cast("long")).alias(px + "days_active"),
    )


def activity_counts(events: DataFrame) -> DataFrame:
    """Counts, distinct actors and active days per (entity, month).

    Aggregated first per actor: the automation test runs once per actor, distinct actors become
    row counts, and a hot month is spread over its actors. Days of a month are bits of one
    integer, so distinct days need no distinct aggregate.
    """
    by_actor = tested_events(events).groupBy("entity", "month", "actor").agg(*actor_measures())
    return months_of_actors(by_actor)


def _window_columns() -> list[Column]:
    return [T.blank_to_null(F.col(f"source_window_{x}_yyyymmdd")).alias(a) for x, a in (("start", "s"), ("end", "e"))]


def _timing_columns() -> list[Column]:
    """What was resolved, if anything, and in how many hours; nothing that ended before it began."""
    pull = (F.col("event_type") == "PullRequestEvent") & (F.col("pr_merged") == F.lit(True))
    issue = (F.col("event_type") == "IssuesEvent") & (F.lower(F.trim("action")) == "closed")
    opened = F.when(pull, F.col("pr_created_ts")).when(issue, F.col("issue_created_ts"))
    done = F.when(pull, F.col("pr_closed_ts")).when(issue, F.col("issue_closed_ts"))
    timed = (pull | issue) & (done > opened)
    return [
        F.when(timed, F.when(pull, "pr_merge").otherwise("issue_close")).alias("resolved"),
        F.when(timed, D.duration_hours(opened, done)).alias("hours"),
    ]


def event_facts(events: DataFrame) -> DataFrame:
    """What all monthly measures need of each event, in one pass over the wide events, written once.

    Texts are tested and left behind here; counts, windows and durations read the narrow table.
    """
    tested = tested_events(events, *_window_columns(), *_timing_columns()).drop("event_time")
    return materialize(tested, "event-facts", many_columns=True)


def _windows(facts: DataFrame) -> DataFrame:
    return facts.select("entity", "month", "s", "e").distinct().groupBy("entity", "month").agg(
        F.count(F.lit(1)).alias(K.ACTIVITY_PREFIX + "source_window_count"))


def source_window_counts(events: DataFrame) -> DataFrame:
    """Number of distinct collection windows that contributed to an (entity, month)."""
    return _windows(
        events.where(T.blank_to_null(F.col("event_yyyymm")).isNotNull())
        .select("entity", F.trim("event_yyyymm").alias("month"), *_window_columns()))


def _durations(facts: DataFrame) -> DataFrame:
    hours = exact_quantiles(
        facts.where(F.col("resolved").isNotNull()), ["entity", "month", "resolved"], F.col("hours"), {"p50": 0.5, "p90": 0.9})
    return hours.groupBy("entity", "month").agg(*[
        F.max(F.when(F.col("resolved") == kind, F.col(p)))
        .alias(f"{K.ACTIVITY_PREFIX}{kind}_time_{p}_hours")
        for kind in ("pr_merge", "issue_close") for p in ("p50", "p90")
    ])


def resolution_times(events: DataFrame) -> DataFrame:
    """Median and 90th percentile hours from opening to merge and to close."""
    return _durations(events.select("entity", F.trim("event_yyyymm").alias("month"), *_timing_columns()))


def counts_of_facts(facts: DataFrame) -> DataFrame:
    """Counts and source windows per (entity, month)."""
    by_actor = facts.groupBy("entity", "month", "actor").agg(*actor_measures())
    return months_of_actors(by_actor).join(_windows(facts), ["entity", "month"], "left")


def activity_months(events: DataFrame) -> DataFrame:
    """All activity base columns per (entity, month); the wide events are read once."""
    facts = event_facts(events)
    return counts_of_facts(facts).join(_durations(facts), ["entity", "month"], "left")
