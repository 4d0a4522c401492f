"""Archive graph: visits, branches, revisions and directory entries as set-based joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions import dates as D
from riskpanel.functions import numbers as N
from riskpanel.functions import text as T
from riskpanel.functions.quantiles import exact_quantiles


def text_of(binary: Column) -> Column:
    """Text of a binary name; bytes that are not UTF-8 become question marks."""
    return F.regexp_replace(F.make_valid_utf8(binary.cast("string")), "�", "?")


def visits_of(statuses: DataFrame, urls: DataFrame, first: str, before: str) -> DataFrame:
    """Visits with a snapshot, of the wanted origins, within [first, before)."""
    wanted = urls.select(F.col("url").alias("origin")).distinct()
    ranged = (F.col("date") >= F.lit(first).cast("timestamp")) & (
        F.col("date") < F.lit(before).cast("timestamp")
    )
    return (
        statuses.where(ranged & F.col("snapshot").isNotNull())
        .join(wanted, "origin", "left_semi")
        .select("origin", "visit", F.col("date").alias("visit_date"),
                F.col("snapshot").alias("snapshot_id"))
    )


def latest_per_month(visits: DataFrame) -> DataFrame:
    """The latest visit of each origin and calendar month.

    A plain maximum, so partial aggregation leaves one row per task, origin and month to shuffle.
    """
    best = F.max(F.struct("visit_date", "visit", "snapshot_id")).alias("best")
    return (
        visits.groupBy("origin", F.trunc("visit_date", "month").alias("visit_month")).agg(best)
        .select("origin", "best.visit", "best.visit_date", "best.snapshot_id")
    )


def latest_visits(visits: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest visits of every origin."""
    from pyspark.sql import Window

    order = Window.partitionBy("origin").orderBy(F.desc("visit_date"), F.desc("visit"))
    return (
        visits.withColumn("visit_rank", F.row_number().over(order))
        .where(F.col("visit_rank") <= max(1, n))
    )


def branches_of(branches: DataFrame, visits: DataFrame) -> DataFrame:
    """Distinct revision branches of the visited snapshots."""
    return (
        branches.where(F.col("target_type") == "revision")
        .join(visits.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
        .select("snapshot_id", "target")
        .distinct()
    )


def revisions_of(revisions: DataFrame, branches: DataFrame) -> DataFrame:
    """Distinct (id, directory) of the revisions some branch points at."""
    targets = branches.select(F.col("target").alias("id")).distinct()
    return revisions.join(targets, "id", "left_semi").select("id", "directory").distinct()


def entries_of(entries: DataFrame, branches: DataFrame, revisions: DataFrame) -> DataFrame:
    """Entries of root directories reachable from the branches.

    The large entry table takes part in one semi-join only; its other side is the distinct set
    of root directories.
    """
    roots = (
        revisions.where(F.col("directory").isNotNull())
        .join(branches.select(F.col("target").alias("id")).distinct(), "id", "left_semi")
        .select(F.col("directory").alias("directory_id"))
        .distinct()
    )
    return (
        entries.join(roots, "directory_id", "left_semi")
        .select("directory_id", text_of(F.col("name")).alias("entry_name"), "type")
        .distinct()
    )


def revision_meta(revisions: DataFrame, branches: DataFrame) -> DataFrame:
    """Commit metadata per snapshot, for all snapshots at once."""
    meta = revisions.select(
        F.col("id").alias("target"), F.col("date").alias("author_date"), "committer_date",
        F.col("date_offset").cast("int").alias("author_tz_offset_minutes"),
        F.col("committer_offset").cast("int").alias("committer_tz_offset_minutes"),
        text_of(F.col("message")).alias("commit_message"),
    )
    return branches.join(meta, "target").withColumnRenamed("target", "revision_id")


def snapshot_signals(revisions: DataFrame, branches: DataFrame) -> DataFrame:
    """Commit signals of every snapshot from the graph: each is computed once, however often it was visited."""
    return commit_signals(revision_meta(revisions, branches))


def visits_of_graph(
    visits: DataFrame, branches: DataFrame, revisions: DataFrame, entries: DataFrame
) -> DataFrame:
    """Every visit with the directory flags and commit signals of its snapshot, all from graph tables."""
    kept = entries_of(entries, branches, revisions)
    flags = name_flags(snapshot_entries(kept, branches, revisions))
    return assemble_visits(visits, flags, snapshot_signals(revisions, branches))


def snapshot_entries(entries: DataFrame, branches: DataFrame, revisions: DataFrame) -> DataFrame:
    """Directory entry names per snapshot, for all snapshots at once."""
    roots = (
        branches.join(
            revisions.where(F.col("directory").isNotNull()).select(
                F.col("id").alias("target"), F.col("directory").alias("directory_id")),
            "target")
        .select("snapshot_id", "directory_id")
        .distinct()
    )
    return roots.join(entries, "directory_id").select("snapshot_id", "entry_name")


def commit_signals(meta: DataFrame) -> DataFrame:
    """Commit-history signals per snapshot; ``last_author_date`` anchors the recency."""
    author, committer = F.col("author_date"), F.col("committer_date")
    tz, tz2 = F.col("author_tz_offset_minutes"), F.col("committer_tz_offset_minutes")
    message = F.col("commit_message")
    # the searched text is prepared once per commit, not once per keyword
    prepared = meta.withColumn("blob", F.lower(F.trim(message)))
    rows, dated = F.count(F.lit(1)), F.count(author)

    def share(condition: Column, of: Column) -> Column:
        return N.half_even(N.safe_div(F.count_if(condition).cast("double"), of), 4)

    counted = prepared.groupBy("snapshot_id").agg(
        rows.alias("commit_count"),
        F.max(author).alias("last_author_date"),
        F.count_distinct(tz).alias("timezone_diversity"),
        share(D.is_weekend(author), dated).alias("weekend_commit_fraction"),
        F.count_if(T.mentions_any(F.col("blob"), K.COMMIT_SECURITY_KEYWORDS))
        .alias("security_fix_commit_count"),
        share(T.is_merge_message(message), rows).alias("merge_commit_fraction"),
        share(T.is_conventional_message(message), rows).alias("conventional_commit_fraction"),
        share(T.references_issue(message), rows).alias("issue_reference_rate"),
        share(T.is_empty_message(message), rows).alias("empty_message_rate"),
        share(tz != tz2, rows).alias("author_committer_mismatch_rate"),
        share(D.is_late_night(author, tz), dated).alias("late_night_commit_fraction"),
    )
    lag = exact_quantiles(
        meta.where(committer >= author), ["snapshot_id"], D.duration_hours(author, committer),
        {"p50": 0.5, "p90": 0.9},
    )
    lags = lag.select(
        "snapshot_id", *[N.half_even(F.col(p), 2).alias(f"author_committer_lag_{p}_hours")
                         for p in ("p50", "p90")])
    return counted.join(lags, "snapshot_id", "left")


def name_flags(entries: DataFrame) -> DataFrame:
    """Directory flags per snapshot from its entry names."""
    name = F.lower(F.trim("entry_name"))
    return (
        entries.where(F.col("entry_name").isNotNull())
        .groupBy("snapshot_id")
        .agg(
            *[F.bool_or(name.isin(*names)).alias(flag)
              for flag, names in K.DIRECTORY_FLAG_NAMES.items()],
            F.count_distinct(name).cast("int").alias("top_level_entry_count"),
        )
    )


def assemble_visits(visits: DataFrame, flags: DataFrame, signals: DataFrame) -> DataFrame:
    """Snapshot-level flags and signals attached to every visit.

    Recency is measured once per snapshot, from its latest visit.
    """
    seen = visits.groupBy("snapshot_id").agg(F.max("visit_date").alias("snapshot_visit"))
    age = (F.unix_micros("snapshot_visit") - F.unix_micros("last_author_date")) / 8.64e10
    recency = N.half_even(F.greatest(F.lit(0.0), age), 1)
    aged = (
        signals.join(seen, "snapshot_id")
        .withColumn("days_since_last_commit",
                    F.when(F.col("last_author_date").isNotNull(), recency))
        .drop("snapshot_visit", "last_author_date")
    )
    joined = visits.join(flags, "snapshot_id", "left").join(aged, "snapshot_id", "left")
    filled = {c: F.coalesce(F.col(c), F.lit(False)) for c in K.VISIT_FLAGS}
    filled |= {c: F.coalesce(F.col(c), F.lit(0)) for c in K.VISIT_INTS}
    return joined.withColumns(filled)


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Keyed merge that keeps history: an incoming record replaces one with the same key.

    Within one side the highest ``order`` wins. A maximum over records instead of a sorted
    window, so many copies of one key collapse before they travel.
    """
    rest = [c for c in incoming.columns if c not in keys]
    both = existing.withColumn("is_new", F.lit(0)).unionByName(
        incoming.withColumn("is_new", F.lit(1)), allowMissingColumns=True
    )
    record = F.max_by(F.struct(*rest), F.struct("is_new", order)).alias("record")
    return both.groupBy(*keys).agg(record).select(*keys, "record.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First record per key in an explicit input order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("record")
    ).select(*keys, "record.*")


def visit_profile(visits: DataFrame, index: DataFrame | None = None,
                  tie_breaker: str = "visit") -> DataFrame:
    """Current-point visit profile per entity; the last 365 days end at its latest visit.

    Visits are first counted per day, so a hot entity shrinks to its days before the window
    that needs its latest day.
    """
    day = F.col("visit_day")
    attributes = [c for c in (*K.VISIT_FLAGS, *K.VISIT_INTS, *K.VISIT_DOUBLES,
                              "days_since_last_commit") if c in visits.columns]
    daily = visits.groupBy("entity", "visit_day").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(F.col(tie_breaker).alias("tie"), *attributes)).alias("record"),
    )
    bounds = daily.groupBy("entity").agg(
        F.sum("n").alias("visit_count"), F.min(day).alias("first_day"),
        F.max(day).alias("last_day"), F.max(F.struct("visit_day", "record")).alias("latest"),
    )
    recent = (
        daily.select("entity", "visit_day", "n").join(bounds.select("entity", "last_day"), "entity")
        .where(F.datediff("last_day", "visit_day") <= 365)
        .groupBy("entity").agg(F.sum("n").alias("recent"))
    )
    profile = bounds.join(recent, "entity", "left")
    if index is not None:
        profile = index.join(profile, "entity", "left")
        found = F.col("record_count") > 0
    else:
        found = F.col("visit_count") > 0
    kept = dict.fromkeys(attributes)
    record = F.col("latest")["record"]
    out = {
        "swh_present": F.lit(True),
        "swh_origin_found": N.as_flag(found),
        "swh_has_snapshot": N.as_flag(F.col("visit_count") > 0),
        "swh_visit_count": F.coalesce("visit_count", F.lit(0)),
        "swh_first_visit_date": F.col("first_day"),
        "swh_latest_visit_date": F.col("last_day"),
        "swh_archive_age_days": F.datediff("last_day", "first_day"),
        "swh_visits_last_365d": F.coalesce("recent", F.lit(0)),
    }
    for c in K.VISIT_FLAGS:
        out[f"swh_{c}"] = N.as_flag(record[c]) if c in kept else F.lit(False)
    for c in K.VISIT_INTS:
        out[f"swh_{c}"] = F.coalesce(record[c], F.lit(0)) if c in kept else F.lit(0)
    for c in ("days_since_last_commit", *K.VISIT_DOUBLES):
        out[f"swh_{c}"] = record[c] if c in kept else F.lit(None).cast("double")
    return profile.select("entity", *[v.alias(k) for k, v in out.items()])


def branch_count(snapshot: Column) -> Column:
    """Number of branches in a snapshot document whose branches are a map or a list."""
    branches = F.get_json_object(snapshot, "$.branches")
    as_map = F.map_keys(F.from_json(branches, "map<string,string>"))
    as_list = F.from_json(branches, "array<string>")
    return (
        F.when(branches.startswith("{"), F.size(as_map))
        .when(branches.startswith("["), F.size(as_list))
        .otherwise(0)
    )


def api_visits(documents: DataFrame) -> DataFrame:
    """Visits of the API backend: a list, or a list under ``results`` or ``visits``."""
    payload = F.trim("payload")
    listed = F.when(payload.startswith("["), payload).otherwise(
        F.coalesce(F.get_json_object(payload, "$.results"), F.get_json_object(payload, "$.visits"))
    )
    visit = F.explode(F.from_json(listed, "array<struct<date:string,visit_date:string,visit:long>>"))
    return documents.select("entity", visit.alias("v")).select(
        "entity", D.iso_date(F.coalesce(T.blank_to_null(F.col("v.date")),
                                        T.blank_to_null(F.col("v.visit_date")))).alias("visit_day"),
        F.coalesce(F.col("v.visit"), F.lit(0)).alias("visit"))


def api_profile(index: DataFrame, visits: DataFrame, latest: DataFrame,
                snapshots: DataFrame) -> DataFrame:
    """Visit profile of the API backend; the latest-visit document overrides the latest date."""
    base = visit_profile(visits).select(
        "entity", "swh_visit_count", "swh_first_visit_date", "swh_latest_visit_date",
        "swh_archive_age_days", "swh_visits_last_365d")
    body = F.coalesce(F.get_json_object("payload", "$.visit"), F.col("payload"))
    overrides = latest.select(
        "entity", F.get_json_object(body, "$.status").alias("swh_latest_visit_status"),
        F.get_json_object(body, "$.type").alias("swh_latest_visit_type"),
        D.iso_date(F.get_json_object(body, "$.date")).alias("override"))
    branches = snapshots.select(
        "entity", branch_count(F.col("payload")).alias("swh_snapshot_branch_count"),
        F.lit(True).alias("has_document"))
    return (
        index.join(base, "entity", "left").join(overrides, "entity", "left")
        .join(branches, "entity", "left")
        .select(
            "entity", F.lit(True).alias("swh_present"),
            N.as_flag(F.col("origin_found")).alias("swh_origin_found"),
            (N.as_flag(F.col("snapshot_found")) | N.as_flag(F.col("has_document")))
            .alias("swh_has_snapshot"),
            F.coalesce("swh_visit_count", F.lit(0)).alias("swh_visit_count"),
            "swh_first_visit_date",
            F.coalesce("override", "swh_latest_visit_date").alias("swh_latest_visit_date"),
            "swh_latest_visit_status", "swh_latest_visit_type", "swh_archive_age_days",
            F.coalesce("swh_visits_last_365d", F.lit(0)).alias("swh_visits_last_365d"),
            F.coalesce("swh_snapshot_branch_count", F.lit(0)).alias("swh_snapshot_branch_count"))
    )


def yearly_coverage(df: DataFrame, moment: str, entity: str) -> DataFrame:
    """Rows and distinct entities per calendar year."""
    return df.groupBy(F.year(moment).alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(entity)).alias("n_entities"))
