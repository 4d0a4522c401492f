"""The dense entity × month panel and its to-date, as-of and trailing features.

Every fact family is first aggregated to one row per (entity, month), so a hot entity costs
no more than its number of months. Families and grid rows are then stacked, moved once by
entity, and all features are window frames over month numbers on that one distribution.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions import dates as D
from riskpanel.functions import numbers as N

GRID_COLUMNS = (
    "month", "window_start", "window_end", "window_year", "window_month", "window_index",
)


def by_entity(df: DataFrame, entity: str = "entity") -> DataFrame:
    """Distribute by entity over a fixed number of partitions.

    The explicit number keeps adaptive coalescing away: before the grid is multiplied by its
    months the rows are few, and merging them would leave the later frames to a handful of tasks.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, entity)


def dense_grid(entities: DataFrame, start: str, end: str, entity: str = "entity") -> DataFrame:
    """Every entity at every month of the range; other entity columns are carried along.

    The short entity table is distributed by entity before it is multiplied by the months, so
    the dense grid itself never travels.
    """
    last = D.months_between_keys(start, end) - 1
    indexed = by_entity(entities, entity).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("window_index")
    )
    begin = F.add_months(F.to_date(F.lit(f"{start}-01")), F.col("window_index"))
    return indexed.withColumns(
        {
            "month": D.month_key(begin),
            "window_start": begin,
            "window_end": F.last_day(begin),
            "window_year": F.year(begin),
            "window_month": F.month(begin),
            "month_no": D.month_number(begin),
        }
    )


def panel_rows(grid: DataFrame, families: Sequence[DataFrame]) -> DataFrame:
    """One row per (entity, month number) out of grid rows and monthly family rows.

    Family months outside the grid stay (``in_grid`` false) so that to-date frames see history
    from before the first grid month. Grid and families share one distribution by entity, which
    the union keeps and all later windows reuse. Each part travels as one struct, so a stacked row
    has one filled column and not the null columns of all other families.
    """
    keys = ("entity", "month_no")

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    parts = {"grid": grid, **{f"family_{i}": by_entity(family) for i, family in enumerate(families)}}
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [packed(df, name) for name, df in parts.items()])
    met = stacked.groupBy(*keys).agg(*[F.first(name, ignorenulls=True).alias(name) for name in parts])
    return met.select(
        *keys, F.col("grid").isNotNull().alias("in_grid"),
        *[F.col(name)[c].alias(c) for name, df in parts.items() for c in df.columns if c not in keys])


def month_window() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("month_no")


def to_date() -> WindowSpec:
    return month_window().rangeBetween(Window.unboundedPreceding, 0)


def trailing(months: int, lag: int = 0) -> WindowSpec:
    """Last ``months`` months, ending ``lag`` months before the current one."""
    return month_window().rangeBetween(-(months - 1) - lag, -lag)


def whole_history() -> WindowSpec:
    return month_window().rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def _last_365_days(count: str, count_on_last_day: str) -> Column:
    """Facts at most 365 days before the month end, both ends included.

    Going back 365 days from a month end reaches the month end of a year ago, or the day after
    it when a leap day lies between. So the frame is twelve whole months, plus the last day of
    the month before them when no leap day lies between.
    """
    year_ago = F.last_day(F.add_months(F.col("window_start"), -12))
    reaches_back = F.datediff(F.col("window_end"), year_ago) <= 365
    whole_months = _zero(F.sum(count).over(trailing(12)))
    edge = _zero(F.sum(count_on_last_day).over(trailing(1, lag=12)))
    return whole_months + F.when(reaches_back, edge).otherwise(F.lit(0))


# --- incidents -----------------------------------------------------------------------------


def incident_months(incidents: DataFrame) -> DataFrame:
    """Monthly measures of incidents (entity, published, cvss)."""
    day = F.col("published")
    return (
        incidents.where(day.isNotNull())
        .groupBy("entity", D.month_number(day).alias("month_no"))
        .agg(
            F.count(F.lit(1)).alias("inc_n"),
            F.count_if(day == F.last_day(day)).alias("inc_n_last_day"),
            F.max("cvss").alias("inc_cvss_max"),
            F.sum("cvss").alias("inc_cvss_sum"),
            F.count("cvss").alias("inc_cvss_n"),
            F.count_if(F.col("cvss") >= 7.0).alias("inc_cvss_ge7"),
            F.min(day).alias("inc_first"),
            F.max(day).alias("inc_last"),
        )
    )


def new_cve_months(incidents: DataFrame) -> DataFrame:
    """Number of CVE ids an entity shows for the first time in a month.

    The distinct count to date is the running sum of these first appearances.
    """
    return (
        incidents.where(F.col("published").isNotNull())
        .select("entity", D.month_number(F.col("published")).alias("m"),
                F.explode("cve_ids").alias("cve"))
        .groupBy("entity", "cve")
        .agg(F.min("m").alias("month_no"))
        .groupBy("entity", "month_no")
        .agg(F.count(F.lit(1)).alias("inc_new_cves"))
    )


def incident_features() -> dict[str, Column]:
    """Features over stacked incident months; six stay null before the first incident."""
    n = _zero(F.sum("inc_n").over(to_date()))
    first, last = F.min("inc_first").over(to_date()), F.max("inc_last").over(to_date())
    seen = n > 0
    end = F.col("window_end")
    scored = F.sum("inc_cvss_n").over(to_date())
    return {
        "advisories_present_any": seen,
        "advisory_count_to_date": n,
        "advisory_count_this_month": _zero(F.col("inc_n")),
        "advisory_cve_count_to_date": _zero(F.sum("inc_new_cves").over(to_date())),
        "advisory_max_cvss_to_date": F.max("inc_cvss_max").over(to_date()),
        "had_advisory_this_month": _zero(F.col("inc_n")) > 0,
        "advisory_days_since_first_to_date": F.datediff(end, first),
        "advisory_days_since_latest_to_date": F.datediff(end, last),
        "advisory_span_days_to_date": F.datediff(last, first),
        "advisories_last_365d": F.when(seen, _last_365_days("inc_n", "inc_n_last_day")),
        "advisory_cvss_ge_7_count_to_date": F.when(
            seen, _zero(F.sum("inc_cvss_ge7").over(to_date()))
        ),
        "advisory_mean_cvss_to_date": F.when(
            scored > 0, F.sum("inc_cvss_sum").over(to_date()) / scored
        ),
    }


# --- archive visits ------------------------------------------------------------------------


def visit_months(visits: DataFrame, tie_breaker: str = "visit") -> DataFrame:
    """Monthly counts and the latest visit record of each (entity, month).

    ``visits`` holds entity, visit_day and any of the visit attributes.
    """
    day = F.col("visit_day")
    kept = [c for c in (*K.VISIT_FLAGS, *K.VISIT_INTS, *K.VISIT_DOUBLES,
                        "days_since_last_commit") if c in visits.columns]
    record = F.struct(day, F.col(tie_breaker).alias("tie"), *kept)
    return (
        visits.where(day.isNotNull())
        .groupBy("entity", D.month_number(day).alias("month_no"))
        .agg(
            F.count(F.lit(1)).alias("vis_n"),
            F.count_if(day == F.last_day(day)).alias("vis_n_last_day"),
            F.min(day).alias("vis_first"),
            F.max(day).alias("vis_last"),
            F.max(record).alias("vis_record"),
        )
    )


def visit_index_rows(index: DataFrame, start: str) -> DataFrame:
    """Index documents as one stacked row per entity.

    An archive index (entity, record_count) finds its origin if it counts any record. An API index says itself, in
    ``origin_found`` and ``snapshot_found``; it is marked by ``is_api``. These flags hold for the whole history.
    """
    first = F.lit(D.months_between_keys("1970-01", start) - 1 + 1970 * 12).cast("int")

    def given(name: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(name), otherwise) if name in index.columns else otherwise

    no = F.lit(False)
    api = given("is_api", no)
    counted = given("record_count", F.lit(0)) > 0
    return index.groupBy("entity").agg(
        first.alias("month_no"), F.max(F.lit(True)).alias("vis_indexed"),
        F.max(F.when(api, given("origin_found", no)).otherwise(counted)).alias("vis_origin"),
        F.max(F.when(api, given("snapshot_found", no))).alias("vis_snapshot"),
    )


def visits_with_fallback(
    archive_visits: DataFrame, archive_index: DataFrame, api_visits: DataFrame, api_index: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Visits and index of two backends: the archive where it knows an entity, else the API.

    API visits carry no attributes. An entity with API visits and no API index has found neither origin nor snapshot.
    """
    known = archive_visits.select("entity").unionByName(archive_index.select("entity")).distinct()
    other_visits = api_visits.join(known, "entity", "left_anti")
    named = api_index.select("entity", "origin_found", "snapshot_found").unionByName(
        other_visits.select("entity", F.lit(False).alias("origin_found"), F.lit(False).alias("snapshot_found")).distinct())
    other_index = named.join(known, "entity", "left_anti").withColumn("is_api", F.lit(True))
    visits = archive_visits.unionByName(other_visits, allowMissingColumns=True)
    index = archive_index.select("entity", "record_count").unionByName(other_index, allowMissingColumns=True)
    return visits, index


def visit_features(columns: Sequence[str]) -> dict[str, Column]:
    """As-of features: the latest visit at or before each month end supplies its record."""
    n = _zero(F.sum("vis_n").over(to_date()))
    ever = _zero(F.sum("vis_n").over(whole_history())) > 0
    indexed, origin, snapshot = (
        F.max(c).over(whole_history()) if c in columns else None
        for c in ("vis_indexed", "vis_origin", "vis_snapshot"))
    first, last = F.min("vis_first").over(to_date()), F.max("vis_last").over(to_date())
    return {
        "swh_present_any": ever if indexed is None else ever | indexed.isNotNull(),
        "swh_origin_found": ever if origin is None else N.as_flag(origin),
        "swh_has_snapshot_to_date": n > 0 if snapshot is None else (n > 0) & F.coalesce(snapshot, F.lit(True)),
        "swh_visit_count_to_date": n,
        "swh_visits_this_month": _zero(F.col("vis_n")),
        "swh_visits_last_365d": _last_365_days("vis_n", "vis_n_last_day"),
        "swh_latest_visit_date_to_date": last,
        "swh_archive_age_days_to_date": F.datediff(last, first),
        "vis_asof": F.last("vis_record", ignorenulls=True).over(to_date()),
    }


def visit_attributes(available: Sequence[str]) -> dict[str, Column]:
    """Flat columns out of the as-of visit record, with their zero defaults."""
    def part(name: str, kind: str) -> Column:
        return F.col("vis_asof")[name] if name in available else F.lit(None).cast(kind)

    out = {f"swh_{c}": N.as_flag(part(c, "boolean")) for c in K.VISIT_FLAGS}
    out |= {f"swh_{c}": _zero(part(c, "int")) for c in K.VISIT_INTS}
    out["swh_days_since_last_commit"] = D.commit_age_at(
        F.col("window_end"), part("visit_day", "date"), part("days_since_last_commit", "double")
    )
    out |= {f"swh_{c}": part(c, "double") for c in K.VISIT_DOUBLES}
    return out


# --- activity ------------------------------------------------------------------------------


def _m(measure: str) -> str:
    return f"{K.ACTIVITY_PREFIX}{measure}"


def activity_defaults(columns: Sequence[str]) -> dict[str, Column]:
    """Month values with zero counts where an entity showed no activity."""
    def pick(name: str, default: Column | None, kind: str) -> Column:
        if _m(name) not in columns:
            return default if default is not None else F.lit(None).cast(kind)
        return F.coalesce(F.col(_m(name)), default) if default is not None else F.col(_m(name))

    out = {_m("present"): pick("present", F.lit(False), "boolean")}
    out |= {_m(c): pick(c, None, "double") for c in K.ACTIVITY_NULLABLE_COLUMNS}
    out |= {_m(c): pick(c, F.lit(0).cast("long"), "long") for c in K.ACTIVITY_COUNT_COLUMNS}
    return out


def activity_frames() -> dict[str, Column]:
    """All window frames the derived activity columns need."""
    out: dict[str, Column] = {}
    for measure in K.TRAILING_MEASURES:
        value = F.coalesce(F.col(_m(measure)).cast("double"), F.lit(0.0))
        for months in (3, 6):
            out[f"{_m(measure)}_trailing_{months}m"] = F.sum(value).over(trailing(months))
    for name, measure in K.STALENESS_MEASURES.items():
        last_seen = F.max(F.when(F.col(_m(measure)) > 0, F.col("month_no"))).over(to_date())
        out[_m(f"months_since_{name}")] = F.col("month_no") - last_seen
    for measure in K.DELTA_MEASURES:
        out[f"prev_{measure}"] = _zero(
            F.sum(F.col(_m(measure)).cast("double")).over(trailing(3, lag=3))
        )
    active = (F.col(_m("events_total")) > 0).cast("int")
    for months in (3, 6):
        out[f"active_{months}m"] = _zero(F.sum(active).over(trailing(months)))
    out["peak_6m"] = F.max(F.col(_m("events_total")).cast("double")).over(trailing(6))
    return out


def activity_ratios() -> dict[str, Column]:
    """Deltas, guarded ratios, active-month shares and burstiness over the frames."""
    def tail(measure: str, months: int) -> Column:
        return F.col(f"{_m(measure)}_trailing_{months}m")

    out: dict[str, Column] = {}
    for measure in K.DELTA_MEASURES:
        out[f"{_m(measure)}_trailing_3m_delta_prev_3m"] = tail(measure, 3) - F.col(
            f"prev_{measure}"
        )
    for name, (top, bottom, smoothed, low, high) in K.GUARDED_RATIOS.items():
        for months, smallest in K.RATIO_MIN_DENOMINATOR.items():
            divide = N.safe_div_smooth if smoothed else N.safe_div_min
            ratio = divide(tail(top, months), tail(bottom, months), smallest)
            out[_m(f"{name}_{months}m")] = N.clip(ratio, low, high)
    for months in (3, 6):
        observed = F.least(F.col("window_index") + 1, F.lit(months))
        out[_m(f"active_month_ratio_{months}m")] = N.clip(
            N.safe_div(F.col(f"active_{months}m"), observed), 0.0, 1.0
        )
    active = F.col("active_6m")
    out[_m("releases_per_active_month_6m")] = N.clip(
        N.safe_div_min(tail("release_events", 6), active, 2.0), 0.0, 12.0
    )
    out[_m("events_per_active_month_6m")] = N.clip(
        N.safe_div_min(tail("events_total", 6), active, 2.0), 0.0, 500.0
    )
    mean_6m = tail("events_total", 6) / F.least(F.col("window_index") + 1, F.lit(6))
    out[_m("activity_burstiness_6m")] = N.clip(
        N.safe_div_min(F.col("peak_6m"), mean_6m, 5.0), 0.0, 10.0
    )
    out[_m("bot_event_ratio_3m")] = N.clip(
        N.safe_div_smooth(tail("bot_events", 3), tail("events_total", 3), 5.0), 0.0, 1.0
    )
    discussed = tail("pull_request_events", 3) + tail("issues_events", 3)
    out[_m("security_keyword_rate_3m")] = N.clip(
        N.safe_div_smooth(tail("security_keyword_events", 3), discussed, 5.0), 0.0, 1.0
    )
    out[_m("stars_trailing_6m")] = tail("watch_events", 6)
    out[_m("forks_trailing_6m")] = tail("fork_events", 6)
    return out


# --- whole panel ---------------------------------------------------------------------------


def incident_panel(grid: DataFrame, incidents: DataFrame) -> DataFrame:
    """Grid rows with the twelve incident columns."""
    carried = [c for c in grid.columns if c != "month_no"]
    rows = panel_rows(grid, [incident_months(incidents), new_cve_months(incidents)])
    features = rows.select(*carried, "month_no", "in_grid",
                           *[v.alias(k) for k, v in incident_features().items()])
    return features.where("in_grid").drop("in_grid")


def visit_panel(grid: DataFrame, visits: DataFrame, tie_breaker: str = "visit",
                index: DataFrame | None = None, start: str | None = None) -> DataFrame:
    """Grid rows with the archive presence columns and the as-of visit attributes."""
    carried = [c for c in grid.columns if c != "month_no"]
    families = [visit_months(visits, tie_breaker)]
    if index is not None and start is not None:
        families.append(visit_index_rows(index, start))
    rows = panel_rows(grid, families)
    framed = rows.select(*carried, "month_no", "in_grid",
                         *[v.alias(k) for k, v in visit_features(rows.columns).items()])
    available = rows.schema["vis_record"].dataType.names
    attributes = visit_attributes(available)
    return (
        framed.where("in_grid").drop("in_grid")
        .select("*", *[v.alias(k) for k, v in attributes.items()]).drop("vis_asof")
    )


def activity_panel(grid: DataFrame, months: DataFrame) -> DataFrame:
    """Grid rows with the activity base, trailing and derived columns.

    ``months`` is one row per (entity, month). Months outside the grid do not count, so this
    family needs no history from before the grid.
    """
    carried = [c for c in grid.columns if c != "month_no"]
    family = months.withColumn("month_no", D.month_number_of_key(F.col("month"))).drop("month")
    rows = panel_rows(grid, [family]).where("in_grid")
    return _derive_activity(rows, [*carried, "month_no"])


def _derive_activity(rows: DataFrame, carried: Sequence[str]) -> DataFrame:
    base = activity_defaults(rows.columns)
    based = rows.select(*carried, *[v.alias(k) for k, v in base.items()])
    framed = based.select("*", *[v.alias(k) for k, v in activity_frames().items()])
    derived = activity_ratios()
    final = framed.select("*", *[v.alias(k) for k, v in derived.items()])
    helpers = [f"prev_{m}" for m in K.DELTA_MEASURES] + ["active_3m", "active_6m", "peak_6m"]
    return final.drop(*helpers)


def build_panel(
    entities: DataFrame,
    start: str,
    end: str,
    incidents: DataFrame,
    activity: DataFrame,
    visits: DataFrame,
    visit_index: DataFrame | None = None,
    tie_breaker: str = "visit",
) -> DataFrame:
    """The complete feature panel: all families over one stacked, entity-distributed table."""
    grid = dense_grid(entities, start, end)
    carried = [c for c in grid.columns if c != "month_no"]
    first = D.months_between_keys("1970-01", start) - 1 + 1970 * 12
    last = first + D.months_between_keys(start, end) - 1
    in_range = F.col("month_no").between(first, last)
    activity_rows = (
        activity.withColumn("month_no", D.month_number_of_key(F.col("month"))).drop("month")
        .where(in_range)
    )
    families = [
        incident_months(incidents), new_cve_months(incidents), activity_rows,
        visit_months(visits, tie_breaker),
    ]
    if visit_index is not None:
        families.append(visit_index_rows(visit_index, start))
    rows = panel_rows(grid, families)
    base = activity_defaults(rows.columns)
    defaults = rows.select(
        *[c for c in rows.columns if c not in base], *[v.alias(k) for k, v in base.items()]
    )
    frames = incident_features() | visit_features(rows.columns) | activity_frames()
    framed = defaults.select(
        *carried, "month_no", "in_grid", *base, *[v.alias(k) for k, v in frames.items()]
    ).where("in_grid")
    available = rows.schema["vis_record"].dataType.names
    late = visit_attributes(available) | activity_ratios()
    kept = [k for k in frames if k.startswith(("advisor", "had_", "swh_", K.ACTIVITY_PREFIX))]
    return framed.select(
        *carried, "month_no", *[k for k in kept if k.startswith(("advisor", "had_"))],
        *base, *[k for k in kept if k.startswith(K.ACTIVITY_PREFIX)],
        *[v.alias(k) for k, v in late.items() if k.startswith(K.ACTIVITY_PREFIX)],
        *[k for k in kept if k.startswith("swh_")],
        *[v.alias(k) for k, v in late.items() if k.startswith("swh_")],
    )
