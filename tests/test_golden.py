"""Hand-computed cases of the published semantics, one test per trap where it matters."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.functions import dates as D
from riskpanel.functions import numbers as N
from riskpanel.functions import severity as S
from riskpanel.functions import text as T
from riskpanel.functions import urls as U
from riskpanel.functions.quantiles import exact_quantiles, upper_median
from riskpanel.operators import activity as A
from riskpanel.operators import archive as R
from riskpanel.operators import cohort as C
from riskpanel.operators import identity as Y
from riskpanel.operators import incidents as I
from riskpanel.operators import labels as L
from riskpanel.operators import panel as P
from riskpanel.operators import ranking as E
from riskpanel.operators import rulescore as M
from riskpanel.operators import splits as X

day = dt.date.fromisoformat
INCIDENTS = "entity STRING, published DATE, cvss DOUBLE, cve_ids ARRAY<STRING>"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def entities(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity STRING")


def incident_rows(spark, *rows):
    return spark.createDataFrame(
        [(e, day(d), c, ids) for e, d, c, ids in rows], INCIDENTS)


TWO = (("demo", "2025-02-07", 4.0, ["CVE-2025-11"]), ("demo", "2025-05-21", 7.5, ["CVE-2025-12"]))


def by_month(df):
    return {r["month"]: r.asDict() for r in df.collect()}


def test_to_date_features_with_equal_days_and_a_score_on_the_line(spark):
    """One incident before the grid, two on one day of which one scores exactly 7, and a shared id."""
    history = [
        ("lib", "2023-11-30", None, ["CVE-A"]), ("lib", "2024-02-29", 7.0, ["CVE-A", "CVE-B"]),
        ("lib", "2024-02-29", 2.0, []), ("other", "2024-03-01", 9.1, ["CVE-A"]),
    ]
    grid = P.dense_grid(entities(spark, "lib", "other", "bare"), "2024-01", "2024-03")
    rows = {(r["entity"], r["month"]): r for r in P.incident_panel(grid, incident_rows(spark, *history)).collect()}
    assert len(rows) == 9
    january, february, march = (rows["lib", f"2024-0{m}"] for m in (1, 2, 3))
    assert [r["advisory_count_to_date"] for r in (january, february, march)] == [1, 3, 3]
    assert [r["advisory_count_this_month"] for r in (january, february, march)] == [0, 2, 0]
    assert [r["had_advisory_this_month"] for r in (january, february, march)] == [False, True, False]
    assert [r["advisory_cve_count_to_date"] for r in (january, february, march)] == [1, 2, 2]
    assert [r["advisory_mean_cvss_to_date"] for r in (january, february, march)] == [None, 4.5, 4.5]
    assert [r["advisory_cvss_ge_7_count_to_date"] for r in (january, february, march)] == [0, 1, 1]
    assert [r["advisory_span_days_to_date"] for r in (january, february, march)] == [0, 91, 91]
    assert february["advisory_days_since_latest_to_date"] == 0 and march["advisory_days_since_latest_to_date"] == 31
    assert january["advisory_days_since_first_to_date"] == 62
    for other, count in (("other", 1), ("bare", 0)):
        row = rows[other, "2024-03"]
        assert row["advisory_count_to_date"] == count and row["advisories_present_any"] is (count > 0)
        assert (row["advisories_last_365d"] is None) == (count == 0)


def test_history_before_the_grid_counts(spark):
    grid = P.dense_grid(entities(spark, "demo"), "2025-04", "2025-05")
    rows = by_month(P.incident_panel(grid, incident_rows(spark, *TWO)))
    assert rows["2025-04"]["advisory_count_to_date"] == 1
    assert len(rows) == 2


def test_trailing_365_days_is_inclusive_around_leap_days(spark):
    random.seed(3)
    days = [day("2022-11-01") + dt.timedelta(days=random.randrange(1500)) for _ in range(300)]
    days += [day("2024-02-29"), day("2023-03-01"), day("2023-02-28"), day("2024-02-28")]
    incidents = spark.createDataFrame([("d", x, 1.0, ["c"]) for x in days], INCIDENTS)
    grid = P.dense_grid(entities(spark, "d"), "2023-01", "2026-12")
    for row in P.incident_panel(grid, incidents).collect():
        end = row["window_end"]
        assert (row["advisories_last_365d"] or 0) == sum(
            x <= end and (end - x).days <= 365 for x in days), row["month"]


def test_adding_a_future_incident_keeps_the_past(spark):
    grid = P.dense_grid(entities(spark, "demo"), "2025-01", "2025-06")
    later = (*TWO, ("demo", "2025-06-20", 9.9, ["CVE-9"]))
    before, after = (by_month(P.incident_panel(grid, incident_rows(spark, *rows)))
                     for rows in (TWO, later))
    assert all(before[m] == after[m] for m in before if m < "2025-06")


def test_month_range_must_be_ordered(spark):
    with pytest.raises(ValueError):
        P.dense_grid(entities(spark, "a"), "2025-02", "2025-01")


def test_labels_of_two_entities(spark):
    rows = [("alpha", f"2025-{m:02d}", m in (6, 10)) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "entity STRING, month STRING, had_advisory_this_month BOOLEAN")
    out = by_month(L.attach_labels(df, (1, 3)))
    assert out["2025-03"]["label_advisory_within_3m"] == 1
    assert out["2025-05"]["label_advisory_within_3m"] == 1
    assert out["2025-06"]["label_advisory_within_3m"] == 0
    assert out["2025-12"]["label_advisory_within_1m"] is None
    assert out["2025-10"]["label_advisory_within_3m"] is None
    assert out["2025-09"]["label_advisory_within_3m"] == 1
    assert out["2025-06"]["months_until_next_advisory"] == 4
    assert out["2025-11"]["months_until_next_advisory"] is None
    assert out["2025-01"]["future_advisory_count"] == 2


@pytest.mark.parametrize("months", [["2024-12", "2025-02"], ["2025-01", "2025-01"]])
def test_gaps_and_duplicates_fail_unless_allowed(spark, months):
    df = spark.createDataFrame(
        [("a", m, False) for m in months], "entity STRING, month STRING, has_advisory_this_month BOOLEAN")
    with pytest.raises(SparkRuntimeException, match="for entity a"):
        L.attach_labels(df, (1,)).collect()
    assert L.attach_labels(df, (1,), require_dense=False).count() == 2
    assert L.density_violations(df).count() == 1


def test_label_input_aliases(spark):
    df = spark.createDataFrame([("a", 202412, 0), ("a", 202501, 2)],
                               "entity STRING, yyyymm INT, advisory_count_this_month INT")
    labels = [r["label_advisory_within_1m"] for r in
              L.attach_labels(df, (1,)).orderBy("yyyymm").collect()]
    assert labels == [1, None]
    with pytest.raises(KeyError):
        L.month_of_row(df.select("entity"))
    with pytest.raises(KeyError):
        L.incident_indicator(df.select("entity"))


def test_calendar_variant_is_strict_and_uncensored(spark):
    grid = P.dense_grid(entities(spark, "demo"), "2025-02", "2025-05")
    rows = by_month(L.calendar_panel(grid, incident_rows(spark, *TWO), (1, 3)))
    assert rows["2025-02"]["advisory_count_to_date"] == 0
    assert rows["2025-03"]["advisory_count_to_date"] == 1
    assert rows["2025-05"]["label_advisory_within_3m"] == 0
    assert rows["2025-02"]["label_advisory_within_3m"] == 1


EVENT = (
    "entity STRING, event_yyyymm STRING, event_type STRING, actor_login STRING, action STRING, "
    "pr_merged BOOLEAN, pr_created_ts TIMESTAMP, pr_closed_ts TIMESTAMP, "
    "issue_created_ts TIMESTAMP, issue_closed_ts TIMESTAMP, ref_type STRING, text_blob STRING, "
    "event_date DATE, event_ts TIMESTAMP, sample_percent DOUBLE, "
    "source_window_start_yyyymmdd STRING, source_window_end_yyyymmdd STRING"
)


def event(kind, actor, date, action=None, merged=None, created=None, closed=None, ref=None,
          text=None, month="2025-05", entity="p"):
    pull = kind == "PullRequestEvent"
    stamp = dt.datetime.fromisoformat
    c, e = (stamp(x) if x else None for x in (created, closed))
    return (entity, month, kind, actor, action, merged, c if pull else None, e if pull else None,
            None if pull else c, None if pull else e, ref, text, day(date), stamp(date), 5.0,
            "20250501", "20250530")


def test_activity_month_of_mixed_events(spark):
    events = spark.createDataFrame([
        event("PushEvent", "alice", "2025-05-01"),
        event("PushEvent", "alice", "2025-05-01"),
        event("PushEvent", "Dependabot[bot]", "2025-05-02"),
        event("PullRequestEvent", "bob", "2025-05-03", "closed", True, "2025-05-01 00:00:00",
              "2025-05-02 12:00:00", text="bump foo to 2"),
        event("PullRequestEvent", "renovate-bot", "2025-05-03", "opened"),
        event("IssuesEvent", "carol", "2025-05-04", "closed", created="2025-05-01 00:00:00",
              closed="2025-05-03 00:00:00", text="source code leak"),
        event("IssuesEvent", "", "2025-05-04", "opened"),
        event("CreateEvent", "carol", "2025-05-04", ref="tag"),
        event("WatchEvent", None, "2025-05-04"),
        event("PushEvent", "x", "2025-05-04", entity=" "),
    ], EVENT)
    row = A.activity_months(events).collect()
    assert len(row) == 1
    got = {k.removeprefix("gharchive_"): v for k, v in row[0].asDict().items()}
    expected = {
        "events_total": 9, "push_events": 3, "bot_events": 2, "human_events": 7,
        "pull_request_events": 2, "pull_request_merged_events": 1, "issues_events": 2,
        "pull_request_closed_events": 1, "issues_closed_events": 1, "tag_create_events": 1,
        "watch_events": 1, "unique_actors": 5, "unique_human_actors": 3, "days_active": 4,
        "owner_push_fraction": 1.0, "pr_merge_time_p50_hours": 36.0,
        "issue_close_time_p50_hours": 48.0, "dependency_bump_events": 2,
        "security_keyword_events": 1, "source_window_count": 1, "sample_percent": 5.0,
    }
    assert {k: got[k] for k in expected} == expected


def test_all_days_of_a_month_are_distinct(spark):
    events = spark.createDataFrame(
        [event("PushEvent", "a", f"2025-05-{d:02d}") for d in range(1, 32)], EVENT)
    assert A.activity_counts(events).first()["gharchive_days_active"] == 31


def test_rolling_features(spark):
    px = K.ACTIVITY_PREFIX
    months = spark.createDataFrame(
        [("p", "2025-01", 10, 4, 1), ("p", "2025-03", 20, 8, 0)],
        f"entity STRING, month STRING, {px}events_total LONG, {px}push_events LONG, "
        f"{px}tag_create_events LONG")
    grid = P.dense_grid(entities(spark, "p"), "2025-01", "2025-04")
    rows = by_month(P.activity_panel(grid, months))
    march, april = rows["2025-03"], rows["2025-04"]
    assert march[px + "events_total_trailing_3m"] == 30.0
    assert march[px + "months_since_release_tag"] == 2
    assert march[px + "months_since_issue"] is None
    assert march[px + "active_month_ratio_3m"] == pytest.approx(2 / 3)
    assert march[px + "active_month_ratio_6m"] == pytest.approx(2 / 3)
    assert march[px + "activity_burstiness_6m"] == pytest.approx(2.0)
    assert march[px + "prs_per_push_3m"] == pytest.approx(1 / 14)
    assert rows["2025-01"][px + "prs_per_push_3m"] is None
    assert april[px + "push_events_trailing_3m_delta_prev_3m"] == 8.0 - 4.0
    assert april[px + "bot_event_ratio_3m"] == pytest.approx(1 / 22)
    assert rows["2025-02"][px + "present"] is False


def test_asof_visit_and_commit_age(spark):
    visits = spark.createDataFrame(
        [("p", day("2025-05-10"), 1, True, 7, 2.0), ("p", day("2025-07-01"), 2, False, 9, None)],
        "entity STRING, visit_day DATE, visit LONG, has_readme BOOLEAN, commit_count INT, "
        "days_since_last_commit DOUBLE")
    grid = P.dense_grid(entities(spark, "p", "q"), "2025-04", "2025-06")
    rows = by_month(P.visit_panel(grid, visits).where("entity = 'p'"))
    may = rows["2025-05"]
    assert may["swh_days_since_last_commit"] == 23.0
    assert may["swh_has_readme"] is True and may["swh_commit_count"] == 7
    # presence uses the whole history, also before the first visit
    assert rows["2025-04"]["swh_present_any"] is True
    assert rows["2025-04"]["swh_has_snapshot_to_date"] is False
    index = spark.createDataFrame([("q", 3)], "entity STRING, record_count LONG")
    q = P.visit_panel(grid, visits, index=index, start="2025-04").where("entity = 'q'").first()
    assert q["swh_present_any"] and q["swh_origin_found"] and q["swh_visit_count_to_date"] == 0


def test_full_panel_has_all_families(spark):
    px = K.ACTIVITY_PREFIX
    months = spark.createDataFrame([("p", "2025-05", 3)],
                                   f"entity STRING, month STRING, {px}events_total LONG")
    visits = spark.createDataFrame([("p", day("2025-05-10"), 1)],
                                   "entity STRING, visit_day DATE, visit LONG")
    panel = P.build_panel(entities(spark, "p"), "2025-05", "2025-06", incident_rows(spark, *TWO),
                          months, visits)
    assert sum(c.startswith(px) for c in panel.columns) == 29 + 42 + 33
    assert sum(c.startswith("swh_") for c in panel.columns) == 8 + 30
    assert sum(c.startswith(("advisor", "had_")) for c in panel.columns) == 12


# --- scalar rules -----------------------------------------------------------------------------


def test_late_night_uses_floored_offsets(spark):
    ts = F.lit("2025-05-05 05:00:00").cast("timestamp")
    assert value(spark, D.is_late_night(ts, F.lit(-90))) is True
    assert value(spark, D.is_late_night(ts, F.lit(-60))) is False
    assert value(spark, D.is_weekend(F.lit("2025-05-03").cast("date"))) is True
    assert value(spark, D.is_weekend(F.lit("2025-05-05").cast("date"))) is False


def test_rounding_is_that_of_the_binary_value(spark):
    rows = [(a / n,) for n in range(1, 401) for a in range(n + 1)]
    rows += [(x,) for x in (-0.00625, 2.675, 12.345, 1e-9, 123456789.125, 0.5, 1.5, -2.5, 1e15 + 0.3)]
    df = spark.createDataFrame(rows, "x DOUBLE")
    for digits in (0, 2, 4, 5):
        for row in df.select("x", N.half_even(F.col("x"), digits).alias("r")).collect():
            assert row["r"] == round(row["x"], digits), (row, digits)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (0.0,)], "x DOUBLE")
    assert [str(r[0]) for r in odd.select(N.half_even(F.col("x"), 2)).collect()] == ["None", "nan", "inf", "0.0"]


def test_scores_and_ids_of_vulnerabilities_count(spark):
    schema = ("plugin_id STRING, published_date STRING, cvss DOUBLE, cve_ids ARRAY<STRING>, "
              "vulnerabilities ARRAY<STRUCT<cvss_base_score DOUBLE, cvssScore STRING, cve_id STRING, cve STRING>>, "
              "severity_summary STRUCT<max_cvss DOUBLE>")
    records = [("p", "2025-04-02", None, None, [(6.1, "8.3", "", " CVE-2 "), (None, "n/a", "CVE-1", "CVE-9")], None),
               ("q", "2025-04-02", 3.0, ["CVE-5"], None, (4.5,)), ("r", "2025-04-02", None, None, None, None)]
    got = {r["entity"]: r for r in I.panel_incidents(spark.createDataFrame(records, schema)).collect()}
    assert got["p"]["cvss"] == 8.3 and got["p"]["cve_ids"] == ["CVE-2", "CVE-1"]
    assert got["q"]["cvss"] == 4.5 and got["q"]["cve_ids"] == ["CVE-5"]
    assert got["r"]["cvss"] is None and got["r"]["cve_ids"] == []


def test_quantile_buckets_stay_small(spark):
    """Small fractions spread over buckets, signs keep their order, and the quantile stays exact."""
    from riskpanel.functions.quantiles import _bucket

    df = spark.range(1_000_000).select((F.col("id") * 1e-9).alias("v"))
    largest = df.groupBy(_bucket(F.col("v")).alias("b")).count().agg(F.max("count")).first()[0]
    assert largest <= 1_000
    assert exact_quantiles(df, [], F.col("v"), {"m": 0.5}).first()["m"] == pytest.approx(499_999.5e-9)
    odd = [-1e300, -2.5, -1e-9, 0.0, 5e-324, 1e-9, 2.5, 1.7e9, 1.71e9, float("inf"), float("nan")]
    keys = [r["b"] for r in spark.createDataFrame([(x,) for x in odd], "v DOUBLE").select(
        _bucket(F.col("v")).alias("b")).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(odd) - 1


def test_last_entry_of_an_id_within_a_record_counts(spark):
    entry = "STRUCT<security_warning_id STRING, url_fragment STRING, severity_label STRING, severity_source STRING, cvss STRUCT<version STRING, vector STRING, base_score DOUBLE, url STRING>>"
    rows = [("s", "advisory", "e", "a", 1, [("A", None, "high", "x", None), ("A", None, None, "y", None)]),
            ("s", "advisory", "e", "a", 2, [("A", None, "low", "z", None)])]
    records = spark.createDataFrame(rows, f"source STRING, type STRING, entity STRING, advisory_id STRING, seq INT, vulnerabilities ARRAY<{entry}>")
    got = I.merge_vulnerabilities(records).first()["vulnerabilities"]
    assert [(v["security_warning_id"], v["severity_label"], v["severity_source"]) for v in got] == [("A", "low", "y")]


def test_half_even_and_clip(spark):
    assert value(spark, N.half_even(F.lit(2.5))) == 2.0
    assert value(spark, N.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert value(spark, N.finite_double(F.lit("nan"))) is None
    assert value(spark, N.finite_double(F.lit("x"))) is None
    assert value(spark, N.safe_div(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, N.safe_div_smooth(F.lit(4.0), F.lit(6.0), 5.0)) == pytest.approx(5 / 8)


def test_dates(spark):
    assert value(spark, D.iso_date(F.lit(" 2025-02-30"))) is None
    assert value(spark, D.iso_date(F.lit("2025-02-03T10:00:00Z"))) == day("2025-02-03")
    assert value(spark, D.compact_date(F.lit("20250203"))) == day("2025-02-03")
    assert value(spark, D.compact_date(F.lit("2025020"))) is None
    assert value(spark, D.month_key_from_text(F.lit("202501"))) == "2025-01"
    assert value(spark, D.add_month_key(F.lit("2024-11"), 3)) == "2025-02"
    buckets = D.date_buckets(spark, "2025-01-01", "2025-01-10", 4).collect()
    assert [str(b["bucket_end"]) for b in buckets] == ["2025-01-04", "2025-01-08", "2025-01-10"]
    with pytest.raises(ValueError):
        D.date_buckets(spark, "2025-01-02", "2025-01-01", 4)


def test_keywords_and_bots(spark):
    assert value(spark, T.mentions_any(F.lit("open source"), K.SECURITY_KEYWORDS)) is True
    assert value(spark, T.mentions_any(F.lit(None).cast("string"), K.SECURITY_KEYWORDS)) is False
    assert value(spark, T.is_bot(F.lit("Renovate[BOT]"))) is True
    assert value(spark, T.is_bot(F.lit(None).cast("string"))) is False
    for words in (K.SECURITY_KEYWORDS, K.HOTFIX_KEYWORDS, K.DEPENDENCY_KEYWORDS):
        for word in words:
            assert any(m in word for m in T.minimal_words(words))
    assert value(spark, T.is_conventional_message(F.lit("fix(core)!: x"))) is True
    assert value(spark, T.is_merge_message(F.lit("mergeable"))) is False
    assert value(spark, T.is_empty_message(F.lit(" wip "))) is True
    names = [value(spark, T.fallback_repo_names(F.lit(x), "o")) for x in (" Git Tool ", "a-plugin")]
    assert names == [["o/git-tool-plugin", "o/git-tool"], ["o/a-plugin-plugin"]]


@pytest.mark.parametrize("vector,score", [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8),
    # a capped score rounds up past the cap, as in the published numbers
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.1),
    ("CVSS:3.0/AV:N/AC:L/PR:L/UI:R/S:C/C:L/I:L/A:N", 5.4),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H", None),
    ("CVSS:2.0/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None),
])
def test_base_scores(spark, vector, score):
    assert value(spark, S.cvss3_base_score(F.lit(vector))) == score


def test_severity_labels(spark):
    labels = [value(spark, S.severity_label(F.lit(x))) for x in (0.0, 3.9, 4.0, 8.9, 9.0)]
    assert labels == ["none", "low", "medium", "high", "critical"]
    array = F.array(F.lit("Low"), F.lit("HIGH"), F.lit("odd"))
    assert value(spark, S.max_severity_label(array)) == "high"


def test_urls(spark):
    canonical = U.canonical_url(F.lit(" http://v.example/a?b#c"), "v.example", "www.v.example")
    assert value(spark, canonical) == "https://www.v.example/a"
    assert value(spark, U.repo_full_name(F.lit("https://GitHub.com/o/r.git"))) == "o/r"
    assert value(spark, U.repo_full_name(F.lit("https://evilgithub.com/o/r"))) is None
    assert value(spark, U.repo_full_name(F.lit("https://www.github.com/o/r"))) is None
    assert value(spark, U.linked_repo(F.lit("https://www.github.com/o/r.git"))) == "o/r"
    url = F.lit("https://v.example/security/advisory/2024-01-24/")
    assert value(spark, U.date_from_advisory_url(url)) == day("2024-01-24")


def test_risk_tiers_and_window(spark):
    tiers = [value(spark, N.risk_tier(F.lit(p))) for p in (0.049, 0.05, 0.2)]
    assert tiers == ["Low", "Medium", "High"]
    window = D.calendar_window(F.lit("2021-08-15").cast("date"))
    assert value(spark, window["window_index"]) == 19


# --- order statistics -------------------------------------------------------------------------


def percentile(values, p):
    s = sorted(values)
    i = p * (len(s) - 1)
    lo, hi = math.floor(i), min(math.floor(i) + 1, len(s) - 1)
    return s[lo] + (s[hi] - s[lo]) * (i - lo)


def test_quantiles_against_brute_force_with_one_hot_group(spark):
    random.seed(5)
    rows = [("hot", random.choice([0.0, -3.5, 7.25, random.gauss(0, 1e4)])) for _ in range(5000)]
    rows += [(f"g{i % 50}", random.random()) for i in range(500)] + [("one", 2.0), ("one", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], F.col("v"), {"a": 0.5, "b": 0.9}).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["a"] == pytest.approx(percentile(values, 0.5), rel=1e-12)
        assert got[g]["b"] == pytest.approx(percentile(values, 0.9), rel=1e-12)
    whole = exact_quantiles(df, [], F.col("v"), {"a": 0.25}).first()
    flat = [v for vs in groups.values() for v in vs]
    assert whole["a"] == pytest.approx(percentile(flat, 0.25), rel=1e-12)
    middle = upper_median(df.where("g = 'hot'"), [], F.col("v"), "m").first()["m"]
    assert middle == sorted(groups["hot"])[len(groups["hot"]) // 2]


# --- archive ----------------------------------------------------------------------------------


def test_upsert_prefers_incoming_and_keeps_history(spark):
    old = spark.createDataFrame([("r", 1, 1, "a"), ("r", 2, 1, "b")], "k STRING, v INT, seq INT, p STRING")
    new = spark.createDataFrame([("r", 2, 1, "c"), ("r", 2, 2, "d"), ("r", 3, 1, "e")],
                                "k STRING, v INT, seq INT, p STRING")
    rows = {r["v"]: r["p"] for r in R.upsert(old, new, ["k", "v"], "seq").collect()}
    assert rows == {1: "a", 2: "d", 3: "e"}


def test_recency_is_measured_from_the_latest_visit_of_a_snapshot(spark):
    stamp = dt.datetime.fromisoformat
    visits = spark.createDataFrame(
        [("o", 1, stamp("2025-01-10"), "s"), ("o", 2, stamp("2025-03-10"), "s")],
        "origin STRING, visit LONG, visit_date TIMESTAMP, snapshot_id STRING")
    meta = spark.createDataFrame(
        [("s", stamp("2025-01-01"), stamp("2025-01-02"), 0, 60, None)],
        "snapshot_id STRING, author_date TIMESTAMP, committer_date TIMESTAMP, "
        "author_tz_offset_minutes INT, committer_tz_offset_minutes INT, commit_message STRING")
    flags = R.name_flags(spark.createDataFrame([("s", " README.md ")],
                                               "snapshot_id STRING, entry_name STRING"))
    rows = R.assemble_visits(visits, flags, R.commit_signals(meta)).collect()
    assert {r["days_since_last_commit"] for r in rows} == {68.0}
    assert all(r["has_readme"] and r["empty_message_rate"] == 1.0 for r in rows)
    assert rows[0]["author_committer_mismatch_rate"] == 1.0
    assert rows[0]["author_committer_lag_p50_hours"] == 24.0


# --- incidents --------------------------------------------------------------------------------

VULN = ("ARRAY<STRUCT<security_warning_id: STRING, url_fragment: STRING, severity_label: STRING, "
        "severity_source: STRING, cvss: STRUCT<version: STRING, vector: STRING, "
        "base_score: DOUBLE, url: STRING>>>")
RECORD = ("source STRING, type STRING, entity STRING, advisory_id STRING, url STRING, "
          "published_date STRING, title STRING, security_warning_ids ARRAY<STRING>, "
          f"active_security_warning BOOLEAN, vulnerabilities {VULN}, seq INT")


def test_merge_of_near_duplicates(spark):
    def record(seq, sid, label=None, cvss=None, url="http://v.example/security/advisory/2024-01-24/",
               title=None, source="vendor", key=None):
        vulns = [(sid, None, label, "page", cvss)] if sid != "none" else [(None, None, "low", "x", None)]
        return (source, "advisory", "p", key, url, None, title, [sid], seq == 2, vulns, seq)

    rows = spark.createDataFrame([
        record(1, "S-2", cvss=("3.1", None, None, "")),
        record(2, "S-1", "high", url="https://www.v.example/security/advisory/2024-01-24/#S-1"),
        record(3, "S-2", "low", (None, "v", 7.5, "u"), title="T"),
        record(4, "S-3", "low", source="other"),
        record(5, "none", key="single"),
    ], RECORD)
    out = {r["advisory_id"]: r for r in I.incident_stream(rows, "vendor", "v.example",
                                                          "www.v.example").collect()}
    merged = out["2024-01-24"]
    assert merged["merged_from_count"] == 3 and merged["title"] == "T"
    assert merged["active_security_warning"] is True
    assert merged["published_date"] == "2024-01-24"
    assert merged["security_warning_ids"] == ["S-1", "S-2"]
    first, second = merged["vulnerabilities"]
    assert (first["security_warning_id"], second["security_warning_id"]) == ("S-1", "S-2")
    assert second["severity_label"] == "low"
    assert tuple(second["cvss"]) == ("3.1", "v", 7.5, "u")
    single = out["single"]
    assert single["merged_from_count"] is None and single["vulnerabilities"] is None


def test_nested_scores_do_not_count_as_flat_scores(spark):
    nested = F.array(F.struct(F.struct(F.lit(9.0).alias("base_score")).alias("cvss")))
    assert value(spark, S.flat_record_score(F.lit(None).cast("double"), F.array(F.lit(4.0)))) == 4.0
    assert value(spark, S.nested_record_score(nested, F.lit(4.0))) == 9.0


# --- identity ---------------------------------------------------------------------------------


def test_alias_chains_and_cycles(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    edges += [("t2", "t1"), ("t1", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("z", "c")]
    df = spark.createDataFrame(edges, "alias STRING, canonical STRING")
    got = {r["alias"]: r["canonical"] for r in Y.resolve_aliases(df).collect()}
    assert all(got[f"n{i}"] == "n40" for i in range(40))
    assert got["t2"] == got["t1"] == "a" and got["z"] == "c"
    assert (got["a"], got["b"], got["c"]) == ("a", "b", "c")


def test_alias_sources_have_precedence(spark):
    rows = [("x", "snap", "snapshot", 1, 0), ("x", "reg1", "registry", 1, 0),
            ("x", "reg2", "registry", 2, 0), ("y", "f1", "file", 1, 0), ("y", "f2", "file", 2, 0),
            ("y", "r", "registry", 0, 0), ("self", "self", "registry", 0, 0)]
    df = spark.createDataFrame(rows, "alias STRING, canonical STRING, source STRING, seq INT, pos INT")
    got = {r["alias"]: r["canonical"] for r in Y.build_alias_map(df).collect()}
    assert got == {"x": "reg1", "y": "f2"}


# --- rule score -------------------------------------------------------------------------------


def test_staleness_brackets(spark):
    def points(commit, release=None):
        return value(spark, M.staleness_points(F.lit(commit).cast("double"),
                                               F.lit(release).cast("int")))

    assert [points(d) for d in (180, 181, 366, 731, 1096, 1826)] == [0, 3, 6, 9, 12, 16]
    assert points(None, 731) == 6 and points(None, 1200) == 8
    assert points(800, 731) == 9 and points(None, None) == 0


def test_health_points_round_half_to_even(spark):
    assert value(spark, M.health_points(F.lit(37.5), 25.0, 4)) == 2
    assert value(spark, M.health_points(F.lit(62.5), 25.0, 4)) == 2
    assert value(spark, M.health_points(F.lit("x"), 25.0, 4)) is None
    assert value(spark, M.history_points(F.lit(10), F.lit(1), F.lit(2))) == 30
    assert value(spark, M.sensitive_words(F.lit("Saml-Auth"))) == ["auth", "saml"]


# --- ranking ----------------------------------------------------------------------------------


def test_auc_and_average_precision_against_brute_force(spark):
    random.seed(9)
    rows = [(f"e{i % 40}", f"m{i:04d}", int(random.random() < 0.3), round(random.random(), 1))
            for i in range(400)]
    df = spark.createDataFrame(rows, "entity STRING, month STRING, y_true INT, y_prob DOUBLE")
    pos = [p for *_, y, p in rows if y]
    neg = [p for *_, y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    ap = 0.0
    for s in sorted({p for *_, p in rows}, reverse=True):
        at, above = sum(p == s for p in pos), sum(p >= s for p in pos)
        ap += at / len(pos) * above / sum(p >= s for *_, p in rows)
    q = E.ranking_quality(df).first()
    assert q["roc_auc"] == pytest.approx(auc) and q["average_precision"] == pytest.approx(ap)
    one_class = E.ranking_quality(df.where("y_true = 1")).first()
    assert one_class["roc_auc"] is None
    ranked = E.full_ranking(df).orderBy("rank").collect()
    expected = sorted(rows, key=lambda r: (-r[3], r[1], r[0]))
    assert [r["month"] for r in ranked] == [r[1] for r in expected]
    assert [r["k"] for r in E.precision_at(df, (10, 400, 500)).collect()] == [10, 400]


def test_case_study_counts_the_observation_month(spark):
    preds = spark.createDataFrame([("a", "2025-05", 0, 0.9), ("b", "2025-05", 0, 0.8)],
                                  "entity STRING, month STRING, y_true INT, y_prob DOUBLE")
    incidents = incident_rows(spark, ("a", "2025-05-03", 4.0, []), ("a", "2025-11-30", 8.0, []),
                              ("b", "2025-12-01", 9.0, []))
    rows = {r["entity"]: r for r in E.case_study(preds, incidents, "2025-05").collect()}
    assert rows["a"]["adv_cvss"] == 8.0 and rows["a"]["confirmed"] is True
    assert rows["b"]["confirmed"] is False


# --- cohort -----------------------------------------------------------------------------------


def test_odds_ratio_with_an_empty_cell(spark):
    rows = [("2024-01", True, 1)] * 3 + [("2024-01", True, 0)] * 5 + [("2024-01", False, None)] * 4
    rows += [("2025-01", None, 1)]
    df = spark.createDataFrame(rows, "month STRING, f BOOLEAN, y INT")
    got = {r["window"]: r for r in C.odds_ratios(df, {"f": F.col("f")}, "y", "2025-01").collect()}
    train = got["train"]
    assert (train["exposed_pos"], train["unexposed_neg"], train["unexposed_pos"]) == (3, 4, 0)
    assert train["odds_ratio"] == pytest.approx(round(3.5 * 4.5 / (5.5 * 0.5), 3))
    assert got["test"]["odds_ratio"] is None and got["test"]["rows_excluded_missing"] == 1
    assert got["all"]["n_rows"] == 13


# --- splits -----------------------------------------------------------------------------------


def test_splits_and_columns(spark):
    df = spark.createDataFrame(
        [("a", "2025-01", 1.0, True, "x", None, 0), ("b", "2025-06", 2.0, False, "y", None, 1)],
        "entity STRING, month STRING, swh_a DOUBLE, advisory_b BOOLEAN, c STRING, d DOUBLE, "
        "window_index INT")
    assert X.select_feature_columns(df, "y") == ["advisory_b", "swh_a"]
    assert "window_index" in X.select_feature_columns(df, "y", include_window=True)
    assert [r["split"] for r in X.split_rows(df, "time", "2025-05").orderBy("month").collect()] == [
        "train", "test"]
    with pytest.raises(ValueError):
        X.split_rows(df, "odd", "2025-05")
    embargo = X.embargo_split(df, "2025-05", cutoff="2024-12").collect()
    assert [r["split"] for r in embargo] == ["test"] and embargo[0]["matured"] == "2025-12"
