"""Archive queries: subset joins, commit signals, flags, upserts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel import constants as K
from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import register
from riskpanel.operators import archive as R


def _text(prefix, column):
    return F.concat(F.lit(prefix), column.cast("string"))


def _statuses(spark, sf_dir):
    key = F.col("o_orderkey")
    return B.table(spark, sf_dir, "orders").select(
        _text("https://h/c", F.col("o_custkey")).alias("origin"), key.alias("visit"),
        F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"),
        F.when(key % 17 != 0, _text("s", key % 997)).alias("snapshot"))


def _urls(spark, sf_dir):
    """Repositories of interest; the archive also holds the ones of another segment."""
    customers = B.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "HOUSEHOLD")
    return customers.select(_text("https://h/c", F.col("c_custkey")).alias("url"))


def _branches(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").select(
        _text("s", F.col("l_orderkey") % 1500).alias("snapshot_id"),
        _text("r", F.col("l_partkey")).alias("target"),
        F.when(F.col("l_linestatus") == "F", "revision").otherwise("release").alias("target_type"))


def _revisions(spark, sf_dir):
    key = F.col("p_partkey")
    return B.table(spark, sf_dir, "part").select(
        _text("r", key).alias("id"),
        F.when(key % 19 != 0, _text("d", key % 800)).alias("directory"))


_NAMES = sorted({n for names in K.DIRECTORY_FLAG_NAMES.values() for n in names[:1]}) + [
    " LICENSE ", "Docs"]


def _entries(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _NAMES])
    return B.table(spark, sf_dir, "lineitem").select(
        _text("d", F.col("l_orderkey") % 1000).alias("directory_id"),
        F.element_at(names, (F.col("l_partkey") % len(_NAMES) + 1).cast("int")).cast("binary")
        .alias("name"), F.lit("file").alias("type"))


_RANGE = ("1996-01-01 00:00:00", "2000-10-01 00:00:00")
_GRAPH = f"""WITH urls AS (SELECT 'https://h/c' || CAST(c_custkey AS VARCHAR) AS origin FROM customer
                           WHERE c_mktsegment <> 'HOUSEHOLD'),
ovs AS (SELECT 'https://h/c' || CAST(o_custkey AS VARCHAR) AS origin, o_orderkey AS visit,
          o_orderdate AS visit_date, CASE WHEN o_orderkey % 17 <> 0 THEN
          's' || CAST(o_orderkey % 997 AS VARCHAR) END AS snapshot_id FROM orders),
visits AS (SELECT ovs.* FROM ovs JOIN urls ON ovs.origin = urls.origin
  WHERE visit_date >= TIMESTAMP '{_RANGE[0]}' AND visit_date < TIMESTAMP '{_RANGE[1]}'
    AND snapshot_id IS NOT NULL),
branches AS (SELECT 's' || CAST(l_orderkey % 1500 AS VARCHAR) AS snapshot_id,
  'r' || CAST(l_partkey AS VARCHAR) AS target FROM lineitem WHERE l_linestatus = 'F'),
sb AS (SELECT DISTINCT b.* FROM branches b JOIN visits v ON v.snapshot_id = b.snapshot_id),
revisions AS (SELECT 'r' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 19 <> 0 THEN
  'd' || CAST(p_partkey % 800 AS VARCHAR) END AS directory FROM part),
entries AS (SELECT 'd' || CAST(l_orderkey % 1000 AS VARCHAR) AS directory_id,
  [{', '.join(f"'{n}'" for n in _NAMES)}][CAST(l_partkey % {len(_NAMES)} + 1 AS INT)] AS entry_name
  FROM lineitem),
roots AS (SELECT DISTINCT sb.snapshot_id, r.directory FROM sb JOIN revisions r ON r.id = sb.target
          WHERE r.directory IS NOT NULL)
"""


def _subset(spark, sf_dir):
    visits = R.visits_of(_statuses(spark, sf_dir), _urls(spark, sf_dir), *_RANGE)
    return visits, R.branches_of(_branches(spark, sf_dir), visits)


@register("latest_per_month", f"""{_GRAPH}
SELECT origin, visit, visit_date, snapshot_id FROM (
  SELECT *, row_number() OVER (PARTITION BY origin, year(visit_date), month(visit_date)
                               ORDER BY visit_date DESC, visit DESC) AS rn FROM visits)
WHERE rn = 1""")
def latest_per_month(spark, sf_dir):
    return R.latest_per_month(_subset(spark, sf_dir)[0])


@register("latest_visits", f"""{_GRAPH}
SELECT origin, visit, visit_date, snapshot_id, rn AS visit_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY origin ORDER BY visit_date DESC, visit DESC) AS rn
  FROM visits) WHERE rn <= 3""")
def latest_visits(spark, sf_dir):
    return B.rounded(R.latest_visits(_subset(spark, sf_dir)[0], 3))


@register("subset_semi_join", f"{_GRAPH} SELECT snapshot_id, target FROM sb")
def subset_semi_join(spark, sf_dir):
    return _subset(spark, sf_dir)[1]


@register("multi_hop_join", f"""{_GRAPH}
SELECT DISTINCT e.directory_id, e.entry_name, 'file' AS type
FROM entries e JOIN roots ON e.directory_id = roots.directory""")
def multi_hop_join(spark, sf_dir):
    _, branches = _subset(spark, sf_dir)
    return R.entries_of(_entries(spark, sf_dir), branches, _revisions(spark, sf_dir))


@register("revision_slim", f"""{_GRAPH}
SELECT DISTINCT r.id, r.directory FROM revisions r JOIN sb ON sb.target = r.id""")
def revision_slim(spark, sf_dir):
    return R.revisions_of(_revisions(spark, sf_dir), _subset(spark, sf_dir)[1])


_FLAG_SQL = ", ".join(
    f"bool_or(n IN ({', '.join(repr(x) for x in names)})) AS {flag}"
    for flag, names in K.DIRECTORY_FLAG_NAMES.items()
)


@register("name_flags", f"""{_GRAPH}
SELECT snapshot_id, {_FLAG_SQL}, count(DISTINCT n) AS top_level_entry_count
FROM (SELECT roots.snapshot_id, lower(trim(entry_name)) AS n
      FROM roots JOIN entries e ON e.directory_id = roots.directory)
GROUP BY snapshot_id""")
def name_flags(spark, sf_dir):
    _, branches = _subset(spark, sf_dir)
    revisions, entries = _revisions(spark, sf_dir), _entries(spark, sf_dir)
    kept = R.entries_of(entries, branches, revisions)
    return B.rounded(R.name_flags(R.snapshot_entries(kept, branches, revisions)))


_MESSAGES = ("Merge pull request", "fix(core): null check #12", "wip", "  ", "feat!: add flag",
             "Fix CVE-2021 issue", "mergeable state", "Source cleanup", "-", "chore: bump #7")


def _meta(spark, sf_dir):
    """One commit per order line, grouped by supplier as the snapshot."""
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    author = F.timestamp_add("HOUR", (order % 24).cast("int"), F.col("o_orderdate"))
    tz = ((part % 27 - 13) * 30).cast("int")
    texts = F.array(*[F.lit(m) for m in _MESSAGES])
    return rows.select(
        _text("s", F.col("l_suppkey")).alias("snapshot_id"),
        F.when(order % 29 != 0, author).alias("author_date"),
        F.timestamp_add("HOUR", (part % 100 - 10).cast("int"), author).alias("committer_date"),
        F.when(part % 31 != 0, tz).alias("author_tz_offset_minutes"),
        F.when(order % 3 == 0, tz).otherwise(F.lit(0)).alias("committer_tz_offset_minutes"),
        F.element_at(texts, (order % len(_MESSAGES) + 1).cast("int")).alias("commit_message"))


_META = f"""WITH base AS (
  SELECT 's' || CAST(l_suppkey AS VARCHAR) AS snapshot_id, l_orderkey AS o, l_partkey AS p,
    o_orderdate + to_hours(CAST(l_orderkey % 24 AS INT)) AS a,
    [{', '.join(f"'{m}'" for m in _MESSAGES)}][CAST(l_orderkey % {len(_MESSAGES)} + 1 AS INT)] AS m
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
meta AS (
  SELECT snapshot_id, CASE WHEN o % 29 <> 0 THEN a END AS author,
    a + to_hours(CAST(p % 100 - 10 AS INT)) AS committer,
    CASE WHEN p % 31 <> 0 THEN (p % 27 - 13) * 30 END AS tz,
    CASE WHEN o % 3 = 0 THEN (p % 27 - 13) * 30 ELSE 0 END AS tz2, trim(m) AS m FROM base)"""
_COMMIT_HIT = "(" + " OR ".join(f"contains(lower(m), '{w}')" for w in K.COMMIT_SECURITY_KEYWORDS) + ")"


def _share(condition: str, name: str, of: str = "count(*)") -> str:
    return f"round_even(count(*) FILTER (WHERE {condition}) / CAST({of} AS DOUBLE), 4) AS {name}"


@register("commit_signals", f"""{_META}
SELECT snapshot_id, count(*) AS commit_count, max(author) AS last_author_date,
  count(DISTINCT tz) AS timezone_diversity,
  count(*) FILTER (WHERE {_COMMIT_HIT}) AS security_fix_commit_count,
  {_share("isodow(author) >= 6", "weekend_commit_fraction", "count(author)")},
  {_share("regexp_matches(m, '(?i)^merge' || chr(92) || 'b')", "merge_commit_fraction")},
  {_share("regexp_matches(m, '(?i)^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)([(].+?[)])?!?:')", "conventional_commit_fraction")},
  {_share("regexp_matches(m, '#[0-9]+')", "issue_reference_rate")},
  {_share("m IN ('', '.', '-', 'wip')", "empty_message_rate")},
  {_share("tz <> tz2", "author_committer_mismatch_rate")},
  {_share("(hour(author) + CAST(floor(COALESCE(tz, 0) / 60.0) AS BIGINT) + 48) % 24 < 4", "late_night_commit_fraction", "count(author)")},
  round_even(quantile_cont(date_diff('second', author, committer) / 3600.0::DOUBLE, 0.5)
    FILTER (WHERE committer >= author), 2) AS author_committer_lag_p50_hours,
  round_even(quantile_cont(date_diff('second', author, committer) / 3600.0::DOUBLE, 0.9)
    FILTER (WHERE committer >= author), 2) AS author_committer_lag_p90_hours
FROM meta GROUP BY snapshot_id""")
def commit_signals(spark, sf_dir):
    return R.commit_signals(_meta(spark, sf_dir))


@register("visit_upsert", """
WITH both_sides AS (
  SELECT o_custkey AS repo, strftime(o_orderdate, '%Y-%m-%d') AS visit_date, o_orderkey AS seq,
         o_totalprice AS payload, 0 AS is_new FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL
  SELECT o_custkey % 700, strftime(o_orderdate, '%Y-%m-%d'), o_orderkey, o_totalprice, 1
  FROM orders WHERE o_orderkey % 2 = 1)
SELECT repo, visit_date, seq, payload FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, visit_date ORDER BY is_new DESC, seq DESC) AS rn
  FROM both_sides) WHERE rn = 1""")
def visit_upsert(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo"), F.date_format("o_orderdate", "yyyy-MM-dd")
        .alias("visit_date"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("payload"))
    old = orders.where(F.col("seq") % 2 == 0)
    new = orders.where(F.col("seq") % 2 == 1).withColumn("repo", F.col("repo") % 700)
    return R.upsert(old, new, ["repo", "visit_date"], "seq")


@register("dedup_keep_first", """
SELECT entity, incident_id, seq, published FROM (
  SELECT o_custkey AS entity, 'I' || strftime(o_orderdate, '%Y-%m') AS incident_id,
    o_orderkey AS seq, CAST(o_orderdate AS DATE) AS published,
    row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m')
                       ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedup_keep_first(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.concat(F.lit("I"), F.date_format("o_orderdate", "yyyy-MM")).alias("incident_id"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("date").alias("published"))
    return R.keep_first(rows, ["entity", "incident_id"], "seq")


@register("visit_profile", f"""WITH {B.CUSTOMER_VISITS_SQL},
b AS (SELECT entity, count(*) AS n, min(visit_day) AS f, max(visit_day) AS l,
             arg_max(visits, (visit_day, visit)) AS v FROM visits GROUP BY entity)
SELECT b.entity, TRUE AS swh_present, n AS swh_visit_count, f AS swh_first_visit_date,
  l AS swh_latest_visit_date, date_diff('day', f, l) AS swh_archive_age_days,
  (SELECT count(*) FROM visits x WHERE x.entity = b.entity
     AND date_diff('day', x.visit_day, b.l) <= 365) AS swh_visits_last_365d,
  v.has_readme AS swh_has_readme, v.has_dependabot AS swh_has_dependabot,
  CAST(v.commit_count AS BIGINT) AS swh_commit_count,
  v.days_since_last_commit AS swh_days_since_last_commit
FROM b""")
def visit_profile(spark, sf_dir):
    profile = R.visit_profile(B.customer_visits(spark, sf_dir))
    return B.rounded(profile.select(
        "entity", "swh_present", "swh_visit_count", "swh_first_visit_date",
        "swh_latest_visit_date", "swh_archive_age_days", "swh_visits_last_365d",
        "swh_has_readme", "swh_has_dependabot", "swh_commit_count", "swh_days_since_last_commit"))


@register("assembled_visits", f"""{_GRAPH}, flags AS (
  SELECT snapshot_id, bool_or(n = 'jenkinsfile') AS has_jenkinsfile,
         count(DISTINCT n) AS top_level_entry_count
  FROM (SELECT roots.snapshot_id, lower(trim(entry_name)) AS n
        FROM roots JOIN entries e ON e.directory_id = roots.directory) GROUP BY snapshot_id),
commits AS (SELECT 's' || CAST(l_orderkey % 1500 AS VARCHAR) AS snapshot_id, count(*) AS n,
    max(l_shipdate) AS last_commit FROM lineitem GROUP BY 1),
seen AS (SELECT snapshot_id, max(visit_date) AS at FROM visits GROUP BY 1)
SELECT v.origin, v.visit, COALESCE(has_jenkinsfile, FALSE) AS has_jenkinsfile,
  COALESCE(top_level_entry_count, 0) AS top_level_entry_count, COALESCE(c.n, 0) AS commit_count,
  CASE WHEN c.last_commit IS NOT NULL THEN
    CAST(greatest(0, date_diff('day', c.last_commit, s.at)) AS DOUBLE) END AS days_since_last_commit
FROM visits v LEFT JOIN flags f ON f.snapshot_id = v.snapshot_id
LEFT JOIN commits c ON c.snapshot_id = v.snapshot_id JOIN seen s ON s.snapshot_id = v.snapshot_id""")
def assembled_visits(spark, sf_dir):
    visits, branches = _subset(spark, sf_dir)
    revisions, entries = _revisions(spark, sf_dir), _entries(spark, sf_dir)
    kept = R.entries_of(entries, branches, revisions)
    flags = R.name_flags(R.snapshot_entries(kept, branches, revisions))
    meta = B.table(spark, sf_dir, "lineitem").select(
        _text("s", F.col("l_orderkey") % 1500).alias("snapshot_id"),
        F.col("l_shipdate").alias("author_date"), F.col("l_shipdate").alias("committer_date"),
        F.lit(0).alias("author_tz_offset_minutes"), F.lit(0).alias("committer_tz_offset_minutes"),
        F.lit("x").alias("commit_message"))
    rows = R.assemble_visits(visits, flags, R.commit_signals(meta))
    return B.rounded(rows.select("origin", "visit", "has_jenkinsfile", "top_level_entry_count",
                                 "commit_count", "days_since_last_commit"))


@register("api_visit_profile", """
WITH v AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k
           FROM orders WHERE o_orderstatus = 'P'),
b AS (SELECT entity, count(*) AS n, min(d) AS f, max(d) AS l, max(k) AS k FROM v GROUP BY entity)
SELECT entity, n AS swh_visit_count, f AS swh_first_visit_date,
  CASE WHEN entity % 2 = 0 THEN DATE '2002-01-01' ELSE l END AS swh_latest_visit_date,
  CASE WHEN entity % 2 = 0 THEN 'full' END AS swh_latest_visit_status,
  date_diff('day', f, l) AS swh_archive_age_days,
  (SELECT count(*) FROM v x WHERE x.entity = b.entity AND date_diff('day', x.d, b.l) <= 365)
    AS swh_visits_last_365d,
  CASE WHEN entity % 3 = 0 THEN least(n, 2) ELSE 1 END AS swh_snapshot_branch_count,
  entity % 5 = 0 AS swh_origin_found, TRUE AS swh_has_snapshot
FROM b""")
def api_visit_profile(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    entity = F.col("o_custkey").alias("entity")
    item = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
                              F.col("o_orderkey").alias("visit")))
    listed = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"results":['), item, F.lit("]}")))
    documents = orders.select(entity, listed.otherwise(F.concat(F.lit("["), item, F.lit("]")))
                              .alias("payload"))
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    index = per.select(entity, (F.col("o_custkey") % 5 == 0).alias("origin_found"),
                       F.lit(False).alias("snapshot_found"))
    latest = per.where(F.col("o_custkey") % 2 == 0).select(entity, F.lit(
        '{"visit":{"status":"full","date":"2002-01-01T00:00:00Z","type":"git"}}').alias("payload"))
    two = F.when(F.col("n") > 1, '{"branches":{"a":1,"b":2}}').otherwise('{"branches":{"a":1}}')
    snapshots = per.select(entity, F.when(F.col("o_custkey") % 3 == 0, two)
                           .otherwise('{"branches":["x"]}').alias("payload"))
    profile = R.api_profile(index, R.api_visits(documents), latest, snapshots)
    return B.rounded(profile.drop("swh_present", "swh_latest_visit_type"))


@register("yearly_coverage", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n_rows,
       count(DISTINCT o_custkey) AS n_entities FROM orders GROUP BY 1""")
def yearly_coverage(spark, sf_dir):
    return B.rounded(R.yearly_coverage(B.table(spark, sf_dir, "orders"), "o_orderdate", "o_custkey"))


def _revision_log(spark, sf_dir):
    """The revision table with its commit dates, offsets and messages."""
    key = F.col("p_partkey")
    date = F.timestamp_add("HOUR", (key * 37 % 40_000).cast("int"), F.lit("1995-01-01 00:00:00").cast("timestamp"))
    tz = ((key % 27 - 13) * 30).cast("smallint")
    texts = F.array(*[F.lit(m) for m in _MESSAGES])
    return B.table(spark, sf_dir, "part").select(
        _text("r", key).alias("id"), F.when(key % 19 != 0, _text("d", key % 800)).alias("directory"),
        F.when(key % 29 != 0, date).alias("date"),
        F.timestamp_add("HOUR", (key % 100 - 10).cast("int"), date).alias("committer_date"),
        F.when(key % 31 != 0, tz).alias("date_offset"),
        F.when(key % 3 == 0, tz).otherwise(F.lit(0).cast("smallint")).alias("committer_offset"),
        F.element_at(texts, (key % len(_MESSAGES) + 1).cast("int")).cast("binary").alias("message"))


@register("graph_visits", f"""{_GRAPH},
flags AS (
  SELECT snapshot_id, bool_or(n = 'jenkinsfile') AS has_jenkinsfile, count(DISTINCT n) AS top_level_entry_count
  FROM (SELECT roots.snapshot_id, lower(trim(entry_name)) AS n
        FROM roots JOIN entries e ON e.directory_id = roots.directory) GROUP BY snapshot_id),
log AS (
  SELECT 'r' || CAST(p_partkey AS VARCHAR) AS id, p_partkey AS p,
    TIMESTAMP '1995-01-01' + to_hours(CAST(p_partkey * 37 % 40000 AS INT)) AS a,
    [{', '.join(f"'{m}'" for m in _MESSAGES)}][CAST(p_partkey % {len(_MESSAGES)} + 1 AS INT)] AS m FROM part),
meta AS (
  SELECT sb.snapshot_id, CASE WHEN p % 29 <> 0 THEN a END AS author, a + to_hours(CAST(p % 100 - 10 AS INT)) AS committer,
    CASE WHEN p % 31 <> 0 THEN (p % 27 - 13) * 30 END AS tz, CASE WHEN p % 3 = 0 THEN (p % 27 - 13) * 30 ELSE 0 END AS tz2,
    trim(m) AS m FROM sb JOIN log ON log.id = sb.target),
signals AS (
  SELECT snapshot_id, count(*) AS commit_count, max(author) AS last_author, count(DISTINCT tz) AS timezone_diversity,
    count(*) FILTER (WHERE {_COMMIT_HIT}) AS security_fix_commit_count,
    {_share("isodow(author) >= 6", "weekend_commit_fraction", "NULLIF(count(author), 0)")},
    {_share("tz <> tz2", "author_committer_mismatch_rate")},
    round_even(quantile_cont(date_diff('second', author, committer) / 3600.0::DOUBLE, 0.5)
      FILTER (WHERE committer >= author), 2) AS author_committer_lag_p50_hours
  FROM meta GROUP BY snapshot_id),
seen AS (SELECT snapshot_id, max(visit_date) AS at FROM visits GROUP BY 1)
SELECT v.origin, v.visit, COALESCE(has_jenkinsfile, FALSE) AS has_jenkinsfile,
  COALESCE(top_level_entry_count, 0) AS top_level_entry_count, COALESCE(commit_count, 0) AS commit_count,
  COALESCE(timezone_diversity, 0) AS timezone_diversity,
  COALESCE(security_fix_commit_count, 0) AS security_fix_commit_count, weekend_commit_fraction,
  author_committer_mismatch_rate, author_committer_lag_p50_hours,
  CASE WHEN last_author IS NOT NULL THEN
    round_even(greatest(0.0::DOUBLE, (epoch_us(s.at) - epoch_us(last_author)) / 8.64e10::DOUBLE), 1) END AS days_since_last_commit
FROM visits v LEFT JOIN flags f ON f.snapshot_id = v.snapshot_id LEFT JOIN signals g ON g.snapshot_id = v.snapshot_id
JOIN seen s ON s.snapshot_id = v.snapshot_id""")
def graph_visits(spark, sf_dir):
    """Visits with everything derived from the graph tables; a snapshot is measured once, at its latest visit."""
    visits, branches = _subset(spark, sf_dir)
    rows = R.visits_of_graph(visits, branches, _revision_log(spark, sf_dir), _entries(spark, sf_dir))
    return B.rounded(rows.select(
        "origin", "visit", "has_jenkinsfile", "top_level_entry_count", "commit_count", "timezone_diversity",
        "security_fix_commit_count", "weekend_commit_fraction", "author_committer_mismatch_rate",
        "author_committer_lag_p50_hours", "days_since_last_commit"))
