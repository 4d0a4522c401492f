"""Structured Streaming queries: arrivals of files, each taken in by a run of its own over one checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.catalogue import bindings as B
from riskpanel.catalogue import register
from riskpanel.catalogue.activity import PX
from riskpanel.session import scratch_path
from riskpanel.streaming import events as E
from riskpanel.streaming import upsert as U

CUT, DELAY_DAYS = "1998-01-01", 7
EVENTS = (
    "entity LONG, event_yyyymm STRING, event_type STRING, event_ts TIMESTAMP, event_date DATE, actor_login STRING, "
    "action STRING, pr_merged BOOLEAN, ref_type STRING, text_blob STRING, sample_percent DOUBLE, late BOOLEAN"
)


@register("activity_stream", f"""WITH {B.ACTIVITY_SQL},
src AS (SELECT l_suppkey AS entity, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_shipdate AS DATE) AS day,
  (l_orderkey + l_linenumber) % 8 AS kind_no, l_linenumber = 7 AS late, l_partkey AS part,
  CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_partkey % 10 = 0 THEN 'dependabot'
    WHEN l_partkey % 10 = 1 THEN 'Build' || CAST(l_partkey % 7 AS VARCHAR) || '[Bot]'
    ELSE 'user' || CAST(l_partkey % 50 AS VARCHAR) END AS actor FROM lineitem),
marks AS (SELECT max(day) FILTER (WHERE NOT late) - {DELAY_DAYS} AS second, max(day) - {DELAY_DAYS} AS third FROM src),
kept AS (SELECT src.* FROM src, marks WHERE (NOT late OR day + 1 > second) AND day + 1 <= third)
SELECT entity, month, count(*) AS {PX}events_total, count(*) FILTER (WHERE kind_no = 0) AS {PX}push_events,
  count(DISTINCT actor) AS {PX}unique_actors,
  count(DISTINCT actor) FILTER (WHERE part % 10 NOT IN (0, 1)) AS {PX}unique_human_actors,
  count(DISTINCT day) AS {PX}days_active FROM kept GROUP BY entity, month""")
def activity_stream(spark, sf_dir):
    """Complete days of three arrivals: two halves of the events, then late ones that the watermark has passed."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("events", "days", "progress"))
    lines = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    part = F.col("l_partkey")
    actor = (
        F.when(part % 23 == 0, F.lit(None).cast("string")).when(part % 10 == 0, "dependabot")
        .when(part % 10 == 1, F.concat(F.lit("Build"), (part % 7).cast("string"), F.lit("[Bot]")))
        .otherwise(F.concat(F.lit("user"), (part % 50).cast("string"))))
    kinds = F.array(*map(F.lit, B.MEMBER_KINDS))
    events = lines.select(
        F.col("l_suppkey").alias("entity"), F.date_format("l_shipdate", "yyyy-MM").alias("event_yyyymm"),
        F.element_at(kinds, ((F.col("l_orderkey") + F.col("l_linenumber")) % 8 + 1).cast("int")).alias("event_type"),
        F.col("l_shipdate").alias("event_ts"), F.col("l_shipdate").cast("date").alias("event_date"),
        actor.alias("actor_login"), F.lit("opened").alias("action"), F.lit(False).alias("pr_merged"),
        F.lit("branch").alias("ref_type"), F.lit("update readme").alias("text_blob"), F.lit(5.0).alias("sample_percent"),
        (F.col("l_linenumber") == 7).alias("late"))
    first, late = F.col("event_date") < F.lit(CUT).cast("date"), F.col("late")
    for arrival in (~late & first, ~late & ~first, late):
        events.where(arrival).write.mode("append").parquet(source)
        E.stream_activity(spark, source, EVENTS, target, checkpoint, f"{DELAY_DAYS} days", "parquet").awaitTermination()
    return E.landed_months(spark, target).select(
        "entity", "month", *[PX + c for c in ("events_total", "push_events", "unique_actors", "unique_human_actors", "days_active")])


@register("upsert_stream", """
SELECT repo, visit_date, seq, payload FROM (
  SELECT o_custkey AS repo, strftime(o_orderdate, '%Y-%m') AS visit_date, o_orderkey AS seq, o_totalprice AS payload,
    row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def upsert_stream(spark, sf_dir):
    """Three arrivals of visits; the second run begins with a lost checkpoint and meets the first files again."""
    source, target = scratch_path(spark, "visits"), scratch_path(spark, "table")
    visits = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo"), F.date_format("o_orderdate", "yyyy-MM").alias("visit_date"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("payload"))
    schema = "repo LONG, visit_date STRING, seq LONG, payload DOUBLE"
    kept = scratch_path(spark, "progress")
    for arrival, checkpoint in enumerate([scratch_path(spark, "progress"), kept, kept]):
        visits.where(F.col("seq") % 3 == arrival).write.mode("append").parquet(source)
        U.upsert_stream(spark, source, schema, target, checkpoint, ["repo", "visit_date"], ["seq"], "parquet", 16).awaitTermination()
    return U.read_current(spark, target, schema)
